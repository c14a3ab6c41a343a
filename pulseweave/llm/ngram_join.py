"""Operator 4: n-gram Jaccard join.

Prefix filtering over sets of distinct word shingles.  All shingles of the
corpus are counted in a sketch of fixed size; a text's shingles are ordered
rare first by that sketch (any fixed order is right, a rare-first one is
fast).  Two texts that reach the threshold share a shingle in their prefixes,
so only prefixes are joined.  Candidates pass the length and positional
filters, are made distinct, pass the suffix filter on small signatures, and
only then are their whole sets brought together and compared, once per pair.

The suffix filter is a lower bound of the Hamming distance: bit k of a
signature is the parity of the number of a set's shingles in hash range k, so
two sets differ in at least as many shingles as their signatures do in bits.

What is asked for are the groups, so the join does not enumerate a group of
near copies.  Texts with equal sets are one node, and only nodes are joined.
The lists of nodes by prefix shingle are used up in two steps:

1. Short lists are compared pair by pair; in long ones every node is held
   against PIVOTS nodes of the list.  Linked nodes get one label.
2. Long lists whose nodes still have several labels go to the home of the list,
   one node of it, so that lists with the same members meet.  There the nodes
   are split into bands by set size (the length filter) and blocks of bounded
   size, and pairs of blocks are compared inside tasks: only pairs with
   different labels, only at the home of their first common prefix shingle.
   Blocks of a band's commonest label are not held against each other.  At
   first only signatures are there, for the suffix filter; whole sets follow
   for the nodes that have a pair left.  A task returns only the links that
   join labels.

So every pair that shares a prefix shingle either has one label or was
compared, and no step makes rows for the pairs of a group.  The work of step 2
grows with the nodes of a long list that the pivots did not join; these grow
faster than the texts, since lists become long, but most of them meet no node
that is near.

Sets are told apart by 128-bit digests and their sizes, shingles by 64-bit
hashes.  A null text, or one without words, has an empty set and links
with nothing.  Texts of fewer words than a shingle have their whole sequence as
one shingle.  Repeated rows are members of one group like other copies; rows
that share an id keep a row each.  Rows without an id take part like others; a
group in which no row has an id has a null component.  An empty table gives an
empty table.  Columns besides id and text play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch, small_batches
from .textgrams import mix64, shingle_sets

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
WIDTH = 5
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Lists of up to this many nodes are compared pair by pair; longer ones have so many pivots.
SHORT, PIVOTS = 8, 4
#: A block has about so many nodes and shingles.
BLOCK_NODES, BLOCK_SHINGLES = 128, 1 << 17
#: Node ids are broadcast to the sets while they take up to so many bytes, and both are shuffled beyond.
BROADCAST_BYTES = 16 << 20
SIGNATURE_BITS = (128, 8192)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits for a set of shingles."""
    one = np.add.reduce(mix64(shingles), dtype=np.uint64)
    two = np.add.reduce(mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the set's counts in hash ranges, for the suffix filter; wider for larger sets."""
    bits = min(max(1 << (2 * len(shingles) - 1).bit_length(), SIGNATURE_BITS[0]), SIGNATURE_BITS[1])
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text of a column."""
    for _, shingles, ends in shingle_sets(column, width):
        a = 0
        for b in ends.tolist():
            yield shingles[a:b]
            a = b


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _squeeze(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + counts[at].astype("<i8").tobytes(), 1)


def _stretch(raw: bytes, size: int) -> np.ndarray:
    data = zlib.decompress(raw)
    n, out = len(data) // 12, np.zeros(size, dtype=np.int64)
    out[np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)] = np.frombuffer(data, "<i8", n, 4 * n)
    return out


_PROFILE = "doc_id long, n long, own long, first boolean, digest binary, signature binary, shingles binary, block int, counts binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in _PROFILE.split(", ")]


def profile(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: a row for each document, with its set where the task sees it first, and the sketch of all shingles.

    ``own`` numbers a task's distinct sets, apart from those of all other tasks.
    The second result ranks the cells of the sketch by count.
    """
    size, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        counts, seen, held, many = np.zeros(size, dtype=np.int64), {}, [], 0
        for batch in batches:
            ids, rows, weight = batch.column(0).to_pylist(), [], 0
            for doc_id, s in zip(ids, _sets(batch.column(1), width), strict=True):
                key = digest(s) if len(s) else None
                first = key is not None and key not in seen
                if first:
                    seen[key] = (task << 36) + len(seen)
                rows.append((doc_id, len(s), seen.get(key), first, key if first else None, signature(s) if first else None, s.tobytes() if first else None, None, None))
                held.append((s >> shift).astype(np.int64))
                many += len(s)
                weight += 8 * len(s) if first else 0
                if many >= size:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, many = [], 0
                if weight >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        if counts.any():
            blocks = [[None, task % 64, *[None] * 5, b, _squeeze(c)] for b, c in enumerate(np.split(counts, SKETCH_BLOCKS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), _TYPES, strict=True)], _NAMES)

    both = scratch.save(docs.mapInArrow(run, _PROFILE), "profile")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = _stretch(c, part)
                held[b] = held[b] + got if b in held else got
        for b, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_squeeze(c)])], ["block", "counts"])

    parts = both.where(F.col("block").isNotNull()).select("block", F.col("n").alias("salt"), "counts")
    parts = parts.repartition(4 * SKETCH_BLOCKS, "block", "salt").select("block", "counts").mapInArrow(add, "block int, counts binary")
    parts = parts.repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect()  # a table of fixed size
    sketch = np.zeros((SKETCH_BLOCKS, part), dtype=np.int64)
    for b, c in parts:
        sketch[b] = _stretch(bytes(c), part)
    rank = np.empty(size, dtype=np.int64)
    rank[np.argsort(sketch.reshape(-1), kind="stable")] = np.arange(size)
    return both.where(F.col("block").isNull()), (rank >> max(SKETCH_BITS - 16, 0)).astype(np.uint16)


def _rare_first(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of a set's shingles by cell rank, then hash."""
    return np.argsort(rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")


def _prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def prefixes(sets: DataFrame, rank: np.ndarray) -> DataFrame:
    """token, node, at: the prefix shingles of every set; ``at`` packs the set's size and the place in rare-first order."""
    shared = sets.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node, at, held = [], [], [], 0
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                n, p = len(s), _prefix_length(len(s))
                token.append(s[_rare_first(s, shared.value)[:p]].view(np.int64))
                node.append(np.full(p, own, dtype=np.int64))
                at.append((n << 32) + np.arange(p, dtype=np.int64))
                held += p
                if held >= 1 << 17:
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in (token, node, at)], ["token", "node", "at"])
                    token, node, at, held = [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in (token, node, at)], ["token", "node", "at"])

    return sets.select("node", "shingles").mapInArrow(run, "token long, node long, at long")


def _passes(x: str, y: str) -> Column:
    """Length and positional filter for two packed places of one shared shingle."""
    nx, ny = F.shiftright(x, 32), F.shiftright(y, 32)
    rest = F.least(nx - F.expr(f"{x} & 4294967295"), ny - F.expr(f"{y} & 4294967295"))
    need = F.ceil((nx + ny) * NUMERATOR / F.lit(float(NUMERATOR + DENOMINATOR)) - F.lit(1e-9))
    return (F.least(nx, ny) * DENOMINATOR >= F.greatest(nx, ny) * NUMERATOR) & (rest >= need)


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def suffix_filter(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule out the threshold."""
    left = signatures.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            near = [(NUMERATOR + DENOMINATOR) * apart(sa, sb) <= (DENOMINATOR - NUMERATOR) * (na + nb) for na, sa, nb, sb in zip(c["na"], c["sa"], c["nb"], c["sb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                linked.append((NUMERATOR + DENOMINATOR) * _common(x, y) >= NUMERATOR * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _bits(rows: np.ndarray, ids: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A matrix of bits, 64 to a word: bit ``ids`` of row ``rows``."""
    out = np.zeros((shape[0], max(1, -(-shape[1] // 64))), dtype=np.uint64)
    np.bitwise_or.at(out, (rows, ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
    return out


def _folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of words, folded to the narrowest of them."""
    words = min(map(len, signatures)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, words), axis=0) for v in signatures])


def undecided(n: np.ndarray, core: np.ndarray, block: np.ndarray, label: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """The nodes of two blocks (of one, if there is only one) that have a pair to compare: neither its sizes nor its signatures rule it out."""
    one, bits, out = len(np.unique(block)) == 1, _folded(signatures), np.zeros(len(n), dtype=bool)
    for i in range(len(n)):
        j = np.arange(i + 1, len(n))
        j = j[(core[j] | core[i]) & (label[j] != label[i]) & (np.minimum(n[j], n[i]) * DENOMINATOR >= np.maximum(n[j], n[i]) * NUMERATOR)]
        if not one:
            j = j[block[j] != block[i]]
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[(NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n[j] + n[i])]
        out[j] = True
        out[i] |= len(j) > 0
    return np.flatnonzero(out)


def compare_blocks(sets: list[np.ndarray], core: np.ndarray, block: np.ndarray, label: np.ndarray, home_tokens: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """Links between nodes of two blocks (of one, if there is only one) that join different labels, as places in the lists.

    A pair is taken if one of it is in the core band, its labels are not joined
    yet, and its first common prefix shingle is one of ``home_tokens``.
    """
    n, one = np.array([len(s) for s in sets]), len(np.unique(block)) == 1
    rows = np.repeat(np.arange(len(sets)), n)
    tokens, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts > 1)
    order = again[np.lexsort((tokens[again], rank[(tokens[again] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))]
    number = np.full(len(tokens), -1)
    number[order] = np.arange(len(order))
    ids = number[ids]
    bits = _bits(rows[ids >= 0], ids[ids >= 0], (len(sets), len(order)))
    held = np.bincount(rows[ids >= 0], minlength=len(sets))
    # prefixes: the rare-first order of a set is the order of the numbers, with shingles of no one else in between
    pre_rows, pre_ids, pre_at, a = [], [], [], 0
    for i, s in enumerate(sets):
        own = ids[a : a + len(s)][_rare_first(s, rank)[: _prefix_length(len(s))]]
        at = np.flatnonzero(own >= 0)
        pre_rows.append(np.full(len(at), i))
        pre_ids.append(own[at])
        pre_at.append(at)
        a += len(s)
    pre_rows, pre_ids, pre_at = (np.concatenate(x) for x in (pre_rows, pre_ids, pre_at))
    pre = _bits(pre_rows, pre_ids, (len(sets), len(order)))
    place = pre_rows * max(1, len(order)) + pre_ids  # rising
    here = np.zeros(len(order) + 1, dtype=bool)
    here[: len(order)] = np.isin(tokens[order], home_tokens)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    now, out = label.copy(), []
    for i in range(len(sets)):
        j = np.arange(i + 1, len(sets))
        j = j[(core[j] | core[i]) & (now[j] != now[i]) & (np.minimum(n[j], n[i]) * DENOMINATOR >= np.maximum(n[j], n[i]) * NUMERATOR)]
        if not one:
            j = j[block[j] != block[i]]
        need = -(-(n[j] + n[i]) * NUMERATOR // (NUMERATOR + DENOMINATOR))
        near = np.minimum(held[j], held[i]) >= need
        j, need = j[near], need[near]
        if not len(j):
            continue
        both = pre[j] & pre[i]
        word = np.argmax(both != 0, axis=1)
        low = both[np.arange(len(j)), word]
        some = np.flatnonzero(low)
        j, need, low, word = j[some], need[some], low[some], word[some]
        first = word * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        at_i = pre_at[np.searchsorted(place, i * max(1, len(order)) + first)]
        at_j = pre_at[np.searchsorted(place, j * max(1, len(order)) + first)]
        near = here[first] & (np.minimum(n[i] - at_i, n[j] - at_j) >= need)
        j, need = j[near], need[near]
        if not len(j):
            continue
        for k in j[np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64) >= need].tolist():
            x, y = root(int(label[i])), root(int(label[k]))
            if x != y:
                out.append((i, k))
                parent[max(x, y)] = min(x, y)
                now[now == max(x, y)] = min(x, y)
    return out


def _homes(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """home, node, label, n, tokens: the nodes of long lists that still have several labels, by the home of the list."""
    live = lists.join(labels, "node", "left").select("token", "node", F.shiftright("at", 32).alias("n"), F.coalesce("label", "node").alias("label"))
    live = scratch.save(live, "live")
    open_ = live.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("node", F.xxhash64("node")).alias("home"))
    open_ = scratch.save(open_.where(F.col("low") != F.col("high")).select("token", "home"), "open")
    return scratch.save(live.join(open_, "token").groupBy("home", "node", "label", "n").agg(F.collect_set("token").alias("tokens")), "homes")


def _place(homes: DataFrame, scratch: Scratch) -> DataFrame:
    """A row of ``homes`` for each pair of blocks (band, p, q) that it is compared in."""
    band = F.floor(F.log("n") / F.lit(math.log(DENOMINATOR / NUMERATOR)) - F.lit(1e-9)).cast("int")
    spread = homes.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("core", F.col("own") == F.col("band")).drop("own")
    sums = spread.groupBy("home", "band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max("core").alias("core"))
    sums = sums.groupBy("home", "band").agg(
        F.max_by("label", F.struct("c", "label")).alias("bulk"), F.max_by("c", F.struct("c", "label")).alias("bulk_c"), F.max_by("s", F.struct("c", "label")).alias("bulk_s"),
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("core").alias("core"), F.count("*").alias("labels"),
    )

    def blocks(c: Column, s: Column) -> Column:
        return F.greatest(F.ceil(c / BLOCK_NODES), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")

    sums = sums.where("core and labels > 1").select("home", "band", "bulk", blocks(F.col("bulk_c"), F.col("bulk_s")).alias("bulks"), blocks(F.col("c") - F.col("bulk_c"), F.col("s") - F.col("bulk_s")).alias("rests"))
    placed = spread.join(scratch.save(sums, "bands"), ["home", "band"])
    in_bulk = F.col("label") == F.col("bulk")
    hashed = F.xxhash64("node", F.lit(1))
    placed = placed.withColumn("block", F.when(in_bulk, F.pmod(hashed, F.col("bulks"))).otherwise(F.col("bulks") + F.pmod(hashed, F.col("rests"))).cast("int"))
    last = F.col("bulks") + F.col("rests") - 1
    other = F.explode(F.when(in_bulk, F.sequence("bulks", last)).otherwise(F.sequence(F.lit(0), last)))
    placed = placed.withColumn("other", other)
    return placed.select("home", "band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "label", "n", "core", "tokens")


@dataclass
class Joined:
    """documents: doc_id, n_shingles, component_id; members: doc_id, node; links: a, b, links between nodes that join every group."""

    documents: DataFrame
    members: DataFrame
    links: DataFrame


def join(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> Joined:
    """Groups the rows of ``docs`` by similarity of their texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    with small_batches(spark):
        return _join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), scratch, width)


def _join(docs: DataFrame, scratch: Scratch, width: int) -> Joined:
    def small(df: DataFrame, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df

    rows, rank = profile(docs, scratch, width)

    # sets that several tasks have seen belong to the one of the least number
    firsts = rows.where("first").select("digest", "n", "own")
    owners = scratch.save(firsts.groupBy("digest", "n").agg(F.min("own").alias("node"), F.count("*").alias("times")).where("times > 1"), "owners")
    others = scratch.save(firsts.join(owners, ["digest", "n"]).where(F.col("own") != F.col("node")).select("own", "node"), "others")
    others = small(others, 16)
    members = rows.select("doc_id", "n", "own").join(others, "own", "left").select("doc_id", "n", F.coalesce("node", "own").alias("node"))
    members = scratch.save(members, "members")
    classes = scratch.save(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    sets = rows.where("first").select(F.col("own").alias("node"), "n", "signature", "shingles").join(others.select(F.col("own").alias("node")), "node", "left_anti")

    def of(nodes: DataFrame, what: str, name: str) -> DataFrame:
        """node and its shingles or signature, of some nodes."""
        return scratch.save(sets.select("node", what).join(small(nodes, 8), "node", "left_semi"), name)

    # prefix shingles that several nodes share
    posts = prefixes(sets, rank)
    heads = scratch.save(posts.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "heads")
    lists = scratch.save(posts.join(heads, "token"), "lists")
    scratch.drop(heads)

    # step 1: short lists pair by pair, long ones against their pivots
    short, long = lists.where(F.col("size") <= SHORT), lists.where(F.col("size") > SHORT)
    found = short.select("token", F.col("node").alias("x"), F.col("at").alias("at_x")).join(short.select("token", F.col("node").alias("y"), F.col("at").alias("at_y")), "token")
    found = found.where((F.col("x") < F.col("y")) & _passes("at_x", "at_y")).select("x", "y")
    if PIVOTS:
        picked = [F.min_by(F.struct(F.col("node").alias("y"), F.col("at").alias("at_y")), F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)]
        pivots = scratch.save(long.groupBy("token").agg(F.array(*picked).alias("pivots")), "pivots")
        star = long.join(pivots, "token").select(F.col("node").alias("x"), "at", F.explode(F.array_distinct("pivots")).alias("pivot")).select("x", "at", "pivot.*")
        found = found.union(star.where((F.col("x") != F.col("y")) & _passes("at", "at_y")).select("x", "y"))
    asked = scratch.save(_ordered(found).distinct(), "pairs")
    near = scratch.save(suffix_filter(asked, sets.select("node", "n", "signature")), "near")
    wanted = scratch.save(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    some = of(wanted, "shingles", "sets")
    links = scratch.save(verify(near, some), "links")
    scratch.drop(some)
    scratch.drop(asked, near)
    labels = connected(links, scratch)

    # step 2: long lists of several labels, in blocks
    homes = _homes(long, labels, scratch)
    placed, block = _place(homes, scratch), ["home", "band", "p", "q"]

    def sift(key: tuple, group: pa.Table) -> pa.Table:
        label, keep = np.asarray(group.column("label")), np.empty(0, np.int64)
        if (label != label[0]).any():
            keep = undecided(np.asarray(group.column("n")), np.asarray(group.column("core").to_pylist()), np.asarray(group.column("block")), label, group.column("signature").to_pylist())
        return group.drop_columns(["n", "signature"]).take(_long(keep))

    # signatures go to every pair of blocks, whole sets only where a pair of nodes is left
    signed = placed.join(of(scratch.save(homes.select("node").distinct(), "wanted"), "signature", "signatures"), "node").select(*placed.columns, "signature")
    left = placed.drop("n").schema
    close = scratch.save(signed.groupBy(*block).applyInArrow(sift, left), "close")
    placed = close.join(of(scratch.save(close.select("node").distinct(), "wanted"), "shingles", "sets"), "node")
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        label = np.asarray(group.column("label"))
        if (label == label[0]).all():
            pairs = []
        else:
            sets = [np.frombuffer(v, np.uint64) for v in group.column("shingles").to_pylist()]
            tokens = np.unique(np.concatenate([np.asarray(v, np.int64) for v in group.column("tokens").to_pylist()])).view(np.uint64)
            pairs = compare_blocks(sets, np.asarray(group.column("core").to_pylist()), np.asarray(group.column("block")), label, tokens, shared.value)
        node = np.asarray(group.column("node"))
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        return pa.table([_long(node[a]), _long(node[b]), _long(label[a]), _long(label[b])], ["a", "b", "la", "lb"])

    more = scratch.save(placed.groupBy(*block).applyInArrow(compare, "a long, b long, la long, lb long"), "more")
    joined = connected(more.select("la", "lb"), scratch, "la", "lb").toDF("label", "joined")

    # the smallest document of each component, for nodes with copies or links
    named = classes.join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    named = named.join(joined, "label", "left").select("node", "rep", "copies", F.coalesce("joined", "label").alias("label"))
    named = scratch.save(named, "named")
    smallest = scratch.save(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("nodes")), "smallest")
    grouped = scratch.save(named.join(smallest, "label").where((F.col("copies") > 1) | (F.col("nodes") > 1)).select("node", "component_id"), "grouped")
    out = members.join(grouped, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = scratch.save(out, "documents")
    scratch.keep(out, members, links, more)
    return Joined(out, members.select("doc_id", "node"), links.union(more.select("a", "b")))
