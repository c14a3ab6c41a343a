"""Operator 8: embedding near-dedup.

NN-descent: a graph of nearest neighbours, begun from blocks of vectors that
lie close under random hyperplanes, is refined by joining the neighbours of
each vector with one another.  Lists whose farthest entry is still within reach
of a link are saturated and are enlarged WIDENINGS times; vectors whose lists
are still open then are compared with all vectors of their label, in blocks.
Recall is audited by brute force on a sample of vectors, half of them with near
candidates, that grows until it sees enough links; where recall is low or could
not be measured, new blocks are added and the descent goes on, and after TRIES
all vectors are compared in blocks.  Edges at or over the threshold stay,
verified in doubles.

Dense groups do not become long lists.  Equal vectors are one node, and nodes
within half the threshold angle of a leader are one ball: by the triangle
inequality all of them link with each other, so they are counted, not
enumerated.  Descent runs over leaders, with the radii of the balls added to
the threshold; a pair of balls that lies wholly within it is counted too, and
only the members of pairs in between are compared, in blocks that return counts.

Vectors are compared only if their labels are equal and not null (and their
lengths are equal).  Null vectors, zero vectors, vectors with null or
non-finite components and vectors without a label link with nothing.  Repeated
rows are vectors of their own.  An empty table gives an empty table.  Columns
besides id, vector and label play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch
from .topk import usable

THRESHOLD = 0.93
NEIGHBOURS = 10
BLOCK = 512
CHUNK = 64
ROUNDS = 5
WIDENINGS = 2
TRIES = 3
AUDIT, AUDIT_MOST, AUDIT_LINKS = 256, 16384, 64
RECALL = 0.95
#: Vectors of a block that is compared exactly, and members of a ball that are.
EXACT_BLOCK, MEMBER_BLOCK = 1024, 256
BITS = 24


@dataclass
class Deduplicated:
    """vectors: vec_id, n_links, component_id, kept; recall: as audited; descent_recall: that of the descent alone (None if the audit saw no link); pairs: links between leaders."""

    vectors: DataFrame
    recall: float
    descent_recall: float | None
    pairs: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed doubles of equal length, one row each."""
    raw = b"".join(x.as_buffer().to_pybytes() for x in column)
    return np.frombuffer(raw, "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of runs of rows (g, key, id, v) with one g and at most ``size`` rows."""
    ids: list[int] = []
    rows: list[bytes] = []
    at = None
    for batch in batches:
        for g, i, v in zip(batch.column("g").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if ids and (g != at or len(ids) == size):
                yield np.array(ids), np.frombuffer(b"".join(rows), "<f8").reshape(len(ids), -1)
                ids, rows = [], []
            at = g
            ids.append(i)
            rows.append(v)
    if ids:
        yield np.array(ids), np.frombuffer(b"".join(rows), "<f8").reshape(len(ids), -1)


def _ordered(nodes: DataFrame, seed: int) -> DataFrame:
    """Rows (g, id, v) in ranges of like signs under random hyperplanes."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, v in zip(batch.column("g").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v, "<f8")
                planes = _planes(seed, len(x))
                out.append(int(np.packbits(planes @ x > 0).astype(np.int64) @ _POWERS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "key"])

    keyed = nodes.select("g", "id", "v").mapInArrow(key, "g long, id long, v binary, key long")
    return keyed.repartitionByRange("g", "key", "id").sortWithinPartitions("g", "key", "id")


_POWERS = np.array([1 << 16, 1 << 8, 1], dtype=np.int64)
_known_planes: dict[tuple[int, int], np.ndarray] = {}


def _planes(seed: int, d: int) -> np.ndarray:
    if (seed, d) not in _known_planes:
        _known_planes[seed, d] = np.random.default_rng([seed, d]).standard_normal((BITS, d))
    return _known_planes[seed, d]


def _arrow(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def _leaders(nodes: DataFrame, seed: int, near: float) -> DataFrame:
    """id, leader: in each block, nodes with a cosine of at least ``near`` to the first that has no leader yet."""

    def run(batches):
        for ids, m in _blocks(batches, BLOCK):
            free, leader = np.ones(len(ids), dtype=bool), ids.copy()
            s = m @ m.T
            for i in range(len(ids)):
                if free[i]:
                    got = free & (s[i] >= near)
                    got[i] = True
                    leader[got] = ids[i]
                    free &= ~got
            yield _arrow("id leader", pa.array(ids, pa.int64()), pa.array(leader, pa.int64()))

    return _ordered(nodes, seed).mapInArrow(run, "id long, leader long")


def balls(nodes: DataFrame, scratch: Scratch, half: float, passes: int = 3) -> DataFrame:
    """id, leader, angle for every node: the angle to its leader is at most ``half``; leaders lead themselves."""
    near = math.cos(half)
    top = scratch.save(_leaders(nodes, 100, near), "led")
    for k in range(1, passes):
        heads = nodes.join(top.where("id = leader").select("id"), "id", "left_semi")
        again = scratch.save(_leaders(heads, 100 + k, near), "heads")
        moved = top.join(again.select(F.col("id").alias("leader"), F.col("leader").alias("above")), "leader", "left")
        checked = _angle(moved.select("id", "leader", F.coalesce("above", "leader").alias("above")), nodes, "id", "above")
        # who is not near the new leader stays with the old one, which then stays a leader
        picked = scratch.save(checked.withColumn("own", F.col("cos") < near).select("id", "leader", "above", "own"), "picked")
        kept = picked.where("own").select(F.col("leader").alias("h")).distinct()
        stays = picked.join(kept, picked["leader"] == kept["h"], "left")
        # a head that somebody kept may itself follow the new leader only if nobody needs it
        new = F.when(F.col("h").isNotNull(), F.col("leader")).otherwise(F.col("above"))
        after = scratch.save(stays.select("id", new.alias("leader")), "led")
        scratch.drop(top, again, picked)
        top = after
    return scratch.save(_angle(top, nodes, "id", "leader").select("id", "leader", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cos"))).alias("angle")), "balls")


def _angle(pairs: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Adds cos, in doubles, of the vectors of two id columns."""

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column("va")), _matrix(batch.column("vb"))
            c = np.einsum("ij,ij->i", x, y) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["va", "vb"]).columns, pa.array(c)], [*(n for n in batch.schema.names if n not in ("va", "vb")), "cos"])

    one = nodes.select(F.col("id").alias(a), F.col("v").alias("va"), "d")
    two = nodes.select(F.col("id").alias(b), F.col("v").alias("vb"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", cos double"
    # vectors of one length only meet in one batch
    return pairs.join(one, a).join(two, b).drop("d").select(*pairs.columns, "va", "vb").mapInArrow(run, schema)


def _top(edges: DataFrame) -> DataFrame:
    """The k best distinct neighbours of each node; edges has u, v, s, fresh, k."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("k")).drop("r")


def _from_blocks(nodes: DataFrame, seed: int, k: int) -> DataFrame:
    def run(batches):
        for ids, m in _blocks(batches, BLOCK):
            n = min(k, len(ids) - 1)
            if n < 1:
                continue
            s = m @ m.T
            np.fill_diagonal(s, -2.0)
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            yield _arrow("u v s", pa.array(np.repeat(ids, n), pa.int64()), pa.array(ids[at].ravel(), pa.int64()), pa.array(np.take_along_axis(s, at, 1).ravel()))

    return _ordered(nodes, seed).mapInArrow(run, "u long, v long, s double")


def _round(edges: DataFrame, nodes: DataFrame, theta: float, neighbours: int, turn: int, best: int = 4) -> DataFrame:
    """Candidates u, v, s from joining the neighbours of each node; lists of hubs are joined in chunks, other ones each turn.

    A node takes its ``best`` partners of each list; one whose own list was widened takes all within reach.
    """
    around = edges.select(F.col("u").alias("w"), F.col("v").alias("id"), "fresh").union(edges.select(F.col("v").alias("w"), F.col("u").alias("id"), "fresh"))
    around = around.groupBy("w", "id").agg(F.max("fresh").alias("fresh"))
    degree = around.groupBy("w").agg(F.count("*").alias("n"), F.max("fresh").alias("any"))
    worst = edges.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("n"), F.max("k").alias("k"))
    worst = worst.select(F.col("u").alias("id"), F.when(F.col("n") >= F.col("k"), F.col("low")).otherwise(-2.0).alias("low"), (F.col("k") > neighbours).alias("wide"))
    lists = around.join(degree.where("any").select("w", F.ceil(F.col("n") / CHUNK).alias("chunks")), "w")
    lists = lists.withColumn("chunk", F.pmod(F.xxhash64("id", "w", F.lit(turn)), F.col("chunks")))
    rows = lists.join(nodes.select("id", "small", "radius").join(worst, "id"), "id").select("w", "chunk", "id", "small", "low", "fresh", "radius", "wide")

    def run(batches):
        ids, low, fresh, vectors, radius, wide, at, out = [], [], [], [], [], [], None, ([], [], [])

        def close():
            m = np.frombuffer(b"".join(vectors), "<f2").reshape(len(ids), -1).astype(np.float32)
            s = m @ m.T
            np.fill_diagonal(s, -2.0)
            new, i = np.array(fresh), np.array(ids)
            s[~(new[:, None] | new[None, :])] = -2.0  # both known before: compared before
            n = min(best, len(ids) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            keep, r, grown = np.zeros(s.shape, dtype=bool), np.array(radius), np.array(wide)
            np.put_along_axis(keep, top, True, 1)
            if grown.any():
                keep |= grown[:, None] & (s >= np.cos(np.minimum(theta + 0.01 + r[:, None] + r[None, :], math.pi)))
            x, y = np.nonzero(keep & (s > np.array(low)[:, None]))
            out[0].append(i[x])
            out[1].append(i[y])
            out[2].append(s[x, y])

        def flush():
            got = _arrow("u v s", pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]).astype(np.float64)))
            for o in out:
                o.clear()
            return got

        for batch in batches:
            for w, c, i, v, x, f, r, g in zip(*(batch.column(n).to_pylist() for n in ("w", "chunk", "id", "small", "low", "fresh", "radius", "wide")), strict=True):
                if at != (w, c):
                    if len(ids) > 1:
                        close()
                    ids, low, fresh, vectors, radius, wide, at = [], [], [], [], [], [], (w, c)
                ids.append(i)
                radius.append(r)
                wide.append(g)
                low.append(x)
                fresh.append(f)
                vectors.append(v)
            if len(out[0]) > 512:
                yield flush()
        if len(ids) > 1:
            close()
        if out[0]:
            yield flush()

    return rows.repartition("w", "chunk").sortWithinPartitions("w", "chunk", "id").mapInArrow(run, "u long, v long, s double")


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> Deduplicated:
    """Links, components and the kept vector of each component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nn-descent")
    theta = math.acos(threshold)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    good = usable(F.col("x")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good &= F.exists("x", lambda v: v != 0.0)

    def unit(batches):
        for batch in batches:
            out = []
            for x in batch.column("x").to_pylist():
                v = np.array(x)
                v = v / np.abs(v).max()
                out.append(v / np.sqrt((v * v).sum()))
            yield _arrow("vec_id g v small d", batch.column("vec_id"), batch.column("g"), pa.array([v.astype("<f8").tobytes() for v in out], pa.binary()), pa.array([v.astype("<f2").tobytes() for v in out], pa.binary()), pa.array([len(v) for v in out], pa.int32()))

    ready = rows.where(F.coalesce(good, F.lit(False))).select("vec_id", F.xxhash64("label", F.size("x")).alias("g"), "x")
    ready = scratch.save(ready.mapInArrow(unit, "vec_id long, g long, v binary, small binary, d int"), "unit")
    nodes = scratch.save(ready.groupBy("g", "v", "d").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("small").alias("small")), "nodes")

    ball = balls(nodes, scratch, theta / 2 - 1e-3)
    size = ball.join(nodes.select("id", "copies"), "id").groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"))
    leaders = scratch.save(nodes.join(size.withColumnRenamed("leader", "id"), "id"), "leaders")

    edges, tries, turn, recall, own, found = None, 0, 0, 0.0, None, None
    radius = leaders.select("id", "radius")
    while True:
        seeds = (2 * tries, 2 * tries + 1)
        first = _from_blocks(leaders, seeds[0], neighbours).union(_from_blocks(leaders, seeds[1], neighbours))
        first = first.select("u", "v", "s", F.lit(True).alias("fresh"), F.lit(neighbours).alias("k"))
        edges = scratch.save(_top(first if edges is None else edges.withColumn("fresh", F.lit(False)).union(first)), "edges")
        for widening in range(WIDENINGS + 1):
            for _ in range(ROUNDS):
                turn += 1
                new = _round(edges, leaders, theta, neighbours, turn).select("u", "v", "s", F.lit(True).alias("fresh"))
                known = edges.groupBy("u").agg(F.max("k").alias("k"))
                new = new.join(known, "u", "left").select("u", "v", "s", "fresh", F.coalesce("k", F.lit(neighbours)).alias("k"))
                after = scratch.save(_top(edges.withColumn("fresh", F.lit(False)).union(new)), "edges")
                scratch.drop(edges)
                edges = after
                count = edges.agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
                if count.new <= 0.02 * count.n:
                    break
            # lists that end within reach of a link may hide more
            ends = scratch.save(_open(edges, radius, theta), "open")
            full = ends.where("n >= k").select(F.col("id").alias("u"), (2 * F.col("k")).alias("wider"))
            if widening == WIDENINGS or not full.count():
                break
            edges = scratch.save(edges.join(full, "u", "left").select("u", "v", "s", (F.col("fresh") | F.col("wider").isNotNull()).alias("fresh"), F.coalesce("wider", "k").cast("int").alias("k")), "edges")
        near = _reach(edges, radius, theta).where("linked").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        rest = _compared(leaders.join(ends.select("id"), "id", "left_semi"), leaders, theta, scratch)
        found = scratch.save(near.union(rest).distinct(), "near")
        recall, own = _audit(leaders, edges, found, near, theta, scratch)
        tries += 1
        if recall >= RECALL:
            break
        if tries == TRIES:
            found, recall = scratch.save(_compared(leaders, leaders, theta, scratch), "near"), 1.0
            break

    # pairs of balls, by exact angles: wholly linked, or compared by member
    exact = _angle(found, nodes, "a", "b").withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cos"))))
    sizes = leaders.select("id", "radius", "weight")
    exact = exact.join(sizes.toDF("a", "ra", "wa"), "a").join(sizes.toDF("b", "rb", "wb"), "b").where(F.col("angle") <= F.lit(theta + 1e-9) + F.col("ra") + F.col("rb"))
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    exact = exact.withColumn("kind", F.when(single, F.when(F.col("cos") >= threshold, "all").otherwise("none")).when(F.col("angle") + F.col("ra") + F.col("rb") <= theta - 1e-9, "all").otherwise("some"))
    exact = scratch.save(exact.where("kind <> 'none'").select("a", "b", "wa", "wb", "kind"), "exact")
    whole = exact.where("kind = 'all'")
    members = ball.join(nodes.select("id", "copies"), "id").select("id", "leader", "copies")
    some = exact.where("kind = 'some'").select("a", "b")
    compared = scratch.save(_crossed(some, members, nodes, threshold), "compared")
    joining = compared.where("id IS NULL").select("a", "b").distinct()

    per_ball = whole.select(F.col("a").alias("leader"), F.col("wb").alias("n")).union(whole.select("b", "wa")).groupBy("leader").agg(F.sum("n").alias("beside"))
    per_ball = leaders.select(F.col("id").alias("leader"), (F.col("weight") - 1).alias("inside")).join(per_ball, "leader", "left")
    per_node = compared.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("more"))
    joined = whole.select("a", "b").union(joining).union(ball.where("id <> leader").select("id", "leader"))
    labels = connected(joined.toDF("a", "b"), scratch)
    counted = members.join(per_ball, "leader").join(per_node, "id", "left").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    counted = counted.select("id", (F.col("inside") + F.coalesce("beside", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    of = scratch.save(counted.join(nodes.select("id", "g", "v"), "id").select("g", "v", "n_links", "component_id"), "counted")
    out = ready.join(of, ["g", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return Deduplicated(out, recall, own, whole.select("a", "b"))


def _crossed(pairs: DataFrame, members: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Members of two balls (a, b) that lie partly within reach, compared in blocks of up to MEMBER_BLOCK.

    id, n: links of a member into the other ball, those of a block added up;
    a, b (with id null): balls that at least one link joins, which is enough,
    for all members of a ball are linked with one another.
    """
    balls_ = pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    rows = members.join(balls_, "leader", "left_semi").join(nodes.select("id", "v"), "id").select("leader", "id", "v", "copies")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[bytes] = []
        copies: list[int] = []
        at = None

        def out() -> pa.RecordBatch:
            return _arrow("leader ids m c", pa.array([at], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(vectors)]), pa.array([np.array(copies, "<i8").tobytes()]))

        for batch in batches:
            for g, i, v, c in zip(*(batch.column(n).to_pylist() for n in ("leader", "id", "v", "copies")), strict=True):
                if ids and (g != at or len(ids) == MEMBER_BLOCK):
                    yield out()
                    ids, vectors, copies = [], [], []
                at = g
                ids.append(i)
                vectors.append(v)
                copies.append(c)
        if ids:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                i, j = np.frombuffer(r["ia"], "<i8"), np.frombuffer(r["ib"], "<i8")
                hit = np.frombuffer(r["ma"], "<f8").reshape(len(i), -1) @ np.frombuffer(r["mb"], "<f8").reshape(len(j), -1).T >= threshold
                if hit.any():
                    n = np.concatenate([hit @ np.frombuffer(r["cb"], "<i8"), np.frombuffer(r["ca"], "<i8") @ hit])
                    found = n > 0
                    k = int(found.sum())
                    ids = pa.array(np.concatenate([i, j])[found].tolist() + [None], pa.int64())
                    yield _arrow("a b id n", pa.array([r["a"]] * (k + 1), pa.int64()), pa.array([r["b"]] * (k + 1), pa.int64()), ids, pa.array(np.append(n[found], 0), pa.int64()))

    blocks = rows.repartitionByRange("leader", "id").sortWithinPartitions("leader", "id").mapInArrow(pack, "leader long, ids binary, m binary, c binary")
    one = blocks.toDF("a", "ia", "ma", "ca")
    two = blocks.toDF("b", "ib", "mb", "cb")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ia", "ma", "ca", "ib", "mb", "cb").mapInArrow(run, "a long, b long, id long, n long")


def _reach(edges: DataFrame, radius: DataFrame, theta: float) -> DataFrame:
    """Adds linked: whether the balls of u and v can hold a link, with room for the rounding of the search vectors."""
    out = edges.join(radius.toDF("u", "ru"), "u").join(radius.toDF("v", "rv"), "v")
    return out.withColumn("linked", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "s"))) <= F.lit(theta + 0.01) + F.col("ru") + F.col("rv"))


def _open(edges: DataFrame, radius: DataFrame, theta: float) -> DataFrame:
    """id, n, k of nodes without a list, or whose list ends within reach of a ball as wide as their own.

    Of two balls that can hold a link, the wider one thus seeks as far as the other.
    """
    ends = edges.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("n"), F.max("k").alias("k"))
    out = radius.join(ends.withColumnRenamed("u", "id"), "id", "left")
    far = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "low")))
    return out.where(F.col("n").isNull() | (far <= F.lit(theta + 0.01) + 2 * F.col("radius"))).select("id", "n", "k")


def _packed(rows: DataFrame, count: int) -> DataFrame:
    """Rows (g, id, v, radius) as blocks of one g."""

    def run(batches):
        held: dict[int, list] = {}

        def out(g):
            ids, vectors, radius = zip(*held.pop(g), strict=True)
            m = np.frombuffer(b"".join(vectors), "<f8").astype("<f4")
            return _arrow("g ids m r", pa.array([g], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([m.tobytes()]), pa.array([np.array(radius, "<f8").tobytes()]))

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("g", "id", "v", "radius")), strict=True):
                if held and row[0] not in held:
                    yield out(next(iter(held)))
                held.setdefault(row[0], []).append(row[1:])
                if len(held[row[0]]) == EXACT_BLOCK:
                    yield out(row[0])
        for g in list(held):
            yield out(g)

    ordered = rows.select("g", "id", "v", "radius").repartitionByRange("g", "id").sortWithinPartitions("g", "id")
    return ordered.coalesce(1 + count // (2 * EXACT_BLOCK)).mapInArrow(run, "g long, ids binary, m binary, r binary")


def _compared(asked: DataFrame, leaders: DataFrame, theta: float, scratch: Scratch) -> DataFrame:
    """a, b: the pairs of one of ``asked`` and any leader whose balls can hold a link, all compared, block by block."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                i, j = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["ids2"], "<i8")
                r, q = np.frombuffer(x["r"], "<f8") + theta + 2e-3, np.frombuffer(x["r2"], "<f8")
                s = np.frombuffer(x["m"], "<f4").reshape(len(i), -1) @ np.frombuffer(x["m2"], "<f4").reshape(len(j), -1).T
                u, v = np.nonzero(s >= math.cos(min(r.max() + q.max(), math.pi)))
                near = (np.arccos(np.clip(s[u, v].astype(np.float64), -1.0, 1.0)) <= r[u] + q[v]) & (i[u] != j[v])
                u, v = i[u[near]], j[v[near]]
                yield _arrow("a b", pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64()))

    asked = scratch.save(asked.select("g", "id", "v", "radius"), "asked")
    one = scratch.save(_packed(asked, asked.count()), "asked-blocks")
    two = one if asked.count() == leaders.count() else scratch.save(_packed(leaders, leaders.count()), "blocks")
    # every pair of blocks of one g meets in one cell of a square, whose side grows with the root of the blocks
    side = max(1, math.isqrt(two.count()))
    cells = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    place = F.pmod(F.xxhash64("ids"), F.lit(side)).cast("int")
    left = one.withColumn("x", place).withColumn("y", cells)
    right = two.withColumn("y", place).withColumn("x", cells).select("g", "x", "y", F.col("ids").alias("ids2"), F.col("m").alias("m2"), F.col("r").alias("r2"))
    pairs = left.join(right, ["g", "x", "y"]).select("ids", "m", "r", "ids2", "m2", "r2")
    return scratch.save(pairs.mapInArrow(run, "a long, b long").distinct(), "compared")


def _audit(leaders: DataFrame, edges: DataFrame, found: DataFrame, descended: DataFrame, theta: float, scratch: Scratch) -> tuple[float, float | None]:
    """The part that the graph has of the true links of a sample of leaders (0.0 if too few links were seen to tell), and the part that the descent alone had (None if none was seen).

    One half is drawn from all leaders and one from those with a candidate a little beyond reach.
    """
    order = (F.xxhash64("id"), "id")
    near = _reach(edges, leaders.select("id", "radius"), theta + 0.1).where("linked").select(F.col("u").alias("id")).distinct()
    near = scratch.save(near, "near-leaders")
    total, size = leaders.count(), AUDIT
    while True:
        picked = leaders.select("id").orderBy(*order).limit(size).union(near.orderBy(*order).limit(size)).distinct()
        true = _compared(leaders.join(picked, "id", "left_semi"), leaders, theta, scratch)
        n = true.count()
        if n >= AUDIT_LINKS or size >= min(total, AUDIT_MOST):
            break
        size *= 8
    part = lambda graph: true.join(graph, ["a", "b"], "left_semi").count() / n
    own = part(descended.distinct()) if n else None
    if n < AUDIT_LINKS and size < total:
        return 0.0, own
    return (part(found) if n else 1.0), own
