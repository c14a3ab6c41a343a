"""Operator 13: ranked lexical search.

Two-level quantised index.  Documents lie in blocks.  The exact level of a
block has, for each posting (term, document), the term's occurrences, and each
document's number of terms; the quantised level has the posting's impact as one
byte, rounded upwards, so that byte times weight is an upper bound of what the
term adds to a score, and the byte below it a lower bound.  A query sums bytes
of its terms over a block; the kth largest lower bound is a bar, and every
document whose upper bound reaches the bar (or the kth best exact score so far,
carried on from block to block within a task) is scored exactly in integers.

Documents are read once: their terms are counted in Arrow functions, which keep
the postings of the terms that are asked for, and every document's length.  The
asked terms go to the tasks while the queries take up to QUERY_BYTES; more
queries are dealt into groups of that size, each with an index of its own.  A
task returns at most k rows for each query, and two windows (first within salts,
then for the query) merge them.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII;
only A-Z are lower-cased.  Null text has no terms.  Every row of either table
counts as a document or a query of its own, repeated ids and null ids included;
equal scores go by ascending id, null ids last.  Documents with a score of 0 are
not returned, so queries without terms, and empty tables, give no row.  Texts of
any length are counted whole, in windows that end between terms.  Other columns
play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

QUERY_BYTES = 16 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
WINDOW = 4 << 20
SALTS = 64
#: A byte stands for so much of the part of an impact that depends on the document (less than 1,000,000).
STEP = 3922
_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


def _windows(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between terms."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text) and _SEPARATE[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end


def counts(text: bytes, number: dict[bytes, int]) -> tuple[int, Counter]:
    """Terms of a text with repeats, and the occurrences of the numbered ones."""
    total, found = 0, Counter()
    for part in [text] if len(text) <= WINDOW else _windows(text):
        words = terms_of(part)
        total += len(words)
        found.update(map(number.get, words))
    found.pop(None, None)
    return total, found


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of an impact that depends on the document: below 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Stats:
    """N documents with terms, L terms with repeats, and the weight of each asked term."""

    documents: int
    terms: int
    weight: np.ndarray

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        return np.array([50 + (50 * int(x) * self.documents) // self.terms for x in n], dtype=np.int64)


@dataclass
class Queries:
    """Queries as lists of term numbers: those of query q are ``flat[ends[q]:ends[q + 1]]``."""

    ids: list
    ends: np.ndarray
    flat: np.ndarray
    number: dict[bytes, int]


def numbered(rows: list[tuple]) -> Queries:
    number: dict[bytes, int] = {}
    lists = [sorted({number.setdefault(t, len(number)) for t in terms_of(text)}) for _, text in rows]
    ends = np.cumsum([0, *map(len, lists)])
    return Queries([i for i, _ in rows], ends, np.array([t for ts in lists for t in ts], dtype=np.int64), number)


_INDEX = "ids binary, missing binary, n binary, doc binary, term binary, tf binary"


def build(docs: DataFrame, number: dict[bytes, int], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The exact level: blocks of documents with the postings of the numbered terms, ordered by term."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes, doc, term, tf = [], [], [], []

        def out() -> pa.RecordBatch:
            t = np.array(term, np.int32)
            order = np.argsort(t, kind="stable")
            columns = [
                np.array([0 if i is None else i for i in ids], np.int64),
                np.array([i is None for i in ids], np.uint8),
                np.array(sizes, np.int64),
                np.array(doc, np.int32)[order],
                t[order],
                np.array(tf, np.int64)[order],
            ]
            for held in (ids, sizes, doc, term, tf):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [f.split()[0] for f in _INDEX.split(", ")])

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                size, found = counts(value.as_py() or b"", number)
                if size:
                    term += found.keys()
                    tf += found.values()
                    doc += [len(ids)] * len(found)
                    ids.append(i)
                    sizes.append(size)
                if len(ids) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield out()
        if ids:
            yield out()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(blocks, _INDEX)


def weigh(index: DataFrame, n_terms: int) -> Stats | None:
    """Statistics over all documents of an index; None without documents."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for n, t in zip(batch.column(0), batch.column(1), strict=True):
                sizes = np.frombuffer(n.as_py(), np.int64)
                documents, terms = documents + len(sizes), terms + int(sizes.sum())
                df += np.bincount(np.frombuffer(t.as_py(), np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([documents, terms, *df[at].tolist()], pa.int64())], ["term", "n"])

    found = dict(index.select("n", "term").mapInArrow(partial, "term int, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each asked term
    documents, terms = found.get(-2, 0), found.get(-1, 0)
    if not documents:
        return None
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in range(n_terms)]
    return Stats(documents, terms, np.array(weight, np.int64))


class Block:
    """A block with both levels; postings of term t are ``starts[t]:starts[t + 1]``."""

    def __init__(self, row: dict, stats: Stats) -> None:
        self.ids, self.missing = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["missing"], np.uint8)
        self.m = stats.length_factor(np.frombuffer(row["n"], np.int64))
        self.doc, self.term, self.tf = np.frombuffer(row["doc"], np.int32), np.frombuffer(row["term"], np.int32), np.frombuffer(row["tf"], np.int64)
        self.starts = np.searchsorted(self.term, np.arange(len(stats.weight) + 1))
        self.byte = (-(-saturated(self.tf, self.m[self.doc]) // STEP)).astype(np.uint8)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of some terms, and the term of each by its place in ``terms``."""
        begin, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


def search_block(block: Block, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that may be among a query's k best, with exact scores of at least ``floor``."""
    at, owner = block.postings(terms)
    doc, w = block.doc[at], weight[owner]
    high = np.bincount(doc, w * (block.byte[at].astype(np.int64) * STEP), len(block.ids))
    low = np.bincount(doc, w * ((np.maximum(block.byte[at], 1).astype(np.int64) - 1) * STEP), len(block.ids))
    bar = float(max(floor, 1))
    if len(low) > k:
        bar = max(bar, float(np.partition(low, len(low) - k)[len(low) - k]))
    reach = high >= bar
    hit = reach[doc]
    at, doc, w = at[hit], doc[hit], w[hit]
    exact = np.zeros(len(block.ids), np.int64)
    np.add.at(exact, doc, w * saturated(block.tf[at], block.m[doc]))
    kept = np.flatnonzero(reach & (exact >= max(floor, 1)))
    return kept, exact[kept]


def score(index: DataFrame, queries: Queries, stats: Stats, k: int) -> DataFrame:
    """The k best documents of each query and task: query (its number), missing, doc_id, score."""
    sc = index.sparkSession.sparkContext
    held = sc.broadcast((queries.ends, queries.flat, stats))  # bounded by QUERY_BYTES

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, flat, stats = held.value
        best: dict[int, np.ndarray] = {}  # query: rows (score, missing, id), at most k
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, stats)
                for q in range(len(ends) - 1):
                    terms = flat[ends[q] : ends[q + 1]]
                    seen = best.get(q)
                    floor = int(seen[-1, 0]) if seen is not None and len(seen) == k else 0
                    kept, scores = search_block(block, terms, stats.weight[terms], k, floor)
                    if len(kept):
                        new = np.column_stack([scores, block.missing[kept].astype(np.int64), block.ids[kept]])
                        new = new if seen is None else np.concatenate([seen, new])
                        best[q] = new[np.lexsort((new[:, 2], new[:, 1], -new[:, 0]))[:k]]
        for q, rows in best.items():
            ids = pa.array(rows[:, 2], mask=rows[:, 1] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), q, np.int32)), ids, pa.array(rows[:, 0])], ["query", "doc_id", "score"])

    return index.mapInArrow(scored, "query int, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def groups(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Queries (id, bytes) in groups of up to QUERY_BYTES."""
    group, held = [], 0
    for r in items.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).toLocalIterator():
        if group and held + len(r["text"]) > QUERY_BYTES:
            yield group
            group, held = [], 0
        group.append((r["id"], bytes(r["text"])))
        held += len(r["text"])
    if group:
        yield group


def rank(docs: DataFrame, items: DataFrame, k: int = 50, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best rows of ``docs`` for each row of ``items``: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    kind = items.schema[item_key].dataType
    out = spark.createDataFrame([], "query int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", "score")
    for rows in groups(items, item_key, item_text):
        queries = numbered(rows)
        index = scratch.save(build(docs, queries.number, key=key, text=text), "index")
        stats = weigh(index, len(queries.number))
        if stats is not None:
            found = scratch.save(best_of(score(index, queries, stats, k), k), "found")
            names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kind.simpleString()}")
            out = out.union(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        scratch.drop(index)
    return out


def oracle_sql(k: int = 50) -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({terms})) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY 1),
s AS (
  SELECT q, item_id, n.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN n USING (r), g GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {k}
"""
