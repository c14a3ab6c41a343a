"""Connected components by alternating large and small stars, for links of any number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A task joins up to so many links at a time by itself.
LOCAL = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, some at a time, as links of each node with the least that it reaches by them."""
    parent: dict[int, int] = {}
    seen = 0

    def root(x: int) -> int:
        at = x
        while (up := parent[at]) != at:
            at = up
        while parent[x] != at:
            parent[x], x = at, parent[x]
        return at

    def out() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(parent.setdefault(x, x)), root(parent.setdefault(y, y))
            parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= LOCAL:
            yield out()
            parent, seen = {}, 0
    yield out()


def connected(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node it reaches) for every node of ``links`` other than the smallest of its component.

    Tasks first join what links they hold.  Each step writes its edges to the
    shared folder.  The least neighbours are written too, so that the join with
    them is between two shuffles and a node with very many links is split over tasks.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = scratch.save(edges.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = scratch.save(small, "edges")
        new = _mark(after)
        scratch.drop(edges, least, large, low)
        edges = after
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
