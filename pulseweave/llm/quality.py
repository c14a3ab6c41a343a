"""Operator 7: quality classifier.

Nearest-neighbour voting in a latent-semantic space.  Hashed character n-grams
(case kept) and n-grams of repeated words are weighted by TF-IDF
with document frequencies over all texts; a truncated singular value
decomposition of a bounded sample of labelled texts gives the space.  The labelled vectors are broadcast; each text is projected
whole, its exact cosines to all labelled vectors are computed in blocks, and
its nearest neighbours vote with their similarities as weights.

The sample bound (``sample``, a documented parameter) fixes the size of what is
broadcast.  Labelled rows come through a broadcast of the sampled labels, so
texts are not shuffled.

A text without n-grams, or null, has no neighbours and gets the share of label
1 in the sample; without any label every score is 0.5.  Null labels are left
out; where a document has several labels, their rounded mean holds.  Labelled
copies of one text and label count once.  Repeated rows are scored each on its
own.  Labels, language, source and id are no inputs of a score.  An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import document_frequencies, inverse
from .scratch import small_batches
from .textgrams import char_counts, text_batches, tf_idf

DIMS = 1 << 13
RANK = 48
SAMPLE = 4096
NEIGHBOURS = 31
#: Repetition n-grams have up to so many words, and so many features.
REPEAT_ORDER = 8
REPEATS = 1 << (REPEAT_ORDER + 1)
#: Labelled rows that are dense at a time while the space is fitted.
BLOCK_ROWS = 256


@dataclass
class NeighbourModel:
    idf: np.ndarray
    space: np.ndarray  # features x rank
    vectors: np.ndarray  # labelled x rank, of length 1
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def project(self, texts: list[str]) -> np.ndarray:
        return project(texts, self.idf, self.space)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.project(texts)
        sim = x @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(sim, at, axis=1), 0.0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 0, np.clip(vote, 0.0, 1.0), self.prior)


def grams(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of hashed character n-grams, and behind them of repetition n-grams.

    A repetition n-gram says which of up to REPEAT_ORDER consecutive words repeat the word before them.
    """
    rows, cols, counts = char_counts(texts, dims, lower=False)
    out = [(rows, cols, counts)]
    for i, t in enumerate(texts):
        words = t.split()
        same = np.fromiter(map(eq, words, words[1:]), dtype=np.int64)
        if not same.any():
            continue
        found, code = np.zeros(1 << (REPEAT_ORDER + 1), dtype=np.int64), np.zeros(len(same), dtype=np.int64)
        for order in range(1, min(REPEAT_ORDER, len(same)) + 1):
            code = code[: len(same) - order + 1] * 2 + same[order - 1 :]
            found += np.bincount(code[code > 0] + (1 << order), minlength=len(found))
        at = np.flatnonzero(found)
        out.append((np.full(len(at), i), dims + at, found[at]))
    if len(out) == 1:
        return out[0]
    rows, cols, counts = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], counts[order]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weights(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, TF-IDF weight), each row of length 1."""
    rows, cols, counts = grams(texts, len(idf) - REPEATS)
    return rows, cols, tf_idf(rows, counts, idf[cols], len(texts)).astype(np.float32)


def features(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, a dense row of length 1 for each text."""
    rows, cols, values = weights(texts, idf)
    out = np.zeros((len(texts), len(idf)), dtype=np.float32)
    out[rows, cols] = values
    return out


@dataclass
class SparseRows:
    """Rows of (features, weights); to iterate gives blocks of them as dense matrices, one at a time."""

    rows: list[list[np.ndarray]]
    width: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), self.width

    def __iter__(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self.rows), BLOCK_ROWS):
            part = self.rows[a : a + BLOCK_ROWS]
            block = np.zeros((len(part), self.width), dtype=np.float32)
            for to, (cols, values) in zip(block, part, strict=True):
                to[cols] = values
            yield block


def project(texts: list[str], idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1; zero where a text is empty."""
    out = unit(features(texts, idf) @ space)
    out[[not t for t in texts]] = 0.0
    return out


def latent_space(x: np.ndarray | SparseRows, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the rows of ``x`` by randomised subspace iteration."""
    blocks, rank = x if isinstance(x, SparseRows) else [x], max(1, min(rank, *x.shape))
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(sum(b.T @ (b @ q) for b in blocks))
    _, _, v = np.linalg.svd(np.concatenate([b @ q for b in blocks]), full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", dims: int = DIMS, rank: int = RANK, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> NeighbourModel | None:
    """A model from the texts of ``docs`` and ``labels`` (id and label); None without labelled texts."""
    with small_batches(docs.sparkSession):
        return _train(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")), dims, rank, sample, neighbours)


def _train(docs: DataFrame, labels: DataFrame, dims: int, rank: int, sample: int, neighbours: int) -> NeighbourModel | None:
    df, n = document_frequencies(docs.select("text"), dims + REPEATS, grams=lambda texts: grams(texts, dims))
    idf = inverse(df, n)
    marked = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    share = min(1.0, 0.95 * sample / max(1, marked.count()))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 24))
    drawn = F.broadcast(marked.where(draw < F.lit(int(share * (1 << 24)) + 1)).limit(sample))
    known = docs.where(F.col("text").isNotNull()).join(drawn, "id").select("text", "label").dropDuplicates(["text", "label"]).limit(sample)
    known = known.withColumn("k", F.xxhash64("text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are let go as soon as their features are there; these stay sparse, since all rows at once take hundreds of MB beside the heap
        got = []
        for batch in batches:
            keys, marks = batch.column("k").to_pylist(), batch.column("label").to_pylist()
            for a, _, some in text_batches(batch.column("text")):
                r, c, w = weights(some, idf)
                ends = np.searchsorted(r, np.arange(len(some) + 1))
                got += [(keys[a + i], marks[a + i], c[ends[i] : ends[i + 1]].astype(np.int32), w[ends[i] : ends[i + 1]].copy()) for i in range(len(some))]
        if got:
            got.sort(key=lambda x: x[:2])
            x = SparseRows([row for _, _, *row in got], len(idf))
            space = latent_space(x, rank)
            z = unit(np.concatenate([b @ space for b in x]))
            yield pa.RecordBatch.from_arrays([pa.array([space.astype("<f4").tobytes()]), pa.array([z.astype("<f4").tobytes()]), pa.array([[y for _, y, *_ in got]], pa.list_(pa.int32())), pa.array([space.shape[1]], pa.int32())], ["space", "vectors", "labels", "rank"])

    got = known.repartition(1).mapInArrow(fit, "space binary, vectors binary, labels array<int>, rank int").first()
    if got is None:
        return None
    y = np.array(got.labels, dtype=np.float64)
    return NeighbourModel(idf.astype(np.float32), np.frombuffer(got.space, "<f4").reshape(dims + REPEATS, got["rank"]), np.frombuffer(got.vectors, "<f4").reshape(len(y), -1), y, float(y.mean()), neighbours)


def score(docs: DataFrame, model: NeighbourModel | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score, from 0 to 1, to every row."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by dims, rank and sample

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            column = pa.Array.from_pandas(batch, type=pa.large_string())
            got = [m.scores(some) for _, _, some in text_batches(column)]
            yield pd.Series(np.concatenate(got) if got else np.empty(0))

    return docs.withColumn(out, rate(F.col(text)))
