"""Operator 2: language ID.

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1
to 3, hashed), trained with follow-the-regularised-leader (per-coordinate
rates, elastic-net penalty), then temperature calibration on texts held back
from the training.

Document frequencies count all training texts.  The weights are fitted on a
bounded sample of them (``sample``, a documented parameter) in one task, which
returns a model of fixed size; every text is then scored whole.

A null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing can be learned (no training row with a language).  Repeated
rows are scored each on its own.  Only the text is an input of a prediction.
An empty table gives an empty table.  Columns of the output's names are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free, small_batches
from .textgrams import char_counts, text_batches, tf_idf

DIMS = 1 << 14
SAMPLE = 12_000
EPOCHS = 2
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages, sparse in content
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, cols, counts = char_counts(texts, len(self.idf))
        return softmax(_margins(rows, cols, tf_idf(rows, counts, self.idf[cols], len(texts)), len(texts), self.weights, self.bias) / self.temperature)


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _margins(rows, cols, values, n, weights, bias) -> np.ndarray:
    return np.stack([np.bincount(rows, weights=values * weights[cols, c], minlength=n) for c in range(weights.shape[1])], axis=1) + bias


def document_frequencies(texts: DataFrame, dims: int, grams: Callable | None = None) -> tuple[np.ndarray, int]:
    """In how many texts each of ``dims`` features occurs, and the number of texts; ``texts`` has one string column."""
    grams = grams or (lambda some: char_counts(some, dims))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for a, b, some in text_batches(batch.column(0)):
                _, cols, _ = grams(some)
                df += np.bincount(cols, minlength=dims)
                n += b - a
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], ["feature", "df"])

    found = texts.mapInArrow(count, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()  # dims + 1 rows at most
    out = np.zeros(dims, dtype=np.int64)
    real = found["feature"] >= 0
    out[found.loc[real, "feature"]] = found.loc[real, "df"]
    return out, int(found.loc[~real, "df"].sum())


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, dims: int, *, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, values, class); returns weights and bias."""
    z, n = np.zeros((dims + 1, n_classes)), np.zeros((dims + 1, n_classes))  # the last row is the bias, without penalty

    def weights(at):
        out = -(np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0.0)) / ((beta + np.sqrt(n[at])) / alpha + l2)
        out[-1] = -z[dims] / ((beta + np.sqrt(n[dims])) / alpha)
        return out

    for _ in range(epochs):
        for cols, values, y in examples:
            at, x = np.append(cols, dims), np.append(values, 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[y] -= 1.0
            g = x[:, None] * g
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(dims + 1))
    return w[:dims], w[dims]


def calibrate(margins: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(margins / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", dims: int = DIMS, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from rows with text and a non-null language; None if there are none."""
    with small_batches(rows.sparkSession):
        return _train(rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), dims, sample)


def _train(rows: DataFrame, dims: int, sample: int) -> LanguageModel | None:
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequencies(rows.select("text"), dims)
    if not n:
        return None
    idf = inverse(df, n)
    share = min(1.0, 0.95 * sample / n)
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 24))
    drawn = rows.where(draw < F.lit(int(share * (1 << 24)) + 1)).dropDuplicates(["text", "lang"]).withColumn("k", F.xxhash64("text", F.lit("order"))).limit(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are let go as soon as their features are there
        got = []
        for batch in batches:
            keys, langs = batch.column("k").to_pylist(), batch.column("lang").to_pylist()
            for a, _, some in text_batches(batch.column("text")):
                r, c, v = char_counts(some, dims)
                w = tf_idf(r, v, idf[c], len(some))
                ends = np.searchsorted(r, np.arange(len(some) + 1))
                got += [(keys[a + i], langs[a + i], c[ends[i] : ends[i + 1]].astype(np.int32), w[ends[i] : ends[i + 1]].astype(np.float32)) for i in range(len(some))]
        got.sort(key=lambda x: x[:2])
        languages = sorted({y for _, y, *_ in got})
        number = {y: i for i, y in enumerate(languages)}
        examples = [(c, w, number[y]) for _, y, c, w in got]
        held = len(examples) // 5 if len(examples) >= 50 else 0
        weights, bias = fit_ftrl(examples[held:], len(languages), dims)
        margins = np.array([x @ weights[c] + bias for c, x, _ in examples[:held]]).reshape(held, len(languages))
        temperature = calibrate(margins, np.array([y for *_, y in examples[:held]], dtype=int))
        yield pa.RecordBatch.from_arrays([pa.array([languages]), pa.array([weights.astype("<f8").tobytes()]), pa.array([bias.astype("<f8").tobytes()]), pa.array([temperature])], ["languages", "weights", "bias", "temperature"])

    got = drawn.repartition(1).mapInArrow(fit, "languages array<string>, weights binary, bias binary, temperature double").first()
    languages = list(got.languages)
    if not languages:
        return None
    return LanguageModel(languages, idf, np.frombuffer(got.weights, "<f8").reshape(dims, len(languages)), np.frombuffer(got.bias, "<f8"), got.temperature)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def detect(docs: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the calibrated probability of lang_pred) to every row."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by dims and the number of languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            column = pa.Array.from_pandas(batch, type=pa.large_string())
            p = [m.scores(some) for _, _, some in text_batches(column)]
            p = np.concatenate(p) if p else np.zeros((0, len(m.languages)))
            best = p.argmax(axis=1) if len(p) else np.empty(0, int)
            yield pd.DataFrame({"lang_pred": np.array(m.languages, dtype=object)[best], "score": p[np.arange(len(p)), best]})

    found, known = free(docs.columns, "_p", "_known")
    out = docs.withColumns({found: predict(F.col(text)), known: has_letter(F.col(text))})
    return out.withColumns({"lang_pred": F.when(F.col(known), F.col(found)["lang_pred"]).otherwise(UNKNOWN), "score": F.when(F.col(known), F.col(found)["score"]).otherwise(0.0)}).drop(found, known)


def held_out(id_: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % F.lit(parts) == F.lit(part)
