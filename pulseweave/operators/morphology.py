"""Beat morphology over windows of samples held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTLIER_R = 0.90


def template(beats: DataFrame, key: str) -> DataFrame:
    """The element-wise median of the beat windows of each group: key, template (array)."""
    p = beats.select(key, F.posexplode("window").alias("i", "x")).groupBy(key, "i").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("template"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; null where one is constant."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    ca, cb = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    saa, sbb = _sum(F.transform(ca, lambda x: x * x)), _sum(F.transform(cb, lambda x: x * x))
    return F.when((saa > 0) & (sbb > 0), _sum(F.zip_with(ca, cb, lambda x, y: x * y)) / F.sqrt(saa * sbb))


def correlate(beats: DataFrame, key: str) -> DataFrame:
    """Adds r, each beat's correlation with its group's template, and outlier."""
    t = template(beats, key)
    d = beats.join(t, key).withColumn("r", pearson(F.transform("window", lambda x: x.cast("double")), F.col("template")))
    return d.withColumn("outlier", F.coalesce(F.col("r") < OUTLIER_R, F.lit(False))).drop("template")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(e))
