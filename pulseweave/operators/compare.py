"""Comparison of sessions, trends with bands, and data behind the report's figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(sessions: DataFrame, metrics: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Long rows (keys, order, metric, value, delta): each metric and its difference from the earliest session."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    long = sessions.unpivot([*keys, *order], list(metrics), "metric", "value")
    w = Window.partitionBy(*keys, "metric").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return long.withColumn("delta", F.col("value") - F.first("value").over(w))


def trend(sessions: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], last: int = 5, least: int = 3) -> DataFrame:
    """Band of mean +- 1.96 sd over the last five sessions, from the fifth on, with three values at least."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = w.rowsBetween(1 - last, 0)
    ok = (F.row_number().over(w) >= last) & (F.count(value).over(r) >= least)
    mean, sd = F.avg(value).over(r), F.stddev_samp(value).over(r)
    return sessions.withColumns({"baseline": F.when(ok, mean), "low": F.when(ok, mean - 1.96 * sd), "high": F.when(ok, mean + 1.96 * sd), "provisional": F.count("*").over(Window.partitionBy(*keys)) < last})


def guards(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What speaks against comparing a set of sessions (comparison_key, duration_s, done, reduced_confidence), as an array."""
    a = sessions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("done")).alias("_open"), F.count_distinct("comparison_key").alias("_keys"),
        F.max("duration_s").alias("_hi"), F.min("duration_s").alias("_lo"), F.max(F.col("reduced_confidence").cast("int")).alias("_rc"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("n") < 2, "fewer than two sessions"), F.when(F.col("_open") > 0, "unfinished session"), F.when(F.col("_keys") > 1, "mixed activities"),
            F.when((F.col("_lo") > 0) & (F.col("_hi") / F.col("_lo") > 1.25), "durations differ"), F.when(F.col("_rc") == 1, "reduced confidence"),
        )
    )
    return a.select(*keys, "n", warnings.alias("warnings"), (F.size(F.array_intersect(warnings, F.array(F.lit("fewer than two sessions"), F.lit("unfinished session"), F.lit("mixed activities")))) == 0).alias("comparable"))


def decimate(df: DataFrame, x: str, y: str, buckets: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The least and greatest y of each of ``buckets`` equal runs of rows, for drawing."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(x)) - 1
    d = df.withColumn("bucket", F.floor(i * buckets / F.count("*").over(w)).cast("long"))
    return d.groupBy(*keys, "bucket").agg(F.min(y).alias("low"), F.max(y).alias("high"))


def minute_table(rr: DataFrame, segments: DataFrame) -> DataFrame:
    """Per bucket of one minute (five in recordings over three hours): rate (five beats a minute at least) and excluded seconds."""
    ends = rr.groupBy("session_id").agg(F.max("t_s").alias("_end"))
    ends = ends.withColumn("width", F.when(F.col("_end") > 180 * 60, 5).otherwise(1)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.floor(F.col("_end") / (60 * F.col("width"))).cast("int"))))
    beats = rr.join(ends.select("session_id", "width").distinct(), "session_id").withColumn("bucket", F.floor(F.col("t_s") / (60 * F.col("width"))).cast("int"))
    beats = beats.groupBy("session_id", "bucket").agg(F.count("*").alias("n_beats"), (60000.0 / F.avg("rr_ms")).alias("_hr"))
    s = segments.join(ends.select("session_id", "width").distinct(), "session_id").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_s") / (60 * F.col("width"))).cast("int"), F.floor(F.col("end_s") / (60 * F.col("width"))).cast("int"))))
    over = F.greatest(F.lit(0.0), F.least(F.col("end_s"), (F.col("bucket") + 1) * 60.0 * F.col("width")) - F.greatest(F.col("start_s"), F.col("bucket") * 60.0 * F.col("width")))
    s = s.groupBy("session_id", "bucket").agg(F.sum(over).alias("excluded_s"))
    out = ends.drop("_end").join(beats, ["session_id", "bucket"], "left").join(s, ["session_id", "bucket"], "left")
    return out.select("session_id", "bucket", "width", F.coalesce("n_beats", F.lit(0)).alias("n_beats"), F.when(F.col("n_beats") >= 5 * F.col("width"), F.col("_hr")).alias("hr_bpm"), F.coalesce("excluded_s", F.lit(0.0)).alias("excluded_s"))
