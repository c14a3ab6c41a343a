"""Irregular series: intervals with seams, islands, interval joins, nearest joins, anchored windows.

A session is the unit of all windows.  Sessions are bounded (a night has some
35,000 intervals); parallelism comes from their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals outside are not physiological (ms).
FLOOR_MS, CEILING_MS = 300.0, 2200.0


def by_session(*order: str, keys: Sequence[str] = ("session_id",)):
    return Window.partitionBy(*keys).orderBy(*order)


def bucketed(df: DataFrame, start: Column, end: Column, width: float, name: str = "bucket") -> DataFrame:
    """A row for each bucket of ``width`` that an interval touches; intervals that end before they start are left out."""
    return df.where(start <= end).withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "left_anti", width: float = 5.0, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Rows of ``left`` (start_s, end_s) without, or with, an overlap of open intervals with ``right`` (start_s, end_s).

    An equi-join on buckets of time instead of a nested loop.
    """
    l = bucketed(left.withColumn("_row", F.struct(*left.columns)), F.col("start_s"), F.col("end_s"), width).select(*keys, "bucket", "_row")
    r = bucketed(right.select(*keys, "start_s", "end_s"), F.col("start_s"), F.col("end_s"), width).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("bucket").alias("_r_bucket"), F.col("start_s").alias("_rs"), F.col("end_s").alias("_re"))
    cond = F.col("bucket") == F.col("_r_bucket")
    for k in keys:
        cond &= F.col(k) == F.col(f"_r_{k}")
    cond &= (F.col("_row.start_s") < F.col("_re")) & (F.col("_row.end_s") > F.col("_rs"))
    hit = l.join(r, cond, "left_semi").select("_row").distinct()
    if how == "left_semi":
        return hit.select("_row.*")
    return left.withColumn("_row", F.struct(*left.columns)).join(hit, "_row", "left_anti").drop("_row")


def intervals(beats: DataFrame) -> DataFrame:
    """session_id, n, start_s, end_s, rr_ms: consecutive differences of beats (session_id, beat, t_s), stamped at the ending beat."""
    w = by_session("beat")
    return (
        beats.select("session_id", F.col("beat").alias("n"), F.lag("t_s").over(w).alias("start_s"), F.col("t_s").alias("end_s"))
        .where(F.col("start_s").isNotNull())
        .withColumn("rr_ms", (F.col("end_s") - F.col("start_s")) * 1000.0)
    )


def judged_intervals(beats: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds fate: excluded (overlaps an excluded segment), ceiling, floor, or kept, in this order."""
    rr = intervals(beats)
    hit = overlap_join(rr, excluded, "left_semi").select("session_id", "n", F.lit(True).alias("_hit"))
    fate = F.when(F.col("_hit"), "excluded").when(F.col("rr_ms") > CEILING_MS, "ceiling").when(F.col("rr_ms") < FLOOR_MS, "floor").otherwise("kept")
    return rr.join(hit, ["session_id", "n"], "left").withColumn("fate", fate).drop("_hit")


def build_rr(beats: DataFrame, excluded: DataFrame) -> DataFrame:
    """session_id, n, t_s, rr_ms, discontinuity: the kept intervals; a seam follows what was dropped."""
    kept = judged_intervals(beats, excluded).where(F.col("fate") == "kept")
    seam = F.coalesce(F.col("n") - F.lag("n").over(by_session("n")) > 1, F.lit(False))
    return kept.select("session_id", "n", F.col("end_s").alias("t_s"), "rr_ms", seam.alias("discontinuity"))


def drop_counts(beats: DataFrame, excluded: DataFrame) -> DataFrame:
    j = judged_intervals(beats, excluded)
    return j.groupBy("session_id").agg(*[F.count_if(F.col("fate") == f).alias(n) for f, n in (("kept", "n_kept"), ("excluded", "dropped_excluded"), ("ceiling", "dropped_ceiling"), ("floor", "dropped_floor"))])


def differences(rr: DataFrame) -> DataFrame:
    """Adds d_ms, the successive difference; null over a seam and for the first."""
    return rr.withColumn("d_ms", F.when(~F.col("discontinuity"), F.col("rr_ms") - F.lag("rr_ms").over(by_session("n"))))


def islands(df: DataFrame, starts: Column, order: Sequence[str], keys: Sequence[str] = ("session_id",), name: str = "run_id") -> DataFrame:
    """Numbers runs from 1; a run begins where ``starts`` is true."""
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(by_session(*order, keys=keys).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def runs(rr: DataFrame, least: int = 4) -> DataFrame:
    """Contiguous runs of at least ``least`` intervals: session_id, run_id, n_beats, start_s, end_s."""
    r = islands(rr, F.col("discontinuity"), ["n"])
    return r.groupBy("session_id", "run_id").agg(F.count("*").alias("n_beats"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s")).where(F.col("n_beats") >= least)


def true_runs(df: DataFrame, flag: Column, order: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Runs of consecutive rows where ``flag`` is true: keys, run_id, size and the first and last of the first order column."""
    k = order[0]
    f = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    f = islands(f, F.col("_f") != F.coalesce(F.lag("_f").over(by_session(*order, keys=keys)), F.lit(False)), order, keys).where("_f")
    return f.groupBy(*keys, "run_id").agg(F.count("*").alias("size"), F.min(k).alias(f"first_{k}"), F.max(k).alias(f"last_{k}"))


def nearest(left: DataFrame, right: DataFrame, tolerance: float, value: str = "value", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Each left row (t_s) with the nearest right row (t_s, value) within ``tolerance``; the earlier one on ties.

    A union and two running values; nothing is joined.
    """
    l = left.withColumn("_row", F.struct(*left.columns)).select(*keys, "t_s", F.lit(1).alias("_side"), "_row", F.lit(None).cast("struct<t:double,v:double>").alias("_r"))
    r = right.select(*keys, "t_s", F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), F.struct(F.col("t_s").alias("t"), F.col(value).cast("double").alias("v")).alias("_r"))
    u = l.unionByName(r)
    back = by_session("t_s", "_side", keys=keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_session("t_s", F.desc("_side"), keys=keys).rowsBetween(0, Window.unboundedFollowing)
    u = u.withColumns({"_b": F.last("_r", True).over(back), "_a": F.first("_r", True).over(ahead)}).where("_side = 1")
    db, da = F.abs(F.col("t_s") - F.col("_b.t")), F.abs(F.col("t_s") - F.col("_a.t"))
    pick = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.col("_b")).otherwise(F.col("_a"))
    u = u.withColumn("_n", pick).withColumn("distance_s", F.abs(F.col("t_s") - F.col("_n.t")))
    return u.where(F.col("distance_s") <= tolerance).select("_row.*", F.col("_n.v").alias("nearest_value"), "distance_s")


def anchored(df: DataFrame, width: float, name: str = "window", t: str = "t_s") -> DataFrame:
    """Tumbling windows of ``width`` seconds that begin at a session's first row."""
    t0 = F.min(t).over(Window.partitionBy("session_id"))
    return df.withColumn("_t0", t0).withColumn(name, F.floor((F.col(t) - F.col("_t0")) / width)).withColumn("window_start_s", F.col("_t0") + F.col(name) * width).drop("_t0")


def sliding(df: DataFrame, width: float, step: float, t: str = "t_s", over: float | None = None, order: str | None = None) -> DataFrame:
    """Rows in each half-open window [start, start + width) that holds them; starts are t0 + k * step.

    The last start is at most t1 - width + ``over`` (``step`` by default).  Each
    row is repeated for its windows, so one grouping serves all windows.  Rows
    of a session come sorted by ``order``, if given; a grouping by session and
    window needs no shuffle and adds them up so, to the last bit.
    """
    over = step if over is None else over
    w = Window.partitionBy("session_id") if order is None else by_session(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"_t0": F.min(t).over(w), "_t1": F.max(t).over(w)}).withColumn("_x", F.col(t) - F.col("_t0"))
    low = F.greatest(F.lit(0), F.floor((F.col("_x") - width) / step) + 1)
    high = F.floor(F.col("_x") / step)
    d = d.withColumns({"_lo": low.cast("long"), "_hi": high.cast("long")}).where("_lo <= _hi").withColumn("window", F.explode(F.sequence("_lo", "_hi")))
    d = d.withColumn("window_start_s", F.col("_t0") + F.col("window") * step)
    return d.where(F.col("window_start_s") <= F.col("_t1") - width + over).drop("_t0", "_t1", "_x", "_lo", "_hi")
