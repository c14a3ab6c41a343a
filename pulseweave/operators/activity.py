"""Activity profiles and metrics derived from interval series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Built-in profiles (key, name, expected rate range, most excluded share that can still be analysed).
PROFILES = (
    ("supine", "Lying down (supine)", 40, 80, None),
    ("sitting", "Sitting", 50, 90, None),
    ("standing", "Standing", 55, 105, None),
    ("walking", "Walking", 70, 125, None),
    ("running", "Running", 110, 195, None),
    ("cycling", "Cycling", 100, 190, None),
    ("swimming", "Swimming", 90, 175, 0.30),
    ("recovery", "Recovery (post-exercise)", 60, 150, None),
    ("sleep", "Sleep (overnight)", 35, 90, 0.50),
)
#: Share of the heart-rate reserve above which variability is not reported.
SUPPRESS_RESERVE = 0.70
ZONES = (50.0, 60.0, 70.0, 80.0, 90.0)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "profile string, name string, expected_min int, expected_max int, max_excluded double")


def resolve(types: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Activity types with their profile's range where they have none of their own; 0 counts as none."""
    p = profile_rows.select("profile", F.col("expected_min").alias("_lo"), F.col("expected_max").alias("_hi"))
    out = types.join(F.broadcast(p), "profile", "left")  # nine profiles
    keep = lambda own, base: F.coalesce(F.when(F.col(own) != 0, F.col(own)), F.col(base))
    return out.withColumns({"expected_hr_min": keep("expected_hr_min", "_lo"), "expected_hr_max": keep("expected_hr_max", "_hi")}).drop("_lo", "_hi")


def effective_max_hr(measured: Column, age: Column) -> Column:
    return F.coalesce(F.when(measured != 0, measured.cast("double")), 208 - 0.7 * age, F.lit(185.0))


def effective_rest(measured: Column) -> Column:
    return F.coalesce(F.when(measured != 0, measured.cast("double")), F.lit(60.0))


def reserve(hr: Column, rest: Column, most: Column) -> Column:
    return F.greatest(F.lit(0.0), (hr - rest) / F.greatest(F.lit(1.0), most - rest))


def suppress(df: DataFrame, when: Column, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def hr_trend(rr: DataFrame, after: float | None = None, least: int = 30) -> DataFrame:
    """Slope of the rate in bpm a minute; ``after`` leaves out the first seconds (drift)."""
    t0 = F.min("t_s").over(Window.partitionBy("session_id"))
    d = rr.withColumn("_x", F.col("t_s") - t0)
    d = d.where(F.col("_x") >= after) if after is not None else d
    return d.groupBy("session_id").agg((F.regr_slope(60000.0 / F.col("rr_ms"), F.col("t_s")) * 60.0).alias("bpm_per_min"), F.count("*").alias("n")).where(F.col("n") >= least)


def settling(per_minute: DataFrame, limit: float = 0.5) -> DataFrame:
    """The first minute (with two more behind it) from which the rate's slope stays within ``limit`` bpm a minute, and the mean rate from there."""
    tail = Window.partitionBy("session_id").orderBy("window").rowsBetween(0, Window.unboundedFollowing)
    d = per_minute.withColumns({"_s": F.regr_slope(F.col("hr_bpm"), F.col("window").cast("double")).over(tail), "_m": F.avg("hr_bpm").over(tail), "_n": F.count("*").over(tail)})
    ok = (F.col("_n") >= 3) & (F.abs("_s") <= limit)
    return d.where(ok).groupBy("session_id").agg(F.min("window").alias("settled_window"), F.min_by("_m", "window").alias("settled_hr_bpm"))


def zones(rr: DataFrame, max_hr: Column) -> DataFrame:
    """Share of time by percent of the greatest rate."""
    pct = 100.0 * (60000.0 / F.col("rr_ms")) / max_hr
    zone = sum([F.when(pct >= z, 1).otherwise(0) for z in ZONES], F.lit(0))
    z = rr.withColumn("zone", zone).groupBy("session_id", "zone").agg(F.sum("rr_ms").alias("_t"))
    return z.select("session_id", "zone", (F.col("_t") / F.sum("_t").over(Window.partitionBy("session_id"))).alias("fraction"))


def recovery(rr: DataFrame, peaks: DataFrame, seconds: Sequence[int] = (60, 120)) -> DataFrame:
    """Peak rate less the mean rate around ``seconds`` after the peak (a window of 20 s, three beats)."""
    d = rr.join(peaks, "session_id")
    aggs = []
    for s in seconds:
        inside = (F.col("t_s") >= F.col("peak_end_s") + s - 10) & (F.col("t_s") < F.col("peak_end_s") + s + 10)
        aggs.append(F.when(F.count_if(inside) >= 3, F.max("peak_hr_bpm") - 60000.0 / F.avg(F.when(inside, F.col("rr_ms")))).alias(f"hrr{s}"))
    return d.groupBy("session_id").agg(*aggs)


def motion_coupling(beats_hr: DataFrame, windows: DataFrame, width: float = 5.0) -> DataFrame:
    """Correlation of a window's movement with the mean rate in it: three beats a window, six windows, both varying."""
    h = beats_hr.withColumn("k", F.floor(F.col("t_s") / width).cast("long")).groupBy("session_id", "k").agg((60000.0 / F.avg("rr_ms")).alias("_hr"), F.count("*").alias("_n")).where(F.col("_n") >= 3)
    j = h.join(windows.select("session_id", "k", "movement"), ["session_id", "k"]).where(F.col("movement").isNotNull())
    ok = (F.count("*") >= 6) & (F.stddev_pop("_hr") > 0) & (F.stddev_pop("movement") > 0)
    return j.groupBy("session_id").agg(F.count("*").alias("n_windows"), F.when(ok, F.corr("_hr", "movement")).alias("r"))


def orthostatic(rr: DataFrame, markers: DataFrame) -> DataFrame:
    """Rate from 5 to 65 s after the first marker of standing, less that of the minute before; five beats on either side."""
    m = markers.groupBy("session_id").agg(F.min("t_s").alias("_m"))
    d = rr.join(m, "session_id").withColumn("_x", F.col("t_s") - F.col("_m"))
    before, after = (F.col("_x") >= -60) & (F.col("_x") < 0), (F.col("_x") >= 5) & (F.col("_x") < 65)
    mean = lambda c: F.when(F.count_if(c) >= 5, 60000.0 / F.avg(F.when(c, F.col("rr_ms"))))
    return d.groupBy("session_id").agg(mean(before).alias("before_bpm"), mean(after).alias("after_bpm")).withColumn("rise_bpm", F.col("after_bpm") - F.col("before_bpm"))


def orthostatic_step(per_minute: DataFrame, rise: float = 8.0) -> DataFrame:
    """Without a marker: the greatest rise between minutes that is at least ``rise`` and keeps half of itself a minute later."""
    w = Window.partitionBy("session_id").orderBy("window")
    d = per_minute.withColumns({"_b": F.lag("hr_bpm").over(w), "_a": F.lead("hr_bpm").over(w)}).withColumn("step_bpm", F.col("hr_bpm") - F.col("_b"))
    d = d.where((F.col("step_bpm") >= rise) & (F.col("_a") > F.col("_b") + 0.5 * F.col("step_bpm")))
    return d.groupBy("session_id").agg(F.max(F.struct("step_bpm", (-F.col("window")).alias("w"))).alias("m")).select("session_id", F.col("m.step_bpm").alias("step_bpm"), (-F.col("m.w")).alias("window"))




def reactivation_slope(per_minute: DataFrame, least: int = 3) -> DataFrame:
    """ms a minute by which RMSSD by minute (session_id, window, rmssd_ms) rises; null under ``least`` minutes."""
    return per_minute.groupBy("session_id").agg(F.when(F.count("*") >= least, F.regr_slope("rmssd_ms", "window")).alias("slope_ms_per_min"))


def excluded_fraction(totals: DataFrame) -> DataFrame:
    """Adds excluded_fraction to excluded_s and analysed_s; 0 without any time."""
    t = F.col("excluded_s") + F.col("analysed_s")
    return totals.withColumn("excluded_fraction", F.when(t > 0, F.col("excluded_s") / t).otherwise(0.0))


# What a profile's figures must be read with care for.
CAUTIONS = {"cycling": ("frequency",), "recovery": ("time", "frequency"), "running": ("frequency",), "sleep": ("frequency", "nonlinear"), "standing": ("time", "frequency"), "walking": ("frequency",)}


def cautions(sessions: DataFrame) -> DataFrame:
    """Adds cautions to sessions (profile_key, paced): those of the profile, and frequency where breathing is paced."""
    own = F.create_map(*[x for k, v in CAUTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return sessions.withColumn("cautions", F.array_sort(F.array_union(F.coalesce(F.try_element_at(own, F.col("profile_key")), none), F.when(F.col("paced"), F.array(F.lit("frequency"))).otherwise(none))))
