"""Screening flags: sustained high or low rate, ectopy, irregularity.  Screening only, never a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, half_away
from .series import by_session, islands, true_runs

# Sustained-rate limits in bpm.
TACHY_BPM, BRADY_BPM, ATHLETE_BRADY_BPM = 100.0, 60.0, 45.0
SLEEP_BRADY_BPM, SLEEP_ATHLETE_BRADY_BPM = 40.0, 35.0
# Ectopy share (percent), bigeminy length, irregularity.
ECTOPY_PCT, BIGEMINY_BEATS = 1.0, 3
COSEN_LIMIT, CV_LIMIT, IRREGULAR_WINDOWS = -1.0, 0.10, 3
# Phrases that no description may have.
BANNED_PHRASES = ("you have", "indicates", "indicative of", "abnormal", "pvc", "premature ventricular", "premature atrial", "diagnos")

DISCLAIMER = "Screening observation from single-lead data; it supports no conclusion about health."


def sustained(windows: DataFrame, kind: str, limit: Column | float, width: float = 45.0) -> DataFrame:
    """session_id, kind, worst_bpm, n_windows, spans: sessions with windows (window_start_s, hr_bpm) across the limit; overlapping windows are one span."""
    high = kind == "sustained_high_hr"
    across = windows.where(F.col("hr_bpm") > limit if high else F.col("hr_bpm") < limit).select("session_id", F.col("window_start_s").alias("start_s"), (F.col("window_start_s") + width).alias("end_s"), "hr_bpm")
    spans = merge_spans(across, F.max("hr_bpm").alias("worst") if high else F.min("hr_bpm").alias("worst"), F.count("*").alias("n"))
    worst = F.max("worst") if high else F.min("worst")
    return spans.groupBy("session_id").agg(
        F.lit(kind).alias("kind"), half_away(worst, 1).alias("worst_bpm"), F.sum("n").alias("n_windows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))), lambda s: F.concat(fixed(s["start_s"]), F.lit("-"), fixed(s["end_s"]))), ",").alias("spans"),
    )


def merge_spans(spans: DataFrame, *aggregates: Column) -> DataFrame:
    """Spans (session_id, start_s, end_s) that overlap or touch become one."""
    w = by_session("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    d = islands(spans, F.col("start_s") > F.max("end_s").over(w), ["start_s", "end_s"])
    return d.groupBy("session_id", "run_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), *aggregates).drop("run_id")


def irregularity(windows: DataFrame) -> DataFrame:
    """Sessions with at least three consecutive windows (session_id, k, has_seam, cosen, cv) that are irregular; a window over a seam breaks a run."""
    odd = ~F.col("has_seam") & (F.col("cosen") > COSEN_LIMIT) & (F.col("cv") > CV_LIMIT)
    runs = true_runs(windows, odd, ["k"])
    return runs.groupBy("session_id").agg(F.max("size").alias("longest_run"), F.count("*").alias("n_runs")).where(F.col("longest_run") >= IRREGULAR_WINDOWS)


def ectopy(burden: DataFrame, bigeminy: DataFrame) -> DataFrame:
    """Sessions whose ectopy share is over the limit or with bigeminy."""
    b = bigeminy.groupBy("session_id").agg(F.max("n_beats").alias("longest_bigeminy"))
    out = burden.join(b, "session_id", "left").withColumn("longest_bigeminy", F.coalesce("longest_bigeminy", F.lit(0)).cast("long"))
    return out.where((F.col("pct") > ECTOPY_PCT) | (F.col("longest_bigeminy") >= BIGEMINY_BEATS)).select("session_id", "n", "pct", "longest_bigeminy")


def flag(df: DataFrame, kind: str, severity: str, description: Column, evidence: Column, threshold: Column) -> DataFrame:
    """One row a flag; every flag carries the disclaimer, and a description with a banned phrase is an error."""
    stop = F.raise_error(F.concat(F.lit("banned phrase in a description: "), description)).cast("string")
    checked = F.when(F.size(banned(description)) > 0, stop).otherwise(description)
    return df.select("session_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), checked.alias("description"), F.to_json(evidence).alias("evidence"), F.to_json(threshold).alias("threshold"), F.lit(DISCLAIMER).alias("disclaimer"))


def banned(text: Column) -> Column:
    """The banned phrases in a text, case apart, as an array."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, BANNED_PHRASES)), lambda p: F.contains(low, p))


def hr_limits(profile: Column, max_hr: Column, athlete: Column) -> Column:
    """struct<tachy_bpm, brady_bpm> of an activity profile.  Fixed values: limits by activity."""
    brady = F.when(athlete, ATHLETE_BRADY_BPM).otherwise(BRADY_BPM)
    asleep = F.when(athlete, SLEEP_ATHLETE_BRADY_BPM).otherwise(SLEEP_BRADY_BPM)
    tachy = F.when(profile == "standing", 115.0).when(profile == "walking", 135.0).when(profile.isin("running", "cycling", "swimming"), max_hr).when(profile == "recovery", 130.0).otherwise(TACHY_BPM)
    low = F.when(profile == "sleep", asleep).when(profile.isin("walking", "running", "cycling", "swimming"), 50.0).when(profile == "recovery", 45.0).otherwise(brady)
    return F.struct(tachy.alias("tachy_bpm"), low.alias("brady_bpm"))
