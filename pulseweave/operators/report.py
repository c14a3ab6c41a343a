"""Data behind a report: the table of minutes, strips of signal around chosen places, the least likely beats, steps of stages, rows of a comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import compare, hrv
from .series import bucketed, by_session, islands

# Length of a strip (s), samples it needs, beats shown beside the mean beat.
STRIP_S, LEAST_SAMPLES, MOST_OUTLIERS = 10.0, 10, 60


def minutes(rr: DataFrame, segments: DataFrame, windows: DataFrame) -> DataFrame:
    """``compare.minute_table`` with sdnn_ms, rmssd_ms (means of the minutes that begin in a row) and sqi (mean of the quality windows that do)."""
    base = compare.minute_table(rr, segments)
    start = rr.groupBy("session_id").agg(F.min("t_s").alias("_t0"))
    width = base.select("session_id", "width").distinct()

    def means(df: DataFrame, at: Column, value: str, out: str) -> DataFrame:
        d = df.join(width, "session_id").withColumn("bucket", F.floor(at / (60.0 * F.col("width"))).cast("int"))
        return d.where(F.col(value).isNotNull()).groupBy("session_id", "bucket").agg(F.avg(value).alias(out))

    begin = F.col("_t0") + 60.0 * F.col("window")
    parts = (
        means(hrv.windowed_sdnn(rr).join(start, "session_id"), begin, "sdnn_ms", "sdnn_ms"),
        means(hrv.per_minute_rmssd(rr).join(start, "session_id"), begin, "rmssd_ms", "rmssd_ms"),
        means(windows, F.col("start_s"), "sqi_mean", "sqi"),
    )
    for p in parts:
        base = base.join(p, ["session_id", "bucket"], "left")
    return base


def least_likely(beats: DataFrame, value: str, n: int = MOST_OUTLIERS, keys: Sequence[str] = ("session_id",), tie: str = "beat") -> DataFrame:
    """The n rows of least ``value`` of each group with their place; nulls take no part.

    Tasks keep n rows of a group before anything is shuffled, so no group is brought together.
    """
    w = Window.partitionBy(*keys).orderBy(value, tie)
    return beats.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def places(durations: DataFrame, worst: DataFrame, length: float = STRIP_S) -> DataFrame:
    """session_id, label, start_s, end_s of the strips of recordings (session_id, duration_s): opening; closing beyond two lengths, middle beyond three; and around the worst beat (session_id, t_s), moved inside."""
    d = F.col("duration_s")
    put = lambda label, at, when: F.when(when, F.struct(F.lit(label).alias("label"), at.alias("start_s")))
    fixed = F.array_compact(F.array(put("opening", F.lit(0.0), F.lit(True)), put("middle", (d - length) / 2.0, d > 3 * length), put("closing", d - length, d > 2 * length)))
    out = durations.select("session_id", "duration_s", F.inline(fixed))
    around = durations.join(worst.select("session_id", "t_s"), "session_id").select("session_id", "duration_s", F.lit("worst").alias("label"), F.greatest(F.lit(0.0), F.least(F.col("t_s") - length / 2.0, d - length)).alias("start_s"))
    return out.union(around).select("session_id", "label", "start_s", (F.col("start_s") + F.least(F.lit(length), d)).alias("end_s"))


def strips(samples: DataFrame, where: DataFrame, length: float = STRIP_S) -> DataFrame:
    """session_id, label, i, at_s, x: the samples (session_id, i, t_s, x) of each strip, from its start; strips of under ten samples are left out.

    An equi-join on buckets of time: only the samples around the strips are kept, and no recording is held.
    """
    cut = bucketed(where, F.col("start_s"), F.col("end_s"), length).select("session_id", "bucket", "label", "start_s", "end_s")
    s = samples.select("session_id", "i", "t_s", "x").withColumn("bucket", F.floor(F.col("t_s") / length))
    hit = s.join(cut, ["session_id", "bucket"]).where((F.col("t_s") >= F.col("start_s")) & (F.col("t_s") < F.col("end_s")))
    n = F.count("*").over(Window.partitionBy("session_id", "label"))
    return hit.withColumn("_n", n).where(F.col("_n") >= LEAST_SAMPLES).select("session_id", "label", "i", (F.col("t_s") - F.col("start_s")).alias("at_s"), "x")


def steps(epochs: DataFrame, value: str, epoch_s: float = 30.0) -> DataFrame:
    """session_id, value, start_s, end_s, epochs: runs of neighbouring epochs of equal value (a stage, a posture), for step lines and bands; a gap of epochs ends a run."""
    w = by_session("epoch")
    new = ~(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag("epoch").over(w) == F.col("epoch") - 1))
    d = islands(epochs, new, ["epoch"])
    return d.groupBy("session_id", "run_id").agg(F.first(value).alias(value), (F.min("epoch") * epoch_s).alias("start_s"), ((F.max("epoch") + 1) * epoch_s).alias("end_s"), F.count("*").alias("epochs")).drop("run_id")


# The rows of a comparison (column, label, unit).
ROWS = (
    ("analysed_min", "Duration analysed", "min"), ("excluded_s", "Excluded time", "s"), ("pct_corrected", "Beats corrected", "%"), ("mean_hr_bpm", "Mean HR", "bpm"),
    ("ectopy_per_hour", "Ectopic beats", "/h"), ("resting_hr_bpm", "Resting HR (lowest sustained)", "bpm"), ("rmssd_ms", "RMSSD", "ms"), ("ln_rmssd", "ln(RMSSD)", "ln ms"),
    ("sdnn_ms", "SDNN (whole record)", "ms"), ("pnn50_pct", "pNN50", "%"), ("sd1_ms", "SD1", "ms"), ("sd2_ms", "SD2", "ms"), ("sd1_sd2_ratio", "SD1/SD2", ""),
    ("sampen", "Sample entropy", ""), ("dfa_alpha1", "DFA α1", ""), ("lf_hf", "LF/HF", ""),
)


def comparison(sessions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, order, place, metric, label, unit, value, delta: sixteen rows for each session (analysed_s and the columns of ROWS but analysed_min and ln_rmssd) and the difference from the first one's."""
    d = sessions.withColumns({"analysed_min": F.when(F.col("analysed_s") != 0, F.col("analysed_s") / 60.0), "ln_rmssd": F.when(F.col("rmssd_ms") > 0, F.ln("rmssd_ms"))})
    d = d.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c, _, _ in ROWS])
    long = compare.deltas(d, [c for c, _, _ in ROWS], keys, order)
    about = F.create_map(*[x for i, (c, label, unit) in enumerate(ROWS) for x in (F.lit(c), F.struct(F.lit(i + 1).alias("place"), F.lit(label).alias("label"), F.lit(unit).alias("unit")))])
    return long.withColumn("_a", about[F.col("metric")]).select(*keys, *order, "_a.place", "metric", "_a.label", "_a.unit", "value", "delta")
