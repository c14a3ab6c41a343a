"""Ectopic beats: confirmation, events, pauses, burden, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import CEILING_MS, FLOOR_MS, by_session, islands

PREMATURE_PCT = -20.0
FULL_PAUSE = 0.95


def confirm(candidates: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, beat of confirmed ectopic beats.

    ``candidates`` (session_id, beat) come from an artifact correction, which
    may name the beat or its successor: of beats i - 1 and i the more premature
    (the first on ties) is confirmed if it is premature by 20 % or more and not
    explained by motion.  ``beats`` has session_id, beat, prematurity_pct, motion.
    """
    two = candidates.select("session_id", F.col("beat").alias("i"), F.explode(F.array(F.col("beat") - 1, F.col("beat"))).alias("beat"))
    found = two.join(beats, ["session_id", "beat"]).where(F.col("prematurity_pct").isNotNull())
    best = found.groupBy("session_id", "i").agg(F.min(F.struct("prematurity_pct", "beat", "motion")).alias("m"))
    return best.where((F.col("m.prematurity_pct") <= PREMATURE_PCT) & ~F.coalesce(F.col("m.motion"), F.lit(False))).select("session_id", F.col("m.beat").alias("beat")).distinct()


def groups(beats: DataFrame) -> DataFrame:
    """Runs of consecutive beats: session_id, start_beat, end_beat, n_ectopic, kind (single, couplet, run)."""
    g = beats.withColumn("_g", F.col("beat") - F.row_number().over(by_session("beat")))
    g = g.groupBy("session_id", "_g").agg(F.min("beat").alias("start_beat"), F.max("beat").alias("end_beat"), F.count("*").alias("n_ectopic")).drop("_g")
    return g.withColumn("kind", F.when(F.col("n_ectopic") >= 3, "run").when(F.col("n_ectopic") == 2, "couplet").otherwise("single"))


def local_reference(events: DataFrame, rr: DataFrame, around: int = 10) -> DataFrame:
    """Adds reference_ms to events (session_id, start_beat, end_beat): the median of the physiological intervals near them, null with under three.

    Near are up to ``around`` intervals before and after those that touch the
    event.  Interval n of ``rr`` (session_id, n, rr_ms) ends at beat n, so
    intervals start_beat to end_beat + 1 touch it.  Only intervals near an
    event are grouped.
    """
    first, last = F.col("start_beat"), F.col("end_beat") + 1
    n = F.explode(F.concat(F.sequence(first - around, first - 1), F.sequence(last + 1, last + around)))
    e = events.select("session_id", "start_beat", "end_beat").distinct()
    near = e.withColumn("n", n).join(rr.select("session_id", "n", "rr_ms").where(F.col("rr_ms").between(FLOOR_MS, CEILING_MS)), ["session_id", "n"])
    ref = near.groupBy("session_id", "start_beat", "end_beat").agg(F.percentile("rr_ms", F.lit(0.5)).alias("reference_ms"), F.count("*").alias("_k"))
    return events.join(ref.where("_k >= 3").drop("_k"), ["session_id", "start_beat", "end_beat"], "left")


def pauses(events: DataFrame, rr: DataFrame) -> DataFrame:
    """Adds pause_ratio, (RR before + RR after) / (2 * reference), and pause_complete to events.

    Null at the edges, outside physiology, and where either interval of ``rr``
    (session_id, n, rr_ms, excluded) overlaps excluded signal.
    """
    ok = F.col("rr_ms").between(FLOOR_MS, CEILING_MS) & ~F.coalesce("excluded", F.lit(False))
    usable = rr.where(ok)
    before = usable.select("session_id", F.col("n").alias("start_beat"), F.col("rr_ms").alias("_pre"))
    after = usable.select("session_id", (F.col("n") - 1).alias("end_beat"), F.col("rr_ms").alias("_post"))
    out = local_reference(events, rr).join(before, ["session_id", "start_beat"], "left").join(after, ["session_id", "end_beat"], "left")
    out = out.withColumn("pause_ratio", F.when(F.col("reference_ms") > 0, (F.col("_pre") + F.col("_post")) / (2 * F.col("reference_ms"))))
    return out.withColumn("pause_complete", F.col("pause_ratio") >= FULL_PAUSE).drop("_pre", "_post", "reference_ms")


def burden(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counts by kind, rate and share for every session of ``sessions`` (session_id, analysed_s, n_beats)."""
    e = events.groupBy("session_id").agg(
        F.sum("n_ectopic").alias("n"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("single", "couplet", "run")],
        F.max("n_ectopic").alias("longest"),
        F.count_if("pause_complete").alias("pauses_complete"),
        F.count_if(~F.col("pause_complete")).alias("pauses_incomplete"),
    )
    counts = [c for c in e.columns if c != "session_id"]
    out = sessions.join(e, "session_id", "left").fillna(0, counts)
    return out.withColumns({"per_hour": F.when(F.col("analysed_s") > 0, F.col("n") / (F.col("analysed_s") / 3600.0)), "pct": F.when(F.col("n_beats") > 0, 100.0 * F.col("n") / F.col("n_beats"))})


def patterns(beats: DataFrame, spacing: int, least: int = 3) -> DataFrame:
    """Chains of ectopic beats exactly ``spacing`` apart (2: bigeminy, 3: trigeminy) of at least ``least`` beats.

    A beat follows the one ``spacing`` before it only if nothing lies between in the sorted list of ectopic beats.
    """
    d = islands(beats, F.col("beat") - F.lag("beat").over(by_session("beat")) != spacing, ["beat"])
    d = d.groupBy("session_id", "run_id").agg(F.min("beat").alias("start_beat"), F.max("beat").alias("end_beat"), F.count("*").alias("n_beats"))
    return d.where(F.col("n_beats") >= least).drop("run_id")


def transitions(df: DataFrame, state: str, order: str, keys=("session_id",)) -> DataFrame:
    """Counts of changes from one state to another between neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state))).groupBy(*keys, "from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
