"""From the intervals of a night to its hypnogram and summary: a dense grid of epochs, windowed features, movement, rules, path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import sleep
from .morphology import softmax
from .quality import mad_threshold
from .series import by_session
from .spectral import BANDS, band_powers

#: Features look at so many epochs on either side.
HALF = 5


def wander_movement(windows: DataFrame) -> DataFrame:
    """session_id, epoch, movement: the mean wander of an epoch's quality windows (session_id, start_s, wander_rms_mv), a coarse stand-in for counts of an accelerometer."""
    w = windows.where(F.col("wander_rms_mv").isNotNull() & ~F.isnan("wander_rms_mv"))
    return w.groupBy("session_id", F.floor(F.col("start_s") / sleep.EPOCH_S).cast("long").alias("epoch")).agg(F.avg("wander_rms_mv").alias("movement"))


def movement(grid: DataFrame, windows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """movement, threshold, source and moving for every epoch of ``grid``.

    Sessions with accelerometer counts (session_id, epoch, counts) go by those,
    others by the wander of their quality windows; the threshold is the median
    and five median deviations of the session's own values.
    """
    proxy = wander_movement(windows).withColumn("source", F.lit("wander_proxy"))
    if counts is not None:
        acc = counts.select("session_id", "epoch", F.col("counts").alias("movement"), F.lit("acc").alias("source"))
        proxy = proxy.join(acc.select("session_id").distinct(), "session_id", "left_anti").union(acc)
    used = grid.join(proxy, ["session_id", "epoch"])
    limits = mad_threshold(used, "movement").select("session_id", "threshold")
    source = used.groupBy("session_id").agg(F.max("source").alias("source"))
    out = grid.join(used.drop("source"), ["session_id", "epoch"], "left").join(limits, "session_id", "left").join(source, "session_id", "left")
    return out.select("session_id", "epoch", "movement", "threshold", F.coalesce("source", F.lit("wander_proxy")).alias("source"), F.coalesce(F.col("movement") > F.col("threshold"), F.lit(False)).alias("moving"))


def lf_hf(grid: DataFrame, powers: DataFrame) -> DataFrame:
    """lf_hf for every epoch: the ratio of mean powers over five epochs on either side that have any."""
    w = by_session("epoch").rowsBetween(-HALF, HALF)
    d = grid.join(powers, ["session_id", "epoch"], "left").withColumns({c: F.avg(c).over(w) for c in ("lf", "hf")})
    return d.select("session_id", "epoch", F.when(F.col("hf") > 0, F.col("lf") / F.col("hf")).alias("lf_hf"))


def features(rr: DataFrame, durations: DataFrame, windows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """All features of every epoch of recordings (session_id, duration_s), from intervals, quality windows and accelerometer counts."""
    grid = sleep.epoch_grid(durations)
    bands = {k: BANDS[k] for k in ("lf", "hf")}
    f = sleep.epoch_features(rr, half=HALF, grid=grid).join(lf_hf(grid, band_powers(rr, bands, sleep.EPOCH_S)), ["session_id", "epoch"])
    return f.join(movement(grid, windows, counts), ["session_id", "epoch"])


def rules(features_: DataFrame) -> DataFrame:
    """session_id, epoch, stage, p: evidence scores as probabilities, the most probable path, and unscored where an epoch has too little signal.

    Epochs without enough signal carry no evidence, so the path bridges them.
    """
    ok = F.coalesce(sleep.stageable(), F.lit(False))
    s = sleep.scores(features_).withColumn("p", F.when(ok, softmax(F.array("s_wake", "s_light", "s_deep", "s_rem"))).otherwise(F.array(*[F.lit(0.25)] * 4)))
    s = s.select("session_id", "epoch", "p", ok.alias("ok"))
    path = sleep.viterbi(s.select("session_id", "epoch", "p"))
    return s.join(path, ["session_id", "epoch"]).select("session_id", "epoch", F.when(F.col("ok"), F.col("stage")).otherwise(sleep.UNSCORED).cast("int").alias("stage"), "p")


@dataclass
class Night:
    """features, hypnogram (stage, p), summary with notes, and plausibility of nights."""

    features: DataFrame
    hypnogram: DataFrame
    summary: DataFrame
    plausibility: DataFrame


def stage(rr: DataFrame, durations: DataFrame, windows: DataFrame, counts: DataFrame | None = None) -> Night:
    """Nights from intervals to summary by the built-in rules; features and hypnogram are written once, for all that reads them."""
    f = written(features(rr, durations, windows, counts), "night-features")
    h = written(rules(f), "hypnogram")
    summary, shares = sleep.summarize(h), sleep.stage_shares(h)
    said = f.join(h.select("session_id", "epoch", "stage"), ["session_id", "epoch"]).groupBy("session_id").agg(F.count_if(F.col("stage") == sleep.UNSCORED).alias("n_unscored"), F.max("source").alias("source"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("n_unscored") > 0, F.concat(F.col("n_unscored").cast("string"), F.lit(" epochs had too little usable signal"))),
            F.when(F.col("source") == "wander_proxy", F.lit("movement is approximated by baseline wander")),
        )
    )
    return Night(f, h, summary.join(said, "session_id").withColumn("notes", notes), sleep.plausibility(summary, shares=shares))
