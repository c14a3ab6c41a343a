"""Accelerometer epochs: magnitude, activity counts, posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Posture codes in order of precedence, angles in degrees, gravity in mg.
POSTURES = ("supine", "prone", "left", "right", "upright")
UPRIGHT_DEG, SUPINE_DEG, PRONE_DEG = 40.0, 45.0, 135.0
GRAVITY_MG = (700.0, 1300.0)
COVERAGE = 0.5


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def activity_counts(acc: DataFrame, rate: float, epoch_s: float = 30.0, offset: float = 0.0) -> DataFrame:
    """session_id, epoch, counts = sum |a| / rate, coverage; counts are null under half coverage.  ``acc`` has session_id, t_s, a (band-passed)."""
    e = acc.withColumn("epoch", F.floor((F.col("t_s") + offset) / epoch_s).cast("long")).groupBy("session_id", "epoch")
    e = e.agg((F.sum(F.abs("a")) / rate).alias("_c"), (F.count("a") / (rate * epoch_s)).alias("coverage"))
    return e.select("session_id", "epoch", F.when(F.col("coverage") >= COVERAGE, F.col("_c")).alias("counts"), "coverage")


def classify(epochs: DataFrame) -> DataFrame:
    """Adds posture to epochs (gx, gy, gz in mg, coverage, counts, threshold)."""
    g = magnitude(F.col("gx"), F.col("gy"), F.col("gz"))
    phi = F.degrees(F.atan2("gx", "gz"))
    known = (F.col("coverage") >= COVERAGE) & (g >= GRAVITY_MG[0]) & (g <= GRAVITY_MG[1])
    lying = F.when(F.abs(phi) <= SUPINE_DEG, "supine").when(F.abs(phi) >= PRONE_DEG, "prone").when(phi > 0, "left").otherwise("right")
    posture = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown")
        .when(F.col("counts") > F.col("threshold"), "moving")
        .when(F.abs("gy") >= F.cos(F.radians(F.lit(UPRIGHT_DEG))) * g, "upright")
        .otherwise(lying)
    )
    return epochs.withColumn("posture", posture)


def summarize(epochs: DataFrame) -> DataFrame:
    """Share of each posture over classifiable epochs, the dominant one (first in order on ties), transitions, valid share."""
    fit = F.col("posture").isin(*POSTURES)
    w = Window.partitionBy("session_id").orderBy("epoch")
    changes = epochs.where(fit).withColumn("_c", (F.col("posture") != F.lag("posture").over(w)).cast("int")).groupBy("session_id").agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("transitions"))
    n = F.count_if(fit)
    shares = [F.when(n > 0, 100.0 * F.count_if(F.col("posture") == p) / n).alias(f"pct_{p}") for p in POSTURES]
    s = epochs.groupBy("session_id").agg(F.count("*").alias("n_epochs"), (100.0 * n / F.count("*")).alias("valid_pct"), *shares)
    best = F.array_max(F.array(*[F.struct(F.col(f"pct_{p}").alias("pct"), F.lit(-i).alias("o"), F.lit(p).alias("p")) for i, p in enumerate(POSTURES)]))
    s = s.withColumn("dominant", F.when(F.col("pct_supine").isNotNull(), best["p"]))
    return s.join(changes, "session_id", "left").withColumn("transitions", F.coalesce("transitions", F.lit(0)).cast("long"))


def autofill(sessions: DataFrame) -> DataFrame:
    """Fills a missing body_position with a lying dominant posture of 60 % or more where half of the epochs are valid."""
    share = F.coalesce(*[F.when(F.col("dominant") == p, F.col(f"pct_{p}")) for p in POSTURES])
    fill = F.when(F.col("dominant").isin("supine", "prone", "left", "right") & (share >= 60) & (F.col("valid_pct") >= 50), F.col("dominant"))
    return sessions.withColumn("body_position", F.coalesce("body_position", fill))
