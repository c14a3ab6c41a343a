"""Sleep: epoch features, stage scores and paths, vocabularies, summaries, agreement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .series import by_session, differences, islands

EPOCH_S = 30.0
UNSCORED = -1
# Stage vocabularies from coarse to fine, with their labels by code.
VOCABULARIES = {
    "wake_sleep_2": ("Wake", "Sleep"),
    "wake_rem_nrem_3": ("Wake", "NREM", "REM"),
    "wldr_4": ("Wake", "Light", "Deep", "REM"),
    "aasm_5": ("Wake", "N1", "N2", "N3", "REM"),
}
# How codes of a finer vocabulary read in a coarser one.
COLLAPSE = {
    ("aasm_5", "wldr_4"): (0, 1, 1, 2, 3),
    ("aasm_5", "wake_rem_nrem_3"): (0, 1, 1, 1, 2),
    ("aasm_5", "wake_sleep_2"): (0, 1, 1, 1, 1),
    ("wldr_4", "wake_rem_nrem_3"): (0, 1, 1, 2),
    ("wldr_4", "wake_sleep_2"): (0, 1, 1, 1),
    ("wake_rem_nrem_3", "wake_sleep_2"): (0, 1, 1),
}
# Transition probabilities from and to wake, light, deep, REM; first-epoch probabilities.
TRANSITIONS = ((0.900, 0.080, 0.005, 0.015), (0.030, 0.900, 0.045, 0.025), (0.010, 0.085, 0.900, 0.005), (0.025, 0.070, 0.005, 0.900))
INITIAL = (0.70, 0.28, 0.01, 0.01)
# Centres of the evidence scores.
WAKE_HR_DELTA, DEEP_HR_DELTA, DEEP_LF_HF, REM_LF_HF, REM_RAMP = 12.0, 4.0, 1.0, 2.5, 0.25


def epoch_grid(durations: DataFrame) -> DataFrame:
    """session_id, epoch of every epoch of recordings (session_id, duration_s); the last one may be cut."""
    n = F.ceil(F.col("duration_s") / EPOCH_S).cast("long")
    return durations.where(F.col("duration_s") > 0).select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("epoch"))


def epoch_features(rr: DataFrame, least: int = 10, half: int = 5, grid: DataFrame | None = None) -> DataFrame:
    """Per 30 s epoch on a dense grid: n_beats, coverage, hr_bpm, rmssd_ms (pairs inside one epoch, +-5 epochs), hr_delta (over the night's 10th percentile).

    ``grid`` has session_id and epoch; without it epochs go to the last interval.
    """
    d = differences(rr).withColumn("epoch", F.floor(F.col("t_s") / EPOCH_S).cast("long"))
    d = d.withColumn("_d", F.when(F.lag("epoch").over(by_session("n")) == F.col("epoch"), F.col("d_ms")))
    e = d.groupBy("session_id", "epoch").agg(F.count("*").alias("n_beats"), F.sum("rr_ms").alias("_rr"), F.sum(F.col("_d") * F.col("_d")).alias("_s"), F.count("_d").alias("_n"))
    if grid is None:
        grid = rr.groupBy("session_id").agg(F.floor(F.max("t_s") / EPOCH_S).cast("long").alias("_last")).select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("epoch"))
    e = grid.join(e, ["session_id", "epoch"], "left").fillna(0, ["n_beats", "_rr", "_n"])
    w = by_session("epoch").rowsBetween(-half, half)
    e = e.withColumns(
        {
            "coverage": F.least(F.lit(1.0), F.col("_rr") / 1000.0 / EPOCH_S),
            "hr_bpm": F.when(F.col("n_beats") >= least, 60000.0 / (F.col("_rr") / F.col("n_beats"))),
            "rmssd_ms": F.when(F.sum("_n").over(w) >= least, F.sqrt(F.sum("_s").over(w) / F.sum("_n").over(w))),
        }
    )
    base = e.groupBy("session_id").agg(F.percentile("hr_bpm", F.lit(0.1)).alias("_base"))
    return e.join(base, "session_id").select("session_id", "epoch", "n_beats", "coverage", "hr_bpm", "rmssd_ms", (F.col("hr_bpm") - F.col("_base")).alias("hr_delta"))


def stageable() -> Column:
    return (F.col("coverage") >= 0.5) & F.col("hr_bpm").isNotNull()


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def scores(features: DataFrame) -> DataFrame:
    """Adds evidence for wake, light, deep and REM (s_*); missing features count as no evidence.

    ``features`` has session_id, epoch, hr_delta, rmssd_ms, lf_hf, moving (boolean).
    """
    med = features.groupBy("session_id").agg(F.percentile("rmssd_ms", F.lit(0.5)).alias("_med"))
    mad = features.join(med, "session_id").groupBy("session_id", "_med").agg(F.percentile(F.abs(F.col("rmssd_ms") - F.col("_med")), F.lit(0.5)).alias("_mad"), F.max("epoch").alias("_last"))
    f = features.join(mad, "session_id")
    z = (F.col("rmssd_ms") - F.col("_med")) / F.when(F.col("_mad") > 1e-9, F.col("_mad")).otherwise(F.greatest(0.1 * F.col("_med"), F.lit(1e-9)))
    moving = F.when(F.col("moving"), 1.0).otherwise(0.0)
    s = lambda x: F.coalesce(sigmoid(x), F.lit(0.0))
    frac = F.when(F.col("_last") > 0, F.col("epoch") / F.col("_last")).otherwise(0.0)
    return f.withColumns(
        {
            "s_wake": 2.0 * moving + 1.6 * s((F.col("hr_delta") - WAKE_HR_DELTA) / 3.0) + 0.4 * s((-z - 1.0) / 0.5),
            "s_light": 1.1 - 1.5 * moving,
            "s_deep": 1.2 * s((DEEP_LF_HF - F.col("lf_hf")) / 0.25) + 0.9 * s((z - 0.3) / 0.4) + 0.6 * s((DEEP_HR_DELTA - F.col("hr_delta")) / 2.0) - 2.5 * moving,
            "s_rem": 1.5 * s((F.col("lf_hf") - REM_LF_HF) / 0.5) + 0.5 * s((F.col("hr_delta") - 3.0) / 2.0) + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac / REM_RAMP)) - 2.5 * moving,
        }
    ).drop("_med", "_mad", "_last")


def viterbi(emissions: DataFrame) -> DataFrame:
    """session_id, epoch, stage: the most probable path under sticky transitions; of equal ones the lowest stage.

    ``emissions`` has session_id, epoch, p (four probabilities).  A night is a
    bounded sequence; its path is folded over an array with back pointers.
    """
    import math

    k = range(len(INITIAL))
    rows = emissions.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("epoch", "p"))).alias("e"))
    log = lambda s, j: F.log(F.greatest(s["p"][j], F.lit(1e-12)))
    first = F.array(*[F.lit(math.log(INITIAL[j])) + log(F.col("e")[0], j) for j in k])
    start = F.struct(first.alias("d"), F.array().cast("array<array<int>>").alias("b"))

    def step(state, s):
        d, back = [], []
        for j in k:
            options = F.array(*[F.struct((state["d"][i] + F.lit(math.log(TRANSITIONS[i][j]))).alias("v"), F.lit(-i).alias("i")) for i in k])
            best = F.array_max(options)
            d.append(best["v"] + log(s, j))
            back.append(-best["i"])
        return F.struct(F.array(*d).alias("d"), F.concat(state["b"], F.array(F.array(*back))).alias("b"))

    folded = rows.withColumn("f", F.aggregate(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), start, step))
    last = -F.array_max(F.array(*[F.struct(F.col("f.d")[j].alias("v"), F.lit(-j).alias("i")) for j in k]))["i"]
    path = F.aggregate(F.reverse("f.b"), F.array(last), lambda p, b: F.concat(F.array(F.element_at(b, p[0] + 1)), p))
    return folded.withColumn("path", path).select("session_id", F.explode(F.arrays_zip(F.col("e.epoch").alias("epoch"), F.col("path").alias("stage"))).alias("x")).select("session_id", "x.epoch", F.col("x.stage").alias("stage"))


def collapse(stage: Column, src: str, dst: str) -> Column:
    """Codes of ``src`` in the coarser ``dst``; unscored stays unscored, and detail is never invented."""
    if src == dst:
        return stage
    if (src, dst) not in COLLAPSE:
        raise ValueError(f"{dst} is finer than {src}")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, COLLAPSE[src, dst])), F.when(stage >= 0, stage + 1).cast("int")), F.lit(UNSCORED))


def common_vocabulary(a: str, b: str) -> str:
    order = list(VOCABULARIES)
    return min(a, b, key=order.index)


def override_wake(hypnogram: DataFrame, least: int = 2) -> DataFrame:
    """Scored epochs in runs of at least two whose counts are over the threshold are wake; adds overridden."""
    over = F.coalesce(F.col("counts") > F.col("threshold"), F.lit(False))
    d = hypnogram.withColumn("_o", over)
    d = islands(d, F.col("_o") != F.lag("_o").over(by_session("epoch")), ["epoch"])
    size = F.count("*").over(Window.partitionBy("session_id", "run_id"))
    d = d.withColumn("overridden", F.col("_o") & (size >= least) & (F.col("stage") > 0))
    return d.withColumn("stage", F.when(F.col("overridden"), 0).otherwise(F.col("stage"))).drop("_o", "run_id")


def summarize(hypnogram: DataFrame, rem: int | None = 3, epoch_s: float = EPOCH_S) -> DataFrame:
    """Time in bed, sleep time, efficiency, latency, wake after onset, awakenings, REM latency (minutes)."""
    m = epoch_s / 60.0
    asleep, scored = F.col("stage") >= 1, F.col("stage") != UNSCORED
    w = Window.partitionBy("session_id")
    d = hypnogram.withColumns({"_on": F.min(F.when(asleep, F.col("epoch"))).over(w), "_off": F.max(F.when(asleep, F.col("epoch"))).over(w), "_prev": F.lag("stage").over(by_session("epoch"))})
    inside = (F.col("epoch") > F.col("_on")) & (F.col("epoch") <= F.col("_off"))
    return d.groupBy("session_id").agg(
        (F.count("*") * m).alias("tib_min"),
        (F.count_if(asleep) * m).alias("tst_min"),
        F.when(F.count_if(scored) > 0, 100.0 * F.count_if(asleep) / F.count_if(scored)).alias("efficiency_pct"),
        (F.max("_on") * m).alias("latency_min"),
        F.when(F.max("_on").isNotNull(), F.count_if(inside & (F.col("stage") == 0)) * m).alias("waso_min"),
        F.count_if(inside & (F.col("stage") == 0) & (F.col("_prev") >= 1)).alias("awakenings"),
        (F.min(F.when(F.col("stage") == (rem if rem is not None else -9), F.col("epoch") - F.col("_on"))) * m).alias("rem_latency_min"),
    )


def stage_statistics(rr: DataFrame, hypnogram: DataFrame, least: int = 10) -> DataFrame:
    """Mean HR and RMSSD of each stage: pairs count if contiguous and of one stage."""
    d = differences(rr).withColumn("epoch", F.floor(F.col("t_s") / EPOCH_S).cast("long")).join(hypnogram.select("session_id", "epoch", "stage"), ["session_id", "epoch"])
    d = d.withColumn("_d", F.when((F.lag("stage").over(by_session("n")) == F.col("stage")) & (F.lag("n").over(by_session("n")) == F.col("n") - 1), F.col("d_ms")))
    return d.where(F.col("stage") != UNSCORED).groupBy("session_id", "stage").agg(F.count("*").alias("n_beats"), (60000.0 / F.avg("rr_ms")).alias("hr_bpm"), F.when(F.count("_d") >= least, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd_ms"))


def confusion(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Agreement and Cohen's kappa of two ratings (a, b) of the same epochs; null where chance agreement is total."""
    c = confusion(pairs, keys)
    w = Window.partitionBy(*keys)
    c = c.withColumns({"_n": F.sum("n").over(w)})
    a = c.groupBy(*keys, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    b = c.groupBy(*keys, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("_c"))
    same = c.groupBy(*keys).agg(F.sum("n").alias("n_epochs"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("_s"))
    out = same.join(chance, list(keys), "left").withColumns({"_po": F.col("_s") / F.col("n_epochs"), "_pe": F.coalesce("_c", F.lit(0)) / (F.col("n_epochs") * F.col("n_epochs"))})
    out = out.where(F.col("n_epochs") >= least)
    return out.select(*keys, "n_epochs", (100.0 * F.col("_po")).alias("agree_pct"), F.when(F.col("_pe") < 1, (F.col("_po") - F.col("_pe")) / (1 - F.col("_pe"))).alias("kappa"))


def pairwise(hypnograms: DataFrame, rank: Column) -> DataFrame:
    """Epochs that two engines of one session both scored, the one of lower rank first: session_id, engine_a, engine_b, a, b."""
    h = hypnograms.where(F.col("stage") != UNSCORED).withColumn("_r", rank)
    a = h.select("session_id", "epoch", F.col("engine").alias("engine_a"), F.col("stage").alias("a"), F.col("_r").alias("_ra"))
    b = h.select("session_id", "epoch", F.col("engine").alias("engine_b"), F.col("stage").alias("b"), F.col("_r").alias("_rb"))
    return a.join(b, ["session_id", "epoch"]).where("_ra < _rb").drop("_ra", "_rb")


def first_available(engines: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """The first engine in order of precedence that is available for a session."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("engine"))
    return engines.where("available").where(rank > 0).groupBy("session_id").agg(F.min_by("engine", rank).alias("engine"))


def thirds(hypnogram: DataFrame) -> DataFrame:
    """Epochs of each stage by third of the night."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    i = F.row_number().over(by_session("epoch")) - 1
    return hypnogram.withColumn("third", F.floor(i * 3 / n).cast("long")).groupBy("session_id", "third", "stage").agg(F.count("*").alias("n"))


# What the columns of a three-stage classifier (undefined, NREM, REM, wake) mean in wake_rem_nrem_3.
CLASSIFIER_CODES = (UNSCORED, 1, 2, 0)


def from_probabilities(scored: DataFrame, grid: DataFrame, codes: Sequence[int] = CLASSIFIER_CODES) -> DataFrame:
    """Epochs of ``grid`` (session_id, epoch) with the stage of the greatest of ``p`` (the first on ties); epochs that were not scored are unscored, and those beyond the grid go."""
    best = F.array_position("p", F.array_max("p"))
    s = scored.select("session_id", "epoch", F.try_element_at(F.array(*map(F.lit, codes)), best.cast("int")).alias("stage"))
    return grid.join(s, ["session_id", "epoch"], "left").select("session_id", "epoch", F.coalesce("stage", F.lit(UNSCORED)).alias("stage"))


def from_codes(scored: DataFrame, grid: DataFrame, n_codes: int = 5) -> DataFrame:
    """Epochs of ``grid`` with codes of an outside engine as they are; others than 0 to n_codes - 1 are unscored. Adds status: count mismatch where an engine scored other than the grid's epochs."""
    s = scored.select("session_id", "epoch", F.when(F.col("stage").between(0, n_codes - 1), F.col("stage")).otherwise(UNSCORED).alias("stage"))
    n = scored.groupBy("session_id").agg(F.count("*").alias("_n"))
    m = grid.groupBy("session_id").agg(F.count("*").alias("_m")).join(n, "session_id", "left")
    m = m.select("session_id", F.when(F.col("_n") == F.col("_m"), "ok").otherwise("count mismatch").alias("status"))
    return grid.join(s, ["session_id", "epoch"], "left").withColumn("stage", F.coalesce("stage", F.lit(UNSCORED))).join(m, "session_id")


def run_engines(features: DataFrame, engines: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Hypnograms (session_id, epoch, stage) of all engines, one below the other, with engine and status.

    Each engine's nights are written before they are used, so one that fails,
    when it is planned or while it runs, gives one row with its error and
    leaves the others alone.
    """
    out = None
    for name, engine in engines.items():
        try:
            h = written(engine(features).select("session_id", "epoch", F.col("stage").cast("int").alias("stage"), F.lit("ok").alias("status")), f"engine-{name}")
        except Exception as e:  # noqa: BLE001 - an engine's failure is an outcome of its own
            h = features.sparkSession.createDataFrame([(None, None, None, f"failed: {e}"[:200])], "session_id long, epoch long, stage int, status string")
        h = h.withColumn("engine", F.lit(name))
        out = h if out is None else out.unionByName(h)
    return out


# Healthy ranges (metric, low, high) of a night's summary, and of the shares of stages in the time asleep by label.
NORMS = (("efficiency_pct", 85.0, 100.0), ("latency_min", 0.0, 30.0), ("waso_min", 0.0, 40.0), ("rem_latency_min", 60.0, 120.0))
SHARE_NORMS = {
    "Light": (40.0, 65.0), "N1": (2.0, 10.0), "N2": (40.0, 60.0), "Deep": (5.0, 25.0), "N3": (5.0, 25.0), "REM": (15.0, 28.0), "NREM": (72.0, 85.0),
}


def stage_shares(hypnogram: DataFrame, vocabulary: str = "wldr_4") -> DataFrame:
    """session_id, label, pct of the time asleep in each stage of the vocabulary, also of stages that do not occur."""
    labels = VOCABULARIES[vocabulary]
    n = hypnogram.groupBy("session_id").agg(F.count_if(F.col("stage") >= 1).alias("_all"), *[F.count_if(F.col("stage") == i).alias(x) for i, x in enumerate(labels) if i])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (100.0 * F.col(x) / F.col("_all")).alias("pct")) for x in labels[1:]]))
    return n.where("_all > 0").select("session_id", rows.alias("r")).select("session_id", "r.*")


def plausibility(summary: DataFrame, norms: Sequence[tuple[str, float, float]] = NORMS, shares: DataFrame | None = None) -> DataFrame:
    """session_id, metric, value, low, high, verdict (within range, below range, above range) of the metrics that a summary has values for, and of the shares of stages (session_id, label, pct) that have a norm."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(a).alias("low"), F.lit(b).alias("high")) for m, a, b in norms]))
    out = summary.select("session_id", rows.alias("r")).select("session_id", "r.*")
    if shares is not None:
        low, high = (F.create_map(*[F.lit(x) for k, v in SHARE_NORMS.items() for x in (k, v[i])]) for i in (0, 1))
        known = shares.where(F.col("label").isin(*SHARE_NORMS))
        out = out.union(known.select("session_id", F.concat(F.col("label"), F.lit("_pct")).alias("metric"), F.col("pct").alias("value"), low[F.col("label")].alias("low"), high[F.col("label")].alias("high")))
    verdict = F.when(F.col("value") < F.col("low"), "below range").when(F.col("value") > F.col("high"), "above range").otherwise("within range")
    return out.where("value IS NOT NULL").withColumn("verdict", verdict)
