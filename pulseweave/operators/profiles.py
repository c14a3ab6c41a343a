"""Activity profiles as a registry, and the figures of every session that its profile asks for, as one variant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import activity, hrv, spectral

# Columns of each family of variability.
FAMILIES = {
    "time": ("sdnn_ms", "rmssd_ms", "pnn50_pct"),
    "frequency": ("vlf", "lf", "hf", "lf_hf", "lf_peak_hz"),
    "nonlinear": ("sd1_ms", "sd2_ms", "sd1_sd2_ratio", "sampen", "dfa_alpha1"),
}


@dataclass(frozen=True)
class Profile:
    """What a session of an activity is expected to show, what is read with care, and which figures it gets.

    ``intense`` profiles have no variability over 70 % of the reserve.
    """

    key: str
    name: str
    expected: tuple[int, int]
    outputs: tuple[str, ...]
    max_excluded: float | None = None
    cautions: tuple[str, ...] = ()
    intense: bool = False
    comparison_key: str = field(default="")


# The figures of each built-in profile.
_MINUTES = ("per_minute_rmssd_t_s", "per_minute_rmssd_ms")
OUTPUTS = {
    "supine": (*_MINUTES, "hr_trend_bpm_per_min"),
    "sitting": (*_MINUTES, "hr_trend_bpm_per_min"),
    "standing": ("mayer_peak_hz", "hr_trend_bpm_per_min", "orthostatic_response"),
    "walking": ("hr_trend_bpm_per_min", "per_minute_hr_bpm", "per_minute_hr_t_s", "motion_hr_coupling_r", "settled_at_min", "settled_hr_bpm"),
    "running": ("hr_zones_fraction", "max_hr_basis", "cardiac_drift_proxy_bpm_per_min", "hrr60_bpm", "peak_hr_bpm", "peak_hr_t_s"),
    "cycling": ("hr_zones_fraction", "max_hr_basis", "cardiac_drift_proxy_bpm_per_min", "hrr60_bpm", "peak_hr_bpm", "peak_hr_t_s"),
    "swimming": ("hr_zones_fraction", "max_hr_basis", "excluded_fraction"),
    "recovery": ("hrr60_bpm", "hrr120_bpm", "recovery_tau_s", *_MINUTES, "rmssd_reactivation_ms_per_min"),
    "sleep": ("lowest_sustained_hr_bpm", "per_minute_hr_bpm", "per_minute_hr_t_s"),
}
REGISTRY: dict[str, Profile] = {}


def register(profile: Profile) -> Profile:
    """Adds a profile; its key is new, and all its outputs have a provider."""
    if not profile.key or profile.key in REGISTRY:
        raise ValueError(f"a profile needs a key of its own: {profile.key!r}")
    unknown = set(profile.outputs) - {c for p in PROVIDERS.values() for c in p.columns} - set(GIVEN)
    if unknown:
        raise ValueError(f"nothing provides {sorted(unknown)}")
    REGISTRY[profile.key] = profile
    return profile


@dataclass
class Inputs:
    """sessions (session_id, profile_key, max_hr, and what GIVEN reads), intervals, markers (session_id, t_s) and quality windows with movement (session_id, k, movement)."""

    sessions: DataFrame
    rr: DataFrame
    markers: DataFrame
    movement: DataFrame


@dataclass(frozen=True)
class Provider:
    """Columns and the function that makes them, one row a session, from the inputs of the sessions that ask for them."""

    columns: tuple[str, ...]
    make: Callable[[Inputs], DataFrame]


#: Figures that are columns of the session already.
GIVEN = {"max_hr_basis": "max_hr_basis", "excluded_fraction": "excluded_fraction", "mayer_peak_hz": "lf_peak_hz"}


def _trend(i: Inputs) -> DataFrame:
    """Slopes of the rate over the whole session and from five minutes on, in one pass."""
    t0 = i.rr.groupBy("session_id").agg(F.min("t_s").alias("_t0"))
    d = i.rr.join(t0, "session_id").withColumns({"_hr": 60000.0 / F.col("rr_ms"), "_late": F.col("t_s") - F.col("_t0") >= 300.0})
    late = lambda c: F.when(F.col("_late"), F.col(c))
    return d.groupBy("session_id").agg(
        F.when(F.count("*") >= 30, F.regr_slope("_hr", "t_s") * 60.0).alias("hr_trend_bpm_per_min"),
        F.when(F.count_if("_late") >= 60, F.regr_slope(late("_hr"), late("t_s")) * 60.0).alias("cardiac_drift_proxy_bpm_per_min"),
    )


def _zones(i: Inputs) -> DataFrame:
    z = activity.zones(i.rr.join(i.sessions.select("session_id", "max_hr"), "session_id"), F.col("max_hr"))
    names = F.concat(F.lit("zone"), F.col("zone").cast("string"))
    return z.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(names.alias("k"), F.col("fraction").alias("v"))))).alias("hr_zones_fraction"))


def _recovery(i: Inputs) -> DataFrame:
    peaks = hrv.rolling_peak(i.rr)
    out = peaks.join(activity.recovery(i.rr, peaks), "session_id", "left")
    return out.select("session_id", "peak_hr_bpm", F.col("peak_end_s").alias("peak_hr_t_s"), F.col("hrr60").alias("hrr60_bpm"), F.col("hrr120").alias("hrr120_bpm"))


def _listed(minutes: DataFrame, rr: DataFrame, value: str, out: str, unit: str) -> DataFrame:
    """Minutes of a session in order as two arrays, their starts and values; a recording has a bounded number of them."""
    d = minutes.join(rr.groupBy("session_id").agg(F.min("t_s").alias("_t0")), "session_id")
    rows = F.array_sort(F.collect_list(F.struct((F.col("_t0") + 60.0 * F.col("window")).alias("t"), F.col(value).alias("v"))))
    return d.groupBy("session_id").agg(rows.alias("_m")).select("session_id", F.transform("_m", lambda x: x["t"]).alias(f"{out}_t_s"), F.transform("_m", lambda x: x["v"]).alias(f"{out}_{unit}"))


def _minutes_hr(i: Inputs) -> DataFrame:
    return _listed(hrv.per_minute_hr(i.rr), i.rr, "hr_bpm", "per_minute_hr", "bpm")


def _minutes_rmssd(i: Inputs) -> DataFrame:
    m = hrv.per_minute_rmssd(i.rr)
    slope = activity.reactivation_slope(m).select("session_id", F.col("slope_ms_per_min").alias("rmssd_reactivation_ms_per_min"))
    return _listed(m, i.rr, "rmssd_ms", "per_minute_rmssd", "ms").join(slope, "session_id")


def _settling(i: Inputs) -> DataFrame:
    return activity.settling(hrv.per_minute_hr(i.rr)).select("session_id", F.col("settled_window").cast("double").alias("settled_at_min"), "settled_hr_bpm")


def _tau(i: Inputs) -> DataFrame:
    return spectral.recovery_tau(i.rr, hrv.rolling_peak(i.rr)).select("session_id", F.col("tau_s").alias("recovery_tau_s"))


def _orthostatic(i: Inputs) -> DataFrame:
    o = activity.orthostatic(i.rr, i.markers).where("rise_bpm IS NOT NULL")
    return o.select("session_id", F.struct("before_bpm", "after_bpm", "rise_bpm").alias("orthostatic_response"))


def _coupling(i: Inputs) -> DataFrame:
    return activity.motion_coupling(i.rr, i.movement).select("session_id", F.col("r").alias("motion_hr_coupling_r"))


def _lowest(i: Inputs) -> DataFrame:
    return hrv.lowest_sustained_hr(i.rr).select("session_id", F.col("lowest_hr_bpm").alias("lowest_sustained_hr_bpm"))


PROVIDERS = {
    "trend": Provider(("hr_trend_bpm_per_min", "cardiac_drift_proxy_bpm_per_min"), _trend),
    "zones": Provider(("hr_zones_fraction",), _zones),
    "recovery": Provider(("peak_hr_bpm", "peak_hr_t_s", "hrr60_bpm", "hrr120_bpm"), _recovery),
    "minutes_hr": Provider(("per_minute_hr_bpm", "per_minute_hr_t_s"), _minutes_hr),
    "minutes_rmssd": Provider((*_MINUTES, "rmssd_reactivation_ms_per_min"), _minutes_rmssd),
    "settling": Provider(("settled_at_min", "settled_hr_bpm"), _settling),
    "tau": Provider(("recovery_tau_s",), _tau),
    "orthostatic": Provider(("orthostatic_response",), _orthostatic),
    "coupling": Provider(("motion_hr_coupling_r",), _coupling),
    "lowest": Provider(("lowest_sustained_hr_bpm",), _lowest),
}

for _key, _name, _low, _high, _most in activity.PROFILES:
    register(Profile(_key, _name, (_low, _high), OUTPUTS[_key], _most, activity.CAUTIONS.get(_key, ()), _key in ("running", "cycling"), _key))


def table(spark: SparkSession) -> DataFrame:
    """All registered profiles."""
    rows = [(p.key, p.name, *p.expected, p.max_excluded, list(p.cautions), p.intense, p.comparison_key or p.key) for p in REGISTRY.values()]
    return spark.createDataFrame(rows, "profile string, name string, expected_min int, expected_max int, max_excluded double, cautions array<string>, intense boolean, comparison_key string")


def judged(sessions: DataFrame) -> DataFrame:
    """Adds not_analysable, suppressed (families without figures) and cautions to sessions (profile_key, excluded_fraction, mean_hr_bpm, rest_hr, max_hr).

    Too much excluded signal suppresses all families and drops the cautions; so
    does a mean rate over 70 % of the reserve in intense activities, which keep theirs.
    """
    p = table(sessions.sparkSession).select(F.col("profile").alias("profile_key"), F.col("max_excluded").alias("_most"), F.col("cautions").alias("_cautions"), F.col("intense").alias("_intense"))
    d = sessions.join(F.broadcast(p), "profile_key", "left")  # a row for each registered profile
    none, families = F.array().cast("array<string>"), F.array(*map(F.lit, FAMILIES))
    hard = F.coalesce(F.col("_intense") & (activity.reserve(F.col("mean_hr_bpm"), F.col("rest_hr"), F.col("max_hr")) > activity.SUPPRESS_RESERVE), F.lit(False))
    d = d.withColumn("not_analysable", F.coalesce(F.col("excluded_fraction") > F.col("_most"), F.lit(False)))
    suppressed = F.when(F.col("not_analysable") | hard, families).otherwise(none)
    cautions = F.when(F.col("not_analysable"), none).otherwise(F.coalesce("_cautions", none))
    return d.withColumns({"suppressed": suppressed, "cautions": cautions}).drop("_most", "_cautions", "_intense")


def suppress_families(metrics: DataFrame, suppressed: Column) -> DataFrame:
    """Blanks the columns of suppressed families, before anything is stored."""
    out = {c: F.when(~F.coalesce(F.array_contains(suppressed, f), F.lit(False)), F.col(c)) for f, names in FAMILIES.items() for c in names if c in metrics.columns}
    return metrics.withColumns(out)


def outputs(inputs: Inputs) -> DataFrame:
    """session_id, profile_key, extras (a variant) of analysable sessions: the figures that the profile asks for and that could be computed.

    A provider sees only the intervals of sessions that ask for it; sessions of
    one profile share its pass.
    """
    sessions = inputs.sessions.where(~F.col("not_analysable")) if "not_analysable" in inputs.sessions.columns else inputs.sessions
    wide = sessions
    for p in PROVIDERS.values():
        asking = [k for k, x in REGISTRY.items() if set(x.outputs) & set(p.columns)]
        who = sessions.where(F.col("profile_key").isin(asking))
        some = Inputs(who, *(d.join(who.select("session_id"), "session_id", "left_semi") for d in (inputs.rr, inputs.markers, inputs.movement)))
        wide = wide.join(p.make(some), "session_id", "left")
    wide = wide.withColumns({k: F.col(c) for k, c in GIVEN.items() if c in wide.columns and k not in wide.columns})
    body = None
    for key, x in REGISTRY.items():
        fields = F.to_json(F.struct(*[F.col(c) for c in x.outputs if c in wide.columns]))  # leaves out what is null
        body = F.when(F.col("profile_key") == key, fields) if body is None else body.when(F.col("profile_key") == key, fields)
    return wide.select("session_id", "profile_key", F.parse_json(body).alias("extras"))
