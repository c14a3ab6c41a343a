"""Exposure statistics: observations, guards, group summaries, effects, associations, hour profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import t_tail

# Least exposure of a session (s), sessions an arm, events, sessions for an association, sessions a level.
MIN_ANALYSED_S, MIN_ARM, MIN_EVENTS, MIN_ENV, MIN_LEVEL = 600.0, 5, 10, 12, 3
# Built-in exposure tags.
TAGS = (
    "caffeine", "alcohol", "poor-sleep", "stress", "large-meal", "dehydration", "lying-down", "illness", "exercise-earlier",
    "nicotine", "sauna", "cold-exposure", "breathwork", "late-meal", "travel-jetlag", "noisy-sleep-env", "menstruation", "vaccination",
)
#: Sessions without an activity are a level of their own.
UNSPECIFIED = "unspecified"
#: Supported outcomes and what their effect is.
OUTCOMES = {"ectopy": "rate_ratio", "ln_rmssd": "pct_change", "resting_hr": "delta", "flow_rmssd": "pct_change"}


def judged(sessions: DataFrame) -> DataFrame:
    """Adds reason: why a session (done, ectopy_count, analysed_s) cannot be used; null if it can."""
    why = F.when(~F.coalesce("done", F.lit(False)), "not done").when(F.col("ectopy_count").isNull(), "no ectopy").when(F.col("analysed_s") < MIN_ANALYSED_S, "too short")
    return sessions.withColumn("reason", why)


def arms(observations: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every observation of a person for every tag that person uses, with exposed, for models that need the rows; ``tags`` has keys, session_id, tag.

    A join on ``keys``: a person's sessions meet that person's tags only.
    """
    pairs = observations.join(tags.select(*keys, "tag").distinct(), list(keys))
    return pairs.join(tags.select("session_id", "tag", F.lit(True).alias("_t")).distinct(), ["session_id", "tag"], "left").withColumn("exposed", F.coalesce("_t", F.lit(False))).drop("_t")


def arm_cells(observations: DataFrame, tags: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What ``arms`` gives, with equal rows as one: keys, tag, ``values``, exposed and weight, the number of observations.

    Only the pairs of a session and a tag it has are joined; cells, not
    observations, meet every tag of their keys.
    """
    by = [*keys, "tag", *values]
    o = observations.select("session_id", *keys, *values)
    cells = o.groupBy(*keys, *values).agg(F.count("*").alias("_all")).join(tags.select(*keys, "tag").distinct(), list(keys))
    exposed = o.join(tags.select("session_id", "tag").distinct(), "session_id").groupBy(*by).agg(F.count("*").alias("_with"))
    both = cells.select(*by, "_all", F.lit(0).alias("_with")).union(exposed.select(*by, F.lit(0).alias("_all"), "_with"))
    both = both.groupBy(*by).agg(F.sum("_all").alias("_all"), F.sum("_with").alias("_with")).where("_all > 0")
    arm = lambda e, n: F.struct(F.lit(e).alias("exposed"), n.alias("weight"))
    return both.select(*by, F.inline(F.array(arm(True, F.col("_with")), arm(False, F.col("_all") - F.col("_with"))))).where("weight > 0")


def arm_sums(observations: DataFrame, tags: DataFrame, sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """keys, tag, and for each sum its value over exposed (name_1) and unexposed (name_0) observations.

    Only the pairs of a session and a tag it has are joined; what is not
    exposed is the total less what is.  Tags no observation has are there with
    nothing exposed.
    """
    added = lambda df, by, tail: df.groupBy(*by).agg(*[F.sum(c).alias(n + tail) for n, c in sums.items()])
    total = added(observations, keys, "_t")
    pairs = observations.join(tags.select("session_id", "tag").distinct(), "session_id")
    exposed = added(pairs, [*keys, "tag"], "_1")
    used = with_totals(tags.select(*keys, "tag").distinct(), total, keys).join(exposed, [*keys, "tag"], "left")
    zero = lambda n: F.coalesce(n + "_1", F.lit(0))
    return used.select(*keys, "tag", *[zero(n).alias(n + "_1") for n in sums], *[(F.col(n + "_t") - zero(n)).alias(n + "_0") for n in sums])


def with_totals(df: DataFrame, total: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the totals of its keys; without keys there is one row of totals, whose values are put in as constants."""
    if keys:
        return df.join(total, list(keys))
    row = total.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in total.schema})


def _split(a: DataFrame, sums: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """The same sums of observations that have exposed for each of ``keys``."""
    part = lambda n, c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n)
    return a.groupBy(*keys).agg(*[part(n + "_1", F.col("exposed"), v) for n, v in sums.items()], *[part(n + "_0", ~F.col("exposed"), v) for n, v in sums.items()])


def _rate_sums() -> dict[str, Column]:
    y, h = F.col("ectopy_count").cast("double"), F.col("hours")
    return {"n": F.lit(1), "y": y, "h": h, "yy": y * y, "yh": y * h, "hh": h * h}


Z95 = 1.959963984540054


def _rates(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intercept and exposure alone have a closed form: the ratio of rates, and for its logarithm the sandwich variance summed over the arms."""
    c = F.col
    rate = {k: F.try_divide(c(f"y_{k}"), c(f"h_{k}")) for k in "10"}
    part = {k: F.try_divide(c(f"yy_{k}") - 2 * rate[k] * c(f"yh_{k}") + rate[k] * rate[k] * c(f"hh_{k}"), c(f"y_{k}") * c(f"y_{k}")) for k in "10"}
    n = c("n_1") + c("n_0")
    status = F.when((c("n_1") < MIN_ARM) | (c("n_0") < MIN_ARM) | (c("y_1") + c("y_0") < MIN_EVENTS), "insufficient").when((c("y_1") == 0) | (c("y_0") == 0), "no_events").otherwise("ok")
    g = g.withColumn("status", status)
    g = g.withColumns({"estimate": F.when(c("status") == "ok", rate["1"] / rate["0"]), "_se": F.when(c("status") == "ok", F.sqrt(F.greatest(part["1"] + part["0"], F.lit(0.0)) * n / (n - 2)))})
    ends = [(c("estimate") * F.exp(k * Z95 * c("_se"))).alias(name) for k, name in ((-1, "ci_low"), (1, "ci_high"))]
    return g.select(*keys, c("n_1").alias("n_exposed"), c("n_0").alias("n_unexposed"), rate["1"].alias("rate_exposed"), rate["0"].alias("rate_unexposed"), "status", "estimate", *ends)


def rate_ratio(a: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Poisson rate ratio of exposed to unexposed sessions (exposed, ectopy_count, hours), with robust standard error and guards."""
    return _rates(_split(a, _rate_sums(), keys), keys)


def rate_ratio_by_tag(observations: DataFrame, tags: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rate ratio of every tag in use, from sums over sessions that have it and over all."""
    return _rates(arm_sums(observations, tags, _rate_sums(), keys), [*keys, "tag"])


def _differences(g: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """From sums of n, v and vv of values less their mean."""
    c = F.col
    mean = {k: F.try_divide(c(f"v_{k}"), c(f"n_{k}")) for k in "10"}
    var = {k: F.greatest(F.try_divide(c(f"vv_{k}"), c(f"n_{k}")) - mean[k] * mean[k], F.lit(0.0)) for k in "10"}
    n = c("n_1") + c("n_0")
    whole = (c("vv_1") + c("vv_0")) / n - ((c("v_1") + c("v_0")) / n) * ((c("v_1") + c("v_0")) / n)
    ok = (c("n_1") >= MIN_ARM) & (c("n_0") >= MIN_ARM) & (whole > 1e-9)
    beta, se = mean["1"] - mean["0"], F.sqrt(n / (n - 2) * (var["1"] / c("n_1") + var["0"] / c("n_0")))
    shown = (lambda x: 100.0 * (F.exp(x) - 1)) if kind == "pct_change" else (lambda x: x)
    pick = lambda x: F.when(ok, shown(x))
    return g.select(*keys, c("n_1").alias("n_exposed"), c("n_0").alias("n_unexposed"), F.when(ok, "ok").otherwise("insufficient").alias("status"), pick(beta).alias("estimate"), pick(beta - Z95 * se).alias("ci_low"), pick(beta + Z95 * se).alias("ci_high"))


def centred(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a value, and v, the value less the mean of its keys: sums of squares then keep their digits."""
    d = df.where(F.col(value).isNotNull())
    mean = d.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("_mean"))
    return with_totals(d, mean, keys).withColumn("v", F.col(value) - F.col("_mean")).drop("_mean")


def _value_sums() -> dict[str, Column]:
    return {"n": F.lit(1), "v": F.col("v"), "vv": F.col("v") * F.col("v")}


def difference(a: DataFrame, value: str, keys: Sequence[str], kind: str = "delta") -> DataFrame:
    """Difference of means of exposed and unexposed sessions with HC1 errors; ``pct_change`` reads it on a log scale."""
    return _differences(_split(centred(a, value, keys), _value_sums(), keys), keys, kind)


def difference_by_tag(observations: DataFrame, tags: DataFrame, value: str, kind: str = "delta", keys: Sequence[str] = ()) -> DataFrame:
    """The difference of every tag in use, from sums over sessions that have it and over all."""
    return _differences(arm_sums(centred(observations, value, keys), tags, _value_sums(), keys), [*keys, "tag"], kind)


def rate_summary(rates: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, and number, mean and standard deviation of the rates (session_id, rate) with it (tagged) and without."""
    r = F.col("rate").cast("double")
    g, c = arm_sums(rates, tags, {"n": r.isNotNull().cast("long"), "v": r, "vv": r * r}), F.col
    out = []
    for k, name in (("1", "tagged"), ("0", "untagged")):
        mean = F.try_divide(c(f"v_{k}"), c(f"n_{k}"))
        out += [c(f"n_{k}").alias(f"n_{name}"), mean.alias(f"mean_{name}"), F.sqrt(F.greatest(F.try_divide(c(f"vv_{k}") - c(f"n_{k}") * mean * mean, c(f"n_{k}") - 1), F.lit(0.0))).alias(f"sd_{name}")]
    return g.select("tag", *out)


def outcome_effects(observations: DataFrame, tags: DataFrame, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """Effect of every tag on one of OUTCOMES (for ectopy counts and hours, else the column of that name), with outcome and effect as columns."""
    kind = OUTCOMES[outcome]
    out = rate_ratio_by_tag(observations, tags, keys) if kind == "rate_ratio" else difference_by_tag(observations, tags, outcome, kind, keys)
    return out.select(F.lit(outcome).alias("outcome"), F.lit(kind).alias("effect"), *keys, "tag", "n_exposed", "n_unexposed", "status", "estimate", "ci_low", "ci_high")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str], least: int = MIN_ENV) -> DataFrame:
    """Rank correlation with average ranks for ties, and its p_value by the t distribution with n - 2 degrees of freedom."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str):
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    r = d.withColumns({"_rx": rank(x), "_ry": rank(y)})
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.stddev_samp(x) > 1e-9) & (F.stddev_samp(y) > 1e-9), F.corr("_rx", "_ry")).alias("rho")).where(F.col("n") >= least).withColumn("p_value", t_tail(_t_of_rho(), F.col("n") - 2))


def _t_of_rho() -> Column:
    rest = 1 - F.col("rho") * F.col("rho")
    return F.when(rest > 0, F.col("rho") * F.sqrt((F.col("n") - 2) / rest)).when(F.col("rho").isNotNull(), F.lit(float("inf")))


def tertiles(df: DataFrame, x: str, y: str, keys: Sequence[str], tiebreak: str) -> DataFrame:
    """Mean of y in thirds of x; sizes differ by one at most, the larger first."""
    t = F.ntile(3).over(Window.partitionBy(*keys).orderBy(x, tiebreak))
    return df.withColumn("tertile", t).groupBy(*keys, "tertile").agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(y).alias("mean"))


def hour_profile(sessions: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events an hour of exposure by clock hour.

    ``sessions`` has start_ts, duration_s and analysed_s: exposure is spread
    over clock hours by overlap and scaled by the analysed part.  ``events``
    has ts.
    """
    start = F.unix_micros(F.col("start_ts").cast("timestamp")) / 1e6
    s = sessions.where("duration_s > 0").withColumns({"_a": start, "_b": start + F.col("duration_s"), "_p": F.col("analysed_s") / F.col("duration_s")})
    s = s.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_a") / 3600), F.floor(F.col("_b") / 3600))))
    over = F.greatest(F.lit(0.0), F.least(F.col("_b"), (F.col("_h") + 1) * 3600.0) - F.greatest(F.col("_a"), F.col("_h") * 3600.0))
    x = s.groupBy(*keys, (F.col("_h") % 24).cast("int").alias("hour")).agg((F.sum(over * F.col("_p")) / 3600.0).alias("exposure_h"))
    n = events.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count("*").alias("n_events"))
    return x.join(n, [*keys, "hour"], "left").select(*keys, "hour", "exposure_h", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.when(F.col("exposure_h") > 0, F.coalesce("n_events", F.lit(0)) / F.col("exposure_h")).alias("per_hour"))


# --- count models ---------------------------------------------------------------


def _design(d: pd.DataFrame) -> np.ndarray:
    """Intercept, exposure, clock hour, activity levels; activity, then hour, is left out where the data are too few."""
    rows, n = len(d), int(d["weight"].sum())
    base = [np.ones(rows), d["exposed"].to_numpy(float)]
    hour = 2 * math.pi * d["hour"].to_numpy(float) / 24
    hours = [np.sin(hour), np.cos(hour)]
    activity = d["comparison_key"].fillna(UNSPECIFIED)
    levels, counts = sorted(activity.unique()), d["weight"].groupby(activity).sum()
    dummies = [(activity == k).to_numpy(float) for k in levels[1:]] if len(levels) > 1 and counts.min() >= MIN_LEVEL else []
    for cols in ([*base, *hours, *dummies], [*base, *hours], base):
        if len(cols) + 2 <= n:
            return np.column_stack(cols)
    return np.column_stack(base)


def fit_negative_binomial(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, steps: int = 200, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """NB2 maximum likelihood: coefficients and standard errors, or None without convergence; a row stands for ``weight`` equal ones.

    Alternates Newton steps for the coefficients and a search of the
    dispersion over its logarithm.
    """
    w = np.ones(len(y)) if weight is None else weight
    off, beta, log_a = np.log(exposure), np.zeros(x.shape[1]), -1.0
    beta[0] = math.log(max((w * y).sum(), 0.5) / (w * exposure).sum())
    counts = y.astype(int)
    of_count, wy = np.bincount(counts, w), w * y

    def losses(b: np.ndarray, logs: Sequence[float]) -> list[float]:
        """The loss for each logarithm of the dispersion; ln(gamma(y + r) / gamma(r)) by sums of logarithms, once for each count."""
        eta, out = np.clip(x @ b + off, -50, 50), []
        mu, fixed = np.exp(eta), (wy * eta).sum()
        for t in logs:
            a, r = math.exp(t), math.exp(-t)
            rising = np.concatenate([[0.0], np.cumsum(np.log(r + np.arange(len(of_count) - 1)))])
            out.append(float(-((of_count * rising).sum() + fixed + t * wy.sum() - ((w * r + wy) * np.log1p(a * mu)).sum())))
        return out

    last = math.inf
    for _ in range(steps):
        a = math.exp(log_a)
        for _ in range(25):
            mu = np.exp(np.clip(x @ beta + off, -50, 50))
            grad = x.T @ (w * (y - mu) / (1 + a * mu))
            info = (x * (w * mu / (1 + a * mu))[:, None]).T @ x
            try:
                move = np.linalg.solve(info, grad)
            except np.linalg.LinAlgError:
                return None
            beta = beta + move
            if np.abs(move).max() < 1e-9:
                break
        grid = np.linspace(max(-12.0, log_a - 1), min(5.0, log_a + 1), 41)
        found = losses(beta, grid)
        k = int(np.argmin(found))
        log_a, now = float(grid[k]), found[k]
        if abs(last - now) < 1e-8:
            se = np.sqrt(np.diag(np.linalg.inv(info)))
            return (beta, se) if np.all(np.isfinite(se)) else None
        last = now
    return None


def fit_poisson(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Poisson regression with HC1 errors; a row stands for ``weight`` equal ones."""
    w = np.ones(len(y)) if weight is None else weight
    off, beta = np.log(exposure), np.zeros(x.shape[1])
    beta[0] = math.log(max((w * y).sum(), 0.5) / (w * exposure).sum())
    for _ in range(100):
        mu = np.exp(np.clip(x @ beta + off, -50, 50))
        info = (x * (w * mu)[:, None]).T @ x
        try:
            move = np.linalg.solve(info, x.T @ (w * (y - mu)))
        except np.linalg.LinAlgError:
            return None
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            bread = np.linalg.inv(info)
            meat = (x * (w * (y - mu) ** 2)[:, None]).T @ x
            n, k = w.sum(), x.shape[1]
            return beta, np.sqrt(np.diag(bread @ meat @ bread) * n / (n - k))
    return None


def effects(a: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rate ratio of each tag with covariates: negative binomial, else Poisson with robust errors; one group a tag and person.

    ``a`` has keys, exposed, ectopy_count, hours, hour, comparison_key, and may
    have weight, the number of equal observations that a row stands for (see
    ``arm_cells``): a group then is bounded by the values that differ.
    """
    a = a if "weight" in a.columns else a.withColumn("weight", F.lit(1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema if f.name in keys) + ", status string, estimate double, ci_low double, ci_high double"

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        out = {k: d[k].iloc[0] for k in keys} | {"status": "insufficient", "estimate": None, "ci_low": None, "ci_high": None}
        # the same order of sums wherever the rows come from
        d = d.sort_values(["exposed", "hour", "comparison_key", "ectopy_count", "hours"])
        w, e = d["weight"].to_numpy(float), d["exposed"].to_numpy(bool)
        n1, n = int(w[e].sum()), int(w.sum())
        y, h = d["ectopy_count"].to_numpy(float), d["hours"].to_numpy(float)
        if min(n1, n - n1) >= MIN_ARM and (w * y).sum() >= MIN_EVENTS:
            if not y[e].sum() or not y[~e].sum():
                out["status"] = "no_events"
            else:
                x = _design(d)
                got, out["status"] = fit_negative_binomial(x, y, h, weight=w), "ok"
                if got is None:
                    got, out["status"] = fit_poisson(x, y, h, w), "poisson_fallback"
                if got is None:
                    out["status"] = "model_failed"
                else:
                    b, s = got[0][1], got[1][1]
                    out |= {"estimate": math.exp(b), "ci_low": math.exp(b - 1.959963984540054 * s), "ci_high": math.exp(b + 1.959963984540054 * s)}
        return pd.DataFrame([out])

    return a.select(*keys, "exposed", "ectopy_count", "hours", "hour", "comparison_key", "weight").groupBy(*keys).applyInPandas(fit, schema)


