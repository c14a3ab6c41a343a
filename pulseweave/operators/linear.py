"""A linear model of an outcome on a tag, the hour of day and the activity, with robust (HC1) errors, for every tag and person.

No group of sessions is brought together.  The sessions of a person give sums
of products of their covariates and outcome up to the fourth order by activity
level; the sessions with a tag give sums of the first order.  Normal equations
and the middle of the sandwich over all sessions follow from these in small
result rows; a second pass over the pairs of a session and a tag it has adds
what the tag changes there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_tail
from .stats import MIN_ARM, MIN_LEVEL, UNSPECIFIED, Z95, centred

#: Powers (a, b, c) of the sine and cosine of the hour and of the outcome, up to order four.
POWERS = [(a, b, c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
_AT = {p: i for i, p in enumerate(POWERS)}


def _times(x: dict, y: dict) -> dict:
    """The product of two polynomials, as dictionaries of powers."""
    out: dict = {}
    for p, u in x.items():
        for q, v in y.items():
            k = (p[0] + q[0], p[1] + q[1], p[2] + q[2])
            out[k] = out.get(k, 0.0) + u * v
    return out


def _linear(one: float, sine: float, cosine: float, outcome: float = 0.0) -> dict:
    return {(0, 0, 0): one, (1, 0, 0): sine, (0, 1, 0): cosine, (0, 0, 1): outcome}


def ladder(counts: dict[str, int]) -> tuple[list[str], bool, str | None]:
    """Activity levels (without the first, the reference) and hours in a model of so many sessions a level, and what was left out and why.

    Activity goes first where a level has few sessions, or where columns are too many for the sessions; then the hour goes.
    """
    n, levels, notes = sum(counts.values()), [], []
    if len(counts) > 1:
        if min(counts.values()) >= MIN_LEVEL:
            levels = sorted(counts)[1:]
        else:
            notes.append("activity: a level has few sessions")
    if levels and 4 + len(levels) + 2 > n:
        levels = []
        notes.append("activity: few sessions")
    hours = 4 + len(levels) + 2 <= n
    if not hours:
        notes.append("hour: few sessions")
    return levels, hours, "; ".join(notes) or None


def _solve(moments: dict[str, np.ndarray], tagged: dict[str, np.ndarray]) -> dict:
    """Coefficients, the tag's row of the inverse, and the sandwich's sum over all sessions as if none had the tag."""
    counts = {k: int(round(m[_AT[0, 0, 0]])) for k, m in moments.items()}
    levels, hours, note = ladder(counts)
    # columns: 1, tag, sine, cosine, levels
    width = 2 + 2 * hours + len(levels)
    gram, right = np.zeros((width, width)), np.zeros(width)
    order = [(0, 0), None, *([(1, 0), (0, 1)] if hours else [])]
    for level, m in moments.items():
        own = [i for i, p in enumerate(order) if p is not None] + ([width - len(levels) + levels.index(level)] if level in levels else [])
        power = {i: order[i] if i < len(order) else (0, 0) for i in own}
        for i in own:
            right[i] += m[_AT[(*power[i], 1)]]
            for j in own:
                gram[i, j] += m[_AT[power[i][0] + power[j][0], power[i][1] + power[j][1], 0]]
        n, s, c, y = tagged.get(level, np.zeros(4))
        right[1] += y
        gram[1, 1] += n
        first = {(0, 0): n, (1, 0): s, (0, 1): c}
        for i in own:
            gram[1, i] += first[power[i]]
            gram[i, 1] += first[power[i]]
    inverse = np.linalg.inv(gram)
    beta, row = inverse @ right, inverse[1]
    spread = lambda v: (v[0], v[2] if hours else 0.0, v[3] if hours else 0.0, {k: v[width - len(levels) + i] for i, k in enumerate(levels)})
    b, g, total = spread(beta), spread(row), 0.0
    for level, m in moments.items():
        e = _linear(-(b[0] + b[3].get(level, 0.0)), -b[1], -b[2], 1.0)
        x = _linear(g[0] + g[3].get(level, 0.0), g[1], g[2])
        total += sum(v * m[_AT[p]] for p, v in _times(_times(e, e), _times(x, x)).items() if v)
    n = sum(counts.values())
    # two coefficients a level with the intercepts in them, so that sessions need only their own level's
    both = {k: [b[0] + b[3].get(k, 0.0), g[0] + g[3].get(k, 0.0)] for k in moments}
    return {"beta": float(beta[1]), "row": float(row[1]), "hours": [float(b[1]), float(b[2]), float(g[1]), float(g[2])], "levels": both, "total": float(total), "scale": n / (n - width), "note": note}


_MODEL = "n_exposed long, n_unexposed long, status string, note string, beta double, row double, hours array<double>, levels map<string,array<double>>, total double, scale double"


def effects(observations: DataFrame, tags: DataFrame, value: str, kind: str = "delta", keys: Sequence[str] = ()) -> DataFrame:
    """keys, tag, n_exposed, n_unexposed, status, note, estimate, ci_low, ci_high, p_value.

    ``observations`` has session_id, keys, ``value``, hour (0 to 24, with a
    fraction) and comparison_key; ``tags`` has keys, session_id and tag.
    ``kind`` pct_change reads the estimate on a log scale.  Sessions without a
    value take no part.  Fewer than five sessions in an arm, or an outcome
    that does not vary, are ``insufficient``; a singular model is ``model_failed``.
    """
    hour = 2 * np.pi * F.col("hour") / 24.0
    d = centred(observations, value, keys).withColumns({"s": F.sin(hour), "c": F.cos(hour), "level": F.coalesce("comparison_key", F.lit(UNSPECIFIED))})
    d = d.select("session_id", *keys, "level", "s", "c", "v")
    on = list(keys)

    def product(a: int, b: int, c: int):
        out = F.lit(1.0)
        for name, k in (("s", a), ("c", b), ("v", c)):
            for _ in range(k):
                out = out * F.col(name)
        return F.sum(out)

    moments = d.groupBy(*on, "level").agg(F.array(*[product(*p) for p in POWERS]).alias("m"))
    moments = moments.groupBy(*on).agg(F.collect_list(F.struct("level", "m")).alias("moments"))  # a row for each activity level
    pairs = d.join(tags.select("session_id", "tag").distinct(), "session_id")
    first = pairs.groupBy(*on, "tag", "level").agg(F.array(*[F.sum(c) for c in (F.lit(1.0), F.col("s"), F.col("c"), F.col("v"))]).alias("m"))
    first = first.groupBy(*on, "tag").agg(F.collect_list(F.struct("level", "m")).alias("tagged"))
    used = tags.select(*on, "tag").distinct()
    if on:
        rows = used.join(moments, on)
    else:  # one person: one row of moments for all tags
        sums = moments.first().moments or []
        pack = lambda x: F.struct(F.lit(x.level).alias("level"), F.array(*map(F.lit, x.m)).alias("m"))
        rows = used.withColumn("moments", F.array(*map(pack, sums)) if sums else F.array().cast("array<struct<level:string,m:array<double>>>"))
    rows = rows.join(first, [*on, "tag"], "left")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*on, "tag").schema)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                sums = {x["level"]: np.asarray(x["m"], float) for x in r["moments"]}
                tagged = {x["level"]: np.asarray(x["m"], float) for x in r["tagged"]} if r["tagged"] is not None else {}
                n, vv = (sum(m[_AT[p]] for m in sums.values()) for p in ((0, 0, 0), (0, 0, 2)))
                n1 = int(round(sum(m[0] for m in tagged.values())))
                row = {k: r[k] for k in (*on, "tag")} | {"n_exposed": n1, "n_unexposed": int(round(n)) - n1, "status": "insufficient"}
                if min(n1, n - n1) >= MIN_ARM and vv / (n - 1) > 1e-18:
                    try:
                        row |= {"status": "ok"} | _solve(sums, tagged)
                    except np.linalg.LinAlgError:
                        row["status"] = "model_failed"
                out.append(row)
            names = [*on, "tag", *(c.split()[0] for c in _MODEL.split(", "))]
            yield pd.DataFrame(out).reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    models = rows.mapInPandas(fit, f"{kept}, {_MODEL}")
    m = models.select(*on, "tag", "beta", "row", "hours", "levels").where(F.col("status") == "ok")
    x = pairs.join(m, [*on, "tag"]).withColumns({"_l": F.col("levels")[F.col("level")], "_h": F.col("hours")})
    e = F.col("v") - F.col("_l")[0] - F.col("_h")[0] * F.col("s") - F.col("_h")[1] * F.col("c")
    g = F.col("_l")[1] + F.col("_h")[2] * F.col("s") + F.col("_h")[3] * F.col("c")
    with_tag = (e - F.col("beta")) * (g + F.col("row"))
    more = x.groupBy(*on, "tag").agg(F.sum(with_tag * with_tag - e * e * g * g).alias("_more"))
    out = models.join(more, [*on, "tag"], "left").withColumn("_se", F.sqrt(F.greatest(F.col("total") + F.col("_more"), F.lit(0.0)) * F.col("scale")))
    shown = (lambda v: 100.0 * (F.exp(v) - 1)) if kind == "pct_change" else (lambda v: v)
    ends = [shown(F.col("beta") + k * Z95 * F.col("_se")).alias(n) for k, n in ((-1, "ci_low"), (1, "ci_high"))]
    return out.select(*keys, "tag", "n_exposed", "n_unexposed", "status", "note", shown(F.col("beta")).alias("estimate"), *ends, normal_tail(F.try_divide("beta", "_se")).alias("p_value"))
