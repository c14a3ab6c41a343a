"""Effects of tags: plain fits, guards, no cross join."""

import math

import numpy as np
import pytest

from pulseweave.functions.tails import t_two_sided
from pulseweave.operators import linear, stats


def sessions(seed, n, persons=2, levels=("a", "b", "c")):
    g = np.random.default_rng(seed)
    rows, tags = [], []
    for i in range(n):
        mine = [t for t, p in (("x", 0.4), ("y", 0.3), ("rare", 0.02)) if g.random() < p]
        hour, level = float(g.integers(0, 1440)) / 60, [*levels, None][int(g.integers(len(levels) + 1))]
        v = 50 + 3 * ("x" in mine) + 2 * math.sin(2 * math.pi * hour / 24) + 4 * (level == "b") + g.normal(0, 1 + ("x" in mine))
        rows.append((i, i % persons, None if i % 17 == 3 else float(v), hour, level, int(g.integers(0, 9)), float(g.uniform(1, 8))))
        tags += [(i % persons, i, t) for t in mine] + [(i % persons, i, t) for t in mine[:1]]
    return rows, tags


SESSIONS, TAGS = "session_id long, person long, v0 double, hour double, comparison_key string, ectopy_count long, hours double", "person long, session_id long, tag string"


def plain_fit(rows, has):
    rows = [r for r in rows if r[2] is not None]
    levels = [r[4] or stats.UNSPECIFIED for r in rows]
    counts = {k: levels.count(k) for k in set(levels)}
    kept, hours, _ = linear.ladder(counts)
    cols = [np.ones(len(rows)), np.array([r[0] in has for r in rows], float)]
    if hours:
        h = 2 * np.pi * np.array([r[3] for r in rows]) / 24
        cols += [np.sin(h), np.cos(h)]
    cols += [np.array([x == k for x in levels], float) for k in kept]
    x, y = np.column_stack(cols), np.array([r[2] for r in rows])
    bread = np.linalg.inv(x.T @ x)
    e = y - x @ (bread @ x.T @ y)
    cov = bread @ ((x * (e * e)[:, None]).T @ x) @ bread * len(y) / (len(y) - x.shape[1])
    return (bread @ x.T @ y)[1], math.sqrt(cov[1, 1])


@pytest.mark.parametrize(("n", "levels"), [(240, ("a", "b", "c")), (40, ("a",)), (26, tuple("abcdefgh")), (16, ())])
def test_linear_model_equals_a_plain_fit(spark, n, levels):
    rows, tags = sessions(n, n, 2 if n > 100 else 1, levels)
    got = linear.effects(spark.createDataFrame(rows, SESSIONS), spark.createDataFrame(tags, TAGS), "v0", keys=["person"]).collect()
    assert {(r.person, r.tag) for r in got} == {(p, t) for p, _, t in tags}
    seen = 0
    for r in got:
        mine = [x for x in rows if x[1] == r.person]
        has = {i for p, i, t in tags if (p, t) == (r.person, r.tag)}
        n1 = sum(x[0] in has and x[2] is not None for x in mine)
        assert r.n_exposed == n1 and r.n_exposed + r.n_unexposed == sum(x[2] is not None for x in mine)
        if r.status == "insufficient":
            assert n1 < 5 or r.n_unexposed < 5
            continue
        seen += 1
        b, se = plain_fit(mine, has)
        assert r.status == "ok" and abs(r.estimate - b) < 1e-7 and abs(r.ci_low - (b - stats.Z95 * se)) < 1e-6 and abs(r.p_value - math.erfc(abs(b / se) / math.sqrt(2))) < 1e-8
    assert seen
    if n == 40:  # as one person without keys
        one = linear.effects(spark.createDataFrame(rows, SESSIONS), spark.createDataFrame(tags, TAGS), "v0").orderBy("tag").collect()
        near = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        assert [near(r) for r in one] == [near(r[1:]) for r in sorted(got, key=lambda r: r.tag)]
        assert linear.effects(spark.createDataFrame(rows, SESSIONS).limit(0), spark.createDataFrame(tags, TAGS), "v0").where("status <> 'insufficient'").count() == 0


def test_ladder_drops_activity_then_hour():
    assert linear.ladder({"a": 20, "b": 9}) == (["b"], True, None)
    assert linear.ladder({"a": 20, "b": 2}) == ([], True, "activity: a level has few sessions")
    assert linear.ladder({"a": 3, "b": 3}) == ([], True, "activity: few sessions")
    assert linear.ladder({"a": 5}) == ([], False, "hour: few sessions")


def test_outcomes_that_do_not_vary_are_refused(spark):
    o = spark.createDataFrame([(i, 0, 1.0, 1.0, "a", 1, 1.0) for i in range(20)], SESSIONS)
    t = spark.createDataFrame([(0, i, "x") for i in range(10)], TAGS)
    assert linear.effects(o, t, "v0").first().status == "insufficient" and stats.difference_by_tag(o, t, "v0").first().status == "insufficient"
    assert linear.effects(o.limit(0), t, "v0", keys=["person"]).count() == 0


def test_arms_from_sums_equal_arms_from_rows(spark):
    rows, tags = sessions(9, 200)
    o, t = spark.createDataFrame(rows, SESSIONS), spark.createDataFrame([*tags, (0, 10**6, "nobody")], TAGS)
    pairs = stats.arms(o, t, ["person"])
    for keys in ([], ["person"]):
        a = pairs if keys else o.crossJoin(t.select("tag").distinct()).join(t.selectExpr("session_id", "tag", "true AS e").distinct(), ["session_id", "tag"], "left").selectExpr("*", "coalesce(e, false) AS exposed")
        for one, two in (
            (stats.rate_ratio(a, [*keys, "tag"]), stats.rate_ratio_by_tag(o, t, keys)),
            (stats.difference(a, "v0", [*keys, "tag"]), stats.difference_by_tag(o, t, "v0", keys=keys)),
        ):
            show = lambda d: sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in d.orderBy(*keys, "tag").collect())
            assert list(map(str, show(one))) == list(map(str, show(two)))
            assert "Cartesian" not in two._jdf.queryExecution().toString() and "NestedLoop" not in two._jdf.queryExecution().toString()  # noqa: SLF001
    assert stats.rate_ratio_by_tag(o, t).where("tag = 'nobody'").first().status == "insufficient"


def test_rank_correlation_has_the_tail_of_t(spark):
    g = np.random.default_rng(2)
    x = g.integers(0, 12, 40)
    d = spark.createDataFrame([(0, float(a), float(a + b)) for a, b in zip(x, g.normal(0, 6, 40), strict=True)] + [(1, float(i), float(i)) for i in range(14)], "k long, x double, y double")
    r = {q.k: q for q in stats.spearman(d, "x", "y", ["k"]).collect()}
    t = r[0].rho * math.sqrt(38 / (1 - r[0].rho ** 2))
    assert abs(r[0].p_value - t_two_sided(t, 38)) < 1e-12 and 0 < r[0].p_value < 1 and r[1].p_value < 1e-9
    for v in (0.1, 2.5, 30.0):
        assert abs(t_two_sided(v, 1) - (1 - 2 / math.pi * math.atan(v))) < 1e-12
        assert abs(t_two_sided(v, 4) - (1 - v / math.sqrt(4 + v * v) * (1 + 2 / (4 + v * v)))) < 1e-12
