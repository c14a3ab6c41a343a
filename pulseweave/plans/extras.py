"""Queries over landing folders, sinks, adapters, Python aggregates and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import grouped
from ..operators import activity, context, hrv, nightly, posture, quality, series, sleep
from ..session import new_folder, table
from ..sources import landing
from .adapter import BEATS_SQL, RR_SQL, beats, rr_series
from .events import PREM_SQL, _confirmed
from .nights import HYP_SQL, _hypnogram
from .registry import Registry, tidy
from .signals import _MERGED, _SUMMARY, _postures, _samples

R = Registry()


def _nights(spark, sf_dir):
    """A night's answer for each event: every fifth score is a word, times have an offset of two hours."""
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(k % 5 == 0, F.lit("n/a")).otherwise(k.cast("string")).alias("sleep_score"), F.col("value").alias("continuity"),
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("sleep_start_time"), F.lit("soon").alias("sleep_end_time"),
        )
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@R.add(
    """WITH e AS (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(ts AS DATE) AS night, CASE WHEN k % 5 = 0 THEN NULL ELSE k END AS sleep_score, round(value, 6) AS continuity,
  CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 2 HOUR AS sleep_start, CAST(NULL AS TIMESTAMP) AS sleep_end FROM e"""
)
def night_landing(spark, sf_dir):
    n = landing.nights(_nights(spark, sf_dir))
    return tidy(n.select("event_id", "night", "sleep_score", "continuity", F.col("sleep_start_time").alias("sleep_start"), F.col("sleep_end_time").alias("sleep_end")))


@R.add("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS VARCHAR) AS time, round(value, 6) AS value FROM events")
def hourly_landing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.struct(F.transform("r", lambda x: x["event_id"].cast("string")).alias("time"), F.transform("r", lambda x: x["value"]).alias("value")).alias("hourly")), {"ignoreNullFields": "false"})
    lines = e.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "value")).alias("r")).select("user_id", body.alias("body"))
    return tidy(landing.series(lines, ["value"]))


@R.add("SELECT l_orderkey, l_linenumber AS n, l_returnflag AS answer, [l_linestatus, l_returnflag][1] AS first_option FROM lineitem WHERE l_linenumber = 1")
def question_round_trip(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    text = F.to_json(F.struct(F.col("l_returnflag").alias("answer"), F.array("l_linestatus", "l_returnflag").alias("options")))
    q = l.select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.from_json(text, "answer string, options array<string>").alias("q"))
    return q.select("l_orderkey", "n", "q.answer", F.col("q.options")[0].alias("first_option"))


@R.add(BEATS_SQL + " SELECT session_id, round(min(t_s), 6) AS first_s, round(max(t_s), 6) AS last_s, round(max(t_s) - min(t_s), 6) AS duration_s FROM beats GROUP BY 1")
def recording_span(spark, sf_dir):
    return tidy(landing.span(beats(spark, sf_dir)))


@R.add(BEATS_SQL + ", s AS (SELECT session_id, min(ts) AS t0 FROM beats GROUP BY 1) SELECT b.session_id, beat, t0 + to_microseconds(CAST(round(t_s * 1e6) AS BIGINT)) AS at FROM beats b JOIN s ON s.session_id = b.session_id")
def elapsed_clock(spark, sf_dir):
    b = beats(spark, sf_dir)
    start = b.groupBy("session_id").agg(F.min("ts").alias("t0"))
    return b.join(start, "session_id").select("session_id", "beat", context.clock(F.col("t0"), F.col("t_s")).alias("at"))


@R.add(PREM_SQL + " SELECT session_id, array_to_string((list(beat ORDER BY beat))[1:100], ',') AS beats FROM ect GROUP BY 1")
def first_confirmed(spark, sf_dir):
    found = F.slice(F.array_sort(F.collect_list("beat")), 1, 100)
    return _confirmed(spark, sf_dir).groupBy("session_id").agg(F.array_join(found.cast("array<string>"), ",").alias("beats"))


@R.add(
    """WITH t AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 18 AS tag FROM events),
r AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS rate FROM events GROUP BY 1),
g AS (SELECT DISTINCT tag FROM t WHERE tag IS NOT NULL),
x AS (SELECT g.tag, r.rate, t.tag IS NOT NULL AS has FROM g CROSS JOIN r LEFT JOIN t ON t.user_id = r.user_id AND t.tag = g.tag)
SELECT tag, coalesce(string_agg(CAST(rate AS VARCHAR), ',' ORDER BY rate) FILTER (has), '') AS tagged, coalesce(string_agg(CAST(rate AS VARCHAR), ',' ORDER BY rate) FILTER (NOT has), '') AS untagged FROM x GROUP BY 1"""
)
def rates_by_tag(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = e.select(F.col("user_id").alias("session_id"), (F.get_json_object("props", "$.k").cast("long") % 18).alias("tag")).where("tag IS NOT NULL")
    rates = e.groupBy(F.col("user_id").alias("session_id")).agg(F.count_if(F.col("event_type") == "signup").alias("rate"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return context.rates_by_tag(rates, tags).select("tag", text("tagged"), text("untagged"))


@R.add(
    _SUMMARY
    + """, u AS (SELECT session_id, unnest([{'p': 'supine', 'c': supine}, {'p': 'prone', 'c': prone}, {'p': 'left', 'c': lft}, {'p': 'right', 'c': rgt}, {'p': 'upright', 'c': upright}]) AS x FROM su WHERE n > 0)
SELECT session_id, string_agg(x.p, ',' ORDER BY x.c DESC, x.p) AS postures FROM u WHERE x.c > 0 GROUP BY 1"""
)
def posture_order(spark, sf_dir):
    s = posture.summarize(_postures(spark, sf_dir))
    names = ("supine", "prone", "left", "right", "upright")
    shares = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"pct_{p}") for p in names]))
    entries = F.filter(F.map_entries(shares), lambda x: x["value"] > 0)
    ordered = F.array_sort(F.transform(entries, lambda x: F.struct((-x["value"]).alias("v"), x["key"].alias("p"))))
    return s.select("session_id", F.array_join(F.transform(ordered, lambda x: x["p"]), ",").alias("postures")).where("postures <> ''")


@R.add("SELECT * FROM (VALUES ('wake_sleep_2', 'Wake/Sleep'), ('wake_rem_nrem_3', 'Wake/NREM/REM'), ('wldr_4', 'Wake/Light/Deep/REM'), ('aasm_5', 'Wake/N1/N2/N3/REM')) AS t(vocab, labels)")
def vocabulary_labels(spark, sf_dir):
    v = spark.createDataFrame([(k, list(x)) for k, x in sleep.VOCABULARIES.items()], "vocab string, labels array<string>")
    return v.select("vocab", F.array_join("labels", "/").alias("labels"))


@R.add("SELECT l_orderkey, l_linenumber AS n, abs(l_extendedprice - l_quantity * 1000) <= greatest(0.5 * greatest(abs(l_extendedprice), abs(l_quantity * 1000)), 100.0) AS near FROM lineitem")
def close_values(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), context.close(F.col("l_extendedprice"), F.col("l_quantity") * 1000, 0.5, 100.0).alias("near"))


@R.add(
    _MERGED
    + """, du AS (SELECT session_id, max(t_s) - min(t_s) AS d FROM sa GROUP BY 1), to_ AS (SELECT session_id, sum(end_s - start_s) AS x FROM me GROUP BY 1),
y AS (SELECT du.session_id, coalesce(x, 0) AS x, greatest(0, d - coalesce(x, 0)) AS a FROM du LEFT JOIN to_ ON du.session_id = to_.session_id)
SELECT session_id, round(CASE WHEN x + a > 0 THEN x / (x + a) ELSE 0.0 END, 6) AS excluded_fraction FROM y"""
)
def excluded_fraction(spark, sf_dir):
    s = _samples(spark, sf_dir)
    t = quality.totals(quality.merge_excluded(quality.windows(s)), landing.span(s).select("session_id", "duration_s"))
    return tidy(activity.excluded_fraction(t).select("session_id", "excluded_fraction"))


@R.add(
    RR_SQL
    + """, a AS (SELECT *, CAST(floor((t_s - t0) / 60.0) AS BIGINT) AS w FROM (SELECT *, min(t_s) OVER (PARTITION BY session_id) AS t0 FROM dd)),
b AS (SELECT *, lag(w) OVER (PARTITION BY session_id ORDER BY n) AS pw FROM a),
m AS (SELECT session_id, w, sqrt(avg(CASE WHEN pw = w THEN d_ms * d_ms END)) AS r FROM b GROUP BY 1, 2 HAVING count(CASE WHEN pw = w THEN d_ms END) >= 10)
SELECT session_id, round(CASE WHEN count(*) >= 3 THEN regr_slope(r, w) END, 6) AS slope_ms_per_min FROM m GROUP BY 1"""
)
def rmssd_reactivation(spark, sf_dir):
    return tidy(activity.reactivation_slope(hrv.per_minute_rmssd(rr_series(spark, sf_dir))))


@R.add(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN hi < 100 OR hi > 250 THEN 'max_hr_bpm' END, CASE WHEN lo < 25 OR lo > 120 THEN 'resting_hr_bpm' END, CASE WHEN lo >= hi THEN 'resting_hr_bpm>=max_hr_bpm' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT c_custkey, c_custkey * 7 % 300 AS hi, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 3 % 150 END AS lo FROM customer)"""
)
def form_ranges(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (k * 7 % 300).alias("max_hr_bpm"), F.when(k % 5 != 0, k * 3 % 150).alias("resting_hr_bpm"))
    found = context.outside_ranges(p, [("max_hr_bpm", 100, 250), ("resting_hr_bpm", 25, 120)], [("resting_hr_bpm", "max_hr_bpm")])
    return found.select("c_custkey", F.array_join("violations", ",").alias("violations"))


@R.add(
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'recovery' WHEN 1 THEN 'sleep' WHEN 2 THEN 'supine' END AS p, o_orderstatus = 'P' AS paced FROM orders)
SELECT o_orderkey, CASE WHEN p = 'recovery' THEN 'frequency,time' WHEN p = 'sleep' THEN 'frequency,nonlinear' WHEN paced THEN 'frequency' ELSE '' END AS cautions FROM s"""
)
def profile_cautions(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "recovery").when(k == 1, "sleep").when(k == 2, "supine").alias("profile_key"), (F.col("o_orderstatus") == "P").alias("paced"))
    return activity.cautions(s).select("o_orderkey", F.array_join("cautions", ",").alias("cautions"))


@R.add(
    """WITH e AS (SELECT CAST(label AS BIGINT) AS session_id, vec_id AS epoch, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS p FROM embeddings WHERE label IS NOT NULL)
SELECT session_id, epoch, CAST(CASE WHEN epoch % 10 = 0 THEN -1 ELSE [-1, 1, 2, 0][list_position(p, list_max(p))] END AS BIGINT) AS stage FROM e"""
)
def classifier_stages(spark, sf_dir):
    """The first four dimensions stand in for a classifier's four columns; it leaves every tenth epoch out."""
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("epoch"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("p"))
    return tidy(sleep.from_probabilities(e.where("epoch % 10 <> 0"), e.select("session_id", "epoch")))


@R.add(
    HYP_SQL
    + """, c AS (SELECT session_id, epoch, stage FROM hy WHERE NOT (session_id % 2 = 0 AND epoch % 3 = 0)), n AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1), m AS (SELECT session_id, count(*) AS m FROM hy GROUP BY 1)
SELECT hy.session_id, hy.epoch, CAST(CASE WHEN c.stage BETWEEN 0 AND 4 THEN c.stage ELSE -1 END AS BIGINT) AS stage, CASE WHEN n.n = m.m THEN 'ok' ELSE 'count mismatch' END AS status
FROM hy LEFT JOIN c ON c.session_id = hy.session_id AND c.epoch = hy.epoch JOIN m ON m.session_id = hy.session_id LEFT JOIN n ON n.session_id = hy.session_id"""
)
def external_stages(spark, sf_dir):
    h = _hypnogram(spark, sf_dir).select("session_id", "epoch", "stage")
    return tidy(sleep.from_codes(h.where("NOT (session_id % 2 = 0 AND epoch % 3 = 0)"), h.select("session_id", "epoch")))


@R.add(HYP_SQL + " SELECT session_id, epoch, CAST(stage AS BIGINT) AS stage, 'ok' AS status, 'as_is' AS engine FROM hy UNION ALL SELECT session_id, epoch, CAST(CASE WHEN stage > 0 THEN 1 ELSE stage END AS BIGINT), 'ok', 'two_stage' FROM hy UNION ALL SELECT NULL, NULL, NULL, 'failed', 'absent'")
def staging_engines(spark, sf_dir):
    def absent(_):
        raise RuntimeError("not installed")

    engines = {"as_is": lambda h: h, "two_stage": lambda h: h.withColumn("stage", F.least("stage", F.lit(1))), "absent": absent}
    out = sleep.run_engines(_hypnogram(spark, sf_dir), engines)
    return tidy(out.withColumn("status", F.substring_index("status", ":", 1)))


@R.add(
    HYP_SQL
    + """,
o AS (SELECT *, min(epoch) FILTER (stage >= 1) OVER w AS on_, max(epoch) FILTER (stage >= 1) OVER w AS off_ FROM hy WINDOW w AS (PARTITION BY session_id)),
s AS (SELECT session_id, 100.0::DOUBLE * count(*) FILTER (stage >= 1) / nullif(count(*) FILTER (stage <> -1), 0) AS eff, max(on_) * 0.5::DOUBLE AS lat,
  CASE WHEN max(on_) IS NOT NULL THEN count(*) FILTER (epoch > on_ AND epoch <= off_ AND stage = 0) * 0.5::DOUBLE END AS waso, min(epoch - on_) FILTER (stage = 3) * 0.5::DOUBLE AS rem FROM o GROUP BY 1),
u AS (SELECT session_id, 'efficiency_pct' AS metric, eff AS value, 85.0 AS low, 100.0 AS high FROM s UNION ALL SELECT session_id, 'latency_min', lat, 0.0, 30.0 FROM s UNION ALL SELECT session_id, 'waso_min', waso, 0.0, 40.0 FROM s UNION ALL SELECT session_id, 'rem_latency_min', rem, 60.0, 120.0 FROM s
  UNION ALL SELECT session_id, x.m, 100.0::DOUBLE * x.c / n, x.lo, x.hi FROM (
    SELECT session_id, n, unnest([{'m': 'Light_pct', 'c': a, 'lo': 40.0, 'hi': 65.0}, {'m': 'Deep_pct', 'c': b, 'lo': 5.0, 'hi': 25.0}, {'m': 'REM_pct', 'c': c, 'lo': 15.0, 'hi': 28.0}]) AS x
    FROM (SELECT session_id, count(*) FILTER (stage >= 1) AS n, count(*) FILTER (stage = 1) AS a, count(*) FILTER (stage = 2) AS b, count(*) FILTER (stage = 3) AS c FROM hy GROUP BY 1) WHERE n > 0))
SELECT session_id, metric, round(value, 6) AS value, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CASE WHEN value < low THEN 'below range' WHEN value > high THEN 'above range' ELSE 'within range' END AS verdict FROM u WHERE value IS NOT NULL"""
)
def night_plausibility(spark, sf_dir):
    h = _hypnogram(spark, sf_dir)
    return tidy(sleep.plausibility(sleep.summarize(h), shares=sleep.stage_shares(h)))


@R.add(RR_SQL + " SELECT session_id, round(sqrt(avg(d_ms * d_ms)), 6) AS rmssd_ms FROM dd GROUP BY 1 HAVING count(d_ms) > 0")
def rmssd_aggregate(spark, sf_dir):
    d = series.differences(rr_series(spark, sf_dir)).where("d_ms IS NOT NULL")
    return tidy(d.groupBy("session_id").agg(grouped.rmssd()("d_ms").alias("rmssd_ms")))


@R.add(
    RR_SQL
    + """, e AS (SELECT session_id, min(t_s) AS t0, max(t_s) AS t1 FROM rr GROUP BY 1), g AS (SELECT *, unnest(generate_series(0, CAST(floor((t1 - t0) / 60.0) AS BIGINT) + 1)) AS k FROM e)
SELECT session_id, k, round(t0 + k * 60.0, 3) AS start_s, round(t0 + k * 60.0 + 300.0, 3) AS end_s FROM g WHERE t0 + k * 60.0 <= t1 - 300.0 + 60.0"""
)
def window_table(spark, sf_dir):
    grouped.register(spark)
    rr_series(spark, sf_dir).groupBy("session_id").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1")).createOrReplaceTempView("pulseweave_spans")
    return tidy(spark.sql("SELECT session_id, w.k, w.start_s, w.end_s FROM pulseweave_spans, LATERAL sliding_windows(t0, t1, 300D, 60D) w"), 3)


@R.add("SELECT c_nationkey AS session_id, count(*) AS n, CASE WHEN c_nationkey % 2 = 0 THEN 4 ELSE 3 END AS pipeline_version FROM customer WHERE c_nationkey % 5 <> 4 OR c_nationkey % 2 = 0 GROUP BY 1")
def session_replace(spark, sf_dir):
    """Version 2 or 3 of all sessions, then version 4 of the even ones, twice; version 2 does not count."""
    folder = new_folder(spark, "sessions")
    k = F.col("c_nationkey").cast("long")
    rows = table(spark, sf_dir, "customer").groupBy(k.alias("session_id")).agg(F.count("*").alias("n"))
    sinks.replace_sessions(rows.withColumn("pipeline_version", F.when(F.col("session_id") % 5 == 4, 2).otherwise(3)), folder)
    for _ in range(2):
        sinks.replace_sessions(rows.where("session_id % 2 = 0").withColumn("pipeline_version", F.lit(4)), folder)
    return tidy(landing.of_version(spark.read.parquet(folder), 3).select("session_id", "n", "pipeline_version"))


_SYNC = """rq AS (SELECT c_custkey AS person_id, DATE '2025-01-01' + CAST(c_custkey % 40 AS INTEGER) AS s, DATE '2025-01-01' + CAST(c_custkey % 97 AS INTEGER) AS e, DATE '2025-03-15' AS today FROM customer),
av AS (SELECT DISTINCT o_custkey AS person_id, DATE '2025-01-01' + CAST(o_orderkey % 60 AS INTEGER) AS date FROM orders),
r AS (SELECT *, today - 28 AS f FROM rq WHERE s <= e),
ca AS (
  SELECT person_id, 0 AS step, unnest([{'c': 'sleep', 'i': 0}, {'c': 'recharge', 'i': 1}]) AS x, 'list' AS kind, greatest(s, f) AS a, e AS b FROM r WHERE e >= f
  UNION ALL SELECT person_id, 1, {'c': 'available', 'i': 0}, 'available', s, least(e, f - 1) FROM r WHERE s < f
  UNION ALL SELECT r.person_id, 2, unnest([{'c': 'sleep', 'i': 0}, {'c': 'recharge', 'i': 1}]), 'night', av.date, av.date FROM r JOIN av ON av.person_id = r.person_id WHERE s < f AND av.date BETWEEN s AND least(e, f - 1)),
pl AS (SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY step, a, x.i) AS seq, x.c AS call, kind, CAST(a AS DATE) AS from_date, CAST(b AS DATE) AS to_date FROM ca)"""


def _sync(spark, sf_dir):
    k = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2025-01-01").cast("date"), n.cast("int"))
    requests = table(spark, sf_dir, "customer").select(k.alias("person_id"), day(k % 40).alias("start_date"), day(k % 97).alias("end_date"), F.lit("2025-03-15").cast("date").alias("today"))
    return nightly.plan(requests, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), day(F.col("o_orderkey") % 60).alias("date")))


@R.add(f"WITH {_SYNC} SELECT person_id, seq, call, kind, from_date, to_date FROM pl")
def sync_plan(spark, sf_dir):
    return tidy(_sync(spark, sf_dir))


@R.add(
    f"""WITH {_SYNC}, an AS (SELECT *, CASE WHEN (person_id * 7 + seq) % 23 = 0 THEN 429 ELSE 200 END AS status FROM pl),
st AS (SELECT *, coalesce(max(status = 429) OVER (PARTITION BY person_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS b FROM an)
SELECT person_id, seq, CASE WHEN b THEN 'skipped' WHEN status = 429 THEN 'stopped' ELSE 'made' END AS outcome FROM st"""
)
def sync_stops(spark, sf_dir):
    calls = _sync(spark, sf_dir)
    answers = calls.select("person_id", "seq", F.when((F.col("person_id") * 7 + F.col("seq")) % 23 == 0, 429).otherwise(200).alias("status"))
    return tidy(nightly.until_stopped(calls, answers).select("person_id", "seq", "outcome"))


@R.add(
    """WITH h AS (SELECT DISTINCT user_id AS person_id, CAST(ts AS DATE) AS date FROM events), w AS (SELECT person_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM h GROUP BY 1),
g AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.person_id = w.person_id AND h.date = w.date)),
r AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY person_id ORDER BY date) AS INTEGER) AS run FROM g),
p AS (SELECT *, (date - min(date) OVER (PARTITION BY person_id, run)) // 28 AS part FROM r)
SELECT person_id, min(date) AS from_date, max(date) AS to_date, count(*) AS nights FROM p GROUP BY person_id, run, part"""
)
def missing_nights(spark, sf_dir):
    held = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.to_date("ts").alias("date"))
    ends = held.groupBy("person_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return nightly.missing_islands(ends.select("person_id", F.explode(F.sequence("a", "b")).alias("date")), held)


@R.add(HYP_SQL + " SELECT session_id, epoch, CAST(stage AS BIGINT) AS stage FROM hy")
def epoch_export(spark, sf_dir):
    folder = new_folder(spark, "export")
    sinks.export_csv(_hypnogram(spark, sf_dir).select("session_id", "epoch", "stage"), folder)
    return spark.read.schema("session_id long, epoch long, stage long").option("header", "true").csv(folder)
