"""Queries over ectopic beats, islands and screening flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ectopy, hrv, screening, series
from .adapter import BEATS_SQL, RR_SQL, beats, excluded, raw_intervals, rr_series
from .registry import Registry, tidy
from .rhythm import _SLIDING, COSEN_SQL

R = Registry()

#: Beat k of a session is under motion if its event has an even property.
PREM_SQL = (
    RR_SQL
    + """,
pl AS (
  SELECT session_id, n, rr_ms, list_concat(coalesce(list(rr_ms) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []),
         coalesce(list(rr_ms) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), [])) AS a FROM raw),
pm AS (SELECT session_id, n, CASE WHEN len(a) >= 3 AND list_median(a) > 0 THEN 100.0 * (rr_ms - list_median(a)) / list_median(a) END AS p FROM pl),
bt AS (SELECT b.session_id, b.beat, pm.p, b.k % 10 = 0 AS motion, b.event_type FROM beats b LEFT JOIN pm ON pm.session_id = b.session_id AND pm.n = b.beat),
cand AS (SELECT session_id, beat AS i FROM bt WHERE event_type = 'signup'),
best AS (
  SELECT cand.session_id, cand.i, bt.beat, bt.p, bt.motion, row_number() OVER (PARTITION BY cand.session_id, cand.i ORDER BY bt.p, bt.beat) AS r
  FROM cand JOIN bt ON bt.session_id = cand.session_id AND bt.beat IN (cand.i - 1, cand.i) WHERE bt.p IS NOT NULL),
ect AS (SELECT DISTINCT session_id, beat FROM best WHERE r = 1 AND p <= -20 AND NOT coalesce(motion, false)),
grp AS (
  SELECT session_id, min(beat) AS start_beat, max(beat) AS end_beat, count(*) AS n_ectopic
  FROM (SELECT *, beat - row_number() OVER (PARTITION BY session_id ORDER BY beat) AS g FROM ect) GROUP BY session_id, g),
kin AS (SELECT *, CASE WHEN n_ectopic >= 3 THEN 'run' WHEN n_ectopic = 2 THEN 'couplet' ELSE 'single' END AS kind FROM grp),
ref AS (
  SELECT kin.session_id, start_beat, end_beat, CASE WHEN count(raw.n) >= 3 THEN quantile_cont(raw.rr_ms, 0.5) END AS reference_ms
  FROM kin LEFT JOIN raw ON raw.session_id = kin.session_id AND raw.rr_ms BETWEEN 300 AND 2200
    AND (raw.n BETWEEN start_beat - 10 AND start_beat - 1 OR raw.n BETWEEN end_beat + 2 AND end_beat + 11) GROUP BY 1, 2, 3),
us AS (SELECT session_id, n, rr_ms FROM fated WHERE fate = 'kept'),
pau AS (
  SELECT kin.*, reference_ms, CASE WHEN reference_ms > 0 THEN (b.rr_ms + c.rr_ms) / (2 * reference_ms) END AS pause_ratio
  FROM kin JOIN ref USING (session_id, start_beat, end_beat)
  LEFT JOIN us b ON b.session_id = kin.session_id AND b.n = kin.start_beat LEFT JOIN us c ON c.session_id = kin.session_id AND c.n = kin.end_beat + 1),
ses AS (SELECT session_id, max(t_s) AS analysed_s, count(*) AS n_beats FROM beats GROUP BY 1),
bur AS (
  SELECT ses.session_id, analysed_s, n_beats, CAST(coalesce(sum(n_ectopic), 0) AS BIGINT) AS n, count(*) FILTER (kind = 'single') AS singles, count(*) FILTER (kind = 'couplet') AS couplets,
         count(*) FILTER (kind = 'run') AS runs, coalesce(max(n_ectopic), 0) AS longest, count(*) FILTER (pause_ratio >= 0.95) AS pauses_complete, count(*) FILTER (pause_ratio < 0.95) AS pauses_incomplete
  FROM ses LEFT JOIN pau ON pau.session_id = ses.session_id GROUP BY 1, 2, 3)"""
)


def _beat_facts(spark, sf_dir):
    b = beats(spark, sf_dir)
    p = hrv.prematurity(series.intervals(b).select("session_id", "n", "rr_ms")).withColumnRenamed("n", "beat")
    return b.join(p, ["session_id", "beat"], "left").select("session_id", "beat", "prematurity_pct", (F.col("k") % 10 == 0).alias("motion"), "event_type")


def _confirmed(spark, sf_dir):
    f = _beat_facts(spark, sf_dir)
    return ectopy.confirm(f.where(F.col("event_type") == "signup").select("session_id", "beat"), f)


def _events(spark, sf_dir):
    b = beats(spark, sf_dir)
    rr = series.judged_intervals(b, excluded(b)).withColumn("excluded", F.col("fate") == "excluded")
    return ectopy.pauses(ectopy.groups(_confirmed(spark, sf_dir)), rr)


def _burden(spark, sf_dir):
    sessions = beats(spark, sf_dir).groupBy("session_id").agg(F.max("t_s").alias("analysed_s"), F.count("*").alias("n_beats"))
    return ectopy.burden(_events(spark, sf_dir), sessions)


@R.add(PREM_SQL + " SELECT session_id, beat FROM ect")
def ectopy_confirm(spark, sf_dir):
    return _confirmed(spark, sf_dir)


@R.add(PREM_SQL + " SELECT session_id, start_beat, end_beat, n_ectopic, kind, round(pause_ratio, 6) AS pause_ratio, pause_ratio >= 0.95 AS pause_complete FROM pau")
def ectopy_events(spark, sf_dir):
    return tidy(_events(spark, sf_dir))


@R.add(
    PREM_SQL
    + """ SELECT session_id, round(analysed_s, 6) AS analysed_s, n_beats, n, singles, couplets, runs, longest, pauses_complete, pauses_incomplete,
  round(n / (analysed_s / 3600.0), 6) AS per_hour, round(100.0 * n / n_beats, 6) AS pct FROM bur"""
)
def ectopy_burden(spark, sf_dir):
    return tidy(_burden(spark, sf_dir))


@R.add(PREM_SQL + " SELECT session_id, start_beat, end_beat, round(reference_ms, 6) AS reference_ms FROM ref")
def local_reference_rr(spark, sf_dir):
    found = ectopy.local_reference(ectopy.groups(_confirmed(spark, sf_dir)), raw_intervals(spark, sf_dir))
    return tidy(found.select("session_id", "start_beat", "end_beat", "reference_ms"))


@R.add(
    BEATS_SQL
    + """ SELECT session_id, min(beat) AS start_beat, max(beat) AS end_beat, count(*) AS n_ectopic,
  CASE WHEN count(*) >= 3 THEN 'run' WHEN count(*) = 2 THEN 'couplet' ELSE 'single' END AS kind
FROM (SELECT *, beat - row_number() OVER (PARTITION BY session_id ORDER BY beat) AS g FROM beats WHERE event_type = 'signup') GROUP BY session_id, g"""
)
def consecutive_groups(spark, sf_dir):
    return ectopy.groups(beats(spark, sf_dir).where(F.col("event_type") == "signup").select("session_id", "beat"))


_CHAIN = (
    BEATS_SQL
    + """,
c AS (SELECT session_id, beat, coalesce(beat - lag(beat) OVER (PARTITION BY session_id ORDER BY beat) <> {step}, true) AS brk FROM beats WHERE event_type = 'click'),
d AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY beat ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT session_id, min(beat) AS start_beat, max(beat) AS end_beat, count(*) AS n_beats FROM d GROUP BY session_id, g HAVING count(*) >= 3"""
)


@R.add(_CHAIN.format(step=2))
def bigeminy(spark, sf_dir):
    return ectopy.patterns(beats(spark, sf_dir).where(F.col("event_type") == "click").select("session_id", "beat"), 2)


@R.add(_CHAIN.format(step=3))
def trigeminy(spark, sf_dir):
    return ectopy.patterns(beats(spark, sf_dir).where(F.col("event_type") == "click").select("session_id", "beat"), 3)


_SPANS = """,
ac AS (SELECT session_id, window_start_s AS s, window_start_s + 45.0 AS e, hr FROM sw WHERE hr {op} {limit}),
br AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM ac),
gr AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM br),
sp AS (SELECT session_id, min(s) AS s, max(e) AS e, {agg}(hr) AS worst, count(*) AS n FROM gr GROUP BY session_id, g)
SELECT session_id, '{kind}' AS kind, round({agg}(worst), 1) AS worst_bpm, CAST(sum(n) AS BIGINT) AS n_windows,
  string_agg(printf('%.1f-%.1f', s, e), ',' ORDER BY s) AS spans FROM sp GROUP BY 1"""


@R.add(_SLIDING.format(width="45.0", step="5.0") + _SPANS.format(op=">", limit=80, agg="max", kind="sustained_high_hr"))
def flag_sustained_high(spark, sf_dir):
    return screening.sustained(hrv.sustained_hr(rr_series(spark, sf_dir)), "sustained_high_hr", 80.0)


@R.add(_SLIDING.format(width="45.0", step="5.0") + _SPANS.format(op="<", limit=80, agg="min", kind="sustained_low_hr"))
def flag_sustained_low(spark, sf_dir):
    return screening.sustained(hrv.sustained_hr(rr_series(spark, sf_dir)), "sustained_low_hr", 80.0)


@R.add(
    BEATS_SQL
    + """,
s AS (SELECT session_id, t_s AS s, t_s + value / 20.0 AS e FROM beats WHERE event_type = 'view' AND value IS NOT NULL),
br AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM s),
gr AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM br)
SELECT session_id, round(min(s), 6) AS start_s, round(max(e), 6) AS end_s FROM gr GROUP BY session_id, g"""
)
def merge_spans(spark, sf_dir):
    b = beats(spark, sf_dir).where((F.col("event_type") == "view") & F.col("value").isNotNull())
    return tidy(screening.merge_spans(b.select("session_id", F.col("t_s").alias("start_s"), (F.col("t_s") + F.col("value") / 20.0).alias("end_s"))))


@R.add(
    PREM_SQL
    + """,
c AS (SELECT session_id, beat, coalesce(beat - lag(beat) OVER (PARTITION BY session_id ORDER BY beat) <> 2, true) AS brk FROM ect),
d AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY beat ROWS UNBOUNDED PRECEDING) AS g FROM c),
l AS (SELECT session_id, max(m) AS m FROM (SELECT session_id, count(*) AS m FROM d GROUP BY session_id, g HAVING count(*) >= 3) GROUP BY 1)
SELECT bur.session_id, n, round(100.0 * n / n_beats, 6) AS pct, coalesce(m, 0) AS longest_bigeminy
FROM bur LEFT JOIN l ON l.session_id = bur.session_id WHERE 100.0 * n / n_beats > 1.0 OR m >= 3"""
)
def flag_ectopy(spark, sf_dir):
    return tidy(screening.ectopy(_burden(spark, sf_dir), ectopy.patterns(_confirmed(spark, sf_dir), 2)))


_IRREGULAR = (
    COSEN_SQL
    + """,
f AS (SELECT session_id, k, coalesce(NOT has_seam AND cosen > -1.0 AND cv > 0.10, false) AS odd FROM cw),
g AS (SELECT *, k - row_number() OVER (PARTITION BY session_id, odd ORDER BY k) AS grp FROM f),
ru AS (SELECT session_id, count(*) AS size FROM g WHERE odd GROUP BY session_id, grp)
SELECT session_id, max(size) AS longest_run, count(*) AS n_runs FROM ru GROUP BY 1 HAVING max(size) >= 3"""
)


@R.add(_IRREGULAR)
def flag_irregularity(spark, sf_dir):
    return screening.irregularity(hrv.cosen(hrv.contiguous_entropy_windows(rr_series(spark, sf_dir))))


_RATE_FLAG = """SELECT session_id, kind, 'review' AS severity, '{title} sustained rate: ' || printf('%.1f', worst_bpm) || ' bpm in ' || n_windows || ' windows' AS description,
  '{{"worst_bpm":' || printf('%.1f', worst_bpm) || ',"n_windows":' || n_windows || ',"spans":"' || spans || '"}}' AS evidence, '{{"bpm":{limit}.0,"window_s":45.0}}' AS threshold FROM ({rows})"""
_ECTOPY_FLAG = (
    PREM_SQL
    + """,
c AS (SELECT session_id, beat, coalesce(beat - lag(beat) OVER (PARTITION BY session_id ORDER BY beat) <> 2, true) AS brk FROM ect),
d AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY beat ROWS UNBOUNDED PRECEDING) AS g FROM c),
l AS (SELECT session_id, max(m) AS m FROM (SELECT session_id, count(*) AS m FROM d GROUP BY session_id, g HAVING count(*) >= 3) GROUP BY 1),
fi AS (SELECT session_id, array_to_string((list(beat ORDER BY beat))[1:100], ',') AS beats FROM ect GROUP BY 1)
SELECT bur.session_id, 'ectopy' AS kind, 'review' AS severity, 'Confirmed ectopic beats: ' || n || ' of ' || n_beats AS description,
  '{"n_confirmed":' || n || ',"n_beats":' || n_beats || ',"longest_bigeminy":' || coalesce(m, 0) || ',"beats":"' || coalesce(beats, '') || '"}' AS evidence, '{"pct":1.0,"bigeminy_beats":3}' AS threshold
FROM bur LEFT JOIN l ON l.session_id = bur.session_id LEFT JOIN fi ON fi.session_id = bur.session_id WHERE 100.0 * n / n_beats > 1.0 OR m >= 3"""
)
_FLAGS = " UNION ALL ".join(
    f"SELECT * FROM ({x})"
    for x in (
        _RATE_FLAG.format(title="Highest", limit=80, rows=_SLIDING.format(width="45.0", step="5.0") + _SPANS.format(op=">", limit=80, agg="max", kind="sustained_high_hr")),
        _RATE_FLAG.format(title="Least", limit=80, rows=_SLIDING.format(width="45.0", step="5.0") + _SPANS.format(op="<", limit=80, agg="min", kind="sustained_low_hr")),
        _ECTOPY_FLAG,
        """SELECT session_id, 'irregularity' AS kind, 'review' AS severity, 'Longest stretch of irregular windows: ' || longest_run AS description,
  '{"longest_run":' || longest_run || ',"n_runs":' || n_runs || '}' AS evidence, '{"cosen":-1.0,"cv":0.1,"windows":3}' AS threshold FROM (""" + _IRREGULAR + ")",
    )
)


@R.add(f"SELECT *, '{screening.DISCLAIMER}' AS disclaimer FROM ({_FLAGS})")
def all_flags(spark, sf_dir):
    def rate(df, title, limit):
        text = F.concat(F.lit(f"{title} sustained rate: "), F.format_string("%.1f", "worst_bpm"), F.lit(" bpm in "), F.col("n_windows").cast("string"), F.lit(" windows"))
        kind = "sustained_high_hr" if title == "Highest" else "sustained_low_hr"
        return screening.flag(df, kind, "review", text, F.struct("worst_bpm", "n_windows", "spans"), F.struct(F.lit(limit).alias("bpm"), F.lit(45.0).alias("window_s")))

    confirmed = _confirmed(spark, sf_dir)
    first = confirmed.groupBy("session_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("beat")), 1, 100).cast("array<string>"), ",").alias("beats"))
    e = screening.ectopy(_burden(spark, sf_dir), ectopy.patterns(confirmed, 2)).join(first, "session_id", "left").withColumn("beats", F.coalesce("beats", F.lit("")))
    e = e.join(beats(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n_beats")), "session_id")
    ectopic = screening.flag(
        e, "ectopy", "review", F.concat(F.lit("Confirmed ectopic beats: "), F.col("n").cast("string"), F.lit(" of "), F.col("n_beats").cast("string")), F.struct(F.col("n").alias("n_confirmed"), "n_beats", "longest_bigeminy", "beats"),
        F.struct(F.lit(screening.ECTOPY_PCT).alias("pct"), F.lit(screening.BIGEMINY_BEATS).alias("bigeminy_beats")),
    )
    limits = F.struct(F.lit(screening.COSEN_LIMIT).alias("cosen"), F.lit(screening.CV_LIMIT).alias("cv"), F.lit(screening.IRREGULAR_WINDOWS).alias("windows"))
    irregular = screening.flag(flag_irregularity(spark, sf_dir), "irregularity", "review", F.concat(F.lit("Longest stretch of irregular windows: "), F.col("longest_run")), F.struct("longest_run", "n_runs"), limits)
    return rate(flag_sustained_high(spark, sf_dir), "Highest", 80.0).unionByName(rate(flag_sustained_low(spark, sf_dir), "Least", 80.0)).unionByName(ectopic).unionByName(irregular)


@R.add("SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in screening.BANNED_PHRASES) + " AS n_banned FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def banned_phrases(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(screening.banned(F.coalesce("text", F.lit("")))).alias("n_banned"))


@R.add(
    BEATS_SQL
    + """,
f AS (SELECT session_id, beat, coalesce(value > 100, false) AS hi FROM beats),
g AS (SELECT *, beat - row_number() OVER (PARTITION BY session_id, hi ORDER BY beat) AS grp FROM f),
r AS (SELECT session_id, count(*) AS size, min(beat) AS s FROM g WHERE hi GROUP BY session_id, grp)
SELECT session_id, max(size) AS size, CAST(min(s) FILTER (size = m) AS BIGINT) AS first_beat FROM (SELECT *, max(size) OVER (PARTITION BY session_id) AS m FROM r) GROUP BY 1"""
)
def longest_run(spark, sf_dir):
    runs = series.true_runs(beats(spark, sf_dir), F.col("value") > 100, ["beat"])
    best = runs.groupBy("session_id").agg(F.max(F.struct("size", (-F.col("first_beat")).alias("neg"))).alias("m"))
    return best.select("session_id", F.col("m.size").alias("size"), (-F.col("m.neg")).alias("first_beat"))


@R.add(
    BEATS_SQL
    + """ SELECT session_id, f AS from_state, event_type AS to_state, count(*) AS n
FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY beat) AS f FROM beats WHERE event_type <> 'error') WHERE f <> event_type GROUP BY 1, 2, 3"""
)
def stage_transitions(spark, sf_dir):
    b = beats(spark, sf_dir).where(F.col("event_type") != "error").select("session_id", "beat", "event_type")
    return ectopy.transitions(b, "event_type", "beat")


@R.add(
    BEATS_SQL
    + """,
g AS (SELECT *, beat - row_number() OVER (PARTITION BY session_id, event_type ORDER BY beat) AS grp FROM beats)
SELECT session_id, event_type, min(beat) AS first_beat, count(*) AS bout FROM g GROUP BY session_id, event_type, grp"""
)
def stage_bouts(spark, sf_dir):
    b = beats(spark, sf_dir)
    d = series.islands(b, F.col("event_type") != F.lag("event_type").over(series.by_session("beat")), ["beat"])
    return d.groupBy("session_id", "run_id", "event_type").agg(F.min("beat").alias("first_beat"), F.count("*").alias("bout")).drop("run_id")
