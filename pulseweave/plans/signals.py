"""Queries over quality windows, accelerometer epochs and beat morphology.

A sample is a beat of the event stand-in with x = value / 20 mV, at most 4.2; its quality
index is k / 100 and its wander value / 1000.  Axes are the first three
dimensions of an embedding in mg, an epoch of session ``label`` each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import morphology, posture, quality, series
from ..session import table
from .adapter import BEATS_SQL, beats
from .registry import Registry, tidy

R = Registry()

SAMPLES_SQL = BEATS_SQL + ",\nsa AS (SELECT session_id, beat AS i, t_s, least(value / 20.0::DOUBLE, 4.2) AS x, CASE WHEN k IS NULL OR k % 7 = 0 THEN NULL ELSE k / 100.0::DOUBLE END AS sqi, value / 1000.0::DOUBLE AS wander FROM beats)"
_GAPS = """,
st AS (SELECT * FROM (SELECT session_id, t_s AS s, lead(t_s) OVER (PARTITION BY session_id ORDER BY i) AS e FROM sa) WHERE e IS NOT NULL),
md AS (SELECT session_id, quantile_cont(e - s, 0.5) AS m FROM st GROUP BY 1),
ga AS (SELECT st.session_id, s, e FROM st JOIN md ON md.session_id = st.session_id WHERE e - s > 2 * m)"""
#: Windows run from a session's first sample to its last in steps of 5 s; the last one is cut and closed.
_CLIP = """,
en AS (SELECT session_id, min(t_s) AS t0, max(t_s) AS t1, greatest(1, CAST(ceil((max(t_s) - min(t_s)) / 5.0::DOUBLE) AS BIGINT)) AS nw FROM sa GROUP BY 1),
ra AS (SELECT sa.*, least(CAST(floor((t_s - t0) / 5.0::DOUBLE) AS BIGINT), nw - 1) AS k, max(abs(x)) OVER (PARTITION BY sa.session_id) AS rail FROM sa JOIN en ON en.session_id = sa.session_id),
pi AS (SELECT *, coalesce(rail >= 2.0 AND abs(x) >= 0.98 * rail, false) AS p FROM ra),
cl AS (SELECT session_id, i, k, t_s, x, sqi, wander, p AND coalesce(lag(p, 1) OVER w, false) AND coalesce(lag(p, 2) OVER w, false) AS clip FROM pi WINDOW w AS (PARTITION BY session_id, k ORDER BY i))"""
_WINDOWS = (
    SAMPLES_SQL
    + _GAPS
    + _CLIP
    + """,
wa AS (SELECT session_id, k, count(*) AS n, bool_or(clip) AS clip, quantile_cont(abs(x), 0.99) AS p99, stddev_pop(x) AS sd, avg(sqi) AS sqi, sqrt(avg(wander * wander)) AS wander FROM cl GROUP BY 1, 2),
gr AS (SELECT session_id, k, t0 + k * 5.0::DOUBLE AS start_s, least(t0 + k * 5.0::DOUBLE + 5.0::DOUBLE, t1) AS end_s FROM (SELECT *, unnest(generate_series(0, nw - 1)) AS k FROM en)),
gk AS (SELECT DISTINCT gr.session_id, gr.k FROM gr JOIN ga ON ga.session_id = gr.session_id AND ga.s < gr.end_s AND ga.e > gr.start_s),
qw AS (
  SELECT gr.session_id, gr.k, start_s, end_s, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE sqi END AS sqi_mean, CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE wander END AS wander_rms_mv,
    CASE WHEN coalesce(n, 0) < 2 THEN ['too few samples'] ELSE
      list_filter([CASE WHEN gk.k IS NOT NULL THEN 'gap' END, CASE WHEN clip THEN 'clipping' END, CASE WHEN p99 > 4.0 THEN 'amplitude' END,
           CASE WHEN sd < 0.01 THEN 'flat' END, CASE WHEN NOT sd < 0.01 AND sqi < 0.5 THEN 'low quality' END], lambda r: r IS NOT NULL) END AS reasons
  FROM gr LEFT JOIN wa ON wa.session_id = gr.session_id AND wa.k = gr.k LEFT JOIN gk ON gk.session_id = gr.session_id AND gk.k = gr.k)"""
)


def _samples(spark, sf_dir):
    return beats(spark, sf_dir).select("session_id", F.col("beat").alias("i"), "t_s", F.least(F.col("value") / 20.0, F.lit(4.2)).alias("x"), F.when(F.col("k") % 7 != 0, F.col("k") / 100.0).alias("sqi"), (F.col("value") / 1000.0).alias("wander"))


@R.add(SAMPLES_SQL + _GAPS + " SELECT session_id, round(s, 6) AS start_s, round(e, 6) AS end_s FROM ga")
def sample_gaps(spark, sf_dir):
    return tidy(quality.gaps(_samples(spark, sf_dir)))


@R.add(SAMPLES_SQL + _CLIP + " SELECT session_id, i FROM cl WHERE clip")
def clipping_runs(spark, sf_dir):
    return quality.clipped(_samples(spark, sf_dir)).where("clip").select("session_id", "i")


@R.add(_WINDOWS + " SELECT session_id, k, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n, round(sqi_mean, 6) AS sqi_mean, round(wander_rms_mv, 6) AS wander_rms_mv, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS excluded FROM qw")
def quality_windows(spark, sf_dir):
    return tidy(quality.windows(_samples(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ",")))


_MERGED = (
    _WINDOWS
    + """,
ex AS (SELECT session_id, k, k - row_number() OVER (PARTITION BY session_id ORDER BY k) AS g, start_s, end_s, reasons FROM qw WHERE len(reasons) > 0),
me AS (SELECT session_id, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(array_to_string(reasons, ','), ',' ORDER BY k) AS every_reason FROM ex GROUP BY session_id, g)"""
)


@R.add(_MERGED + " SELECT session_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, array_to_string(list_sort(list_distinct(string_split(every_reason, ','))), ',') AS reasons FROM me")
def merge_excluded(spark, sf_dir):
    found = quality.merge_excluded(quality.windows(_samples(spark, sf_dir)))
    return tidy(found.withColumn("reasons", F.array_join(F.array_sort("reasons"), ",")))


@R.add(
    _MERGED
    + """, du AS (SELECT session_id, max(t_s) - min(t_s) AS d FROM sa GROUP BY 1), to_ AS (SELECT session_id, sum(end_s - start_s) AS x FROM me GROUP BY 1)
SELECT du.session_id, round(d, 6) AS duration_s, round(coalesce(x, 0), 6) AS excluded_s, round(greatest(0, d - coalesce(x, 0)), 6) AS analysed_s FROM du LEFT JOIN to_ ON du.session_id = to_.session_id"""
)
def excluded_totals(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return tidy(quality.totals(quality.merge_excluded(quality.windows(s)), s.groupBy("session_id").agg((F.max("t_s") - F.min("t_s")).alias("duration_s"))))


@R.add(
    _WINDOWS
    + """, mw AS (SELECT session_id, quantile_cont(wander_rms_mv, 0.5) AS m FROM qw GROUP BY 1),
mo AS (SELECT qw.session_id, k, start_s, end_s, len(reasons) > 0 OR coalesce(sqi_mean < 0.5, false) OR coalesce(wander_rms_mv > 3.0 * greatest(m, 1e-6), false) AS motion FROM qw JOIN mw ON mw.session_id = qw.session_id)
SELECT sa.session_id, i, coalesce(motion, false) AS motion FROM sa LEFT JOIN mo ON mo.session_id = sa.session_id AND sa.t_s >= mo.start_s AND sa.t_s < mo.end_s"""
)
def motion_degraded(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return quality.motion_degraded(s, quality.windows(s)).select("session_id", "i", "motion")


@R.add(
    BEATS_SQL
    + """, m AS (SELECT session_id, quantile_cont(value, 0.5) AS median FROM beats WHERE value IS NOT NULL GROUP BY 1),
d AS (SELECT b.session_id, median, quantile_cont(abs(value - median), 0.5) AS mad FROM beats b JOIN m ON m.session_id = b.session_id GROUP BY 1, 2)
SELECT session_id, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN median + 5.0 * mad ELSE 2.0 * median + 1e-9 END, 6) AS threshold FROM d"""
)
def mad_threshold(spark, sf_dir):
    return tidy(quality.mad_threshold(beats(spark, sf_dir), "value"))


_AXES = """
WITH ax AS (SELECT CAST(label AS BIGINT) AS session_id, vec_id AS epoch, CAST(embedding[1] AS DOUBLE) * 1000 AS gx, CAST(embedding[2] AS DOUBLE) * 1000 AS gy, CAST(embedding[3] AS DOUBLE) * 1000 AS gz,
              CAST(embedding[4] AS DOUBLE) AS a FROM embeddings WHERE label IS NOT NULL),
sc AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS raw_g FROM ax)"""
#: Gravity is brought to 1000 mg for three epochs of four, so that postures occur.
_POSTURE = (
    _AXES
    + """,
nx AS (SELECT session_id, epoch, CASE WHEN epoch % 4 < 3 THEN gx * 1000 / raw_g ELSE gx END AS gx, CASE WHEN epoch % 4 < 3 THEN gy * 1000 / raw_g ELSE gy END AS gy, CASE WHEN epoch % 4 < 3 THEN gz * 1000 / raw_g ELSE gz END AS gz,
         abs(a) AS counts, (epoch % 10) / 10.0::DOUBLE + 0.3::DOUBLE AS coverage FROM sc WHERE raw_g > 0),
pg AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS g, degrees(atan2(gx, gz)) AS phi FROM nx),
po AS (SELECT session_id, epoch, CASE
    WHEN NOT coalesce(coverage >= 0.5 AND g >= 700 AND g <= 1300, false) THEN 'unknown' WHEN counts > 0.3 THEN 'moving'
    WHEN abs(gy) >= cos(radians(40.0)) * g THEN 'upright' WHEN abs(phi) <= 45 THEN 'supine' WHEN abs(phi) >= 135 THEN 'prone' WHEN phi > 0 THEN 'left' ELSE 'right' END AS posture FROM pg)"""
)
_SUMMARY = (
    _POSTURE
    + """,
fi AS (SELECT *, lag(posture) OVER (PARTITION BY session_id ORDER BY epoch) AS pp FROM po WHERE posture NOT IN ('unknown', 'moving')),
tr AS (SELECT session_id, count(*) FILTER (pp <> posture) AS transitions FROM fi GROUP BY 1),
co AS (SELECT session_id, count(*) AS n_epochs, count(*) FILTER (posture NOT IN ('unknown', 'moving')) AS n, count(*) FILTER (posture = 'supine') AS supine, count(*) FILTER (posture = 'prone') AS prone,
         count(*) FILTER (posture = 'left') AS lft, count(*) FILTER (posture = 'right') AS rgt, count(*) FILTER (posture = 'upright') AS upright FROM po GROUP BY 1),
su AS (SELECT co.*, coalesce(transitions, 0) AS transitions, 100.0::DOUBLE * n / n_epochs AS valid_pct, greatest(supine, prone, lft, rgt, upright) AS top FROM co LEFT JOIN tr ON tr.session_id = co.session_id),
sd AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN supine = top THEN 'supine' WHEN prone = top THEN 'prone' WHEN lft = top THEN 'left' WHEN rgt = top THEN 'right' ELSE 'upright' END AS dominant FROM su)"""
)


def _axes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull())
    axis = lambda i: F.try_element_at("embedding", F.lit(i)).cast("double")
    return e.select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("epoch"), (axis(1) * 1000).alias("gx"), (axis(2) * 1000).alias("gy"), (axis(3) * 1000).alias("gz"), axis(4).alias("a"))


def _postures(spark, sf_dir):
    a = _axes(spark, sf_dir).withColumn("_g", posture.magnitude(F.col("gx"), F.col("gy"), F.col("gz"))).where("_g > 0")
    whole = F.col("epoch") % 4 < 3
    a = a.withColumns({c: F.when(whole, F.col(c) * 1000 / F.col("_g")).otherwise(F.col(c)) for c in ("gx", "gy", "gz")})
    a = a.withColumns({"counts": F.abs("a"), "threshold": F.lit(0.3), "coverage": (F.col("epoch") % 10) / 10.0 + 0.3})
    return posture.classify(a).select("session_id", "epoch", "posture")


@R.add(_AXES + " SELECT session_id, epoch, round(raw_g, 6) AS magnitude FROM sc")
def vector_magnitude(spark, sf_dir):
    return tidy(_axes(spark, sf_dir).select("session_id", "epoch", posture.magnitude(F.col("gx"), F.col("gy"), F.col("gz")).alias("magnitude")))


@R.add(_POSTURE + " SELECT * FROM po")
def posture_classify(spark, sf_dir):
    return _postures(spark, sf_dir)


_SHARES = ", ".join(f"round(CASE WHEN n > 0 THEN 100.0::DOUBLE * {c} / n END, 6) AS pct_{p}" for p, c in (("supine", "supine"), ("prone", "prone"), ("left", "lft"), ("right", "rgt"), ("upright", "upright")))


@R.add(_SUMMARY + f" SELECT session_id, n_epochs, round(valid_pct, 6) AS valid_pct, {_SHARES}, dominant, transitions FROM sd")
def posture_summary(spark, sf_dir):
    return tidy(posture.summarize(_postures(spark, sf_dir)))


@R.add(
    _SUMMARY
    + """ SELECT session_id, dominant, CASE WHEN session_id % 3 = 0 THEN 'sitting' WHEN dominant IN ('supine', 'prone', 'left', 'right') AND 100.0::DOUBLE * top / n >= 60 AND valid_pct >= 50 THEN dominant END AS body_position FROM sd"""
)
def posture_autofill(spark, sf_dir):
    s = posture.summarize(_postures(spark, sf_dir)).withColumn("body_position", F.when(F.col("session_id") % 3 == 0, "sitting"))
    return posture.autofill(s).select("session_id", "dominant", "body_position")


@R.add(
    BEATS_SQL
    + """, e AS (SELECT session_id, CAST(floor(t_s / 30.0) AS BIGINT) AS epoch, sum(abs(value)) / 2.0 AS c, count(value) / 60.0 AS coverage FROM beats GROUP BY 1, 2)
SELECT session_id, epoch, round(CASE WHEN coverage >= 0.5 THEN c END, 6) AS counts, round(coverage, 6) AS coverage FROM e"""
)
def activity_counts(spark, sf_dir):
    return tidy(posture.activity_counts(beats(spark, sf_dir).select("session_id", "t_s", F.col("value").alias("a")), 2.0))


_TEMPLATE = """
WITH p AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL),
t AS (SELECT label, i, quantile_cont(x, 0.5) AS m FROM p GROUP BY 1, 2)"""


@R.add(_TEMPLATE + " SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS i, round(m, 6) AS m FROM t")
def template_median(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull()).withColumnRenamed("embedding", "window")
    return tidy(morphology.template(b, "label").select("label", F.posexplode("template").alias("i", "m")))


@R.add(
    _TEMPLATE
    + """ SELECT vec_id, round(corr(x, m), 6) AS r, coalesce(round(corr(x, m), 6) < 0.90, false) AS outlier FROM p JOIN t ON t.label = p.label AND t.i = p.i GROUP BY 1"""
)
def beat_correlation(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull()).withColumnRenamed("embedding", "window")
    return tidy(morphology.correlate(b, "label").select("vec_id", "r", "outlier"))


@R.add(
    """WITH s AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS s FROM embeddings),
e AS (SELECT vec_id, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM s)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, round(e[4] / list_sum(e), 6) AS p3 FROM e"""
)
def softmax_scores(spark, sf_dir):
    s = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", morphology.softmax(s).alias("p"))
    return tidy(e.select("vec_id", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]))


@R.add(
    SAMPLES_SQL
    + """,
sw AS (SELECT session_id, start_s, (k % 4 = 0) AS excluded FROM (SELECT session_id, beat AS k, beat * 5.0::DOUBLE AS start_s FROM beats WHERE beat < 200 AND session_id % 7 <> 3)),
sr AS (SELECT *, CAST(start_s / 5 AS BIGINT) - row_number() OVER (PARTITION BY session_id ORDER BY start_s) AS run FROM sw WHERE excluded),
sg AS (SELECT session_id, sum(e - s) AS x FROM (SELECT session_id, run, min(start_s) AS s, max(start_s) + 5.0 AS e FROM sr GROUP BY 1, 2) GROUP BY 1),
sn AS (SELECT session_id, count(*) * 5.0 AS d FROM sw GROUP BY 1)
SELECT b.session_id, b.session_id % 7 = 3 AS stale, round(CASE WHEN d IS NOT NULL THEN coalesce(x, 0) END, 6) AS excluded_s, round(d - coalesce(x, 0), 6) AS analysed_s
FROM (SELECT DISTINCT session_id FROM beats) b LEFT JOIN sn ON sn.session_id = b.session_id LEFT JOIN sg ON sg.session_id = b.session_id"""
)
def stored_quality(spark, sf_dir):
    b = beats(spark, sf_dir)
    w = b.where("beat < 200").select("session_id", (F.col("beat") * 5.0).alias("start_s"), F.lit(0.9).alias("sqi_mean"), F.lit(0.1).alias("wander_rms_mv"), (F.col("beat") % 4 == 0).alias("excluded"))
    stored = quality.to_store(w).withColumn("version", F.when(F.col("session_id") % 7 == 3, 2).otherwise(3))
    s, ids = quality.from_stored(stored, b), b.select("session_id").distinct()
    out = ids.join(s.stale.withColumn("stale", F.lit(True)), "session_id", "left").join(s.totals, "session_id", "left")
    return tidy(out.select("session_id", F.coalesce("stale", F.lit(False)).alias("stale"), "excluded_s", "analysed_s"))
