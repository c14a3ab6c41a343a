"""Stand-ins for recordings over the event tables, and the same in SQL.

A session is ten neighbouring users.  Its events in order of time are beats;
an interval is 250 ms and 8 ms for each unit of value, so that both bounds of
physiology really occur.  Five seconds behind an ``error`` of a value over 150
are excluded.  ``purchase`` rows are a device's own stream, ``signup`` rows
what an artifact correction called ectopic, ``view`` rows markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import build_rr, intervals
from ..session import table


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, beat, t_s, event_type, value, ts, k (a number in the event's properties)."""
    e = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).cast("long").alias("session_id"),
        "ts",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.lit(25000) + F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") * 8).alias("rc"),
    )
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = F.sum("rc").over(w) / F.lit(1e5)
    return e.select("session_id", (F.row_number().over(w) - 1).cast("long").alias("beat"), t.alias("t_s"), "event_type", "value", "ts", "k")


def excluded(b: DataFrame) -> DataFrame:
    hit = b.where((F.col("event_type") == "error") & (F.col("value") > 150))
    return hit.select("session_id", F.col("t_s").alias("start_s"), (F.col("t_s") + 5.0).alias("end_s"))


def rr_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beats(spark, sf_dir)
    return build_rr(b, excluded(b))


def raw_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(beats(spark, sf_dir)).select("session_id", "n", F.col("end_s").alias("t_s"), "rr_ms")


#: Samples a second of a stand-in trace.
TRACE_HZ = 40.0


#: Half the width of a beat in a stand-in trace, in units of 1e-5 s.
REACH = 6000


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the beats in blocks (session_id, i of the first, t_s and x as arrays): each beat is a triangle of 120 ms, the higher the greater its event's value.

    A block goes from a beat to the next, the first one from 0.  Beats that
    reach into it are found by windows, so only events are shuffled.
    """
    b = beats(spark, sf_dir).select("session_id", "t_s", (0.6 + F.coalesce("value", F.lit(0.0)) / 1000.0).alias("a"), F.round(F.col("t_s") * 1e5).cast("long").alias("at"))
    w = Window.partitionBy("session_id").orderBy("at")
    begin = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("t_s") * TRACE_HZ))).cast("long")
    b = b.withColumns({"i": begin, "near": F.collect_list(F.struct("t_s", "a")).over(w.rangeBetween(-REACH - 1, REACH + 1))})
    end = F.coalesce(F.lead("i").over(w), F.ceil((F.col("t_s") + 0.5) * TRACE_HZ).cast("long") + 1)
    b = b.select("session_id", "i", end.alias("end"), F.concat("near", F.coalesce(F.lead("near").over(w), F.array().cast("array<struct<t_s:double,a:double>>"))).alias("near")).where("i < end")

    def value(t):
        heights = F.transform("near", lambda n: F.when(F.abs(t - n["t_s"]) <= REACH / 1e5, n["a"] * (1 - F.abs(t - n["t_s"]) / (REACH / 1e5))))
        return F.coalesce(F.array_max(heights), F.lit(0.0))

    t = F.transform(F.sequence(F.col("i"), F.col("end") - 1), lambda i: i / TRACE_HZ)
    return b.withColumn("t_s", t).select("session_id", "i", "t_s", F.transform("t_s", value).alias("x"))


BEATS_SQL = """
WITH ev AS (
  SELECT CAST(floor(user_id / 10) AS BIGINT) AS session_id, ts, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         25000 + CAST(round(coalesce(value, 0) * 100) AS BIGINT) * 8 AS rc
  FROM events),
beats AS (
  SELECT session_id, row_number() OVER w - 1 AS beat, CAST(sum(rc) OVER w AS BIGINT) / 1e5 AS t_s, event_type, value, ts, k
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
seg AS (SELECT session_id, t_s AS start_s, t_s + 5.0 AS end_s FROM beats WHERE event_type = 'error' AND value > 150),
raw AS (
  SELECT * FROM (
    SELECT session_id, beat AS n, lag(t_s) OVER (PARTITION BY session_id ORDER BY beat) AS start_s, t_s AS end_s,
           (t_s - lag(t_s) OVER (PARTITION BY session_id ORDER BY beat)) * 1000.0::DOUBLE AS rr_ms
    FROM beats) WHERE start_s IS NOT NULL)"""
RR_SQL = (
    BEATS_SQL
    + """,
fated AS (
  SELECT raw.*, CASE
    WHEN EXISTS (SELECT 1 FROM seg WHERE seg.session_id = raw.session_id AND raw.start_s < seg.end_s AND raw.end_s > seg.start_s) THEN 'excluded'
    WHEN rr_ms > 2200 THEN 'ceiling' WHEN rr_ms < 300 THEN 'floor' ELSE 'kept' END AS fate
  FROM raw),
rr AS (
  SELECT session_id, n, end_s AS t_s, rr_ms, coalesce(n - lag(n) OVER (PARTITION BY session_id ORDER BY n) > 1, false) AS discontinuity
  FROM fated WHERE fate = 'kept'),
dd AS (
  SELECT *, CASE WHEN NOT discontinuity THEN rr_ms - lag(rr_ms) OVER (PARTITION BY session_id ORDER BY n) END AS d_ms FROM rr)"""
)
