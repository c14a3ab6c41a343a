"""Landing folders of JSON answers: nights and hourly series, read with tolerance for what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a night by the type they are wanted in, as the answers name them.
NIGHT_WHOLE = ("light_sleep", "deep_sleep", "rem_sleep", "unrecognized_sleep_stage", "total_interruption_duration", "sleep_score", "sleep_charge", "continuity_class", "sleep_cycles", "heart_rate_avg", "beat_to_beat_avg", "heart_rate_variability_avg", "nightly_recharge_status", "ans_charge_status")
NIGHT_REAL = ("continuity", "breathing_rate_avg", "ans_charge")
NIGHT_TIMES = ("sleep_start_time", "sleep_end_time")


def utc(text: Column) -> Column:
    """An ISO time as a time in UTC without a zone; one without an offset is taken as it is, and null if it cannot be read."""
    zoned = F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    return F.when(zoned, text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))


def nights(lines: DataFrame, body: str = "body") -> DataFrame:
    """Adds night (a date) and the fields of a night to rows with a JSON text; a field that cannot be read is null. Sessions in UTC."""
    get = lambda k: F.get_json_object(body, f"$.{k}")
    cols = {"night": F.substring(get("date"), 1, 10).try_cast("date"), "device_id": get("device_id")}
    cols |= {k: get(k).try_cast("double").cast("int") for k in NIGHT_WHOLE} | {k: get(k).try_cast("double") for k in NIGHT_REAL} | {k: utc(get(k)) for k in NIGHT_TIMES}
    return lines.withColumns(cols)


def series(lines: DataFrame, values: Sequence[str], body: str = "body", group: str = "hourly") -> DataFrame:
    """Rows of parallel arrays, {group: {time: [...], value: [...]}}: the other columns, time and a column for each value; a shorter array gives nulls."""
    schema = f"`{group}` struct<time: array<string>, {', '.join(f'`{v}`: array<double>' for v in values)}>"
    parsed = lines.withColumn("_j", F.from_json(body, schema))
    arrays = F.arrays_zip(*[F.coalesce(F.col(f"_j.{group}.{v}"), F.array()).alias(v) for v in ("time", *values)])
    keep = [c for c in lines.columns if c != body]
    return parsed.select(*keep, F.explode(arrays).alias("_r")).select(*keep, *[F.col(f"_r.{v}").alias(v) for v in ("time", *values)])


def span(rows: DataFrame, t: str = "t_s") -> DataFrame:
    """First and last time of every session; a Parquet scan answers it from one column."""
    return rows.groupBy("session_id").agg(F.min(t).alias("first_s"), F.max(t).alias("last_s"), (F.max(t) - F.min(t)).alias("duration_s"))


def of_version(cache: DataFrame, least: int) -> DataFrame:
    """Rows of a cache table (pipeline_version) that a version from ``least`` on has written; older ones count as not there."""
    return cache.where(F.col("pipeline_version") >= least)
