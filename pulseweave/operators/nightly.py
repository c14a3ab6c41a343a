"""Nightly synchronisation with a service: which calls to make, where to stop, and how nights that come late are stored.

The calls themselves are made elsewhere; their answers land as JSON (``sources.landing``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import sinks

# Days that the list calls cover, calls of a list and of a single night, answers that stop a person's further calls.
LIST_DAYS, LIST_CALLS, NIGHT_CALLS, STOPS = 28, ("sleep", "recharge"), ("sleep", "recharge"), (401, 403, 429)


def plan(requests: DataFrame, available: DataFrame) -> DataFrame:
    """person_id, seq, call, kind, from_date, to_date: the calls for every request (person_id, start_date, end_date, today), in order.

    Two list calls cover what lies within the last 28 days.  Before that, dates
    are asked for one by one, and only those that the service says it holds
    (``available``: person_id, date), which itself takes one call.  A request
    that ends before it starts has no calls.
    """
    r = requests.where(F.col("start_date") <= F.col("end_date")).withColumn("_floor", F.date_sub("today", LIST_DAYS))
    calls = lambda names, kind, a, b: F.explode(F.array(*[F.struct(F.lit(c).alias("call"), F.lit(kind).alias("kind"), a.alias("from_date"), b.alias("to_date"), F.lit(i).alias("i")) for i, c in enumerate(names)])).alias("c")
    recent = r.where(F.col("end_date") >= F.col("_floor")).select("person_id", F.lit(0).alias("step"), calls(LIST_CALLS, "list", F.greatest("start_date", "_floor"), F.col("end_date")))
    older = r.where(F.col("start_date") < F.col("_floor")).withColumn("_last", F.least("end_date", F.date_sub("_floor", 1)))
    ask = older.select("person_id", F.lit(1).alias("step"), calls(("available",), "available", F.col("start_date"), F.col("_last")))
    held = older.join(available.select("person_id", "date").distinct(), "person_id").where(F.col("date").between(F.col("start_date"), F.col("_last")))
    single = held.select("person_id", F.lit(2).alias("step"), calls(NIGHT_CALLS, "night", F.col("date"), F.col("date")))
    w = Window.partitionBy("person_id").orderBy("step", "c.from_date", "c.i")
    return recent.union(ask).union(single).select("person_id", F.row_number().over(w).alias("seq"), "c.call", "c.kind", "c.from_date", "c.to_date")


def until_stopped(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Calls with their answer (person_id, seq, status) and outcome: made, stopped (this answer ends the person's calls) or skipped (one before it did)."""
    stop = F.coalesce(F.col("status").isin(*STOPS), F.lit(False))
    before = F.max(stop).over(Window.partitionBy("person_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    d = calls.join(answers.select("person_id", "seq", "status"), ["person_id", "seq"], "left").withColumns({"_s": stop, "_b": F.coalesce(before, F.lit(False))})
    outcome = F.when(F.col("_b"), "skipped").when(F.col("_s"), "stopped").otherwise("made")
    return d.select(*calls.columns, F.when(~F.col("_b"), F.col("status")).alias("status"), outcome.alias("outcome"))


def missing_islands(wanted: DataFrame, held: DataFrame, most: int = LIST_DAYS) -> DataFrame:
    """person_id, from_date, to_date, nights: runs of missing nights (wanted, not held: person_id, date), cut after ``most`` days, so that each is one request."""
    gone = wanted.select("person_id", "date").distinct().join(held.select("person_id", "date").distinct(), ["person_id", "date"], "left_anti")
    w = Window.partitionBy("person_id").orderBy("date")
    d = gone.withColumn("_run", F.date_sub("date", F.row_number().over(w)))
    first = F.min("date").over(Window.partitionBy("person_id", "_run"))
    d = d.withColumn("_part", F.floor(F.datediff("date", first) / most))
    return d.groupBy("person_id", "_run", "_part").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.count("*").alias("nights")).drop("_run", "_part")


def has_content(fields: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()


def upsert_nights(target: str, fields: Sequence[str], order: str, buckets: int = sinks.BUCKETS) -> Callable[[DataFrame, int], None]:
    """For every batch: nights (person_id, date, fields) are added to the table at ``target`` or replace what is held, the latest by ``order`` of each; empty ones are not stored.

    Counts of created, updated and empty nights by batch and person are kept
    beside the table, in ``target``-counts.  A batch given again changes neither.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def run() -> None:
            full = has_content(fields)
            last = batch.where(full).groupBy("person_id", "date").agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
            held = spark.read.parquet(target).select("person_id", "date").withColumn("_held", F.lit(True)) if sinks.exists(spark, target) else None
            seen = last.withColumn("_held", F.lit(False)) if held is None else last.join(held, ["person_id", "date"], "left")
            one = seen.groupBy("person_id").agg(F.count_if(~F.coalesce("_held", F.lit(False))).alias("created"), F.count_if("_held").alias("updated"))
            empty = batch.where(~full).select("person_id", "date").distinct().join(last, ["person_id", "date"], "left_anti").groupBy("person_id").agg(F.count("*").alias("empty"))
            zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
            counts = one.join(empty, "person_id", "full").select("person_id", *map(zero, ("created", "updated", "empty")))
            sinks.append(counts, f"{target}-counts", batch_id)  # before the nights: a repeat after a failure counts the same
            sinks.upsert(last, target, ["person_id", "date"], "person_id", buckets)

        sinks.once(spark, target, batch_id, run)

    return write
