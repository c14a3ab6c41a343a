"""Context of sessions: environment by the hour, nights, tags, data-quality rules, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_mean(sessions: DataFrame, hourly: DataFrame, values: Sequence[str], hours: int = 2) -> DataFrame:
    """Mean of hourly slots that overlap a session (session_id, start_ts, end_ts); else the nearest slot within ``hours``.

    ``hourly`` has slot_ts (start of the hour).  Slots are found by hour, not by a range join.
    """
    s = sessions.withColumn("_h", F.date_trunc("hour", "start_ts"))
    span = F.sequence(F.date_trunc("hour", "start_ts") - F.expr(f"interval {hours + 1} hours"), F.date_trunc("hour", "end_ts") + F.expr(f"interval {hours + 1} hours"), F.expr("interval 1 hour"))
    j = s.drop("_h").withColumn("slot_ts", F.explode(span)).join(hourly, "slot_ts")
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    t0, t1, b = second(F.col("slot_ts")), second(F.col("start_ts")), second(F.col("end_ts"))
    j = j.withColumns({"_in": (t0 < b) & (t0 + 3600 > t1), "_gap": F.least(F.abs(t0 - t1), F.abs(t0 - b))})
    near = Window.partitionBy("session_id").orderBy("_gap", "slot_ts")
    j = j.withColumn("_r", F.row_number().over(near))
    inside = F.count_if("_in") > 0
    return j.groupBy("session_id").agg(
        F.count_if("_in").alias("n_slots"), *[F.when(inside, F.avg(F.when(F.col("_in"), F.col(v)))).otherwise(F.max(F.when((F.col("_r") == 1) & (F.col("_gap") <= hours * 3600), F.col(v)))).alias(v) for v in values]
    )


def endpoint(age_days: Column, limit: int = 85) -> Column:
    """Which weather source covers a session of this age."""
    return F.when(age_days <= limit, "forecast").otherwise("archive")


def merge_nights(*sources: DataFrame, keys: Sequence[str] = ("person_id", "date")) -> DataFrame:
    """Full outer join of independent nightly sources by person and date."""
    out = sources[0]
    for s in sources[1:]:
        out = out.join(s, list(keys), "full_outer")
    return out


def night_before(sessions: DataFrame, nights: DataFrame) -> DataFrame:
    """Sessions with the night of their date, if there is one."""
    return sessions.withColumn("date", F.to_date("recorded_at")).join(nights, ["person_id", "date"], "left")


def total_sleep(*parts: Column) -> Column:
    """Sum of the parts that are present; null if none is."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def any_present(*parts: Column) -> Column:
    return F.coalesce(*parts).isNotNull()


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows after writing ``incoming`` over ``stored``, with status created, updated, unchanged, kept or empty (nothing in it, not written)."""
    full = incoming.withColumn("_full", any_present(*[F.col(v) for v in values]))
    a = stored.select(*keys, F.lit(True).alias("_old"), *[F.col(v).alias(f"_o_{v}") for v in values])
    j = a.join(full, list(keys), "full_outer")
    new, old = F.coalesce(F.col("_full"), F.lit(False)), F.coalesce(F.col("_old"), F.lit(False))
    same = F.lit(True)
    for v in values:
        same &= F.coalesce(F.col(v), F.col(f"_o_{v}")).eqNullSafe(F.col(f"_o_{v}"))
    status = F.when(new & ~old, "created").when(new & ~same, "updated").when(new, "unchanged").when(old, "kept").otherwise("empty")
    return j.select(*keys, *[F.when(new, F.coalesce(F.col(v), F.col(f"_o_{v}"))).otherwise(F.col(f"_o_{v}")).alias(v) for v in values], status.alias("status"))


def missing(wanted: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(there, list(keys), "left_anti")


def tags_of(bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """session_id, tags: sorted distinct slugs over the bridge."""
    return bridge.join(tags, "tag_id").groupBy("session_id").agg(F.array_sort(F.collect_set("slug")).alias("tags"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return d.select(F.lit(rule).alias("rule"), F.concat_ws(":", *keys).alias("key"), "n")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti").groupBy(child_key).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col(child_key).cast("string").alias("key"), "n")


def outside(df: DataFrame, key: str, ok: Column, rule: str) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(True))).groupBy(key).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), "n")


def first_seen(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """One row for each content, the first in order, with its SHA-256."""
    d = df.withColumn("sha256", F.sha2(content, 256))
    return d.groupBy("sha256").agg(F.min(F.struct(*order)).alias("_m"), F.count("*").alias("copies")).select("sha256", *[F.col(f"_m.{o}").alias(o) for o in order], "copies")


def places(df: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """Adds place, from 1, of every row in ``order``, without bringing the rows into one task.

    Rows are dealt by ranges of the order and sorted there; the sorted table is
    written to ``folder``, so that its parts stay as they are, and the sizes of
    the parts before it are added to a row's number in its part.  Rows that tie
    in all of ``order`` get places of their own.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each part
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("place", F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def outside_ranges(df: DataFrame, ranges: Sequence[tuple[str, float, float]], ordered: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds violations, an array: columns outside of their range (null is allowed), and pairs of which the first is not under the second."""
    found = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, lo, hi in ranges] + [F.when(F.col(a) >= F.col(b), F.lit(f"{a}>={b}")) for a, b in ordered]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def rates_by_tag(rates: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, tagged, untagged: the rates (session_id, rate) of sessions with and without each tag in use (session_id, tag), sorted.

    Sessions are counted by rate, once in all and once for each tag they have;
    those without a tag are all less those with it.  So no session is repeated
    for the tags it lacks, and what is brought together is counts of rates.
    """
    known = rates.where("rate IS NOT NULL")
    every = known.groupBy("rate").agg(F.count("*").alias("_all"))
    marked = tags.select("session_id", "tag").where("tag IS NOT NULL").distinct()
    having = marked.join(known, "session_id").groupBy("tag", "rate").agg(F.count("*").alias("_with"))
    counts = every.crossJoin(marked.select("tag").distinct()).join(having, ["tag", "rate"], "left").withColumn("_with", F.coalesce("_with", F.lit(0)))
    both = counts.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("rate", "_with", (F.col("_all") - F.col("_with")).alias("_rest")))).alias("_c"))
    spread = lambda n: F.flatten(F.transform("_c", lambda c: F.array_repeat(c["rate"], c[n].cast("int"))))
    return both.select("tag", spread("_with").alias("tagged"), spread("_rest").alias("untagged"))


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Whether two numbers are within a share of the greater or an absolute distance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def clock(start: Column, elapsed_s: Column) -> Column:
    """The time that lies so many seconds behind ``start``."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), elapsed_s.cast("decimal(18,6)"))
