"""Tables as sinks: replacing sessions, upserting rows, appending, exporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import exists

#: Partitions of a table whose sessions are replaced; a session belongs to one by its hash, so files stay few and large.
BUCKETS = 64
_BUCKET = "bucket"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_sessions(rows: DataFrame, path: str, key: str = "session_id", buckets: int = BUCKETS) -> None:
    """Replaces the sessions that ``rows`` has in the table at ``path``; all others stay.

    The table has ``buckets`` partitions.  Only those that hold a session of
    ``rows`` are written anew, with their other sessions merged in; they are
    swapped when all are written, so a failure leaves the table as it was, and
    a repeat changes nothing.  A session without rows here is left alone.
    """
    upsert(rows, path, [key], key, buckets)


def upsert(rows: DataFrame, path: str, keys: Sequence[str], by: str, buckets: int = BUCKETS) -> None:
    """``replace_sessions`` for rows told apart by ``keys`` and dealt by ``by``, one of them."""
    spark = rows.sparkSession
    new = rows.withColumn(_BUCKET, bucket_of(by, buckets))
    out = new
    if exists(spark, path):
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # at most ``buckets``
        held = spark.read.schema(new.schema).parquet(path).where(F.col(_BUCKET).isin(touched))
        out = held.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(new)
    out.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def append(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Adds rows; under the number of a batch they replace what the same batch wrote before, so a repeat changes nothing."""
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def once(spark, path: str, batch: int, write) -> bool:
    """Runs ``write`` unless the marker of ``batch`` under ``path`` is there, then leaves the marker; False if it was there."""
    marker = f"{path}-batches/{batch}"
    if exists(spark, marker):
        return False
    write()
    spark.range(1).write.mode("overwrite").parquet(marker)
    return True


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; times and numbers as Spark writes them."""
    rows.write.mode("overwrite").option("header", "true").csv(path)
