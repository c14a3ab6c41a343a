"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType

from pulseweave.session import shared_dir

#: Rows that go to Python at a time; texts of a few kB make batches of a few MB.
BATCH_ROWS = 1000
#: A row group of a table with binary columns.
GROUP_BYTES = 16 << 20


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a block, and are as before behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Fewer rows for an Arrow batch, and for one of Parquet's reader, while an operator runs, so that batches of long texts take little memory beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return settings(spark, {key: str(min(now, rows) if now > 0 else rows), "spark.sql.parquet.columnarReaderBatchSize": str(rows)})


def free(columns: list[str], *names: str) -> list[str]:
    """Names that no column has, in upper case or lower."""
    taken = {c.lower() for c in columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


class Scratch:
    """Cuts lineage by writing Parquet to the shared folder and reading it back.

    A lost executor then costs only the stage that ran on it: everything
    before the last written table is read again, not computed again.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back; the shuffle files of the step go with it.

        Binary columns are written in small groups and without a dictionary, which keeps a writer's memory low.
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            writer = df.write.mode("overwrite")
            for f in df.schema.fields:
                if isinstance(f.dataType, BinaryType):
                    writer = writer.option(f"parquet.enable.dictionary#{f.name}", "false").option("parquet.block.size", str(GROUP_BYTES))
            writer.parquet(path)
        out = self._tables[path] = self.spark.read.schema(df.schema).parquet(path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing will read any more."""
        jvm = self.spark._jvm  # noqa: SLF001
        for path in [p for p, t in self._tables.items() if any(t is x for x in tables)]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
            del self._tables[path]

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*[t for t in self._tables.values() if not any(t is x for x in tables)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
