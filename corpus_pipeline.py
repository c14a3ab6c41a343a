"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``documents``.

1. language ID: texts without a recognised language, or recognised with less
   than MIN_LANGUAGE, go.
2. quality classifier: texts that score under MIN_QUALITY go.
3. n-gram Jaccard join: of each group of near copies, rows repeated in full
   included, one row stays, with the smallest id (a null id only if all are).
4. mixing: sources are brought nearer to one another by up to MAX_REPETITION
   passes; every document is passed at least once, so none is dropped.
5. packing: token pieces with their sequences and offsets.

Null text and texts without letters go in stage 1.  After stage 3 rows repeat
an id where different texts share it, or by further passes of stage 4.  An empty table gives an
empty result.  Without a usable training label a stage has no model to reject
by: stage 1 then rejects only texts without letters, stage 2 nothing.  SQL cannot express the stages with models and tokenizers; the
tests hold them against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.llm import langid, mixing, ngram_join, packing, quality
from pulseweave.llm.scratch import Scratch, free, table

#: Rows that go to Python at a time in this application, so that batches of long texts take little memory beside the heap.
BATCH_ROWS = 1000
MIN_LANGUAGE, MIN_QUALITY, MAX_REPETITION = 0.5, 0.7, 2.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 5, 0)))
    if model is None:
        return docs.where(langid.has_letter(F.col("text")))
    # under names of their own, so that the outputs do not take the place of input columns
    judged = langid.detect(docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns]), model, text="_in_text")
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE))
    return kept.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"), 4, 2))
    model = quality.train(docs, labels)
    if model is None:
        return docs
    (mark,) = free(docs.columns, "_quality")
    return quality.score(docs, model, out=mark).where(F.col(mark) >= MIN_QUALITY).drop(mark)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids can be null or repeated, so a row goes by a hash of all that it holds; rows repeated in full share it
    cols, (key,) = docs.columns, free(docs.columns, "_row")
    keyed = docs.withColumn(key, F.xxhash64(*cols, *[F.col(c).isNull() for c in cols]))
    groups = ngram_join.join(keyed.select(key, "text"), id_col=key).documents
    groups = groups.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("component"), F.count("*").alias("times"), F.max("n_shingles").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row"), "times", "n")).alias("first")
    kept = groups.join(keyed.select(key, "doc_id").distinct(), key).groupBy("component").agg(first).select(F.col("first.row").alias(key), "first.times", "first.n")
    scratch = Scratch(spark, "copies")
    kept = scratch.save(kept, "kept")
    once = (F.col("times") == 1) | (F.col("n") == 0)  # texts without words are in no group

    def small(rows: DataFrame) -> DataFrame:
        """Few rows go, or repeat in full, as a rule; else the texts are shuffled once more."""
        return F.broadcast(rows) if rows.count() * 16 <= ngram_join.BROADCAST_BYTES else rows

    gone = scratch.save(groups.select(key).join(kept.where(once), key, "left_anti"), "gone")
    one = keyed.join(small(gone), key, "left_anti").select(*cols)
    return one.union(keyed.join(small(kept.where(~once).select(key)), key, "left_semi").select(*cols).dropDuplicates())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # under names of their own, so that the mixture's columns do not take the place of input columns
    mixed = mixing.mix(docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns]), id_col="_in_doc_id", source="_in_source", text="_in_text", max_repetition=MAX_REPETITION, budget="cover")
    return mixed.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("copies", copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
