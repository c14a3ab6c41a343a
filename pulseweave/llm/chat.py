"""Operator 10: chat formatting.

Multi-party perspective rotation: for every participant of a dialogue, the
dialogue is rendered with that speaker as assistant and the others as named
users, and a mask marks what is trained on (the messages of that speaker).

Built from DataFrame functions only.  A dialogue is rendered in segments of
``turns`` turn numbers, so that a dialogue of any length, even one that holds
most rows, is many rows of bounded size.  The participants of a dialogue are
its distinct speakers other than ``system``; system messages stay system
messages for everyone.  Joining them back is a join that skew handling can
split.

A null or blank speaker is the participant ``unknown``; null text is empty;
speakers are compared after trimming and in lower case.  Rows with a null
dialogue or turn have no place and are left out.  Rows repeated in full are one
message, and n_rows tells how many rows a segment stands for.  Different
messages of one turn go by speaker and text.  A dialogue of system messages
alone has no participant and gives no row.  An empty table gives an empty
table.  Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = 64


def rotate(
    conversations: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns: int = TURNS,
    system: str = "system",
) -> DataFrame:
    """One row for each dialogue, perspective and segment.

    Columns: conv_id, perspective, segment, n_rows, n_messages, text,
    target_spans and n_target_chars.  ``text`` is the rendered segment;
    ``target_spans`` lists the character ranges (start inclusive, from 0, end
    exclusive) of the perspective's own content, as ``start-end`` joined by
    commas: the mask is 1 there and 0 elsewhere.
    """
    speaker = F.lower(F.trim(F.coalesce(F.col(role), F.lit(""))))
    messages = (
        conversations.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.when(speaker == "", "unknown").otherwise(speaker).alias("speaker"),
            F.coalesce(F.col(text), F.lit("")).alias("content"),
        )
        .where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("conv_id", "turn", "speaker", "content")
        .agg(F.count("*").alias("copies"))
    )
    # segments first: participants then meet few rows, each of at most the messages of its turns
    segments = messages.groupBy("conv_id", F.floor(F.col("turn") / F.lit(turns)).cast("long").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "content"))).alias("messages"), F.sum("copies").alias("n_rows")
    )
    people = segments.select("conv_id", F.explode(F.array_distinct(F.transform("messages", lambda m: m["speaker"]))).alias("perspective")).where(F.col("perspective") != system).distinct()
    seen = segments.join(people, "conv_id")

    def header(m):
        other = F.concat(F.lit("<|user name="), m["speaker"], F.lit("|>\n"))
        return F.when(m["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n")).when(m["speaker"] == system, F.lit("<|system|>\n")).otherwise(other)

    def step(state, m):
        begin = state["at"] + F.length(header(m))
        end = begin + F.length(m["content"])
        own = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(
            (end + F.lit(len("<|end|>\n"))).cast("int").alias("at"),
            F.when(m["speaker"] == F.col("perspective"), F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"),
            (state["kept"] + F.when(m["speaker"] == F.col("perspective"), F.length(m["content"])).otherwise(F.lit(0))).cast("int").alias("kept"),
        )

    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("int").alias("kept"))
    mask = F.aggregate("messages", start, step)
    body = F.array_join(F.transform("messages", lambda m: F.concat(header(m), m["content"], F.lit("<|end|>\n"))), "")
    return seen.select(
        "conv_id",
        "perspective",
        "segment",
        "n_rows",
        F.size("messages").cast("long").alias("n_messages"),
        body.alias("text"),
        mask.alias("mask"),
    ).select("conv_id", "perspective", "segment", "n_rows", "n_messages", "text", F.array_join("mask.spans", ",").alias("target_spans"), F.col("mask.kept").cast("long").alias("n_target_chars"))


ORACLE_SQL = f"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn,
         CASE WHEN lower(trim(coalesce(role, ''))) = '' THEN 'unknown' ELSE lower(trim(coalesce(role, ''))) END AS speaker,
         coalesce(text, '') AS content, count(*) AS copies
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2, 3, 4),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT m.conv_id, perspective, CAST(floor(turn / {TURNS}.0) AS BIGINT) AS segment, turn, speaker, content, copies,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || speaker || '|>' END || chr(10) AS header
  FROM m JOIN p ON m.conv_id = p.conv_id),
o AS (
  SELECT *, CAST(sum(length(header) + length(content) + 8) OVER w AS BIGINT) - length(content) - 8 AS s
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective, segment ORDER BY turn, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, segment, CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS n_messages,
       string_agg(header || content || '<|end|>' || chr(10), '' ORDER BY turn, speaker, content) AS text,
       coalesce(string_agg(s || '-' || (s + length(content)), ',' ORDER BY turn, speaker, content) FILTER (speaker = perspective), '') AS target_spans,
       CAST(coalesce(sum(length(content)) FILTER (speaker = perspective), 0) AS BIGINT) AS n_target_chars
FROM o GROUP BY 1, 2, 3
"""
