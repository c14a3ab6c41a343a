"""Raw recording exports: ragged CSV files of single-lead ECG and of accelerometers, with format detection.

Many files are read at once; what a file leaves open becomes a row of
questions, not an exception.  Lines stay distributed; only one row a file (its
header and what was detected) is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import filename_date

# Canonical columns, epochs, limits of plausibility and of units.
COLUMNS = ("time", "ecg", "hr", "rr", "marker")
DEVICE_EPOCH_S = 946_684_800
EARLIEST = "2010-01-01"
BAD_SHARE, MIN_SAMPLES = 0.001, 100
MICROVOLT_P99, MILLIVOLT_P99 = 20.0, 5.0
RATE_HZ, ACC_RATE_HZ = (50.0, 2000.0), (10.0, 500.0)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line: the non-blank lines of every file, in order; a byte-order mark is dropped.

    Files are read whole lines at a time in one split each, so that the
    position within a split is the order within the file.
    """
    raw = spark.read.option("wholetext", "false").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.trim(F.regexp_replace("value", "^﻿|\r$", "")).alias("line"))
    return raw.where("line <> ''").select("path", F.struct("_b", "_i").alias("pos"), "line")


def delimiter(header: Column) -> Column:
    """The one delimiter of ``, ; tab`` that a header has; null if several or none."""
    n = [F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in (",", ";", "\t")]
    some = sum((F.when(x > 0, 1).otherwise(0) for x in n), F.lit(0))
    return F.when(some == 1, F.when(n[0] > 0, ",").when(n[1] > 0, ";").otherwise("\t"))


#: What a user can answer for a file: its delimiter and decimal sign, its columns by their names in the file, its unit
#: (mV, uV) and its epoch (unix, device).
ANSWERS = "path string, delimiter string, decimal string, column_map map<string,string>, unit string, epoch string"
#: A column of the file that is mapped to this is left out.
IGNORED = "ignored"


def no_answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANSWERS)


def headers(all_lines: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row a file: path, header (array of lower-case names), first_line, delimiter, question, and the answers given for it (ANSWERS), which take precedence over what is detected."""
    h = all_lines.groupBy("path").agg(F.min_by("line", "pos").alias("first_line"), F.count("*").alias("n_lines"))
    answers = no_answers(all_lines.sparkSession) if answers is None else answers
    given = [f.split()[0] for f in ANSWERS.split(", ")][1:]
    h = h.join(answers.select("path", *[F.col(c).alias(f"a_{c}") for c in given]), "path", "left")
    found = delimiter(F.col("first_line"))
    d = F.coalesce(F.when(F.col("a_delimiter") == "tab", "\t").otherwise(F.col("a_delimiter")), found)
    names = F.transform(F.split(F.lower("first_line"), F.concat(F.lit("["), F.coalesce(d, F.lit(",")), F.lit("]"))), lambda x: F.trim(x))
    mapping = F.coalesce("a_column_map", F.create_map().cast("map<string,string>"))
    lowered = F.transform_keys(mapping, lambda k, v: F.lower(F.trim(k)))
    names = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.coalesce(lowered[x], x))  # a trailing delimiter is tolerated
    h = h.withColumns({"delimiter": d, "header": names})
    first = F.try_element_at("header", F.lit(1))
    named = F.array(*map(F.lit, (*COLUMNS, IGNORED)))
    question = (
        F.when(F.col("n_lines") < 2, "empty")
        .when(F.col("a_delimiter").isNull() & (F.col("delimiter").isNull() | (F.col("delimiter") != ",")), "delimiter")
        .when(first.try_cast("double").isNotNull(), "no header")
        .when(~F.array_contains("header", "time") | ~F.array_contains("header", "ecg"), "columns")
        .when(F.col("a_column_map").isNull() & (F.slice("header", 1, 2) != F.array(F.lit("time"), F.lit("ecg"))), "columns")
        .when(F.size(F.array_except("header", named)) > 0, "columns")
    )
    return h.withColumn("question", question)


def rows(all_lines: DataFrame, head: DataFrame) -> DataFrame:
    """path, pos, n_fields, t_ns, ecg, hr, rr, marker, wide, bad, keep, comma for each data line of files without a question.

    Short rows are padded; wide rows are told apart.  A row without a time or a
    signal is bad and dropped; one with a bad rate or interval is bad and kept.
    ``comma`` marks one of the first 200 signals that reads as a number with a
    decimal comma, where nobody said which sign the file uses.
    """
    first = Window.partitionBy("path").orderBy("pos")
    d = all_lines.withColumn("_n", F.row_number().over(first)).where("_n > 1").join(head.where("question IS NULL").select("path", "header", "delimiter", "a_decimal"), "path")
    parts = F.transform(F.split("line", F.concat(F.lit("["), F.col("delimiter"), F.lit("]"))), lambda x: F.trim(x))
    d = d.withColumn("_p", parts)
    get = lambda name: F.try_element_at("_p", F.when(F.array_position("header", F.lit(name)) > 0, F.array_position("header", F.lit(name)).cast("int")))
    text = {c: F.nullif(get(c), F.lit("")) for c in COLUMNS}
    number = lambda c: F.when(F.col("a_decimal") == ",", F.replace(text[c], F.lit(","), F.lit("."))).otherwise(text[c]).try_cast("double")
    open_sign = F.col("a_decimal").isNull() & (F.col("delimiter") != ",") & (F.col("_n") <= 201)
    d = d.withColumns({"t_ns": text["time"].try_cast("bigint"), "ecg": number("ecg"), "hr": number("hr"), "rr": number("rr"), "marker": text["marker"], "_hr": text["hr"], "_rr": text["rr"], "comma": F.coalesce(open_sign & decimal_comma(text["ecg"]), F.lit(False))})
    drop = F.col("t_ns").isNull() | F.col("ecg").isNull() | F.isnan("ecg")
    odd = (F.col("_hr").isNotNull() & F.col("hr").isNull()) | (F.col("_rr").isNotNull() & F.col("rr").isNull())
    return d.select("path", "pos", F.size("_p").alias("n_fields"), "t_ns", "ecg", "hr", "rr", "marker", (F.size("_p") > F.size("header")).alias("wide"), (drop | odd).alias("bad"), (~drop).alias("keep"), "comma")


def plausible(t_ns: Column, now: Column) -> Column:
    """The readings of a time as a number (``unix``, ``device``) whose date lies between 2010 and two days from now."""
    s = t_ns / F.lit(1e9)
    ok = lambda x: F.timestamp_seconds(x).between(F.lit(EARLIEST).cast("timestamp"), now + F.expr("interval 2 days"))
    return F.array_compact(F.array(F.when(ok(s), "unix"), F.when(ok(s + DEVICE_EPOCH_S), "device")))


def choose_epoch(candidates: Column, t_ns: Column, name: Column) -> Column:
    """The only candidate, or of two the one within a day of the date in the file's name; else null."""
    day = filename_date(name)
    near = lambda shift: F.abs(F.datediff(F.timestamp_seconds(t_ns / F.lit(1e9) + shift).cast("date"), day)) <= 1
    both = F.when(near(0) & ~near(DEVICE_EPOCH_S), "unix").when(near(DEVICE_EPOCH_S) & ~near(0), "device")
    return F.when(F.size(candidates) == 1, candidates[0]).when(F.size(candidates) == 2, both)


def unit(p99: Column) -> Column:
    return F.when(p99 > MICROVOLT_P99, "uV").when(p99 <= MILLIVOLT_P99, "mV")


def recordings(spark: SparkSession, path: str, now: str, answers: DataFrame | None = None) -> DataFrame:
    """One row a file: status (ok, question, error), question, observed, unit, epoch, rate_hz, jitter_ns, n_samples, n_bad, started_at, answered.

    ``answers`` (ANSWERS, a row for each file at most) come before what is
    detected; ``answered`` lists what they settled, ``observed`` what made a
    question arise.
    """
    l = lines(spark, path)
    head = headers(l, answers)
    r = rows(l, head)
    w = Window.partitionBy("path").orderBy("pos")
    r = r.withColumn("_dt", F.when(F.col("keep"), F.col("t_ns") - F.lag(F.when(F.col("keep"), F.col("t_ns")), 1).over(w)))
    up = F.when(F.col("_dt") > 0, F.col("_dt"))
    a = r.groupBy("path").agg(
        F.count("*").alias("n_rows"), F.count_if("keep").alias("n_samples"), F.count_if("bad").alias("n_bad"), F.max("wide").alias("_wide"), F.max("comma").alias("_comma"), F.percentile(F.abs(F.when(F.col("keep"), F.col("ecg"))), F.lit(0.99)).alias("_p99"),
        F.percentile(up, F.lit(0.5)).alias("_dt"), F.stddev_pop(up).alias("jitter_ns"), F.count(up).alias("_n_up"), F.count_if(F.col("_dt") <= 0).alias("n_backward"), F.min_by(F.when(F.col("keep"), F.col("t_ns")), F.when(F.col("keep"), F.col("pos"))).alias("t0_ns"),
    )
    j = head.join(a, "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    j = j.withColumn("_c", plausible(F.col("t0_ns"), F.lit(now).cast("timestamp")))
    j = j.withColumns({"epoch": F.coalesce("a_epoch", choose_epoch(F.col("_c"), F.col("t0_ns"), name)), "unit": F.coalesce("a_unit", unit(F.col("_p99"))), "rate_hz": 1e9 / F.col("_dt")})
    question = F.coalesce(
        F.when(F.col("question") != "empty", F.col("question")), F.when(F.col("_wide"), "wide row"), F.when(F.col("_comma"), "decimal"), F.when(F.col("n_bad") > BAD_SHARE * F.col("n_rows"), "bad rows"),
        F.when(F.col("epoch").isNull() & (F.size("_c") == 0), "implausible time"), F.when(F.col("epoch").isNull(), "epoch"), F.when(F.col("unit").isNull(), "unit"),
    )
    error = F.when(F.col("question") == "empty", "empty").when(F.col("n_samples") < MIN_SAMPLES, "too short").when(F.col("_n_up") < MIN_SAMPLES - 1, "clock").when(~F.col("rate_hz").between(*RATE_HZ), "sampling rate")
    j = j.withColumn("error", F.when((F.col("question").isNull() & ~F.coalesce("_comma", F.lit(False))) | (F.col("question") == "empty"), error)).withColumn("question", F.when(F.col("error").isNull(), question))
    seen = (
        F.when(F.col("question").isin("delimiter", "no header", "columns"), F.substring("first_line", 1, 120))
        .when(F.col("question").isin("epoch", "implausible time"), F.concat(F.lit("first time "), F.col("t0_ns").cast("string")))
        .when(F.col("question") == "unit", F.concat(F.lit("99 % under "), F.round("_p99", 3).cast("string")))
        .when(F.col("question") == "bad rows", F.concat("n_bad", F.lit(" of "), "n_rows"))
    )
    keys = F.array_compact(F.array(*[F.when(F.col(f"a_{c}").isNotNull(), c) for c in ("delimiter", "decimal", "column_map", "unit", "epoch")]))
    shift = F.when(F.col("epoch") == "device", DEVICE_EPOCH_S).otherwise(0)
    return j.select(
        "path", F.when(F.col("error").isNotNull(), "error").when(F.col("question").isNotNull(), "question").otherwise("ok").alias("status"), "question", "error", "unit", "epoch", "rate_hz", "jitter_ns", "n_samples", "n_bad", "n_backward",
        F.timestamp_seconds(F.col("t0_ns") / F.lit(1e9) + shift).alias("started_at"), F.datediff(F.timestamp_seconds(F.col("t0_ns") / F.lit(1e9) + shift).cast("date"), filename_date(name)).alias("days_from_name"),
        seen.alias("observed"), keys.alias("answered"),
    )


# What a user is asked for each question, and what can be answered (nothing: the file has to be mended).
ASKED = {
    "delimiter": ("Which character separates the columns?", (",", ";", "tab")),
    "decimal": ("Which decimal separator does the file use?", (".", ",")),
    "columns": ("Which of the canonical columns is each column of the file?", (*COLUMNS, IGNORED)),
    "no header": ("Which columns does the file have, in order?", COLUMNS),
    "wide row": ("What do the extra fields contain?", ()),
    "bad rows": ("What are the rows that cannot be read?", ()),
    "epoch": ("When did this recording start?", ("unix", "device")),
    "implausible time": ("When did this recording start?", ("unix", "device")),
    "unit": ("Which unit is the signal in?", ("mV", "uV")),
}


def questions(found: DataFrame) -> DataFrame:
    """path, key, question, options, observed: what a user is to be asked about files of ``recordings``."""
    text = F.create_map(*[F.lit(x) for k, (q, _) in ASKED.items() for x in (k, q)])
    options = F.create_map(*[x for k, (_, o) in ASKED.items() for x in (F.lit(k), F.array(*map(F.lit, o)).cast("array<string>"))])
    return found.where("status = 'question'").select("path", F.col("question").alias("key"), text[F.col("question")].alias("question"), options[F.col("question")].alias("options"), "observed")


def samples(spark: SparkSession, path: str, now: str, answers: DataFrame | None = None) -> DataFrame:
    """path, pos, t_s (from the start), ecg_mv, hr, rr, marker of files that can be read without a question, or with the answers to it."""
    ok = recordings(spark, path, now, answers).where("status = 'ok'").select("path", "unit")
    l = lines(spark, path)
    r = rows(l, headers(l, answers)).where("keep").join(ok, "path")
    t0 = F.first("t_ns").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("path", "pos", ((F.col("t_ns") - t0) / F.lit(1e9)).alias("t_s"), F.when(F.col("unit") == "uV", F.col("ecg") / 1000.0).otherwise(F.col("ecg")).alias("ecg_mv"), "hr", "rr", "marker")


def accelerometer(spark: SparkSession, path: str) -> DataFrame:
    """path, t_ns, x_mg, y_mg, z_mg: the most frequent of ``; , tab`` splits, columns are found by name, g becomes mg, decimal commas points; rows with a gap go."""
    l = lines(spark, path)
    h = l.groupBy("path").agg(F.min_by("line", "pos").alias("_h"))
    n = {d: F.length("_h") - F.length(F.replace("_h", F.lit(d), F.lit(""))) for d in (";", ",", "\t")}
    best = F.when((n[";"] >= n[","]) & (n[";"] >= n["\t"]), ";").when(n[","] >= n["\t"], ",").otherwise("\t")
    h = h.withColumn("_d", best).withColumn("_names", F.transform(F.split(F.lower("_h"), F.concat(F.lit("["), F.col("_d"), F.lit("]"))), lambda x: F.trim(x)))
    place = lambda ok: F.array_position(F.transform("_names", ok), F.lit(True)).cast("int")

    def axis(a: str):
        return lambda x: (x == a) | F.startswith(x, F.lit(f"{a} ["))

    h = h.select(
        "path", "_h", "_d", place(lambda x: F.contains(x, F.lit("timestamp [ns]")) | (x == "time") | (x == "t_ns")).alias("_t"),
        *[place(axis(a)).alias(f"_{a}") for a in "xyz"], F.contains(F.lower("_h"), F.lit("[g]")).alias("_g"),
    )
    d = l.join(h, "path").where("line <> _h")
    parts = F.split("line", F.concat(F.lit("["), F.col("_d"), F.lit("]")))
    number = lambda c: F.replace(F.trim(F.try_element_at(parts, F.when(F.col(c) > 0, F.col(c)))), F.when(F.col("_d") != ",", F.lit(",")).otherwise(F.lit("\u0000")), F.lit(".")).try_cast("double")
    d = d.select("path", F.trim(F.try_element_at(parts, F.when(F.col("_t") > 0, F.col("_t")))).try_cast("bigint").alias("t_ns"), *[(number(f"_{a}") * F.when(F.col("_g"), 1000.0).otherwise(1.0)).alias(f"{a}_mg") for a in "xyz"])
    return d.where("t_ns IS NOT NULL AND x_mg IS NOT NULL AND y_mg IS NOT NULL AND z_mg IS NOT NULL")


def decimal_comma(sample: Column) -> Column:
    """Whether a number is written with a decimal comma."""
    return F.rlike(sample, F.lit(r"^-?\d+,\d+$"))
