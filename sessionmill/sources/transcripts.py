"""Transcript files: their list, their lines, and the blocks of their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.sources.files import walk

SUMMARY_SUFFIX = "-summary"
RAW_BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:variant>>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts under ``root``, without opening them: path, dir, session_stem, modification_ms, length, has_summary_sibling."""
    files = walk(spark, root).where("path LIKE '%.jsonl'")
    files = files.select("path", "dir", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_stem"), "modification_ms", "length")
    is_summary = F.col("session_stem").endswith(SUMMARY_SUFFIX)
    siblings = files.where(is_summary).select("dir", F.regexp_replace("session_stem", f"{SUMMARY_SUFFIX}$", "").alias("session_stem")).withColumn("has_summary_sibling", F.lit(True))
    return files.where(~is_summary).join(siblings, ["dir", "session_stem"], "left").withColumn("has_summary_sibling", F.coalesce("has_summary_sibling", F.lit(False)))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _string(path: str) -> Column:
    """A value that is a string; numbers and others do not count."""
    return F.when(F.schema_of_variant(_get(path, "variant")) == "STRING", _get(path, "string"))


def _flag(path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(_get(path, "variant")) == "BOOLEAN", _get(path, "boolean")), F.lit(False))


DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def strict_json(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the value of JSON text, null if it is not exactly one value; of a key that is given twice the last counts.

    Spark's parser takes what follows a value for nothing. So the text is read as the
    first of two elements of a list; the second is made from the text's hash, and no
    text closes the list before it and still ends in it.
    """
    spark = df.sparkSession
    seal = F.hex(F.xxhash64(column))
    before = spark.conf.get(DUPLICATES)
    # the setting is read as the expression is made
    spark.conf.set(DUPLICATES, "true")
    try:
        out = df.withColumn(name, F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(',"'), seal, F.lit('"]'))))
        out.schema  # noqa: B018
    finally:
        spark.conf.set(DUPLICATES, before)
    sealed = (F.try_variant_get(name, "$[1]", "string") == seal) & F.try_variant_get(name, "$[2]", "variant").isNull()
    return out.withColumn(name, F.when(sealed, F.try_variant_get(name, "$[0]", "variant")))


def plain_numbers(text: Column) -> Column:
    """JSON text with fractions as short as they can be: 1.0 is 1 and 2.50 is 2.5; strings stay. Exponents are left as they are."""
    string = r'("(?:[^"\\]|\\.)*+")'
    zeros = F.regexp_replace(text, rf"{string}|(-?[0-9]+)\.0+(?![0-9eE])", "$1$2")
    return F.regexp_replace(zeros, rf"{string}|(-?[0-9]+\.[0-9]*[1-9])0+(?![0-9eE])", "$1$2")


def parsed(raw: DataFrame) -> DataFrame:
    """Lines as values: path, line_no, raw, is_bad, type, and of messages session_id, cwd, uuid, ts, is_sidechain."""
    out = strict_json(raw, "raw", "v")
    return out.select(
        "path", "line_no", "raw", "v", F.col("v").isNull().alias("is_bad"), _string("$.type").alias("type"), _string("$.sessionId").alias("session_id"), _string("$.cwd").alias("cwd"),
        F.coalesce(_string("$.uuid"), F.lit("")).alias("uuid"), F.coalesce(_string("$.timestamp"), F.lit("")).alias("ts"), _flag("$.isSidechain").alias("is_sidechain"),
    )


def is_message() -> Column:
    return F.col("type").isin("user", "assistant")


def parse_outcomes(found: DataFrame) -> DataFrame:
    """Whether each strictly read file can be used: path, outcome, bad_line (the first)."""
    sums = found.groupBy("path").agg(
        F.min(F.when(F.col("is_bad"), F.col("line_no"))).alias("bad_line"),
        F.count_if(is_message()).alias("messages"),
        F.count_if(is_message() & (F.col("session_id") != "")).alias("with_id"),
        F.count_if(is_message() & F.col("cwd").isNotNull()).alias("with_cwd"),
    )
    outcome = F.when(F.col("bad_line").isNotNull(), "json_parse_failed").when(F.col("messages") == 0, "empty_transcript").when(F.col("with_id") == 0, "missing_session_id").when(F.col("with_cwd") == 0, "no_cwd_found").otherwise("ok")
    return sums.select("path", outcome.alias("outcome"), "bad_line")


def blocks(found: DataFrame) -> DataFrame:
    """Blocks of the messages of each file, as the operators take them; seq is the line.

    The session id is that of the file's first message that has one. A message
    without known blocks has one row of kind null.
    """
    messages = found.where(is_message())
    ids = messages.where(F.coalesce("session_id", F.lit("")) != "").groupBy("path").agg(F.min_by("session_id", "line_no").alias("session_id"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    parts = F.transform(F.try_variant_get("v", "$.message.content", "array<variant>"), lambda p: p)
    rows = messages.select("path", F.col("line_no").alias("seq"), F.col("type").alias("role"), "uuid", "ts", "is_sidechain", "cwd", "raw", F.when(is_text, F.array(content)).otherwise(parts).alias("parts"), is_text.alias("is_text"))
    rows = rows.select("*", F.posexplode_outer("parts").alias("block_no", "v")).drop("parts")
    kind = F.when(F.coalesce(F.col("is_text"), F.lit(False)), "text").otherwise(_string("$.type"))
    result = F.try_variant_get("v", "$.content", "variant")
    listed = F.try_variant_get("v", "$.content", "array<variant>")
    inner = F.transform(listed, lambda p: F.when((F.try_variant_get(p, "$.type", "string") == "text") & F.try_variant_get(p, "$.text", "string").isNotNull(), F.try_variant_get(p, "$.text", "string")).otherwise(F.to_json(p)))
    flat = F.when(F.schema_of_variant(result) == "STRING", F.try_variant_get("v", "$.content", "string")).otherwise(F.array_join(inner, "\n"))
    text = F.when(kind == "tool_result", F.coalesce(flat, F.lit(""))).when(F.col("is_text"), F.try_variant_get("v", "$", "string")).otherwise(_string("$.text"))
    # the input keeps the order of its keys as text
    given = F.expr("get_json_object(raw, concat('$.message.content[', block_no, '].input'))")
    known = (kind == "text") & text.isNotNull() | (kind == "tool_use") & _string("$.name").isNotNull() | (kind == "tool_result")
    out = rows.select("path", "seq", "block_no", "role", "uuid", "ts", "is_sidechain", "cwd", F.when(known, kind).alias("kind"), F.when(known, text).alias("text"), F.when(kind == "tool_use", _string("$.name")).alias("tool_name"), F.when(kind == "tool_use", F.coalesce(plain_numbers(given), F.lit("{}"))).alias("input_json"), F.when(kind == "tool_result", _flag("$.is_error")).otherwise(F.lit(False)).alias("is_error"))
    return out.join(ids, "path")
