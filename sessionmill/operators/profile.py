"""Session profiles from blocks of messages.

``blocks`` has a row for each content block: session_id, seq, block_no, role, cwd,
kind (text, tool_use, tool_result, or null for a message without blocks), text,
tool_name, input_json, is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.text import js_len, language, tokens

READ_ONLY = ("Read", "Glob", "Grep")
ROLES = ("user", "assistant")


def block_chars() -> Column:
    """What a block adds to a session's size: its text, or a tool's input as JSON."""
    return F.coalesce(js_len(F.when(F.col("kind") == "tool_use", F.coalesce("input_json", F.lit("{}"))).otherwise(F.col("text"))), F.lit(0))


def messages_only(blocks: DataFrame) -> DataFrame:
    """Blocks of user and assistant messages."""
    return blocks.where(F.col("role").isin(*ROLES))


def _tool(*names: str) -> Column:
    return F.count_if((F.col("kind") == "tool_use") & F.col("tool_name").isin(*names))


def first_seen(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """The distinct non-null values of each session, in order of encounter: session_id, ``name`` (array)."""
    place = F.min(F.struct("seq", "block_no")).alias("place")
    once = blocks.select("session_id", "seq", "block_no", value.alias("value")).where("value IS NOT NULL").groupBy("session_id", "value").agg(place)
    return once.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(name))


def dominant_cwd(blocks: DataFrame) -> DataFrame:
    """session_id, cwd (the most frequent over messages, the first met on ties), n_cwds, cwds_seen (in order of encounter), is_multi_cwd."""
    messages = blocks.select("session_id", "seq", "cwd").where("cwd IS NOT NULL").distinct()
    each = messages.groupBy("session_id", "cwd").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return each.groupBy("session_id").agg(F.max_by("cwd", F.struct("n", -F.col("first"))).alias("cwd"), F.count("*").alias("n_cwds"), F.transform(F.array_sort(F.collect_list(F.struct("first", "cwd"))), lambda x: x["cwd"]).alias("cwds_seen"), (F.count("*") > 1).alias("is_multi_cwd"))


def session_profile(blocks: DataFrame, min_user_turns: int = 3, read_only: tuple[str, ...] = READ_ONLY) -> DataFrame:
    """One row per session: sizes, tools, language, directory, and why it would be skipped as trivial.

    Messages are counted by their first block, so that one distinct count is left
    and rows need not be repeated for several.
    """
    blocks = messages_only(blocks)
    text = F.when(F.col("kind") == "text", F.col("text"))
    used = F.col("kind") == "tool_use"
    sizes = blocks.groupBy("session_id").agg(
        F.count_if(F.coalesce("block_no", F.lit(0)) == 0).alias("message_count"),
        F.count_distinct(F.when((F.col("role") == "user") & (F.coalesce(text, F.lit("")) != ""), F.col("seq"))).alias("user_turns"),
        tokens(F.sum(block_chars())).alias("tokens"),
        F.coalesce(F.bool_or(F.col("is_error")), F.lit(False)).alias("has_errors"),
        _tool("Read").alias("tools_read"),
        _tool("Write").alias("tools_write"),
        _tool("Edit", "MultiEdit").alias("tools_edit"),
        _tool("Bash").alias("tools_bash"),
        F.count_if(used & ~F.col("tool_name").isin("Read", "Write", "Edit", "MultiEdit", "Bash")).alias("tools_other"),
        F.count_if(used & ~F.col("tool_name").isin(*read_only)).alias("writes"),
        F.count_if(used).alias("uses"),
        F.coalesce(F.sum(F.regexp_count(text, F.lit("[가-힣]"))), F.lit(0)).alias("hangul"),
        F.coalesce(F.sum(F.regexp_count(text, F.lit("[A-Za-z]"))), F.lit(0)).alias("ascii_letters"),
    )
    skip = F.when(F.col("user_turns") < min_user_turns, "few-user-turns").when(F.col("uses") == 0, "no-tools").when(F.col("writes") == 0, "read-only")
    sizes = sizes.withColumns({"language": language(F.col("hangul"), F.col("ascii_letters")), "skip_reason": skip}).drop("hangul", "ascii_letters", "writes", "uses")
    return sizes.join(dominant_cwd(blocks), "session_id", "left").withColumns({"n_cwds": F.coalesce("n_cwds", F.lit(0)), "cwds_seen": F.coalesce("cwds_seen", F.array().cast("array<string>")), "is_multi_cwd": F.coalesce("is_multi_cwd", F.lit(False))})


def touched(blocks: DataFrame) -> DataFrame:
    """session_id, paths and tools: the files that tools were given and the tools' names, in order of encounter."""
    blocks = messages_only(blocks).where("kind = 'tool_use'")
    given = F.try_variant_get(F.try_parse_json("input_json"), "$.file_path", "variant")
    path = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string"))
    paths = first_seen(blocks, F.when(path != "", path), "paths")
    return paths.join(first_seen(blocks, F.col("tool_name"), "tools"), "session_id", "full")


def several_kbs(session_kbs: DataFrame) -> DataFrame:
    """Sessions whose directories fall into more than one KB: session_id, n_kbs."""
    return session_kbs.where("kb_path IS NOT NULL").groupBy("session_id").agg(F.count_distinct("kb_path").alias("n_kbs")).where("n_kbs > 1")
