"""Renderings of sessions: in full, as a summary, and compressed into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.tables import Steps
from sessionmill.functions.text import head_and_tail, head_only, js_len, tokens
from sessionmill.operators.profile import first_seen, messages_only

NO_USER, NO_TOOLS = "(no user prompt)", "(no tools)"


def header() -> Column:
    uuid = F.when(F.coalesce("uuid", F.lit("")) == "", "(no-uuid)").otherwise(F.left("uuid", F.lit(8)))
    ts = F.when(F.coalesce("ts", F.lit("")) == "", "(no-ts)").otherwise(F.col("ts"))
    return F.concat(F.lit("=== "), F.col("role"), F.lit(" "), uuid, F.lit(" @ "), ts, F.when(F.col("is_sidechain"), " sidechain").otherwise(""), F.lit(" ==="))


def _tool(rest: Column) -> Column:
    return F.concat(F.lit("[Tool: "), F.col("tool_name"), F.lit("] "), rest)


def _result(text: Column) -> Column:
    return F.concat(F.when(F.col("is_error"), "[Result error] ").otherwise("[Result] "), text)


def full_line() -> Column:
    return F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "tool_use", _tool(F.col("input_json"))).when(F.col("kind") == "tool_result", _result(F.col("text")))


def reduced_line(assistant: Column) -> Column:
    """A block in a compressed rendering; ``assistant`` is how an assistant's text is shortened."""
    keys = F.concat(F.lit("keys=["), F.array_join(F.coalesce(F.json_object_keys("input_json"), F.array().cast("array<string>")), ","), F.lit("]"))
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(assistant)
    return F.when(F.col("kind") == "text", text).when(F.col("kind") == "tool_use", _tool(keys)).when(F.col("kind") == "tool_result", _result(head_only(F.col("text"), 200, " ... [+{} chars]")))


def _messages(blocks: DataFrame, **lines: Column) -> DataFrame:
    """Each message's lines under its header, for each named rendering."""
    named = blocks.select("session_id", "seq", "block_no", "role", header().alias("header"), *[c.alias(n) for n, c in lines.items()])
    gathered = [F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("block_no", F.col(n).alias("line"))))).alias(n) for n in lines]
    grouped = named.groupBy("session_id", "seq", "role").agg(F.first("header").alias("header"), *gathered)
    return grouped.select("session_id", "seq", "role", *[F.concat(F.array("header"), F.transform(n, lambda x: x["line"])).alias(n) for n in lines])


def _joined(messages: DataFrame, column: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.array_join(column, "\n").alias("text"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda m: m["text"]), "\n").alias("content"), F.count("*").alias("message_count_after"))


def full(blocks: DataFrame) -> DataFrame:
    """session_id, content, message_count_after."""
    return _joined(_messages(messages_only(blocks), line=full_line()), "line")


def summary(blocks: DataFrame) -> DataFrame:
    """The first user text and the tools used: session_id, content, message_count_after."""
    blocks = messages_only(blocks)
    asked = (F.col("role") == "user") & (F.col("kind") == "text") & (F.col("text") != "")
    first = blocks.groupBy("session_id").agg(F.min_by(F.when(asked, F.col("text")), F.when(asked, F.struct("seq", "block_no"))).alias("prompt"), F.min(F.when(asked, F.col("seq"))).alias("first"))
    tools = first_seen(blocks.where("kind = 'tool_use'"), F.col("tool_name"), "tools")
    with_tools = blocks.where("kind = 'tool_use'").groupBy("session_id").agg(F.count_distinct("seq").alias("n"))
    asked_too = blocks.where("kind = 'tool_use'").select("session_id", F.col("seq").alias("first")).distinct().withColumn("both", F.lit(1))
    out = first.join(tools, "session_id", "left").join(with_tools, "session_id", "left").join(asked_too, ["session_id", "first"], "left")
    lines = F.concat_ws("\n", F.coalesce("prompt", F.lit(NO_USER)), F.when(F.size("tools") > 0, F.concat(F.lit("Tools used: "), F.array_join("tools", ", "))).otherwise(NO_TOOLS))
    count = F.coalesce("n", F.lit(0)) + F.when(F.col("first").isNotNull() & F.col("both").isNull(), 1).otherwise(0)
    return out.select("session_id", lines.alias("content"), count.cast("bigint").alias("message_count_after"))


def _older(weights: DataFrame, chunk: int) -> DataFrame:
    """``weights(session_id, seq, w)`` with ``older``, the sum of w of the session before seq.

    A session is cut into chunks of ``chunk`` places: sums run within a chunk, and
    over the chunks' own sums, so that no task holds a long session.
    """
    cut = weights.withColumn("chunk", F.floor(F.col("seq") / chunk))
    sums = cut.groupBy("session_id", "chunk").agg(F.sum("w").alias("chunk_w"))
    ahead = F.sum("chunk_w").over(Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("w").over(Window.partitionBy("session_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("within", F.coalesce(within, F.lit(0))).join(sums.select("session_id", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["session_id", "chunk"])
    return placed.withColumn("older", F.col("within") + F.col("ahead")).drop("chunk", "within", "ahead")


def compressed(blocks: DataFrame, target: int, on_fit: str = "error", chunk: int = 4096) -> DataFrame:
    """Sessions within ``target`` tokens: session_id, outcome, pass, message_count_after, estimated_tokens, content.

    Pass 1 shortens blocks, pass 2 shortens assistants' texts more, pass 3 leaves
    out the oldest assistant messages, as few as it takes: one stays exactly if
    leaving out all those before it is enough. Users' messages always stay; outcome is
    compression_infeasible if they alone are too long, and fits_already (without
    content, unless ``on_fit`` is "full") if the whole session is within the target.

    What is decided on is lengths, one row a message; only what stays is rendered, in
    the one way that was chosen. So a session of any length is spread over tasks, and
    what comes together of it is within the target.
    """
    blocks = messages_only(blocks)
    steps, text = Steps(blocks.sparkSession, "compress"), F.col("text")
    ways = {"whole": full_line(), "one": reduced_line(head_and_tail(text, 800, 400, 200)), "two": reduced_line(head_only(text, 200, " ... [truncated {} chars]"))}
    head = F.first(js_len(header())) + 1
    sized = blocks.groupBy("session_id", "seq", "role").agg(*[(head + F.coalesce(F.sum(js_len(c) + 1), F.lit(0))).alias(n) for n, c in ways.items()])
    sized = steps.store(sized.withColumn("gone", F.when(F.col("role") == "assistant", F.col("two")).otherwise(0)), "sizes")
    totals = sized.groupBy("session_id").agg(*[F.sum(n).alias(n) for n in (*ways, "gone")])
    fits = lambda chars: tokens(F.greatest(chars, F.lit(0))) <= target
    step = F.when(fits(F.col("whole") - 1), 0).when(fits(F.col("one") - 1), 1).when(fits(F.col("two") - 1), 2).when(fits(F.col("two") - 1 - F.col("gone")), 3).otherwise(4)
    decided = steps.store(totals.select("session_id", step.alias("pass"), F.col("two").alias("total")), "decided")
    told = decided.where(F.col("pass").between(0 if on_fit == "full" else 1, 3))
    cut = told.where(F.col("pass") == 3)
    weights = sized.join(cut.select("session_id", "total"), "session_id")
    stays = _older(weights.where("role = 'assistant'").select("session_id", "seq", "role", "total", F.col("two").alias("w")), chunk).where(fits(F.col("total") - 1 - F.col("older")))
    stays = stays.select("session_id", "seq", "role").unionByName(weights.where("role <> 'assistant'").select("session_id", "seq", "role"))
    left = blocks.join(told.where(F.col("pass") < 3).select("session_id", "pass"), "session_id").unionByName(blocks.join(stays.withColumn("pass", F.lit(3)), ["session_id", "seq", "role"]), allowMissingColumns=True)
    line = F.when(F.col("pass") == 0, ways["whole"]).when(F.col("pass") == 1, ways["one"]).otherwise(ways["two"])
    rendered = _joined(_messages(left, line=line), "line")
    out = decided.join(rendered, "session_id", "left")
    with_content = F.col("pass").between(0 if on_fit == "full" else 1, 3)
    content = F.when(with_content, F.coalesce("content", F.lit("")))
    outcome = F.when(F.col("pass") == 0, "fits_already").when(F.col("pass") == 4, "compression_infeasible").otherwise("ok")
    return out.select("session_id", outcome.alias("outcome"), "pass", F.when(with_content, F.coalesce("message_count_after", F.lit(0))).alias("message_count_after"), tokens(js_len(content)).alias("estimated_tokens"), content.alias("content"))


def external_summary(text: Column, tools: Column) -> Column:
    """A summary from outside, with the tools that the session used."""
    return F.concat_ws("\n", text, F.when(F.size(tools) > 0, F.concat(F.lit("Tools used: "), F.array_join(tools, ", "))).otherwise(NO_TOOLS))
