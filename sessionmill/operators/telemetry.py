"""What happened in agent runs. ``steps`` has session_id, seq, ts, type, tool_name, error_code, input_tokens, output_tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAG_AT = 6
QUIET_TOOL = "report_progress"


def error_streaks(results: DataFrame, flag_at: int = FLAG_AT) -> DataFrame:
    """Runs of the same tool and error code one after the other; a success or another error ends a run.

    ``results(session_id, seq, tool_name, error_code)``, error_code null for a
    success. Returns session_id, tool_name, error_code, first_seq, length, flagged.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    same = F.lag(F.struct("tool_name", "error_code")).over(order).eqNullSafe(F.struct("tool_name", "error_code"))
    islands = results.withColumn("fresh", F.when(same & F.col("error_code").isNotNull(), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    runs = islands.where("error_code IS NOT NULL").groupBy("session_id", "island", "tool_name", "error_code").agg(F.min("seq").alias("first_seq"), F.count("*").alias("length"))
    return runs.select("session_id", "tool_name", "error_code", "first_seq", "length", (F.col("length") >= flag_at).alias("flagged"))


def tool_elapsed(calls: DataFrame, starts: DataFrame) -> DataFrame:
    """Milliseconds since the tool call before, or since the run's start: session_id, seq, elapsed_ms.

    ``calls(session_id, seq, ts, tool_name)``, ``starts(session_id, started_at)``; progress reports are left out.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    known = calls.where(F.col("tool_name") != QUIET_TOOL).join(starts, "session_id", "left").withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "started_at")})
    before = F.coalesce(F.lag("ts").over(order), F.col("started_at"))
    return known.select("session_id", "seq", (F.unix_millis("ts") - F.unix_millis(before)).alias("elapsed_ms"))


def run_totals(steps: DataFrame) -> DataFrame:
    """turns, tool calls, errors and tokens of each session."""
    return steps.groupBy("session_id").agg(
        F.count_if(F.col("type") == "assistant_text").alias("turns"),
        F.count_if(F.col("type") == "tool_call").alias("tool_calls"),
        F.count("error_code").alias("errors"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def grand_totals(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for a run: turns, input_tokens, output_tokens, cost_usd, target_count, processed_count, deferred_count.

    ``totals(session_id, turns, input_tokens, output_tokens, cost_usd)`` has what each
    session used, ``targets(session_id, status)`` what became of it. Tokens are null where
    none were used, and the cost where no session told one. The deferred sessions
    themselves are the rows of ``targets``.
    """
    some = lambda c: F.when(F.sum(c) > 0, F.sum(c)).alias(c)
    used = totals.agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), some("input_tokens"), some("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.lit(1).alias("run"))
    late = F.count_if(F.col("status") == "deferred")
    met = targets.agg(F.count("*").alias("target_count"), (F.count("*") - late).alias("processed_count"), late.alias("deferred_count"), F.lit(1).alias("run"))
    return used.join(met, "run").drop("run")


def repeated_targets(targets: DataFrame) -> DataFrame:
    """``targets(session_id, transcript_sha256)`` with how often the id is listed, and a label that tells its versions apart."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    label = F.when(n > 1, F.concat(F.left("session_id", F.lit(8)), F.lit("@"), F.left("transcript_sha256", F.lit(4)))).otherwise(F.left("session_id", F.lit(8)))
    return targets.withColumns({"listed": n, "label": label})
