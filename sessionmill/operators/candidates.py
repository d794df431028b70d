"""Proposed knowledge items: requests, recorded answers, and the validation of what was proposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.functions.text import CATEGORIES, SEVERITIES, UNIVERSALITIES, js_left, js_len, js_trim

REQUIRED = ("category", "title_slug", "summary", "body_markdown", "tags", "paths", "universality")
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
TAG = r"^[a-z][a-z0-9_]*\z"
HEADING = "(?m)^## [A-Z]"
BODY_LIMIT = 8000
TRUNCATED = "\n\n[...truncated to 8000 chars]"


def _string(item: str, name: str) -> Column:
    """A field's value if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _strings(item: str, name: str) -> Column:
    """A field's values if it is an array of strings."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.coalesce(F.try_variant_get(item, f"$.{name}", "array<string>"), F.array().cast("array<string>")))


def validated(items: DataFrame, item: str = "item") -> DataFrame:
    """Adds reject_step (1 to 9, null for a valid item) and the item's fields as they would be kept.

    ``item`` is a JSON string. Steps: required fields, category, slug, summary, tags,
    paths, universality, severity, body; the first that fails counts. A body over
    the limit is cut; an anti-pattern without severity is normal.
    """
    parsed = items.withColumn("_v", F.try_parse_json(item))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    names = F.coalesce(F.json_object_keys(item), F.array().cast("array<string>"))
    fields = {n: _string("_v", n) for n in ("category", "title_slug", "summary", "body_markdown", "universality")} | {n: _strings("_v", n) for n in ("tags", "paths")}
    parsed = parsed.withColumns({"_names": names, "_severity": F.try_variant_get("_v", "$.severity", "variant"), **{f"_{n}": c for n, c in fields.items()}})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    category, severity = F.col("_category"), F.coalesce(F.schema_of_variant("_severity"), F.lit("VOID"))
    named = _string("_v", "severity")
    severity_ok = F.when(category == "anti-pattern", (severity == "VOID") | F.coalesce(named.isin(*SEVERITIES), F.lit(False))).otherwise(severity == "VOID")
    body = F.col("_body_markdown")
    step = (
        F.when(no(is_object) | (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "_names")) > 0), 1)
        .when(no(category.isin(*[c[0] for c in CATEGORIES])), 2)
        .when(no(F.col("_title_slug").rlike(SLUG) & (F.length("_title_slug") <= 32)), 3)
        .when(no((js_trim(F.col("_summary")) != "") & (F.length("_summary") <= 60)), 4)
        .when(no(F.size("_tags").between(1, 5) & F.forall("_tags", lambda t: t.rlike(TAG))), 5)
        .when(no(F.forall("_paths", lambda p: p != "")), 6)
        .when(no(F.col("_universality").isin(*UNIVERSALITIES)), 7)
        .when(no(severity_ok), 8)
        .when(no((js_len(js_trim(body)) >= 50) & body.rlike(HEADING)), 9)
    )
    kept = {n: F.col(f"_{n}") for n in fields} | {
        "body_markdown": F.when(js_len(body) > BODY_LIMIT, F.concat(js_left(body, BODY_LIMIT), F.lit(TRUNCATED))).otherwise(body),
        "severity": F.when(category == "anti-pattern", F.coalesce(named, F.lit("normal"))),
    }
    out = parsed.withColumn("reject_step", step)
    return out.select(*items.columns, "reject_step", *[F.when(F.col("reject_step").isNull(), c).alias(n) for n, c in kept.items()])


def extraction_outcomes(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """session_id, total, rejected, outcome (ok, empty, all_items_rejected) of each session asked for."""
    counts = verdicts.groupBy("session_id").agg(F.count("*").alias("total"), F.count("reject_step").alias("rejected"))
    out = sessions.select("session_id").distinct().join(counts, "session_id", "left").select("session_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return out.withColumn("outcome", F.when(F.col("total") == 0, "empty").when(F.col("total") == F.col("rejected"), "all_items_rejected").otherwise("ok"))


def answer_outcomes(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """What became of each session's request: session_id, outcome, total_extracted, rejected_count, input_tokens, output_tokens, cost_usd.

    ``answers(session_id, items, input_tokens, output_tokens, cost_usd)`` has the items as
    JSON text, one answer a session. Outcomes: llm_call_failed without an answer,
    llm_output_unparseable if its items are no list, all_items_rejected if there are
    some and none is valid, else ok. Only valid items count as extracted; an empty list
    is ok. Usage is told of answers that are ok; a refused one has its number of
    rejected items alone.
    """
    asked = sessions.select("session_id").distinct().join(answers.withColumn("answered", F.lit(True)), "session_id", "left")
    listed = F.try_variant_get(F.try_parse_json("items"), "$", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json("items")).startswith("ARRAY"), F.lit(False))
    each = asked.select("session_id", F.explode(F.when(is_list, listed)).alias("one")).select("session_id", F.to_json("one").alias("item"))
    counts = validated(each).groupBy("session_id").agg(F.count("*").alias("n"), F.count("reject_step").alias("rejected"))
    told = asked.join(counts, "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    outcome = F.when(F.col("answered").isNull(), "llm_call_failed").when(~is_list, "llm_output_unparseable").when((F.col("n") > 0) & (F.col("n") == F.col("rejected")), "all_items_rejected").otherwise("ok")
    told = told.withColumn("outcome", outcome)
    good = F.col("outcome") == "ok"
    usage = [F.when(good, F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")]
    return told.select("session_id", "outcome", F.when(good, F.col("n") - F.col("rejected")).alias("total_extracted"), F.when(good | (F.col("outcome") == "all_items_rejected"), F.col("rejected")).alias("rejected_count"), *usage)


def request_key(system: Column, user: Column, model: Column, tools: Column) -> Column:
    """The SHA-256 of a request as JSON, whatever the order of its tools."""
    return F.sha2(F.to_json(F.struct(F.array_sort(tools).alias("allowedTools"), model.alias("model"), system.alias("systemPrompt"), user.alias("userMessage"))), 256)


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """``requests(..., request_key)`` with the recorded answer's columns and ``found``."""
    return requests.join(recorded.withColumn("found", F.lit(True)), "request_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def extraction_prompt(context: Column, language: Column, cwd: Column, tokens: Column) -> Column:
    """The request's text for one session."""
    return F.concat_ws("\n", F.concat(F.lit("language: "), language), F.concat(F.lit("cwd: "), F.coalesce(cwd, F.lit("(none)"))), F.concat(F.lit("estimated_tokens: "), tokens.cast("string")), F.lit(""), context)
