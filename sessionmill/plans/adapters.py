"""The given tables as inputs of the operators, in Spark and, for the oracles, in SQL.

Conversations stand for transcripts, events for tool calls, page addresses for
directories and touched files, documents for knowledge items and for files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = {"view": "Read", "click": "Edit", "purchase": "Bash"}
TAGS = ("the", "and", "der", "des", "los", "que", "une", "est", "for", "die")
NOW = "2024-06-15T12:00:00+00:00"
#: A slug is bounded by its schema (32); this leaves room for a suffix.
SLUG_LENGTH = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_input() -> Column:
    return F.concat(F.lit('{"file_path":"/src/f'), F.regexp_extract("props", "([0-9]+)", 1), F.lit('.py"}'))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions c<conv_id> of texts and u<user_id> of tool calls, their errors, and sign-ups as user texts."""
    nothing = F.lit(None).cast("string")
    talk = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("seq"), F.lit(0).alias("block_no"), "role", F.md5(F.concat_ws(":", "conv_id", "turn").cast("binary")).alias("uuid"),
        F.lit("").alias("ts"), F.lit(False).alias("is_sidechain"), F.concat(F.lit("/work/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), F.lit("text").alias("kind"), "text", nothing.alias("tool_name"), nothing.alias("input_json"), F.lit(False).alias("is_error"),
    )
    kind = F.when(F.col("event_type") == "signup", "text").when(F.col("event_type") == "error", "tool_result").otherwise("tool_use")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Bash")
    calls = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), F.lit(0).alias("block_no"), F.when(kind == "text", "user").otherwise("assistant").alias("role"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("uuid"),
        F.lit("").alias("ts"), (F.col("event_id") % 9 == 0).alias("is_sidechain"), F.concat(F.lit("/src/d"), (F.col("event_id") % 3).cast("string")).alias("cwd"), kind.alias("kind"),
        F.when(kind == "text", F.concat(F.lit("signup "), F.col("event_id").cast("string"))).when(kind == "tool_result", F.col("props")).alias("text"),
        tool.alias("tool_name"), F.when(kind == "tool_use", event_input()).alias("input_json"), (kind == "tool_result").alias("is_error"),
    )
    return talk.unionByName(calls)


BLOCKS = """
blocks AS (
  SELECT concat('c', conv_id) AS session_id, turn AS seq, role, md5(concat(conv_id, ':', turn)) AS uuid, false AS is_sidechain, concat('/work/p', conv_id % 7) AS cwd, 'text' AS kind, text, NULL AS tool_name, NULL AS input_json, false AS is_error FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL
  SELECT concat('u', user_id), event_id, CASE WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END, md5(event_id::VARCHAR), event_id % 9 = 0, concat('/src/d', event_id % 3),
    CASE event_type WHEN 'signup' THEN 'text' WHEN 'error' THEN 'tool_result' ELSE 'tool_use' END, CASE event_type WHEN 'signup' THEN concat('signup ', event_id) WHEN 'error' THEN props END,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Bash' END, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat('{"file_path":"/src/f', regexp_extract(props, '([0-9]+)', 1), '.py"}') END, event_type = 'error' FROM events)
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: page addresses as absolute paths, without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(bare, "/+$", "").alias("path"))


def registry(paths: DataFrame) -> DataFrame:
    """KBs at every other host and at hosts' language directories of two letters e or d first."""
    host, lang = F.regexp_extract("path", "^/[^/]+", 0), F.regexp_extract("path", "^/[^/]+/[ed][a-z]", 0)
    dirs = paths.select(host.alias("kb_dir")).where(F.length("kb_dir") % 2 == 0).union(paths.select(lang).where(lang != "")).distinct()
    return dirs.select(F.concat("kb_dir", F.lit("/.kb")).alias("kb_path"), "kb_dir")


def boundaries(paths: DataFrame) -> DataFrame:
    return paths.select(F.regexp_extract("path", "^/[^/]+/[a-z][a-z]", 0).alias("dir")).where("dir LIKE '%/de'").distinct()


PATHS = r"""
paths AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/+$', '') AS path FROM pages),
registry AS (SELECT concat(kb_dir, '/.kb') AS kb_path, kb_dir FROM (SELECT regexp_extract(path, '^/[^/]+') AS kb_dir FROM paths WHERE length(regexp_extract(path, '^/[^/]+')) % 2 = 0 UNION SELECT regexp_extract(path, '^/[^/]+/[ed][a-z]') FROM paths WHERE regexp_extract(path, '^/[^/]+/[ed][a-z]') <> '')),
boundaries AS (SELECT DISTINCT regexp_extract(path, '^/[^/]+/[a-z][a-z]') AS dir FROM paths WHERE regexp_extract(path, '^/[^/]+/[a-z][a-z]') LIKE '%/de')
"""


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "-")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge item for each document: KBs of about 40 documents, ten of each category, slug of the first letters, tags by words that occur."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    number = F.floor(F.col("doc_id") / 80) % 999 + 1
    group = F.floor(F.col("doc_id") / 20) % 4
    kind = F.element_at(F.array(*map(F.lit, ("decision", "learning", "reusable", "anti-pattern"))), (group + 1).cast("int"))
    # what the start of a text gives is the start of what all of it gives: the rest is read only where that is too short
    begun = _letters(F.left("text", F.lit(16 * SLUG_LENGTH)))
    d = d.withColumns({"_low": F.lower("text"), "_begun": F.left(F.when(F.length(begun) >= SLUG_LENGTH, begun).otherwise(_letters(F.col("text"))), F.lit(SLUG_LENGTH))})
    d = d.withColumn("_slug", F.regexp_replace("_begun", "^-+|-+$", ""))
    slug = F.col("_slug")
    tags = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(f" {t} ")), t) for t in TAGS]))
    return d.select(
        F.concat(F.lit("/kb/"), "source", F.lit("/"), F.floor(F.col("doc_id") / 800).cast("string")).alias("kb_path"), "doc_id",
        F.concat(F.substring(F.lit("DLRA"), (group + 1).cast("int"), F.lit(1)), F.lit("-"), F.lpad(number.cast("string"), 3, "0")).alias("item_id"),
        kind.alias("category"), F.when(slug == "", "untitled").otherwise(slug).alias("slug"), F.lit("T").alias("title"), F.col("text").alias("summary"), F.slice(tags, 1, 5).alias("tags"),
        F.array(F.concat(F.lit("src/f"), (F.col("doc_id") % 37).cast("string"), F.lit(".py")), F.concat(F.lit("lib/g"), (F.col("doc_id") % 11).cast("string"), F.lit(".py"))).alias("paths"),
        F.when(F.col("doc_id") % 13 == 5, "deprecated").when(F.col("doc_id") % 13 == 7, "superseded-by:D-001").when(F.col("doc_id") % 13 == 9, "archived").otherwise("active").alias("status"),
        F.when(F.col("doc_id") % 3 == 0, "universal").otherwise("unverified").alias("universality"), F.when(group == 3, F.when(number % 2 == 0, "critical").otherwise("normal")).alias("severity"),
        F.lit("2023-01-01T00:00:00+00:00").alias("created"), F.concat(F.when(F.col("doc_id") % 2 == 0, "2023").otherwise("2024"), F.lit("-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("updated"),
        F.lit(None).cast("string").alias("archived_at"), F.lit(None).cast("string").alias("archive_reason"), F.when(F.col("doc_id") % 13 == 9, "archive").otherwise("active").alias("location"), F.col("text").alias("body"),
    )


_TAG_LIST = ", ".join(f"CASE WHEN contains(lower(text), ' {t} ') THEN '{t}' END" for t in TAGS)
ITEMS = f"""
raw_items AS (SELECT *, regexp_replace(substr(regexp_replace(lower(text), '[^a-z]+', '-', 'g'), 1, {SLUG_LENGTH}), '^-+|-+$', '', 'g') AS s FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
items AS (SELECT concat('/kb/', source, '/', doc_id // 800) AS kb_path, doc_id, concat(substr('DLRA', (doc_id // 20 % 4 + 1)::INTEGER, 1), '-', lpad(((doc_id // 80) % 999 + 1)::VARCHAR, 3, '0')) AS item_id,
  ['decision', 'learning', 'reusable', 'anti-pattern'][doc_id // 20 % 4 + 1] AS category, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, 'T' AS title, text AS summary, list_filter([{_TAG_LIST}], lambda x: x IS NOT NULL)[1:5] AS tags,
  [concat('src/f', doc_id % 37, '.py'), concat('lib/g', doc_id % 11, '.py')] AS paths, CASE doc_id % 13 WHEN 5 THEN 'deprecated' WHEN 7 THEN 'superseded-by:D-001' WHEN 9 THEN 'archived' ELSE 'active' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'universal' ELSE 'unverified' END AS universality, CASE WHEN doc_id // 20 % 4 <> 3 THEN NULL WHEN (doc_id // 80 % 999 + 1) % 2 = 0 THEN 'critical' ELSE 'normal' END AS severity, '2023-01-01T00:00:00+00:00' AS created,
  concat(CASE WHEN doc_id % 2 = 0 THEN '2023' ELSE '2024' END, '-03-', lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'), 'T00:00:00+00:00') AS updated, CASE WHEN doc_id % 13 = 9 THEN 'archive' ELSE 'active' END AS location, text AS body FROM raw_items)
"""


def candidates(items_: DataFrame) -> DataFrame:
    """Every item again as a candidate, for its own KB."""
    return items_.select(F.col("doc_id").alias("candidate_id"), "kb_path", "category", F.concat("slug", F.lit("x")).alias("title_slug"), "tags", "paths")


CANDIDATES = "candidates AS (SELECT doc_id AS candidate_id, kb_path, category, concat(slug, 'x') AS title_slug, tags, paths FROM items)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcript files, some of them without a directory."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_stem"), F.concat(F.lit("/t/"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("doc_id") * 1000).alias("modification_ms"), F.sha2("text", 256).alias("transcript_sha256"), F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit("/kb/"), "source", F.lit("/d"))).alias("cwd"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")).alias("first_seen_at"),
    )


def ledger(found: DataFrame) -> DataFrame:
    """A third of the sessions as recorded; of these some by another hash, some with an unknown time."""
    n = F.col("modification_ms") / 1000
    return found.where(n % 3 == 0).select(
        F.regexp_replace(F.coalesce("cwd", F.lit("/kb/none/d")), "/d$", "").alias("kb_path"), "session_id", F.when(n % 5 == 0, F.sha2("transcript_sha256", 256)).otherwise(F.col("transcript_sha256")).alias("transcript_sha256"),
        F.when(n % 6 == 0, 0).otherwise(F.col("modification_ms") + F.when(n % 9 == 0, 0).otherwise(1)).alias("transcript_mtime_ms"), F.lit("2024-01-01T00:00:00+00:00").alias("first_seen_at"), F.lit("2024-01-01T00:00:00+00:00").alias("last_seen_at"),
        F.when(n % 4 == 0, "skipped").otherwise("processed").alias("status"), F.when(n % 4 == 0, "trivial").alias("skipped_reason"), F.lit(1).alias("extracted_count"), F.array().cast("array<struct<kb:string,actions:array<string>>>").alias("kb_actions"), F.lit(None).cast("string").alias("failure_reason"),
    )


def session_registry(found: DataFrame) -> DataFrame:
    dirs = found.where("cwd IS NOT NULL").select(F.regexp_replace("cwd", "/d$", "").alias("kb_dir")).distinct().where("kb_dir NOT LIKE '%7'")
    return dirs.select(F.col("kb_dir").alias("kb_path"), "kb_dir")


SESSIONS = """
sessions AS (SELECT doc_id AS n, concat('s', doc_id) AS session_id, concat('/t/', doc_id) AS path, doc_id * 1000 AS modification_ms, sha256(text) AS transcript_sha256, CASE WHEN doc_id % 17 <> 0 THEN concat('/kb/', source, '/d') END AS cwd, concat('2024-01-', lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'), 'T00:00:00+00:00') AS first_seen_at FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ledger AS (SELECT regexp_replace(coalesce(cwd, '/kb/none/d'), '/d$', '') AS kb_path, session_id, CASE WHEN n % 5 = 0 THEN sha256(transcript_sha256) ELSE transcript_sha256 END AS transcript_sha256, CASE WHEN n % 6 = 0 THEN 0 WHEN n % 9 = 0 THEN modification_ms ELSE modification_ms + 1 END AS transcript_mtime_ms,
  '2024-01-01T00:00:00+00:00' AS first_seen_at, '2024-01-01T00:00:00+00:00' AS last_seen_at, CASE WHEN n % 4 = 0 THEN 'skipped' ELSE 'processed' END AS status FROM sessions WHERE n % 3 = 0)
"""
