"""Ledgers, items, summaries and indexes as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.text import CATEGORIES, category_dir, category_of_letter, slug_of_file
from sessionmill.functions.yaml import YamlError, read_yaml
from sessionmill.operators.items import item_error
from sessionmill.sources.files import whole_files

SESSION = "session_id string, transcript_sha256 string, transcript_mtime_ms bigint, first_seen_at string, last_seen_at string, status string, skipped_reason string, extracted_count int, kb_actions array<struct<kb:string,actions:array<string>>>, failure_reason string"
LEDGER = f"schema_version int, last_run string, sessions array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in SESSION.split(', '))}>>, _corrupt_record string"
FIELDS = ("id", "type", "title", "summary", "status", "universality", "created", "updated", "severity", "archived_at", "archive_reason")
LISTS = ("tags", "paths", "related")


def read_ledgers(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ledger files of version 1 (without times: 0) and 2, and the files that are neither: (ledger, rejects)."""
    files = spark.read.schema(LEDGER).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths).withColumn("path", F.col("_metadata.file_path"))
    good = F.col("_corrupt_record").isNull() & F.col("schema_version").isin(1, 2)
    rows = files.where(good).select(F.regexp_extract("path", r"^(?:file:(?://)?)?(.*)/[^/]+$", 1).alias("kb_path"), F.explode("sessions").alias("s")).select("kb_path", "s.*")
    rejects = files.where(~F.coalesce(good, F.lit(False))).select("path", F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("unknown_version").alias("reason"))
    return rows.withColumn("transcript_mtime_ms", F.coalesce("transcript_mtime_ms", F.lit(0))), rejects


def write_ledger(ledger: DataFrame, path: str, buckets: int = 16) -> None:
    """A new snapshot, dealt by KB."""
    bucket = F.pmod(F.xxhash64("kb_path"), F.lit(buckets)).cast("int")
    ledger.withColumn("kb_bucket", bucket).repartition("kb_bucket").write.mode("overwrite").partitionBy("kb_bucket").parquet(path)


def ledger_json(ledger: DataFrame, now: str) -> DataFrame:
    """kb_path, content: each KB's ledger as a version 2 document."""
    row = F.struct(*[c for c in ledger.columns if c != "kb_path"])
    document = F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit(now).alias("last_run"), F.array_sort(F.collect_list(F.struct("first_seen_at", "session_id", "transcript_sha256", row.alias("row")))).getField("row").alias("sessions")))
    return ledger.groupBy("kb_path").agg(document.alias("content"))


OPTIONAL = ("related", "severity", "archived_at", "archive_reason")
FRONT = ", ".join(["path string", *[f"{n} string" for n in FIELDS], *[f"{n} array<string>" for n in LISTS], "error string"])


def front_fields(front: str) -> dict:
    """The fields of a front matter, and error: yaml if it is none, mapping if it is no mapping, else the first optional field that is there but no text (or no list of texts)."""
    try:
        found = read_yaml(front)
    except YamlError:
        return {"error": "yaml"}
    if not isinstance(found, dict):
        return {"error": "mapping"}
    is_list = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    out = {n: found[n] for n in FIELDS if isinstance(found.get(n), str)} | {n: found[n] for n in LISTS if is_list(found.get(n))}
    return out | {"error": next((n for n in OPTIONAL if n in found and (n not in out or out[n] == "")), None)}


def _front_matter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", *FIELDS, *LISTS, "error"]
    for batch in batches:
        rows = [front_fields(f) for f in batch["front"].to_pylist()]
        columns = [pa.array([r.get(n) for r in rows], pa.list_(pa.string()) if n in LISTS else pa.string()) for n in names[1:]]
        kept = ["folder", "file_name", "framed", "body"]
        yield pa.RecordBatch.from_arrays([batch["path"], *columns, *[batch[n] for n in kept]], names=[*names, *kept])


def read_items(kbs: DataFrame) -> DataFrame:
    """The item files of ``kbs(kb_path)``, in their category folders and the archive: an item row each, whether valid or not.

    Columns are those of the item operators, with related, file_name and parse_error:
    frontmatter (no block), yaml, mapping, the first field that is missing or not as it
    should be, or directory (of another category). Only the front matter goes through
    the parser, as YAML 1.2: dates stay text, and numbers and booleans are no text.
    """
    folders = [*(c[1] for c in CATEGORIES), ".archive"]
    spread = kbs.select(F.explode(F.array(*[F.concat(F.regexp_replace("kb_path", "/+$", ""), F.lit(f"/{f}")) for f in folders])).alias("folder"))
    files = whole_files(spread, r"[DLRA]-[0-9]{3}-.*\.md").select(F.concat_ws("/", "folder", "file_name").alias("path"), "folder", "file_name", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    whole = r"(?s)\A---\n((?:.*?\n)??)---(?:\n\n?|\z)(.*)\z"
    framed = files.select("path", "folder", "file_name", F.col("text").rlike(whole).alias("framed"), F.regexp_replace(F.regexp_extract("text", whole, 1), r"\n\z", "").alias("front"), F.regexp_extract("text", whole, 2).alias("body"))
    out = framed.mapInArrow(_front_matter, f"{FRONT}, folder string, file_name string, framed boolean, body string")
    out = out.withColumns({"kb_path": F.regexp_extract("folder", r"^(.*)/[^/]+$", 1), "folder": F.regexp_extract("folder", r"([^/]+)$", 1)})
    category = F.when(F.col("folder") == ".archive", F.coalesce("type", category_of_letter(F.left("file_name", F.lit(1))))).otherwise(F.col("type"))
    out = out.select(
        "kb_path", F.col("id").alias("item_id"), category.alias("category"), slug_of_file(F.col("file_name"), F.col("id")).alias("slug"), "title", "summary", "tags", "paths", "status", "universality", "severity", "created", "updated", "archived_at", "archive_reason",
        F.when(F.col("folder") == ".archive", "archive").otherwise("active").alias("location"), "body", "related", "file_name", "framed", "folder", "type", "error",
    )
    early = F.when(~F.col("framed"), "frontmatter").when(F.col("error").isin("yaml", "mapping"), F.col("error"))
    late = F.when((F.col("folder") != ".archive") & (F.col("folder") != category_dir(F.col("type"))), "directory")
    return out.withColumn("parse_error", F.coalesce(early, item_error(), "error", late)).drop("framed", "folder", "type", "error")


def rendered_items(items: DataFrame) -> DataFrame:
    """kb_path, file_name, content: items as Markdown with front matter in a fixed order of keys."""

    def line(name: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))

    def flow(name: str) -> Column:
        return F.concat(F.lit(f"{name}: ["), F.array_join(F.transform(name, lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)), ", "), F.lit("]"))

    def quoted(name: str) -> Column:
        text = F.to_json(F.array(name))
        return F.when(F.col(name).isNotNull(), text.substr(F.lit(2), F.length(text) - 2))

    parts = [line("id", F.col("item_id")), line("type", F.col("category")), line("title", quoted("title")), line("summary", quoted("summary")), flow("tags"), flow("paths"), line("status", quoted("status")), line("universality", F.col("universality"))]
    parts += [line("created", quoted("created")), line("updated", quoted("updated"))] + ([F.when(F.col("related").isNotNull(), flow("related"))] if "related" in items.columns else [])
    parts += [line("severity", F.col("severity")), line("archived_at", quoted("archived_at")), line("archive_reason", quoted("archive_reason"))]
    # a body ends with a line feed, and an empty one leaves no blank line
    body = F.when(F.col("body") == "", "").when(F.endswith("body", F.lit("\n")), F.concat(F.lit("\n"), "body")).otherwise(F.concat(F.lit("\n"), "body", F.lit("\n")))
    content = F.concat(F.lit("---\n"), F.concat_ws("\n", *parts), F.lit("\n---\n"), body)
    folder = F.when(F.col("location") == "archive", ".archive").otherwise(category_dir(F.col("category")))
    return items.select("kb_path", F.concat(folder, F.lit("/"), "item_id", F.lit("-"), "slug", F.lit(".md")).alias("file_name"), content.alias("content"))


def summaries(files: DataFrame, indexed: DataFrame, siblings: DataFrame, computed: DataFrame) -> DataFrame:
    """path, session_stem, summary, origin: from an index file, else from a sibling, else computed.

    ``indexed(session_stem, summary)``, ``siblings(session_stem, summary)``, ``computed(session_stem, summary)``.
    """
    out = files.select("path", "session_stem")
    for name, table in (("index", indexed), ("sibling", siblings), ("computed", computed)):
        out = out.join(table.groupBy("session_stem").agg(F.min("summary").alias(name)), "session_stem", "left")
    origin = F.when(F.col("index").isNotNull(), "index").when(F.col("sibling").isNotNull(), "sibling").when(F.col("computed").isNotNull(), "computed")
    return out.select("path", "session_stem", F.coalesce("index", "sibling", "computed").alias("summary"), origin.alias("origin"))


def index_summaries(contents: DataFrame) -> DataFrame:
    """session_stem, summary from ``contents(content)`` of index files: a list under sessions, a list under entries, or an object by id."""
    v = contents.select(F.try_parse_json("content").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.sessions", "array<variant>"), F.try_variant_get("v", "$.entries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = v.select(F.explode(listed).alias("e")).select(F.coalesce(F.try_variant_get("e", "$.sessionId", "string"), F.try_variant_get("e", "$.id", "string")).alias("session_stem"), F.try_variant_get("e", "$.summary", "string").alias("summary"))
    named = v.where(listed.isNull()).select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("session_stem", "e")).select("session_stem", F.coalesce(F.try_variant_get("e", "$.summary", "string"), F.try_variant_get("e", "$", "string")).alias("summary"))
    return rows.union(named).where("session_stem IS NOT NULL AND summary IS NOT NULL")


def write_indexes(documents: DataFrame, path: str, buckets: int = 16) -> None:
    bucket = F.pmod(F.xxhash64("kb_path"), F.lit(buckets)).cast("int")
    documents.withColumn("kb_bucket", bucket).repartition("kb_bucket").write.mode("overwrite").partitionBy("kb_bucket").parquet(path)
