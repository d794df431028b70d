"""State of each KB and the index document that is published for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.functions.text import CATEGORIES, category_dir, cell, one_line, short_date, status_kind
from sessionmill.operators.similarity import CAP

# Section headings of the index document.
SECTIONS = {"decision": "## 🧠 Decisions", "learning": "## 💡 Learnings", "reusable": "## ♻️ Reusable", "anti-pattern": "## ⚠️ Anti-patterns"}
CRITICAL = "## 🚨 Critical Anti-patterns"


@dataclass(frozen=True)
class Wording:
    """The document's free lines, for readers who expect others."""

    title: str = "# Knowledge Index — "
    intro: tuple[str, ...] = ("> Skim this index before starting; read only items whose topic or paths match.", "> Without a match, go on.")
    critical: str = "> Items of critical severity only. Never repeat these."
    counts: str = "(deprecated, superseded and archived items are counted only)"


MOST_CRITICAL = 5


def kb_state(items: DataFrame) -> DataFrame:
    """Counts of each KB: active of each category, which are full, archived, superseded, unverified, last_modified."""
    live = (F.col("status") == "active") & (F.col("location") == "active")
    named = [(c, d.replace("-", "_")) for c, d, _ in CATEGORIES]
    state = items.groupBy("kb_path").agg(
        *[F.count_if(live & (F.col("category") == c)).alias(f"active_{n}") for c, n in named],
        F.count_if((F.col("status") == "archived") & (F.col("location") == "active")).alias("archived"),
        F.count_if(F.col("status").startswith("superseded-by")).alias("superseded"),
        F.count_if(live & (F.col("universality") == "unverified")).alias("unverified"),
        F.max("updated").alias("last_modified"),
    )
    return state.withColumn("full_categories", F.array_compact(F.array(*[F.when(F.col(f"active_{n}") >= CAP, c) for c, n in named])))


def corrupt_kbs(files: DataFrame) -> DataFrame:
    """KBs all of whose item files failed: ``files(kb_path, error_field)`` to kb_path, files."""
    sums = files.groupBy("kb_path").agg(F.count("*").alias("files"), F.count("error_field").alias("failed"))
    return sums.where("files > 0 AND files = failed").select("kb_path", "files")


def ranked(items: DataFrame) -> DataFrame:
    """Active items with ``rank`` in their KB and category: newest first, as text, then by id."""
    order = Window.partitionBy("kb_path", "category").orderBy(F.desc("updated"), "item_id")
    return items.where("status = 'active' AND location = 'active'").withColumn("rank", F.row_number().over(order))


def top_critical(items: DataFrame, most: int = MOST_CRITICAL) -> DataFrame:
    """The newest critical anti-patterns of each KB."""
    return ranked(items.where("category = 'anti-pattern' AND severity = 'critical'")).where(F.col("rank") <= most)


def status_counts(registry: DataFrame, items: DataFrame) -> DataFrame:
    """active, deprecated, superseded (of those in category directories) and archived (in the archive) of every KB, those without items too."""
    kept = F.col("location") == "active"
    kinds = status_kind(F.col("status"))
    sums = items.groupBy("kb_path").agg(
        *[F.count_if(kept & (F.col("status") == "active") & (F.col("category") == c)).alias(f"n_{i}") for i, (c, _, _) in enumerate(CATEGORIES)],
        F.count_if(kept & (kinds == "deprecated")).alias("deprecated"),
        F.count_if(kept & kinds.startswith("superseded-by")).alias("superseded"),
        F.count_if(F.col("location") == "archive").alias("archived"),
    )
    names = [*[f"n_{i}" for i in range(len(CATEGORIES))], "deprecated", "superseded", "archived"]
    out = registry.select("kb_path").distinct().join(sums, "kb_path", "left").select("kb_path", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("active", sum((F.col(f"n_{i}") for i in range(1, len(CATEGORIES))), F.col("n_0")))


def _row(now: Column) -> Column:
    cells = [cell(F.col("item_id")), cell(F.col("slug")), cell(one_line(F.col("summary")))]
    severity = F.when(F.col("category") == "anti-pattern", F.concat(F.lit(" | "), cell(F.coalesce("severity", F.lit("normal"))))).otherwise("")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), severity, F.lit(" | "), cell(short_date(F.col("updated"), now)), F.lit(" |"))


def _bullet() -> Column:
    name = F.when(F.col("slug") != "", F.concat_ws(" ", "item_id", "slug")).otherwise(F.col("item_id"))
    link = F.concat(category_dir(F.col("category")), F.lit("/"), F.col("item_id"), F.lit("-"), F.col("slug"), F.lit(".md"))
    paths = F.when(F.size("paths") > 0, F.concat(F.lit(" (`"), F.array_join(F.slice("paths", 1, 2), ", "), F.lit("`)"))).otherwise("")
    return F.concat(F.lit("- **["), name, F.lit("]("), link, F.lit(")** — "), one_line(F.col("summary")), paths)


def index_documents(registry: DataFrame, items: DataFrame, now: str, wording: Wording = Wording()) -> DataFrame:  # noqa: B008
    """kb_path, content, line_count: the index of every KB of ``registry(kb_path, name)``, which holds at most CAP rows a category."""
    at = F.lit(now)
    # lines, not whole items, are sorted and sent
    keys = ["kb_path", "category", "item_id", "status", "location", "severity", "updated"]
    rows, marks = (items.select(*keys, line.alias("line")) for line in (_row(at), _bullet()))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    lists = ranked(rows).groupBy("kb_path", "category").agg(in_order.alias("lines"))
    tables = lists.groupBy("kb_path").agg(*[F.first(F.when(F.col("category") == c, F.col("lines")), ignorenulls=True).alias(f"table_{i}") for i, (c, _, _) in enumerate(CATEGORIES)])
    bullets = top_critical(marks).groupBy("kb_path").agg(in_order.alias("critical"))
    kb = status_counts(registry, items).join(registry.select("kb_path", "name"), "kb_path").join(tables, "kb_path", "left").join(bullets, "kb_path", "left")

    def text(*parts) -> Column:
        return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))

    none = F.array().cast("array<string>")
    front = [text("---"), text("generated_at: ", at), text("schema_version: 1"), text("kb_path: ", F.col("kb_path")), text("total_items: ", F.col("active")), text("counts:")]
    front += [text(f"  {d}: ", F.col(f"n_{i}")) for i, (_, d, _) in enumerate(CATEGORIES)]
    lines = [*front, text("---"), text(""), text(wording.title, F.col("name")), text(""), *[text(x) for x in wording.intro], text("")]
    lines += [text(CRITICAL), text(""), text(wording.critical), text(""), F.coalesce("critical", text("_(none)_")), text("")]
    for i, (c, _, _) in enumerate(CATEGORIES):
        head = ("| ID | Title | Summary | Severity | Updated |", "|---|---|---|---|---|") if c == "anti-pattern" else ("| ID | Title | Summary | Updated |", "|---|---|---|---|")
        lines += [text(SECTIONS[c]), text(""), text(head[0]), text(head[1]), F.coalesce(f"table_{i}", none), text("")]
    lines += [text("---"), text(""), text("## Status Summary"), text("")]
    lines += [text(f"- {n.capitalize()}: ", F.col(n), " items") for n in ("active", "deprecated", "superseded", "archived")]
    lines += [text(""), text(wording.counts)]
    whole = kb.withColumn("lines", F.concat(*lines))
    return whole.select("kb_path", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("content"), F.size("lines").alias("line_count"))
