"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.functions.paths import relative, resolved
from sessionmill.functions.text import decided_language, iso_of_millis, js_len, status_kind, superseded_id, tokens
from sessionmill.operators import candidates as cand
from sessionmill.operators import compress, index, items, ledger, moves, profile, regions, similarity, telemetry
from sessionmill.plans import adapters as A
from sessionmill.functions.tables import Steps
from sessionmill.sources import files, stores, transcripts
from sessionmill.sources.ledgers import LedgerStore
from sessionmill.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {A.BLOCKS},
cwds AS (SELECT session_id, cwd, count(DISTINCT seq) AS n, min(seq) AS first FROM blocks GROUP BY session_id, cwd),
best AS (SELECT session_id, arg_max(cwd, n * 1000000000 - first) AS cwd, count(*) AS n_cwds, string_agg(cwd, ',' ORDER BY first, cwd) AS cwds_seen FROM cwds GROUP BY session_id),
sizes AS (SELECT session_id, count(DISTINCT seq) AS message_count, count(DISTINCT CASE WHEN role = 'user' AND kind = 'text' AND text <> '' THEN seq END) AS user_turns,
  round(sum(length(coalesce(CASE WHEN kind = 'tool_use' THEN input_json ELSE text END, ''))) / 3.5)::BIGINT AS tokens, bool_or(is_error) AS has_errors, count(*) FILTER (tool_name = 'Read') AS tools_read, 0::BIGINT AS tools_write, count(*) FILTER (tool_name = 'Edit') AS tools_edit,
  count(*) FILTER (tool_name = 'Bash') AS tools_bash, 0::BIGINT AS tools_other, count(*) FILTER (kind = 'tool_use') AS uses, sum(CASE WHEN kind = 'text' THEN len(regexp_extract_all(text, '[가-힣]')) ELSE 0 END) AS hangul, sum(CASE WHEN kind = 'text' THEN len(regexp_extract_all(text, '[A-Za-z]')) ELSE 0 END) AS letters FROM blocks GROUP BY session_id)
SELECT session_id, message_count, user_turns, tokens, has_errors, tools_read, tools_write, tools_edit, tools_bash, tools_other, CASE WHEN hangul + letters = 0 THEN 'mixed' WHEN 2 * hangul >= hangul + letters THEN 'ko' ELSE 'en' END AS language,
  CASE WHEN user_turns < 3 THEN 'few-user-turns' WHEN uses = 0 THEN 'no-tools' WHEN uses = tools_read THEN 'read-only' END AS skip_reason, cwd, n_cwds, cwds_seen, n_cwds > 1 AS is_multi_cwd FROM sizes JOIN best USING (session_id)""")
def session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P8, A1-A3, F1, F2."""
    return profile.session_profile(A.blocks(spark, sf_dir)).withColumn("cwds_seen", F.array_join("cwds_seen", ","))


@query(f"""WITH {A.BLOCKS}, used AS (SELECT session_id, seq, tool_name, regexp_extract(input_json, ':"(.*)"', 1) AS path FROM blocks WHERE kind = 'tool_use'),
p AS (SELECT session_id, path, min(seq) AS first FROM used GROUP BY session_id, path), t AS (SELECT session_id, tool_name, min(seq) AS first FROM used GROUP BY session_id, tool_name)
SELECT session_id, (SELECT string_agg(path, ',' ORDER BY first) FROM p WHERE p.session_id = u.session_id) AS paths, (SELECT string_agg(tool_name, ',' ORDER BY first) FROM t WHERE t.session_id = u.session_id) AS tools FROM (SELECT DISTINCT session_id FROM used) u""")
def touched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    return profile.touched(A.blocks(spark, sf_dir)).select("session_id", F.array_join("paths", ",").alias("paths"), F.array_join("tools", ",").alias("tools"))


@query(f"""WITH {A.BLOCKS}, asked AS (SELECT session_id, arg_min(text, seq) AS prompt, min(seq) AS first FROM blocks WHERE role = 'user' AND kind = 'text' AND text <> '' GROUP BY session_id),
tools AS (SELECT session_id, string_agg(tool_name, ', ' ORDER BY first) AS tools FROM (SELECT session_id, tool_name, min(seq) AS first FROM blocks WHERE kind = 'tool_use' GROUP BY session_id, tool_name) GROUP BY session_id),
members AS (SELECT DISTINCT session_id, seq FROM blocks WHERE kind = 'tool_use' UNION SELECT session_id, first FROM asked)
SELECT s.session_id, concat(coalesce(prompt, '(no user prompt)'), chr(10), coalesce('Tools used: ' || tools, '(no tools)')) AS content, (SELECT count(*) FROM members m WHERE m.session_id = s.session_id) AS message_count_after
FROM (SELECT DISTINCT session_id FROM blocks) s LEFT JOIN asked USING (session_id) LEFT JOIN tools USING (session_id)""")
def summary_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, F9 (summary), W7."""
    return compress.summary(A.blocks(spark, sf_dir))


TARGET = 250


@query(f"""WITH {A.BLOCKS},
m AS (SELECT session_id, seq, role, concat('=== ', role, ' ', left(uuid, 8), ' @ (no-ts)', CASE WHEN is_sidechain THEN ' sidechain' ELSE '' END, ' ===') AS h,
  CASE kind WHEN 'text' THEN text WHEN 'tool_use' THEN concat('[Tool: ', tool_name, '] ', input_json) ELSE concat('[Result error] ', text) END AS whole,
  CASE kind WHEN 'tool_use' THEN concat('[Tool: ', tool_name, '] keys=[file_path]') WHEN 'tool_result' THEN concat('[Result error] ', CASE WHEN length(text) > 200 THEN concat(left(text, 200), ' ... [+', length(text) - 200, ' chars]') ELSE text END)
    ELSE CASE WHEN role = 'assistant' AND length(text) > 800 THEN concat(left(text, 400), ' ... [truncated ', length(text) - 600, ' chars] ... ', right(text, 200)) ELSE text END END AS one,
  CASE kind WHEN 'tool_use' THEN concat('[Tool: ', tool_name, '] keys=[file_path]') WHEN 'tool_result' THEN concat('[Result error] ', CASE WHEN length(text) > 200 THEN concat(left(text, 200), ' ... [+', length(text) - 200, ' chars]') ELSE text END)
    ELSE CASE WHEN role = 'assistant' AND length(text) > 200 THEN concat(left(text, 200), ' ... [truncated ', length(text) - 200, ' chars]') ELSE text END END AS two FROM blocks),
w AS (SELECT *, length(h) + length(whole) + 2 AS ww, length(h) + length(one) + 2 AS w1, length(h) + length(two) + 2 AS w2 FROM m),
t AS (SELECT *, sum(ww) OVER s - 1 AS tw, sum(w1) OVER s - 1 AS t1, sum(w2) OVER s - 1 AS t2, coalesce(sum(CASE WHEN role = 'assistant' THEN w2 END) OVER s, 0) AS every,
  coalesce(sum(CASE WHEN role = 'assistant' THEN w2 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM w WINDOW s AS (PARTITION BY session_id)),
p AS (SELECT *, CASE WHEN round(tw / 3.5) <= {TARGET} THEN 0 WHEN round(t1 / 3.5) <= {TARGET} THEN 1 WHEN round(t2 / 3.5) <= {TARGET} THEN 2 WHEN round(greatest(t2 - every, 0) / 3.5) <= {TARGET} THEN 3 ELSE 4 END AS pass FROM t),
k AS (SELECT *, CASE WHEN pass IN (1, 2) OR pass = 3 AND (role <> 'assistant' OR round(greatest(t2 - older, 0) / 3.5) <= {TARGET}) THEN concat(h, chr(10), CASE WHEN pass = 1 THEN one ELSE two END) END AS told FROM p),
g AS (SELECT session_id, pass, count(told) AS n, coalesce(string_agg(told, chr(10) ORDER BY seq), '') AS content FROM k GROUP BY session_id, pass)
SELECT session_id, CASE pass WHEN 0 THEN 'fits_already' WHEN 4 THEN 'compression_infeasible' ELSE 'ok' END AS outcome, pass, CASE WHEN pass BETWEEN 1 AND 3 THEN n END AS message_count_after, CASE WHEN pass BETWEEN 1 AND 3 THEN round(length(content) / 3.5)::BIGINT END AS estimated_tokens, CASE WHEN pass BETWEEN 1 AND 3 THEN content END AS content FROM g""")
def compressed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4-F9, W1."""
    return compress.compressed(A.blocks(spark, sf_dir), TARGET)


@query(f"""WITH {A.PATHS}, parts AS (SELECT DISTINCT path AS cwd, string_split(path, '/') AS s FROM paths), up AS (SELECT cwd, len(s) - k AS steps, array_to_string(s[1:k], '/') AS dir FROM parts, unnest(range(2, len(s) + 1)) AS r(k)),
stop AS (SELECT cwd, min(steps) AS last FROM up JOIN boundaries USING (dir) GROUP BY cwd),
chain AS (SELECT up.cwd, kb_path, kb_dir, 1 AS part, steps FROM up LEFT JOIN stop USING (cwd) JOIN registry ON kb_dir = dir WHERE last IS NULL OR steps <= last
  UNION ALL SELECT cwd, kb_path, kb_dir, 0, 0 FROM parts JOIN registry ON starts_with(kb_dir, cwd || '/')),
placed AS (SELECT *, row_number() OVER (PARTITION BY cwd ORDER BY part, steps, kb_dir) - 1 AS position FROM chain)
SELECT cwd, position::INTEGER AS position, kb_path, position = max(position) OVER (PARTITION BY cwd) AS is_root, len(string_split(kb_dir, '/')) - 1 AS depth,
  CASE WHEN part = 0 THEN substr(kb_dir, length(cwd) + 2) WHEN steps = 0 THEN '.' ELSE rtrim(repeat('../', steps::INTEGER), '/') END AS relative_to_cwd FROM placed""")
def kb_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, T5, U1."""
    paths = A.page_paths(spark, sf_dir)
    return regions.chains(paths.select(F.col("path").alias("cwd")), A.registry(paths), A.boundaries(paths))


@query(f"""WITH {A.PATHS}, p AS (SELECT DISTINCT path FROM paths) SELECT path, (SELECT arg_max(kb_path, length(kb_dir)) FROM registry WHERE path = kb_dir OR starts_with(path, kb_dir || '/')) AS kb_path, (SELECT arg_max(kb_dir, length(kb_dir)) FROM registry WHERE path = kb_dir OR starts_with(path, kb_dir || '/')) AS kb_dir FROM p""")
def path_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, P7."""
    paths = A.page_paths(spark, sf_dir)
    return regions.owners(paths, A.registry(paths))


@query(f"""WITH {A.PATHS}, o AS (SELECT page_id % 90 AS item_key, (SELECT arg_max(kb_path, length(kb_dir)) FROM registry WHERE path = kb_dir OR starts_with(path, kb_dir || '/')) AS kb_path FROM paths)
SELECT item_key, CASE WHEN count(DISTINCT kb_path) = 1 THEN min(kb_path) END AS kb_path FROM o GROUP BY item_key""")
def item_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    paths = A.page_paths(spark, sf_dir)
    return regions.routes(paths.select((F.col("page_id") % 90).alias("item_key"), "path"), A.registry(paths))


@query(f"""WITH {A.PATHS} SELECT r.kb_path, coalesce('**,' || (SELECT string_agg('!' || substr(c.kb_dir, length(r.kb_dir) + 2) || '/**', ',' ORDER BY '!' || substr(c.kb_dir, length(r.kb_dir) + 2) || '/**') FROM registry c WHERE starts_with(c.kb_dir, r.kb_dir || '/')), '**') AS globs FROM registry r""")
def region_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5."""
    return regions.region_globs(A.registry(A.page_paths(spark, sf_dir))).select("kb_path", F.array_join("globs", ",").alias("globs"))


@query(f"""WITH {A.PATHS} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN path ELSE concat(regexp_extract(path, '^/[^/]+'), '/x') END AS absolute, CASE WHEN page_id % 4 = 0 THEN CASE WHEN path = regexp_extract(path, '^/[^/]+') THEN '.' ELSE substr(path, length(regexp_extract(path, '^/[^/]+')) + 2) END ELSE 'x' END AS relative,
  concat('../', ltrim(path, '/')) AS from_sibling FROM paths""")
def normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, U3."""
    paths = A.page_paths(spark, sf_dir).withColumn("host", F.regexp_extract("path", "^/[^/]+", 0))
    given = F.when(F.col("page_id") % 4 == 0, F.col("path")).when(F.col("page_id") % 4 == 1, "./x").when(F.col("page_id") % 4 == 2, "a/../x").otherwise("b/./c/../../x")
    absolute = resolved(F.col("host"), given)
    return paths.select("page_id", absolute.alias("absolute"), relative(F.col("host"), absolute).alias("relative"), relative(F.lit("/elsewhere"), F.col("path")).alias("from_sibling"))


_FOUND = f"""{A.SESSIONS}, found AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = s.session_id AND l.transcript_mtime_ms = s.modification_ms AND l.transcript_mtime_ms <> 0) THEN 'already' WHEN cwd IS NULL THEN 'unparseable' WHEN cwd LIKE '/kb/src1%' THEN 'out_of_scope' WHEN cwd LIKE '%7/d' THEN 'no_kb'
  WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = s.session_id AND l.transcript_sha256 = s.transcript_sha256 AND l.kb_path = regexp_replace(s.cwd, '/d$', '')) THEN 'already' WHEN first_seen_at < '2024-01-05T00:00:00+00:00' THEN 'before_since' ELSE 'collectible' END AS outcome FROM sessions s)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.sessions(spark, sf_dir)
    cwds = found.where("cwd IS NOT NULL").select("cwd").distinct()
    roots = cwds.where("cwd NOT LIKE '/kb/src1%'").select(F.regexp_replace("cwd", "/d$", "").alias("root"))
    none = cwds.select(F.col("cwd").alias("dir")).where("false")
    chain = regions.chain_up(cwds, A.session_registry(found), none)
    return ledger.outcomes(found, chain, A.ledger(found), regions.in_scope(cwds, roots), since="2024-01-05T00:00:00+00:00")


@query(f"WITH {_FOUND} SELECT session_id, outcome FROM found")
def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2, P5, P6, U4."""
    return _outcomes(spark, sf_dir).select("session_id", "outcome")


@query(f"WITH {_FOUND} SELECT outcome, count(*) AS sessions FROM found WHERE outcome NOT IN ('unparseable', 'before_since') GROUP BY outcome")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return ledger.counters(_outcomes(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT session_id, first_seen_at, path FROM found WHERE outcome = 'collectible' ORDER BY first_seen_at DESC, path LIMIT 20")
def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return ledger.newest(_outcomes(spark, sf_dir)).select("session_id", "first_seen_at", "path")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.sessions(spark, sf_dir)
    refused = F.col("modification_ms") % 2000 != 0
    kb = F.regexp_replace(F.coalesce("cwd", F.lit("/kb/none/d")), "/d$", "")
    actions = F.array(F.struct(kb.alias("kb"), F.array(F.lit("create")).alias("actions")))
    return found.select("session_id", "transcript_sha256", F.col("modification_ms").alias("transcript_mtime_ms"), F.when(refused, "skipped").otherwise("processed").alias("status"), F.lit(None).cast("string").alias("skipped_reason"), F.lit(None).cast("string").alias("failure_reason"), F.array(kb, F.lit("/kb/root")).alias("affected_kbs"), actions.alias("kb_actions"), F.lit(2).alias("extracted_count"), F.lit(0).alias("stamp_order"))


_MARKS = f"""{A.SESSIONS}, marks AS (SELECT session_id, transcript_sha256, modification_ms, regexp_replace(coalesce(cwd, '/kb/none/d'), '/d$', '') AS own FROM sessions WHERE n % 2 = 0),
stamps AS (SELECT own AS kb_path, session_id, transcript_sha256, modification_ms, 1 AS actions FROM marks UNION ALL SELECT '/kb/root', session_id, transcript_sha256, modification_ms, 0 FROM marks)"""


@query(f"""WITH {_MARKS} SELECT kb_path, session_id, transcript_sha256, coalesce(s.modification_ms, l.transcript_mtime_ms) AS transcript_mtime_ms, CASE WHEN s.session_id IS NOT NULL THEN 'processed' ELSE l.status END AS status, CASE WHEN s.session_id IS NOT NULL THEN 2 ELSE 1 END AS extracted_count,
  coalesce(s.actions, 0) AS n_actions, coalesce(l.first_seen_at, '{A.NOW}') AS first_seen_at, CASE WHEN s.session_id IS NOT NULL THEN '{A.NOW}' ELSE l.last_seen_at END AS last_seen_at FROM ledger l FULL JOIN stamps s USING (kb_path, session_id, transcript_sha256)""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, P12, W8."""
    marks = _marks(spark, sf_dir).where(ledger.mark_verdict().isNull())
    next_ = ledger.upserted(A.ledger(A.sessions(spark, sf_dir)), ledger.fanned_out(marks), F.lit(A.NOW))
    return next_.select("kb_path", "session_id", "transcript_sha256", "transcript_mtime_ms", "status", "extracted_count", F.size("kb_actions").alias("n_actions"), "first_seen_at", "last_seen_at")


@query(f"""WITH {A.SESSIONS}, every AS (SELECT kb_path, session_id, status FROM ledger UNION ALL SELECT '/kb/r', session_id, 'failed' FROM ledger WHERE status = 'skipped'), chain AS (SELECT DISTINCT kb_path, length(kb_path) AS position FROM every WHERE kb_path NOT LIKE '%3'),
first AS (SELECT session_id, arg_min(status, (position, kb_path)) AS status, arg_min(kb_path, (position, kb_path)) AS kb_path FROM every JOIN chain USING (kb_path) GROUP BY session_id)
SELECT s.session_id, coalesce(status, 'deferred') AS status, kb_path FROM (SELECT DISTINCT session_id FROM sessions) s LEFT JOIN first USING (session_id)""")
def reconciled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    found = A.sessions(spark, sf_dir)
    own = A.ledger(found)
    every = own.unionByName(own.where("status = 'skipped'").withColumns({"kb_path": F.lit("/kb/r"), "status": F.lit("failed")}))
    chain = every.select("kb_path").distinct().where("kb_path NOT LIKE '%3'").withColumn("position", F.length("kb_path"))
    return ledger.reconciled(found, every, chain)


@query(f"""WITH {A.ITEMS}, {A.CANDIDATES}, x AS (SELECT candidate_id, item_id, len(list_intersect(c.tags, i.tags)) AS tag_overlap, levenshtein(i.slug, title_slug)::DOUBLE / greatest(length(i.slug), length(title_slug)) AS slug_distance, len(list_intersect(c.paths, i.paths)) > 0 AS path_overlap
  FROM candidates c JOIN items i ON i.kb_path = c.kb_path AND i.category = c.category AND i.status = 'active' WHERE len(c.tags) > 0),
y AS (SELECT *, 0.4 * least(tag_overlap / 3.0, 1) + 0.4 * (1 - slug_distance) + CASE WHEN path_overlap THEN 0.2 ELSE 0 END AS score FROM x WHERE tag_overlap >= 2 OR slug_distance <= 0.4 OR path_overlap AND tag_overlap >= 1)
SELECT candidate_id, item_id, tag_overlap, round(slug_distance, 9) AS slug_distance, path_overlap, round(score, 9) AS score, row_number() OVER (PARTITION BY candidate_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM y""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, F11, F12, T4, U2."""
    held = A.items(spark, sf_dir)
    return similarity.similar(A.candidates(held), held).select("candidate_id", "item_id", "tag_overlap", F.round("slug_distance", 9).alias("slug_distance"), "path_overlap", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {A.ITEMS}, u AS (SELECT kb_path, item_id, category, slug, list_sort(list_distinct(tags)) AS tags FROM items WHERE status = 'active' AND universality = 'unverified' AND len(tags) >= 2)
SELECT a.kb_path AS left_kb, a.item_id AS left_id, b.kb_path AS right_kb, b.item_id AS right_id, len(list_intersect(a.tags, b.tags)) AS shared_tags, round(levenshtein(a.slug, b.slug)::DOUBLE / greatest(length(a.slug), length(b.slug)), 9) AS slug_distance
FROM u a JOIN u b ON a.category = b.category AND a.kb_path < b.kb_path AND len(list_intersect(a.tags, b.tags)) >= 2 AND levenshtein(a.slug, b.slug)::DOUBLE / greatest(length(a.slug), length(b.slug)) <= 0.4""")
def promotion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return similarity.promotion_pairs(A.items(spark, sf_dir)).withColumn("slug_distance", F.round("slug_distance", 9))


@query(f"""WITH {A.ITEMS}, p AS (SELECT kb_path, item_id, universality, unnest(paths) AS path FROM items WHERE status = 'active')
SELECT r.item_id AS root_id, c.kb_path, count(*) AS overlaps FROM (SELECT DISTINCT item_id, path FROM p WHERE kb_path = '/kb/src1/0' AND universality = 'universal') r JOIN (SELECT DISTINCT kb_path, item_id, path FROM p WHERE kb_path <> '/kb/src1/0') c USING (path) GROUP BY ALL HAVING count(*) >= 2""")
def demotion_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return similarity.demotion_hints(A.items(spark, sf_dir), "/kb/src1/0")


@query(f"""WITH {A.ITEMS}, {A.CANDIDATES}, n AS (SELECT kb_path, category, count(*) FILTER (status = 'active') AS active FROM items GROUP BY ALL),
x AS (SELECT candidate_id, item_id, len(list_intersect(c.tags, i.tags)) AS t, levenshtein(i.slug, title_slug)::DOUBLE / greatest(length(i.slug), length(title_slug)) AS d, len(list_intersect(c.paths, i.paths)) > 0 AS p FROM candidates c JOIN items i ON i.kb_path = c.kb_path AND i.category = c.category AND i.status = 'active'),
best AS (SELECT candidate_id, arg_min(item_id, (-round(0.4 * least(t / 3.0, 1) + 0.4 * (1 - d) + CASE WHEN p THEN 0.2 ELSE 0 END, 9), item_id)) AS best_match FROM x WHERE t >= 2 OR d <= 0.4 OR p AND t >= 1 GROUP BY candidate_id)
SELECT candidate_id, CASE WHEN best_match IS NOT NULL THEN 'merge' WHEN 10 - coalesce(active, 0) > 0 THEN 'create' ELSE 'needs_eviction' END AS action, best_match FROM candidates LEFT JOIN best USING (candidate_id) LEFT JOIN n USING (kb_path, category) WHERE len(tags) > 0""")
def reconcile_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, A10."""
    held = A.items(spark, sf_dir)
    return similarity.suggestions(A.candidates(held), held)


@query(f"""WITH {A.ITEMS} SELECT kb_path, count(*) FILTER (status = 'active' AND location = 'active' AND category = 'decision') AS active_decisions, count(*) FILTER (status = 'active' AND location = 'active' AND category = 'learning') AS active_learnings, count(*) FILTER (status = 'active' AND location = 'active' AND category = 'reusable') AS active_reusable,
  count(*) FILTER (status = 'active' AND location = 'active' AND category = 'anti-pattern') AS active_anti_patterns, count(*) FILTER (status = 'archived' AND location = 'active') AS archived, count(*) FILTER (status LIKE 'superseded-by%') AS superseded, count(*) FILTER (status = 'active' AND location = 'active' AND universality = 'unverified') AS unverified, max(updated) AS last_modified FROM items GROUP BY kb_path""")
def kb_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, P14."""
    return index.kb_state(A.items(spark, sf_dir)).drop("full_categories")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = A.items(spark, sf_dir)
    return index.index_documents(held.select("kb_path", F.regexp_extract("kb_path", "[^/]+$", 0).alias("name")).distinct(), held, A.NOW)


_LINE = "CASE WHEN length(l) > 60 THEN left(l, 60) || '…' ELSE l END"


@query(f"""WITH {A.ITEMS}, s AS (SELECT *, {_LINE} AS one FROM (SELECT *, trim(regexp_replace(summary, '\\s*\\n\\s*', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS l FROM items)),
r AS (SELECT kb_path, category, row_number() OVER (PARTITION BY kb_path, category ORDER BY updated DESC, item_id) AS rank, concat('| ', item_id, ' | ', slug, ' | ', replace(replace(one, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), CASE WHEN category = 'anti-pattern' THEN ' | ' || severity ELSE '' END, ' | ', CASE WHEN left(updated, 4) = '2024' THEN substr(updated, 6, 5) ELSE left(updated, 10) END, ' |') AS line FROM s WHERE status = 'active' AND location = 'active'),
c AS (SELECT kb_path, row_number() OVER (PARTITION BY kb_path ORDER BY updated DESC, item_id) AS rank, concat('- **[', item_id, ' ', slug, '](anti-patterns/', item_id, '-', slug, '.md)** — ', one, ' (`', paths[1], ', ', paths[2], '`)') AS line FROM s WHERE status = 'active' AND location = 'active' AND severity = 'critical' AND category = 'anti-pattern'),
t AS (SELECT kb_path, category, chr(10) || string_agg(line, chr(10) ORDER BY rank) AS lines, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT kb_path, string_agg(line, chr(10) ORDER BY rank) AS lines, count(*) AS n FROM c WHERE rank <= 5 GROUP BY kb_path),
k AS (SELECT kb_path, count(*) FILTER (location = 'active' AND status = 'active') AS active, count(*) FILTER (location = 'active' AND status = 'deprecated') AS deprecated, count(*) FILTER (location = 'active' AND status LIKE 'superseded-by%') AS superseded, count(*) FILTER (location = 'archive') AS archived FROM items GROUP BY kb_path),
d AS (SELECT k.*, coalesce(t1.n, 0) AS n1, coalesce(t2.n, 0) AS n2, coalesce(t3.n, 0) AS n3, coalesce(t4.n, 0) AS n4, coalesce(t1.lines, '') AS l1, coalesce(t2.lines, '') AS l2, coalesce(t3.lines, '') AS l3, coalesce(t4.lines, '') AS l4, coalesce(b.lines, '_(none)_') AS lb, coalesce(b.n, 1) AS nb FROM k
  LEFT JOIN t t1 ON t1.kb_path = k.kb_path AND t1.category = 'decision' LEFT JOIN t t2 ON t2.kb_path = k.kb_path AND t2.category = 'learning' LEFT JOIN t t3 ON t3.kb_path = k.kb_path AND t3.category = 'reusable' LEFT JOIN t t4 ON t4.kb_path = k.kb_path AND t4.category = 'anti-pattern' LEFT JOIN b ON b.kb_path = k.kb_path)
SELECT kb_path, concat_ws(chr(10), '---', 'generated_at: {A.NOW}', 'schema_version: 1', 'kb_path: ' || kb_path, 'total_items: ' || active, 'counts:', '  decisions: ' || n1, '  learnings: ' || n2, '  reusable: ' || n3, '  anti-patterns: ' || n4, '---', '', '{index.Wording.title}' || regexp_extract(kb_path, '[^/]+$'), '', '{index.Wording.intro[0]}', '{index.Wording.intro[1]}', '',
  '{index.CRITICAL}', '', '{index.Wording.critical}', '', lb, '', '{index.SECTIONS["decision"]}', '', '| ID | Title | Summary | Updated |', '|---|---|---|---|' || l1, '', '{index.SECTIONS["learning"]}', '', '| ID | Title | Summary | Updated |', '|---|---|---|---|' || l2, '', '{index.SECTIONS["reusable"]}', '', '| ID | Title | Summary | Updated |', '|---|---|---|---|' || l3, '',
  '{index.SECTIONS["anti-pattern"]}', '', '| ID | Title | Summary | Severity | Updated |', '|---|---|---|---|---|' || l4, '', '---', '', '## Status Summary', '', '- Active: ' || active || ' items', '- Deprecated: ' || deprecated || ' items', '- Superseded: ' || superseded || ' items', '- Archived: ' || archived || ' items', '', '{index.Wording.counts}') || chr(10) AS content,
  (52 + nb + n1 + n2 + n3 + n4)::INTEGER AS line_count FROM d""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, A11, T2, T3, F16."""
    return _documents(spark, sf_dir)


def _creates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items; a create for each, some of them for another KB's files or for files outside all KBs; and the KBs."""
    held = A.items(spark, sf_dir)
    n = F.col("doc_id")
    path = F.when(n % 70 == 3, "/kb/zz/f.py").when(n % 10 == 4, "/q/x.py").otherwise("a/../b.py")
    asked = held.select(n.alias("req_id"), n.alias("req_order"), "kb_path", "category", F.concat(F.lit("n"), n.cast("string")).alias("title_slug"), F.lit("new").alias("summary"), F.array(F.lit("auth")).alias("tags"), F.array(path, F.lit("/q/y.py")).alias("paths"), "universality", "severity", F.concat(F.lit("## Why\n"), "body").alias("body"))
    dirs = held.select("kb_path").distinct().union(spark.sql("SELECT '/kb/zz'"))
    return held, asked, dirs.select("kb_path", F.col("kb_path").alias("kb_dir"))


_CREATED = f"""{A.ITEMS}, asked AS (SELECT doc_id, kb_path AS own_kb, category, CASE WHEN doc_id % 70 = 3 THEN '/kb/zz' ELSE kb_path END AS kb_path, length(body) BETWEEN 43 AND 7993 AS sound, doc_id % 70 = 3 OR doc_id % 10 <> 4 AS inside, severity FROM items),
held AS (SELECT kb_path, category, count(*) FILTER (status = 'active' AND location = 'active') AS active, max(substr(item_id, 3, 3)::INTEGER) AS last FROM items GROUP BY ALL),
turns AS (SELECT a.*, coalesce(active, 0) AS active, coalesce(last, 0) AS last, coalesce(sum(CASE WHEN sound AND inside THEN 1 ELSE 0 END) OVER (PARTITION BY a.kb_path, a.category ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM asked a LEFT JOIN held h ON h.kb_path = a.kb_path AND h.category = a.category),
verdicts AS (SELECT *, CASE WHEN NOT sound THEN 'schema_violation' WHEN before >= 10 - active AND 10 - active <= 999 - last THEN 'category_full' WHEN NOT inside THEN 'region_violation' WHEN before >= 999 - last THEN 'id_exhausted' END AS code FROM turns),
numbered AS (SELECT *, CASE WHEN code IS NULL THEN concat(CASE category WHEN 'decision' THEN 'D' WHEN 'learning' THEN 'L' WHEN 'reusable' THEN 'R' ELSE 'A' END, '-', lpad((last + before + 1)::VARCHAR, 3, '0')) END AS new_id FROM verdicts)"""


@query(f"""WITH {_CREATED} SELECT doc_id AS req_id, kb_path, new_id AS item_id, code, CASE WHEN doc_id % 70 = 3 THEN own_kb END AS rerouted_from, CASE WHEN doc_id % 70 = 3 THEN 'f.py' WHEN inside THEN 'b.py' ELSE '' END AS paths_kept, CASE WHEN inside THEN '/q/y.py' ELSE '/q/x.py,/q/y.py' END AS paths_dropped FROM numbered""")
def created_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed creates and their verdicts."""
    held, asked, registry = _creates(spark, sf_dir)
    return items.create_verdicts(asked, held, registry).select("req_id", "kb_path", "item_id", "code", "rerouted_from", F.array_join("paths", ",").alias("paths_kept"), F.array_join("paths_dropped", ",").alias("paths_dropped"))


@query(f"""WITH {_CREATED} SELECT kb_path, item_id, slug, title, status, severity, created FROM items UNION ALL SELECT kb_path, new_id, concat('n', doc_id), concat('N', doc_id), 'active', severity, '{A.NOW}' FROM numbered WHERE code IS NULL""")
def items_after_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot."""
    held, asked, registry = _creates(spark, sf_dir)
    return items.with_created(held, items.create_verdicts(asked, held, registry), F.lit(A.NOW)).select("kb_path", "item_id", "slug", "title", "status", "severity", "created")


_CLASHING = f"""RECURSIVE {A.ITEMS}, held AS (SELECT kb_path, category, count(*) FILTER (status = 'active' AND location = 'active') AS active, max(substr(item_id, 3, 3)::INTEGER) AS last FROM items GROUP BY ALL),
names AS (SELECT DISTINCT concat(kb_path, category, '|', array_to_string(string_split(slug, '-')[i:], '-')) AS name FROM items, unnest(range(1, len(string_split(slug, '-')) + 1)) AS r(i)),
given AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN slug WHEN 1 THEN coalesce(nullif(regexp_extract(slug, '-(.*)$', 1), ''), 'fix') WHEN 2 THEN 'auth-fix' ELSE concat('fix-', doc_id % 3) END AS s FROM items WHERE doc_id % 8 < 6 UNION ALL SELECT *, CASE WHEN doc_id % 8 = 6 THEN 'fix' ELSE concat('n', doc_id) END FROM items WHERE doc_id % 8 > 5),
reqs AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, g.kb_path, g.category, s, concat(g.kb_path, g.category) AS place, coalesce(active, 0) AS active, coalesce(last, 0) AS last, CASE WHEN NOT (length(body) BETWEEN 43 AND 7993) THEN 'schema_violation' END AS own, names.name IS NOT NULL AS clash,
  list_transform(range(1, len(string_split(s, '-')) + 1), lambda i: concat(g.kb_path, g.category, '|', array_to_string(string_split(s, '-')[i:], '-'))) AS parts FROM given g LEFT JOIN held h ON h.kb_path = g.kb_path AND h.category = g.category LEFT JOIN names ON name = concat(g.kb_path, g.category, '|', s)),
walk(n, taken, came, code, number) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR, NULL::BIGINT UNION ALL
  SELECT n, CASE WHEN code IS NULL THEN list_concat(taken, parts) ELSE taken END, CASE WHEN code IS NULL THEN list_append(came, place) ELSE came END, code, CASE WHEN code IS NULL THEN last + so_far + 1 END FROM (
    SELECT r.n, taken, came, parts, place, last, len(list_filter(came, lambda p: p = place)) AS so_far, coalesce(own, CASE WHEN active + len(list_filter(came, lambda p: p = place)) >= 10 THEN 'category_full' WHEN clash OR list_contains(taken, parts[1]) THEN 'duplicate_slug' END) AS code FROM walk JOIN reqs r ON r.n = walk.n + 1))"""


@query(f"WITH {_CLASHING} SELECT doc_id AS req_id, code, CASE WHEN number IS NOT NULL THEN concat(CASE category WHEN 'decision' THEN 'D' WHEN 'learning' THEN 'L' WHEN 'reusable' THEN 'R' ELSE 'A' END, '-', lpad(number::VARCHAR, 3, '0')) END AS item_id FROM walk JOIN reqs USING (n)")
def clashing_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates whose slugs are those of stored items, ends of these, or ends of slugs that were asked for before."""
    held, n = A.items(spark, sf_dir), F.col("doc_id")
    rest = F.regexp_extract("slug", "-(.*)$", 1)
    slug = F.when(n % 8 == 6, "fix").when(n % 8 == 7, F.concat(F.lit("n"), n.cast("string"))).when(n % 4 == 0, F.col("slug")).when(n % 4 == 1, F.when(rest == "", "fix").otherwise(rest)).when(n % 4 == 2, "auth-fix").otherwise(F.concat(F.lit("fix-"), (n % 3).cast("string")))
    asked = held.select(n.alias("req_id"), n.alias("req_order"), "kb_path", "category", slug.alias("title_slug"), F.lit("new").alias("summary"), F.array(F.lit("auth")).alias("tags"), F.array().cast("array<string>").alias("paths"), "universality", "severity", F.concat(F.lit("## Why\n"), "body").alias("body"))
    registry = held.select("kb_path", F.col("kb_path").alias("kb_dir")).distinct()
    return items.create_verdicts(asked, held, registry).select("req_id", "code", "item_id")


def _edits(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two edits for every item, of its whole text; the second gives no summary and no paths. Some break a rule. And the KBs' directories."""
    n, turn = F.col("doc_id"), F.col("turn")
    both = held.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    paths = F.when(n % 5 == 2, F.array(F.lit("/q/x.py"), F.lit(" "))).otherwise(F.array(F.lit("a/../b.py"), F.lit("/q/x.py"), F.lit("./b.py")))
    asked = both.select(
        F.concat_ws("-", "doc_id", "turn").alias("req_id"), turn.alias("req_order"), "kb_path", "item_id", F.concat(F.lit("## Why\n"), turn.cast("string"), "body").alias("new_body"), F.when(turn == 1, "new summary").alias("new_summary"),
        F.when((turn == 2) & (n % 11 == 4), F.array(F.lit("No"))).alias("new_tags"), F.when(turn == 1, paths).alias("new_paths"), F.when((turn == 2) & (n % 17 == 1), "maybe").alias("new_universality"), F.lit("normal").alias("new_severity"),
        F.concat(F.lit("edit "), turn.cast("string"), F.when(n % 13 != 6, " for cause").otherwise("")).alias("history_note"),
    )
    return asked, held.select("kb_path", F.col("kb_path").alias("kb_dir")).distinct()


_EDITED = f"""{A.ITEMS}, hit AS (SELECT *, location = 'active' AND status <> 'archived' AS h FROM items),
edits AS (SELECT kb_path, doc_id, turn, CASE WHEN NOT (length(body) BETWEEN 42 AND 7992) OR turn = 2 AND (doc_id % 11 = 4 OR doc_id % 17 = 1) THEN 'schema_violation' END AS bad, doc_id % 13 = 6 AS brief, CASE WHEN NOT h THEN 'target_archived' WHEN turn = 1 AND doc_id % 5 = 2 THEN 'region_violation' END AS late FROM hit, unnest([1, 2]) AS t(turn))"""


def _edited_sql(code: str, body: str, status: str) -> str:
    """The next snapshot after both edits of each item; ``code`` is null for accepted ones."""
    return f"""WITH {_EDITED}, done AS (SELECT doc_id, max(turn) AS turn, min(turn) = 1 AS first FROM edits WHERE {code} IS NULL GROUP BY doc_id)
SELECT kb_path, item_id, hit.doc_id, CASE WHEN first THEN 'new summary' ELSE summary END AS summary, CASE WHEN turn IS NULL THEN body ELSE {body} END AS body, CASE WHEN turn IS NULL THEN status ELSE {status} END AS status, CASE WHEN first THEN 'b.py' ELSE array_to_string(paths, ',') END AS paths,
  created, CASE WHEN turn IS NULL THEN updated ELSE '{A.NOW}' END AS updated, CASE WHEN turn IS NOT NULL AND category = 'anti-pattern' THEN 'normal' ELSE severity END AS severity FROM hit LEFT JOIN done USING (doc_id)"""


_EDIT_COLUMNS = ["kb_path", "item_id", "doc_id", "summary", "body", "status", "array_join(paths, ',') AS paths", "created", "updated", "severity"]
_NOTED = "CASE WHEN bad IS NULL AND brief THEN 'history_note_too_short' ELSE coalesce(bad, late) END"
_EDIT_VERDICT = "array_to_string(CASE WHEN turn = 1 THEN ['/q/x.py'] ELSE [] END, ',') AS paths_dropped, CASE WHEN turn = 1 AND doc_id % 5 <> 2 THEN 'b.py' WHEN turn = 1 THEN '' END AS paths_kept"


@query(f"WITH {_EDITED} SELECT concat(doc_id, '-', turn) AS req_id, {_NOTED} AS code, {_EDIT_VERDICT} FROM edits")
def supersede_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, P11, J8, U3."""
    held = A.items(spark, sf_dir)
    asked, registry = _edits(held)
    return items.update_verdicts(asked, held, registry, superseding=True).select("req_id", "code", F.array_join("paths_dropped", ",").alias("paths_dropped"), F.array_join("new_paths", ",").alias("paths_kept"))


@query(_edited_sql(_NOTED, f"concat('## Why', chr(10), turn, body, chr(10), chr(10), '## History', chr(10), chr(10), '- {A.NOW}: superseded — edit ', turn, ' for cause')", "'active'"))
def superseded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot."""
    held = A.items(spark, sf_dir)
    asked, registry = _edits(held)
    return items.superseded(held, asked, F.lit(A.NOW), registry).selectExpr(*_EDIT_COLUMNS)


@query(f"WITH {_EDITED} SELECT concat(doc_id, '-', turn) AS req_id, coalesce(bad, late) AS code, {_EDIT_VERDICT} FROM edits")
def update_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, P11, J8, U3."""
    held = A.items(spark, sf_dir)
    asked, registry = _edits(held)
    return items.update_verdicts(asked, held, registry).select("req_id", "code", F.array_join("paths_dropped", ",").alias("paths_dropped"), F.array_join("new_paths", ",").alias("paths_kept"))


@query(_edited_sql("coalesce(bad, late)", "concat('## Why', chr(10), turn, body)", "status"))
def updated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the next snapshot."""
    held = A.items(spark, sf_dir)
    asked, registry = _edits(held)
    return items.updated(held, asked, F.lit(A.NOW), registry).selectExpr(*_EDIT_COLUMNS)


@query(f"""WITH {_EDITED} SELECT concat(doc_id, '-', turn) AS req_id, CASE WHEN turn = 3 THEN 'target_not_found' WHEN NOT h OR turn = 2 THEN 'already_archived' END AS code FROM hit, unnest([1, 2, 3]) AS t(turn)""")
def archive_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first, a second and a misdirected request for each item."""
    held = A.items(spark, sf_dir)
    asked = held.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(F.concat_ws("-", "doc_id", "turn").alias("req_id"), F.col("turn").alias("req_order"), "kb_path", F.when(F.col("turn") == 3, "X-000").otherwise(F.col("item_id")).alias("item_id"))
    # each of the misdirected ones is for a KB of its own items, none of which has the id
    return items.edit_verdicts(asked, held, archiving=True).select("req_id", F.when(F.col("req_order") == 3, F.coalesce("code", F.lit("found"))).otherwise(F.col("code")).alias("code"))


@query(f"""WITH {_EDITED}, done AS (SELECT *, h AND doc_id % 6 = 0 AS d FROM hit) SELECT kb_path, item_id, doc_id, CASE WHEN d THEN 'archived' ELSE status END AS status, CASE WHEN d THEN '{A.NOW}' END AS archived_at, CASE WHEN d THEN 'no longer true 1' END AS archive_reason, CASE WHEN d THEN 'archive' ELSE location END AS location FROM done""")
def archived_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests for every item, of which most give too short a reason."""
    held = A.items(spark, sf_dir)
    asked = held.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.concat_ws("-", "doc_id", "turn").alias("req_id"), F.col("turn").alias("req_order"), "kb_path", "item_id", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("no longer true "), F.col("turn").cast("string"))).otherwise("old").alias("reason"))
    return items.archived(held, asked.where(items.reason_verdict("reason", 10, 500).isNull()), F.lit(A.NOW)).select("kb_path", "item_id", "doc_id", "status", "archived_at", "archive_reason", "location")


@query(f"""WITH {A.ITEMS} SELECT kb_path, doc_id, CASE WHEN len(tags) = 0 THEN NULL END AS error_field, CASE WHEN status LIKE 'superseded-by%' THEN 'superseded-by' ELSE status END AS kind, CASE WHEN status LIKE 'superseded-by%' THEN 'D-001' END AS replaced_by FROM items""")
def item_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, F20."""
    return A.items(spark, sf_dir).select("kb_path", "doc_id", items.item_error().alias("error_field"), status_kind(F.col("status")).alias("kind"), superseded_id(F.col("status")).alias("replaced_by"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS code FROM events), f AS (SELECT *, CASE WHEN code IS NOT NULL AND lag(code) OVER w = code THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
SELECT concat('u', user_id) AS session_id, 'call' AS tool_name, code AS error_code, min(event_id) AS first_seq, count(*) AS length, count(*) >= 6 AS flagged FROM g WHERE code IS NOT NULL GROUP BY user_id, island, code""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    e = A.table(spark, sf_dir, "events")
    return telemetry.error_streaks(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), F.lit("call").alias("tool_name"), F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("error_code")))


@query("""WITH s AS (SELECT user_id, min(ts) AS started_at FROM events GROUP BY user_id) SELECT concat('u', user_id) AS session_id, event_id AS seq, epoch_us(ts) // 1000 - epoch_us(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), started_at)) // 1000 AS elapsed_ms FROM events JOIN s USING (user_id) WHERE event_type <> 'signup'""")
def tool_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    e = A.table(spark, sf_dir, "events").withColumn("session_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    tool = F.when(F.col("event_type") == "signup", telemetry.QUIET_TOOL).otherwise(F.col("event_type"))
    return telemetry.tool_elapsed(e.select("session_id", F.col("event_id").alias("seq"), "ts", tool.alias("tool_name")), e.groupBy("session_id").agg(F.min("ts").alias("started_at")))


@query("""SELECT concat('u', user_id) AS session_id, count(*) FILTER (event_type = 'signup') AS turns, count(*) FILTER (event_type IN ('view', 'click')) AS tool_calls, count(*) FILTER (event_type = 'error') AS errors, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 10)::BIGINT AS output_tokens FROM events GROUP BY user_id""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    kind = F.when(F.col("event_type") == "signup", "assistant_text").when(F.col("event_type").isin("view", "click"), "tool_call").otherwise("other")
    e = A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), kind.alias("type"), F.when(F.col("event_type") == "error", "failed").alias("error_code"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"))
    return telemetry.run_totals(e)


@query("""WITH d AS (SELECT (doc_id // 2) AS n, sha256(text) AS sha FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) SELECT concat('session-', n) AS session_id, sha AS transcript_sha256, count(*) OVER (PARTITION BY n) AS listed, CASE WHEN count(*) OVER (PARTITION BY n) > 1 THEN 'session-@' || left(sha, 4) ELSE 'session-' END AS label FROM d""")
def repeated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    d = A.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return telemetry.repeated_targets(d.select(F.concat(F.lit("session-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("session_id"), F.sha2("text", 256).alias("transcript_sha256")))


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as proposed items of which most break one rule."""
    n = F.col("doc_id") % 11
    body = F.when(n == 9, F.lit("too short")).otherwise(F.concat(F.lit("## Why\n"), "text", F.lit("x" * 60)))
    fields = {
        "category": F.when(n == 2, "note").otherwise(F.when(F.col("doc_id") % 2 == 0, "decision").otherwise("anti-pattern")),
        "title_slug": F.when(n == 3, "Bad Slug").otherwise("good-slug"),
        "summary": F.when(n == 4, F.repeat(F.lit("x"), F.lit(61))).otherwise(F.lit("fine")),
        "body_markdown": body,
        "tags": F.when(n == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("auth"))),
        "paths": F.when(n == 6, F.array(F.lit(""))).otherwise(F.array(F.lit("src/a.py"))),
        "universality": F.when(n == 7, "maybe").when(n == 1, None).otherwise("universal"),
        "severity": F.when(n == 8, "dire").when(n == 10, "critical"),
    }
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return A.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.concat(F.lit("s"), (F.floor(F.col("doc_id") / 6)).cast("string")).alias("session_id"), F.col("doc_id").alias("candidate_id"), F.when(F.col("doc_id") % 97 == 0, "[1]").otherwise(text).alias("item"))


_VERDICTS = """v AS (SELECT doc_id AS candidate_id, concat('s', doc_id // 6) AS session_id, CASE WHEN doc_id % 97 = 0 OR doc_id % 11 = 1 THEN 1 WHEN doc_id % 11 BETWEEN 2 AND 9 THEN doc_id % 11 WHEN doc_id % 11 = 10 AND doc_id % 2 = 0 THEN 8 END AS reject_step FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""


@query(f"WITH {_VERDICTS} SELECT candidate_id, reject_step, CASE WHEN reject_step IS NULL AND candidate_id % 2 = 1 THEN CASE WHEN candidate_id % 11 = 10 THEN 'critical' ELSE 'normal' END END AS severity FROM v")
def candidate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    return cand.validated(_proposed(spark, sf_dir)).select("candidate_id", F.col("reject_step").cast("bigint").alias("reject_step"), "severity")


@query(f"WITH {_VERDICTS} SELECT session_id, count(*) AS total, count(reject_step) AS rejected, CASE WHEN count(*) = count(reject_step) THEN 'all_items_rejected' ELSE 'ok' END AS outcome FROM v GROUP BY session_id")
def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    proposed = _proposed(spark, sf_dir)
    return cand.extraction_outcomes(proposed, cand.validated(proposed))


_ANSWERS = f"""{_VERDICTS}, n AS (SELECT session_id, substr(session_id, 2)::BIGINT AS n, count(*) AS total, count(reject_step) AS bad FROM v GROUP BY session_id),
o AS (SELECT *, CASE WHEN n % 10 = 9 THEN 'llm_call_failed' WHEN n % 10 = 7 THEN 'llm_output_unparseable' WHEN n % 10 = 8 THEN 'ok' WHEN total = bad THEN 'all_items_rejected' ELSE 'ok' END AS outcome, CASE WHEN n % 10 = 8 THEN 0 ELSE total END AS given, CASE WHEN n % 10 = 8 THEN 0 ELSE bad END AS rejected FROM n)"""


@query(f"""WITH {_ANSWERS} SELECT session_id, outcome, CASE WHEN outcome = 'ok' THEN given - rejected END AS total_extracted, CASE WHEN outcome IN ('ok', 'all_items_rejected') THEN rejected END AS rejected_count, CASE WHEN outcome = 'ok' THEN 100 + n END AS input_tokens, CASE WHEN outcome = 'ok' THEN n % 50 END AS output_tokens, CASE WHEN outcome = 'ok' AND n % 3 > 0 THEN n / 4 END AS cost_usd FROM o""")
def extraction_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six proposed items to an answer; some answers are empty, no list, or missing."""
    return cand.answer_outcomes(*_answers(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sessions, and the answers to their requests."""
    proposed, n = _proposed(spark, sf_dir), F.expr("bigint(substring(session_id, 2))")
    items_ = F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]"))
    whole = proposed.groupBy("session_id").agg(items_.alias("items")).where(n % 10 != 9)
    text = F.when(n % 10 == 7, '{"items":1}').when(n % 10 == 8, "[]").otherwise(F.col("items"))
    return proposed, whole.select("session_id", text.alias("items"), (n + 100).alias("input_tokens"), (n % 50).alias("output_tokens"), F.when(n % 3 > 0, n / 4).alias("cost_usd"))


@query(f"""WITH {_ANSWERS} SELECT sum(given)::BIGINT AS turns, sum(100 + n)::BIGINT AS input_tokens, sum(n % 50)::BIGINT AS output_tokens, sum(CASE WHEN n % 3 > 0 THEN n / 4 END) AS cost_usd, (SELECT count(*) FROM o) AS target_count, (SELECT count(*) FILTER (outcome = 'ok') FROM o) AS processed_count, (SELECT count(*) FILTER (outcome <> 'ok') FROM o) AS deferred_count FROM o WHERE outcome = 'ok'""")
def run_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all sessions of a run used, and how many were processed."""
    told = cand.answer_outcomes(*_answers(spark, sf_dir)).withColumn("turns", F.col("total_extracted") + F.col("rejected_count"))
    return telemetry.grand_totals(told.where("outcome = 'ok'"), told.select("session_id", F.when(F.col("outcome") != "ok", "deferred").otherwise("processed").alias("status")))


@query("""SELECT conv_id, sha256(concat('{"allowedTools":["Grep","Read"],"model":"m","systemPrompt":"', 'extract', '","userMessage":"', role, '-', turn, '"}')) AS request_key, turn % 2 = 0 AS found FROM conversations""")
def replayed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, F19."""
    c = A.table(spark, sf_dir, "conversations")
    message = F.concat_ws("-", "role", F.col("turn").cast("string"))
    key = cand.request_key(F.lit("extract"), message, F.lit("m"), F.array(F.lit("Read"), F.lit("Grep")))
    requests = c.select("conv_id", key.alias("request_key"))
    recorded = c.where("turn % 2 = 0").select(key.alias("request_key")).distinct()
    return cand.replayed(requests, recorded)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: texts, some as arrays of blocks, and some lines that are no JSON."""
    c = A.table(spark, sf_dir, "conversations")
    session = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    part = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text"))).otherwise(F.concat(F.lit('{"text":[{"type":"text","text":'), F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"), F.lit('},{"type":"tool_use","id":"t1","name":"Edit","input":{"z":1,"file_path":"/a"}},{"type":"other"}]}')))
    content = F.regexp_extract(part, r'(?s)^\{"text":(.*)\}$', 1)
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","uuid":"'), session, F.lit('","sessionId":"'), session, F.lit('","cwd":"/w","message":{"content":'), content, F.lit("}}"))
    bad = (F.col("conv_id") % 10 == 3) & (F.col("turn") == 1)
    return c.select(session.alias("path"), (F.col("turn") + 1).alias("line_no"), F.when(bad, "{broken").otherwise(line).alias("raw"))


_BAD = "conv_id % 10 = 3 AND turn = 1"


@query(f"""SELECT concat('c', conv_id) AS path, CASE WHEN bool_or({_BAD}) THEN 'json_parse_failed' WHEN count(*) FILTER (role IN ('user', 'assistant')) = 0 THEN 'empty_transcript' ELSE 'ok' END AS outcome, min(CASE WHEN {_BAD} THEN turn + 1 END) AS bad_line FROM conversations GROUP BY conv_id""")
def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4, S5, P1."""
    return transcripts.parse_outcomes(transcripts.parsed(_lines(spark, sf_dir)))


@query(f"""WITH m AS (SELECT concat('c', conv_id) AS session_id, turn + 1 AS seq, turn, text FROM conversations WHERE role IN ('user', 'assistant') AND NOT ({_BAD}))
SELECT session_id, seq, 0 AS block_no, 'text' AS kind, text, NULL AS tool_name, NULL AS input_json FROM m UNION ALL SELECT session_id, seq, 1, 'tool_use', NULL, 'Edit', '{{"z":1,"file_path":"/a"}}' FROM m WHERE turn % 2 = 1 UNION ALL SELECT session_id, seq, 2, NULL, NULL, NULL, NULL FROM m WHERE turn % 2 = 1""")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2-P4, F8."""
    return transcripts.blocks(transcripts.parsed(_lines(spark, sf_dir))).select("session_id", "seq", "block_no", "kind", "text", "tool_name", "input_json")


@query(f"WITH {A.BLOCKS}, l AS (SELECT session_id, sum(CASE WHEN kind = 'text' THEN len(regexp_extract_all(text, '[A-Za-z]')) ELSE 0 END) AS letters FROM blocks GROUP BY session_id) SELECT session_id, CASE WHEN session_id LIKE '%1' THEN 'en' WHEN letters > 0 THEN 'en' ELSE 'ko' END AS written_in FROM l")
def written_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    found = profile.session_profile(A.blocks(spark, sf_dir))
    return found.select("session_id", decided_language(F.when(F.col("session_id").endswith("1"), "en").otherwise("auto"), F.col("language")).alias("written_in"))


_STATIC = "CASE WHEN status <> 'active' OR location <> 'active' THEN 'origin_not_found' WHEN universality <> '{}' THEN 'origin_not_unverified' ELSE '' END"


def _walked_sql(requests: str) -> str:
    """Requests, the table ``reqs`` of ``requests``, taken one after the other: n, code, number. What is granted takes its keys and a place."""
    return f"""{requests},
walk(n, taken, came, code, number) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR, NULL::BIGINT UNION ALL
  SELECT n, CASE WHEN code IS NULL THEN list_concat(taken, keys) ELSE taken END, CASE WHEN code IS NULL THEN list_append(came, place) ELSE came END, code, CASE WHEN code IS NULL THEN held + 1 END FROM (
    SELECT r.n, taken, came, keys, place, len(list_filter(came, lambda p: p = place)) AS held, coalesce(own,
      list_filter(list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN list_contains(taken, keys[i]) OR fails[i] = 'origin_not_found' THEN 'origin_not_found' WHEN fails[i] <> '' THEN fails[i] END), lambda f: f IS NOT NULL)[1],
      away, CASE WHEN len(list_filter(came, lambda p: p = place)) >= 10 THEN 'target_kb_full' END) AS code FROM walk JOIN reqs r ON r.n = walk.n + 1)),
verdicts AS (SELECT reqs.*, walk.code, CASE WHEN walk.code IS NULL THEN concat(CASE category WHEN 'decision' THEN 'D' WHEN 'learning' THEN 'L' WHEN 'reusable' THEN 'R' ELSE 'A' END, '-', lpad(number::VARCHAR, 3, '0')) END AS new_id FROM walk JOIN reqs USING (n))"""


_PROMOTED = "RECURSIVE " + _walked_sql(f"""{A.ITEMS}, raw AS (SELECT *, {_STATIC.format("unverified")} AS fail, concat(kb_path, '/', item_id) AS key, regexp_extract(kb_path, '^/kb/[^/]+') AS above FROM items),
reqs AS (SELECT row_number() OVER (ORDER BY a.doc_id) AS n, a.doc_id AS req_id, a.category, a.above, a.kb_path, a.body, CASE WHEN a.doc_id % 9 = 5 THEN '/kb/none' WHEN regexp_matches(a.above, '[13579]$') THEN a.above ELSE '/kb' END AS target_kb, concat(target_kb, a.category) AS place,
  CASE WHEN a.doc_id % 23 = 4 OR b.key IS NULL THEN [a.key] WHEN a.doc_id % 11 = 3 THEN [a.key, a.key] ELSE [a.key, b.key] END AS keys, [a.fail, coalesce(b.fail, '')] AS fails,
  CASE WHEN NOT (length(a.body) BETWEEN 43 AND 7993) THEN 'schema_violation' WHEN a.doc_id % 23 = 4 OR b.key IS NULL OR a.doc_id % 11 = 3 THEN 'invalid_origin_count' END AS own, CASE WHEN a.doc_id % 9 = 5 THEN 'target_kb_not_root' END AS away FROM raw a LEFT JOIN raw b ON b.doc_id = a.doc_id + 1)""")


def _written(text: Column) -> list[Column]:
    """The fields that are the same for all new items of promotions and demotions."""
    return [F.concat(F.lit("## Why\n"), text).alias("body"), F.lit("both").alias("summary"), F.array(F.lit("auth")).alias("tags"), F.lit("critical").alias("severity")]


def _promotions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items; for each, its promotion together with its neighbour, so that all are asked for twice; all KBs; where chains end.

    Sources with an odd last digit are roots; the others have one root for all of them.
    """
    held = A.items(spark, sf_dir)
    n, above = F.col("a.doc_id"), F.regexp_extract("a.kb_path", "^/kb/[^/]+", 0)
    one, other = (F.struct(F.col(f"{t}.kb_path").alias("kb_path"), F.col(f"{t}.item_id").alias("item_id")) for t in "ab")
    origins = F.when((n % 23 == 4) | F.col("b.item_id").isNull(), F.array(one)).when(n % 11 == 3, F.array(one, one)).otherwise(F.array(one, other))
    asked = held.alias("a").join(held.select("doc_id", "kb_path", "item_id").alias("b"), F.col("b.doc_id") == n + 1, "left").select(
        n.alias("req_id"), n.alias("req_order"), F.when(n % 9 == 5, "/kb/none").when(above.rlike("[13579]$"), above).otherwise("/kb").alias("target_kb"), origins.alias("origins"), F.col("a.category").alias("category"), F.lit("both").alias("title_slug"), *_written(F.col("a.body")),
        F.array(F.lit("src/f.py"), F.concat(above, F.lit("/0/x.py")), F.lit("/q/y.py"), F.lit("/kb/other/z.py")).alias("paths"),
    )
    above = held.select(F.regexp_extract("kb_path", "^/kb/[^/]+", 0).alias("kb_path")).distinct()
    registry = held.select("kb_path").union(above).union(spark.sql("SELECT '/kb'")).distinct()
    return held, asked, registry.select("kb_path", F.col("kb_path").alias("kb_dir")), above.where("kb_path RLIKE '[13579]$'").select(F.col("kb_path").alias("dir"))


@query(f"WITH {_PROMOTED} SELECT req_id, code, new_id AS item_id FROM verdicts")
def promotion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours share their items, so most requests depend on the ones before."""
    held, asked, registry, ends = _promotions(spark, sf_dir)
    return moves.promotion_verdicts(asked, held, registry, ends)


@query(f"""WITH {_PROMOTED}, taken AS (SELECT unnest(keys) AS key, target_kb, new_id FROM verdicts WHERE new_id IS NOT NULL)
SELECT kb_path, item_id, doc_id, CASE WHEN new_id IS NULL THEN status ELSE concat('superseded-by-cross:', CASE WHEN target_kb = '/kb' THEN '../..' WHEN above = target_kb THEN '..' ELSE concat('../../', substr(target_kb, 5)) END, ':', new_id) END AS status, universality, CASE WHEN new_id IS NULL THEN updated ELSE '{A.NOW}' END AS updated,
  array_to_string(paths, ',') AS paths, severity, CASE WHEN new_id IS NULL THEN md5(body) ELSE md5(concat(rtrim(body, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), chr(10), chr(10), '## History', chr(10), chr(10), '- {A.NOW}: promoted to root KB as ', new_id)) END AS body FROM raw LEFT JOIN taken USING (key)
UNION ALL SELECT target_kb, new_id, NULL, 'active', 'universal', '{A.NOW}', CASE WHEN target_kb = '/kb' THEN 'src/f.py,other/z.py' WHEN kb_path LIKE '%/0' THEN 'src/f.py' ELSE 'src/f.py,0/x.py' END, CASE WHEN category = 'anti-pattern' THEN 'critical' END, md5(concat('## Why', chr(10), body)) FROM verdicts WHERE new_id IS NOT NULL""")
def promoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot."""
    held, asked, registry, ends = _promotions(spark, sf_dir)
    return moves.promoted(held, asked, F.lit(A.NOW), registry, ends).select("kb_path", "item_id", "doc_id", "status", "universality", "updated", F.array_join("paths", ",").alias("paths"), "severity", F.md5("body").alias("body"))


_DEMOTED = "RECURSIVE " + _walked_sql(f"""{A.ITEMS}, raw AS (SELECT *, {_STATIC.format("universal")} AS fail, concat(kb_path, '/', item_id) AS key FROM items),
asked AS (SELECT raw.*, turn, CASE WHEN doc_id % 9 = 5 THEN '/kb/zz/0/a' WHEN turn = 1 THEN kb_path || '/a' WHEN doc_id % 10 = 4 THEN kb_path ELSE kb_path || '/b' END AS target_kb FROM raw, unnest([1, 2]) AS t(turn)),
reqs AS (SELECT row_number() OVER (ORDER BY turn, doc_id) AS n, concat(doc_id, '-', turn) AS req_id, doc_id, kb_path, item_id, body, 'decision' AS category, target_kb, target_kb AS place, [key] AS keys, [fail] AS fails, key,
  CASE WHEN NOT (length(body) BETWEEN 43 AND 7993) THEN 'schema_violation' END AS own, CASE WHEN doc_id % 9 = 5 OR turn = 2 AND doc_id % 10 = 4 THEN 'target_kb_not_child' END AS away FROM asked)""")


def _demotions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, whose KBs are roots here; for each, two demotions to its KB's children, or to no child of it; all KBs; no ends of chains."""
    held = A.items(spark, sf_dir)
    n, turn = F.col("doc_id"), F.col("turn")
    target = F.when(n % 9 == 5, "/kb/zz/0/a").when(turn == 1, F.concat("kb_path", F.lit("/a"))).when(n % 10 == 4, F.col("kb_path")).otherwise(F.concat("kb_path", F.lit("/b")))
    asked = held.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat_ws("-", "doc_id", "turn").alias("req_id"), F.struct("turn", "doc_id").alias("req_order"), F.col("kb_path").alias("origin_kb"), F.col("item_id").alias("origin_id"), target.alias("target_kb"), F.lit("decision").alias("category"), F.lit("moved").alias("title_slug"), *_written(F.col("body")), F.array(F.lit("src/f.py"), F.lit("/q/y.py")).alias("paths"),
    )
    own = held.select("kb_path").distinct()
    registry = own.union(own.select(F.concat("kb_path", F.lit("/a")))).union(own.select(F.concat("kb_path", F.lit("/b")))).union(spark.sql("SELECT '/kb/zz/0' UNION ALL SELECT '/kb/zz/0/a'"))
    return held, asked, registry.select("kb_path", F.col("kb_path").alias("kb_dir")), spark.sql("SELECT '/' AS dir WHERE false")


@query(f"WITH {_DEMOTED} SELECT req_id, code, new_id AS item_id FROM verdicts")
def demotion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is asked for twice."""
    return moves.demotion_verdicts(*(_demotions(spark, sf_dir)[i] for i in (1, 0, 2, 3)))


@query(f"""WITH {_DEMOTED}, taken AS (SELECT key, right(target_kb, 1) AS link, new_id FROM verdicts WHERE new_id IS NOT NULL)
SELECT kb_path, item_id, CASE WHEN new_id IS NULL THEN status ELSE 'archived' END AS status, CASE WHEN new_id IS NULL THEN location ELSE 'archive' END AS location, universality, CASE WHEN new_id IS NOT NULL THEN concat('demoted to ', link, ':', new_id) END AS archive_reason, CASE WHEN new_id IS NOT NULL THEN '{A.NOW}' END AS archived_at,
  CASE WHEN new_id IS NULL THEN md5(body) ELSE md5(concat(rtrim(body, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), chr(10), chr(10), '## History', chr(10), chr(10), '- {A.NOW}: demoted to child KB ', link, ' as ', new_id)) END AS body FROM raw LEFT JOIN taken USING (key)
UNION ALL SELECT target_kb, new_id, 'active', 'active', 'app-specific', NULL, NULL, md5(concat('## Why', chr(10), rtrim(body, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), chr(10), chr(10), '## History', chr(10), chr(10), '- {A.NOW}: demoted from root KB (was ', item_id, ')')) FROM verdicts WHERE new_id IS NOT NULL""")
def demoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot."""
    held, asked, registry, ends = _demotions(spark, sf_dir)
    return moves.demoted(held, asked, F.lit(A.NOW), registry, ends).select("kb_path", "item_id", "status", "location", "universality", "archive_reason", "archived_at", F.md5("body").alias("body"))


_RENDERED = f"""{A.ITEMS}, files AS (SELECT *, concat(CASE WHEN location = 'archive' THEN '.archive' WHEN category = 'decision' THEN 'decisions' WHEN category = 'learning' THEN 'learnings' WHEN category = 'reusable' THEN 'reusable' ELSE 'anti-patterns' END, '/', item_id, '-', slug, '.md') AS file_name,
  concat(concat_ws(chr(10), '---', 'id: ' || item_id, 'type: ' || category, 'title: "T"', 'summary: ' || to_json(summary)::VARCHAR, 'tags: [' || array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ', ') || ']', 'paths: ["' || paths[1] || '", "' || paths[2] || '"]', 'status: "' || status || '"', 'universality: ' || universality,
  'created: "' || created || '"', 'updated: "' || updated || '"', 'severity: ' || severity, '---', ''), CASE WHEN body = '' THEN '' WHEN body LIKE concat('%', chr(10)) THEN concat(chr(10), body) ELSE concat(chr(10), body, chr(10)) END) AS content FROM items)"""


@query(f"WITH {_RENDERED} SELECT kb_path, file_name, content FROM files")
def rendered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    return stores.rendered_items(A.items(spark, sf_dir))


@query("""WITH f AS (SELECT doc_id // 3 AS kb, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 < 3 THEN 'status' END AS error_field FROM documents WHERE doc_id IS NOT NULL) SELECT concat('/kb/', kb) AS kb_path, count(*) AS files FROM f GROUP BY kb HAVING count(*) = count(error_field)""")
def corrupt_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    d = A.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    failed = (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 7 < 3)
    return index.corrupt_kbs(d.select(F.concat(F.lit("/kb/"), F.floor(F.col("doc_id") / 3).cast("string")).alias("kb_path"), F.when(failed, "status").alias("error_field")))


@query(f"""WITH {A.PATHS}, o AS (SELECT page_id % 40 AS session_id, (SELECT arg_max(kb_path, length(kb_dir)) FROM registry WHERE path = kb_dir OR starts_with(path, kb_dir || '/')) AS kb_path FROM paths) SELECT session_id, count(DISTINCT kb_path) AS n_kbs FROM o GROUP BY session_id HAVING count(DISTINCT kb_path) > 1""")
def sessions_in_several_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    paths = A.page_paths(spark, sf_dir)
    owned = paths.join(regions.owners(paths, A.registry(paths)), "path").select((F.col("page_id") % 40).alias("session_id"), "kb_path")
    return profile.several_kbs(owned)


@query(f"""WITH {A.BLOCKS}, h AS (SELECT session_id, seq, concat('=== ', role, ' ', left(uuid, 8), ' @ (no-ts)', CASE WHEN is_sidechain THEN ' sidechain' ELSE '' END, ' ===', chr(10), CASE kind WHEN 'text' THEN text WHEN 'tool_use' THEN concat('[Tool: ', tool_name, '] ', input_json) ELSE concat('[Result error] ', text) END) AS m FROM blocks)
SELECT session_id, string_agg(m, chr(10) ORDER BY seq) AS content, count(*) AS message_count_after FROM h GROUP BY session_id""")
def full_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7-F9 (full)."""
    return compress.full(A.blocks(spark, sf_dir))


@query("""SELECT concat('c', conv_id) AS session_id, turn + 1 AS seq, concat(text, chr(10), '{"k":', conv_id, '}') AS text, turn % 2 = 0 AS is_error, '' AS uuid FROM conversations WHERE role IN ('user', 'assistant')""")
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results given as arrays of parts, with ids and flags of the wrong type."""
    c = A.table(spark, sf_dir, "conversations")
    session = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    part = F.struct(F.lit("text").alias("type"), "text")
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t","content":['), F.to_json(part), F.lit(',{"k":'), F.col("conv_id").cast("string"), F.lit('}],"is_error":'), F.when(F.col("turn") % 2 == 0, "true").otherwise('"yes"'), F.lit("}]"))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","uuid":5,"timestamp":[],"isSidechain":"no","sessionId":"'), session, F.lit('","cwd":"/w","message":{"content":'), result, F.lit("}}"))
    lines = c.select(session.alias("path"), (F.col("turn") + 1).alias("line_no"), line.alias("raw"))
    return transcripts.blocks(transcripts.parsed(lines)).select("session_id", "seq", "text", "is_error", "uuid")


@query(f"""WITH {A.SESSIONS} SELECT session_id, CASE n % 6 WHEN 1 THEN 'skipped_without_reason' WHEN 3 THEN 'failed_without_reason' WHEN 4 THEN 'schema_violation' WHEN 5 THEN 'action_outside_affected' END AS verdict FROM sessions""")
def mark_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session marked, in six ways."""
    n = (F.col("modification_ms") / 1000).cast("bigint") % 6
    kb = F.when(n == 5, "/kb/other").otherwise("/kb/own")
    fields = {
        "status": F.when(n <= 1, "skipped").when(n <= 3, "failed").when(n == 4, "odd").otherwise("processed"),
        "skipped_reason": F.when(n == 0, "trivial"),
        "failure_reason": F.when(n == 2, "broken"),
        "affected_kbs": F.array(F.lit("/kb/own")),
        "kb_actions": F.array(F.struct(kb.alias("kb"), F.array(F.lit("create")).alias("actions"))),
    }
    return A.sessions(spark, sf_dir).select("session_id", *[c.alias(k) for k, c in fields.items()]).select("session_id", ledger.mark_verdict().alias("verdict"))


@query("""SELECT conv_id, turn, concat_ws(chr(10), 'language: ko', 'cwd: ' || CASE WHEN turn % 2 = 0 THEN '/w' ELSE '(none)' END, 'estimated_tokens: ' || round(length(text) / 3.5)::BIGINT, '', text) AS prompt FROM conversations""")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, F1."""
    size = tokens(js_len(F.col("text")))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", cand.extraction_prompt(F.col("text"), F.lit("ko"), F.when(F.col("turn") % 2 == 0, "/w"), size).alias("prompt"))


@query("""SELECT conv_id, turn, concat(text, chr(10), CASE WHEN turn % 2 = 0 THEN 'Tools used: Read, ' || role ELSE '(no tools)' END) AS summary FROM conversations""")
def external_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    tools = F.when(F.col("turn") % 2 == 0, F.array(F.lit("Read"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", compress.external_summary(F.col("text"), tools).alias("summary"))


@query(f"""WITH {A.ITEMS} SELECT doc_id, CASE WHEN NOT (len(tags) BETWEEN 1 AND 5) OR NOT (length(CASE WHEN doc_id % 3 = 0 THEN 'fine' ELSE summary END) BETWEEN 1 AND 60) OR NOT (length(body) BETWEEN 43 AND 7993) OR doc_id % 7 = 2 THEN 'schema_violation' END AS verdict FROM items""")
def write_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they would be written, some with too long a summary, some without a heading."""
    held = A.items(spark, sf_dir)
    heading = F.when(F.col("doc_id") % 7 == 2, "-- why\n").otherwise("## Why\n")
    given = held.select("doc_id", F.col("slug").alias("title_slug"), F.when(F.col("doc_id") % 3 == 0, "fine").otherwise(F.col("summary")).alias("summary"), F.concat(heading, "body").alias("body"), "tags")
    return given.select("doc_id", items.schema_verdict().alias("verdict"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, without the offset, which is the session's."""
    return A.table(spark, sf_dir, "events").select("event_id", F.left(iso_of_millis(F.unix_millis(F.col("ts").cast("timestamp"))), F.lit(19)).alias("at"))


@query(f"""WITH {_RENDERED} SELECT kb_path, item_id, category, slug, title, md5(replace(summary, concat(chr(13), chr(10)), concat(chr(13), chr(10)))) AS summary, array_to_string(tags, ',') AS tags, array_to_string(paths, ',') AS paths, status, universality, severity, created, updated, location, file_name[strpos(file_name, '/') + 1:] AS file_name,
  CASE WHEN summary = '' THEN 'summary' END AS parse_error, md5(CASE WHEN body = '' OR body LIKE concat('%', chr(10)) THEN replace(body, concat(chr(13), chr(10)), chr(10)) ELSE concat(replace(body, concat(chr(13), chr(10)), chr(10)), chr(10)) END) AS body FROM files""")
def items_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item written as a file of its KB, and all KBs read."""
    held, root = A.items(spark, sf_dir), Steps(spark, "items").folder
    rendered = stores.rendered_items(held)
    files.write_named(rendered.select(F.concat(F.expr("substring(kb_path, 2)"), F.lit("/"), "file_name").alias("name"), "content"), root)
    found = stores.read_items(held.select(F.concat(F.lit(root), "kb_path").alias("kb_path")).distinct())
    return found.select(F.substring("kb_path", len(root) + 1, 1 << 30).alias("kb_path"), "item_id", "category", "slug", "title", F.md5("summary").alias("summary"), F.array_join("tags", ",").alias("tags"), F.array_join("paths", ",").alias("paths"), "status", "universality", "severity", "created", "updated", "location", "file_name", "parse_error", F.md5("body").alias("body"))


_TRANSCRIPTS = """turns AS (SELECT conv_id, turn, concat('{"type":"', role, '","sessionId":"c', conv_id, '","cwd":"/w","digest":"', md5(text), '"}', CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN '}' ELSE '' END) AS line, role FROM conversations),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS content, count(*) FILTER (role IN ('user', 'assistant') AND NOT (conv_id % 10 = 3 AND turn = 1)) AS messages FROM turns GROUP BY conv_id)"""


def _transcripts(spark: SparkSession, sf_dir: str, turns: Column | None = None) -> DataFrame:
    """name, content: every conversation as a file of lines, some not JSON, in folders of which some are hidden; ``turns`` tells which turns are in it yet."""
    c = A.table(spark, sf_dir, "conversations")
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","cwd":"/w","digest":"'), F.md5("text"), F.lit('"}'), F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), "}").otherwise(""))
    c = c.select("conv_id", "turn", line.alias("line"))
    c = c if turns is None else c.where(turns)
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return whole.select("conv_id", F.concat(F.when(F.col("conv_id") % 4 == 0, ".d/").otherwise("d/"), (F.col("conv_id") % 3).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("name"), "content")


@query(f"""WITH {_TRANSCRIPTS} SELECT concat('c', conv_id) AS session_stem, length(content) AS length, conv_id % 7 = 0 AS has_summary_sibling, sha256(content) AS transcript_sha256, CASE WHEN content LIKE '%}}}}%' THEN 'json_parse_failed' WHEN messages = 0 THEN 'empty_transcript' ELSE 'ok' END AS outcome FROM whole""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as a file, and all files listed, hashed and read."""
    root, made = Steps(spark, "transcripts").folder, _transcripts(spark, sf_dir)
    files.write_named(made.unionByName(made.where("conv_id % 7 = 0").select("conv_id", F.regexp_replace("name", "\\.jsonl$", "-summary.jsonl").alias("name"), F.lit("{}").alias("content"))), root)
    found = transcripts.list_files(spark, root)
    read = files.opened(found)
    told = transcripts.parse_outcomes(transcripts.parsed(files.lines_of(read)))
    return found.join(files.hashes_of(read), "path").join(told, "path").select("session_stem", "length", "has_summary_sibling", "transcript_sha256", "outcome")


@query(f"""WITH {_TRANSCRIPTS}, half AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS content, count(*) FILTER (role IN ('user', 'assistant') AND NOT (conv_id % 10 = 3 AND turn = 1)) AS messages FROM turns WHERE turn < 3 OR conv_id % 2 = 0 GROUP BY conv_id)
SELECT '/kb' AS kb_path, concat('c', conv_id) AS session_id, sha256(content) AS transcript_sha256, min(seen) AS first_seen_at FROM (SELECT *, 'first' AS seen FROM half UNION ALL SELECT *, 'second' FROM whole) WHERE messages > 0 GROUP BY conv_id, content""")
def intake_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan while half of the sessions have three turns at most, and one after they grew; both versions of these are in the ledger."""
    root = Steps(spark, "intake").folder
    store = LedgerStore(spark, f"{root}/ledger", buckets=8)
    for now, turns in (("first", (F.col("turn") < 3) | (F.col("conv_id") % 2 == 0)), ("second", F.col("conv_id") % 2 == 1)):
        files.write_named(_transcripts(spark, sf_dir, turns), f"{root}/in")
        intake.stamp(transcripts.list_files(spark, f"{root}/in"), store, "/kb", now)
    return store.read().select("kb_path", "session_id", "transcript_sha256", "first_seen_at")


@query(f"""WITH {A.SESSIONS}, marks AS (SELECT n, session_id, transcript_sha256, n % 3 = 0 AS one, n % 2 = 0 AS two FROM sessions)
SELECT '/kb' AS kb_path, session_id, transcript_sha256, CASE WHEN two THEN 2 ELSE 1 END AS extracted_count, CASE WHEN one THEN 't1' ELSE 't2' END AS first_seen_at, CASE WHEN two THEN 't2' ELSE 't1' END AS last_seen_at FROM marks WHERE one OR two""")
def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes of a ledger that is kept in buckets, the second one handed in twice."""
    store = LedgerStore(spark, Steps(spark, "ledger").folder, buckets=8)
    n, nothing = F.col("modification_ms") / 1000, F.lit(None).cast("string")
    for turn, chosen in ((1, n % 3 == 0), (2, n % 2 == 0), (2, n % 2 == 0)):
        stamps = A.sessions(spark, sf_dir).where(chosen).select(F.lit("/kb").alias("kb_path"), "session_id", "transcript_sha256", F.col("modification_ms").alias("transcript_mtime_ms"), F.lit("processed").alias("status"), nothing.alias("skipped_reason"), F.lit(turn).alias("extracted_count"), F.array().cast(ledger.ACTIONS).alias("kb_actions"), nothing.alias("failure_reason"), F.lit(0).alias("stamp_order"))
        store.upsert(stamps, F.lit(f"t{turn}"), "marks", turn)
    return store.read().select("kb_path", "session_id", "transcript_sha256", "extracted_count", "first_seen_at", "last_seen_at")
