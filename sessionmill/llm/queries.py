"""The registered queries of the document operators: each reads its whole table and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm.ann import neighbours
from sessionmill.llm.centroids import centroid_clusters
from sessionmill.llm.jpeg import media_digests, stored_as_media
from sessionmill.llm.language import languages
from sessionmill.llm.licenses import scan
from sessionmill.llm.lm_score import lm_scores
from sessionmill.llm.mixing import mix
from sessionmill.llm.near_dedup import near_duplicates
from sessionmill.llm.negatives import hard_negatives
from sessionmill.llm.packing import pack
from sessionmill.llm.pii import base_columns, personal_data, with_base
from sessionmill.llm.token_counts import token_counts
from sessionmill.llm.toxicity import toxicity

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op3_media_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(stored_as_media(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


#: Domains of the sources, by the number in a source's name modulo four.
DOMAINS = ("web", "books", "code", "forum")
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "forum": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 1}}
SHARE, EPOCHS, SEED = 0.6, 2, 17


def domain() -> Column:
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    return F.when(number != "", F.element_at(F.array(*map(F.lit, DOMAINS)), (number.try_cast("int") % 4) + 1))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS, SHARE, EPOCHS, SEED)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


#: Rows whose vec_id is divisible by this count under the next of the ten labels.
MISLABELLED = 7


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("vec_id") % MISLABELLED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shown))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that its contract fixes, for which there is SQL."""
    return op8_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that its contract fixes, for which there is SQL; they need no model."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return base_columns(with_base(docs))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_pii_boosting, op3_media_progressive_jpeg, op4_toxicity, op5_nearest_neighbours, op6_mixing_sources, op7_token_counts, op8_license_scans, op9_minhash_near_dedup, op10_best_fit_packing, op11_language_id, op12_centroid_clustering, op13_hard_negatives, license_base_places, personal_data_base)}

#: Words between ASCII white space, A-Z in lower case.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
placed AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev, CASE WHEN i > 2 THEN w[i - 2] END AS far FROM words, unnest(range(1, len(w) + 1)) AS r(i)),
one AS (SELECT word, count(*) AS n FROM placed GROUP BY word),
two AS (SELECT prev, word, count(*) AS n FROM placed WHERE prev IS NOT NULL GROUP BY prev, word),
three AS (SELECT far, prev, word, count(*) AS n FROM placed WHERE far IS NOT NULL GROUP BY far, prev, word),
own1 AS (SELECT doc_id, word, count(*) AS n FROM placed GROUP BY doc_id, word),
own2 AS (SELECT doc_id, prev, word, count(*) AS n FROM placed WHERE prev IS NOT NULL GROUP BY doc_id, prev, word),
own3 AS (SELECT doc_id, far, prev, word, count(*) AS n FROM placed WHERE far IS NOT NULL GROUP BY doc_id, far, prev, word),
size AS (SELECT doc_id, len(w) AS n FROM words), total AS (SELECT sum(n) AS n FROM size),
counted AS (
  SELECT x.doc_id, x.prev, x.far, o.n - p.n AS c1, coalesce(t.n - q.n, 0) AS c2, coalesce(h.n - g.n, 0) AS c3, greatest(coalesce(op.n - pp.n, 1), 1) AS context, greatest(coalesce(ot.n - pt.n, 1), 1) AS context2, greatest(total.n - size.n, 1) AS rest
  FROM placed x JOIN one o USING (word) JOIN own1 p ON p.doc_id = x.doc_id AND p.word = x.word JOIN size ON size.doc_id = x.doc_id CROSS JOIN total
  LEFT JOIN two t ON t.prev = x.prev AND t.word = x.word LEFT JOIN own2 q ON q.doc_id = x.doc_id AND q.prev = x.prev AND q.word = x.word
  LEFT JOIN three h ON h.far = x.far AND h.prev = x.prev AND h.word = x.word LEFT JOIN own3 g ON g.doc_id = x.doc_id AND g.far = x.far AND g.prev = x.prev AND g.word = x.word
  LEFT JOIN one op ON op.word = x.prev LEFT JOIN own1 pp ON pp.doc_id = x.doc_id AND pp.word = x.prev
  LEFT JOIN two ot ON ot.prev = x.far AND ot.word = x.prev LEFT JOIN own2 pt ON pt.doc_id = x.doc_id AND pt.prev = x.far AND pt.word = x.prev),
logs AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / context2) WHEN c2 > 0 THEN ln(c2::DOUBLE / context) + CASE WHEN far IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln((CASE WHEN c1 > 0 THEN c1 ELSE 0.4 END)::DOUBLE / rest) + CASE WHEN prev IS NULL THEN 0 WHEN far IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS l FROM counted)
SELECT size.doc_id, size.n::BIGINT AS n_words, round(avg(l), 6) AS score FROM size LEFT JOIN logs ON logs.doc_id = size.doc_id GROUP BY size.doc_id, size.n
"""

def _split_sql(name: str, keys: list[str], parent: list[str], weights: dict[str, float], budget: str, source: str) -> str:
    """The budgets of one level of the tree, as a common table expression."""
    own, above = ", ".join(keys), ", ".join(parent)
    by = f"PARTITION BY {above} " if parent else ""
    cases = " ".join(f"WHEN {name} = '{k}' THEN {float(v)}" for k, v in weights.items())
    weight = f"CASE {cases} ELSE 1.0 END" if cases else "1.0"
    joined = f"JOIN {source} USING ({above})" if parent else ""
    return f"""
{name}_nodes AS (SELECT {own}, sum(available) AS available, (sum(available) * {EPOCHS})::BIGINT AS capacity, ({weight})::DOUBLE AS weight FROM leaves GROUP BY {own}),
{name}_level AS (SELECT *, {budget} AS given, ({budget} - coalesce(sum(capacity) OVER ({by}ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({by}ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight >= capacity AS is_full FROM {name}_nodes {joined}),
{name}_budget AS (SELECT {own}, available, CASE WHEN is_full THEN capacity ELSE floor((given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by})) * weight
  / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}))::BIGINT END AS {name}_given FROM {name}_level)"""


OP6_SQL = f"""
WITH told AS (SELECT doc_id, coalesce(CASE regexp_extract(source, '([0-9]{{1,9}})$', 1)::INTEGER % 4 {" ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS))} END, '(none)') AS domain,
  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(text) AS digest FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available FROM told WHERE n_tokens > 0 GROUP BY domain, lang, source),
total AS (SELECT floor(sum(available) * {SHARE})::BIGINT AS tokens FROM leaves),
{_split_sql("domain", ["domain"], [], WEIGHTS["domain"], "(SELECT tokens FROM total)", "")},
{_split_sql("lang", ["domain", "lang"], ["domain"], WEIGHTS["lang"], "domain_given", "(SELECT domain, domain_given FROM domain_budget)")},
{_split_sql("source", ["domain", "lang", "source"], ["domain", "lang"], {}, "lang_given", "(SELECT domain, lang, lang_given FROM lang_budget)")},
ordered AS (SELECT told.*, epoch, source_given AS budget, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, md5(concat_ws(':', '{SEED}', epoch, doc_id, digest)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM told JOIN source_budget USING (domain, lang, source) CROSS JOIN unnest(range({EPOCHS})) AS e(epoch) WHERE n_tokens > 0)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, start, n_tokens, least(n_tokens, budget - start)::BIGINT AS taken FROM ordered WHERE start < budget
"""

#: All pairs that share a shingle are counted: for small tables.
OP9_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM size UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(other, w.doc_id) AS component_id, coalesce(other, w.doc_id) = w.doc_id AS kept FROM words w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id
"""

LICENSE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hits AS (SELECT rid, i, CASE WHEN w[i + 1:i + 4] = ['gnu', 'general', 'public', 'license'] THEN 'gpl' WHEN w[i + 1:i + 2] = ['apache', 'license'] THEN 'apache' WHEN w[i + 1:i + 2] = ['cc', 'by'] THEN 'cc-by' WHEN w[i + 1:i + 2] = ['mit', 'license'] THEN 'mit' END AS label FROM w, unnest(range(len(w))) AS r(i)),
found AS (SELECT rid, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits WHERE label IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN found USING (rid)
"""

PII_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) AS k(kind, name, pattern)),
found AS (SELECT rid, 0 AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM docs
  UNION ALL SELECT rid, 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM docs
  UNION ALL SELECT rid, 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM docs
  UNION ALL SELECT rid, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs),
each AS (SELECT rid, kind, i, m[i] AS m, length(gaps[i]) AS gap FROM found, unnest(range(1, len(m) + 1)) AS r(i)),
placed AS (SELECT *, sum(gap) OVER w + sum(length(m)) OVER w AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM each WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
spans AS (SELECT rid, kind, stop - length(m) AS start, stop FROM placed WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INTEGER), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse(digits), j, 1)::INTEGER WHEN substr(reverse(digits), j, 1)::INTEGER > 4 THEN 2 * substr(reverse(digits), j, 1)::INTEGER - 9 ELSE 2 * substr(reverse(digits), j, 1)::INTEGER END)) % 10 = 0
  ELSE length(digits) BETWEEN 10 AND 15 END),
told AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, string_agg(concat(name, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, kind) AS spans FROM spans JOIN kinds USING (kind) GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM docs LEFT JOIN told USING (rid)
"""



def _centroid_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Rounds of full assignment, one common table expression after the other."""
    assign = lambda t: f"""
near{t} AS MATERIALIZED (SELECT rid, j, d FROM (SELECT rid, j, sum((comp.v - c{t}.v) ** 2)::HUGEINT AS d FROM comp JOIN c{t} USING (i) GROUP BY rid, j) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, j) = 1)"""  # noqa: E731
    move = lambda t: f"""
sums{t} AS (SELECT j, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{t} JOIN comp USING (rid) GROUP BY j, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.j, c{t}.i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c{t}.v) AS v FROM c{t} LEFT JOIN sums{t} USING (j, i))"""  # noqa: E731
    steps = ",".join(assign(t) + "," + move(t) for t in range(rounds)) + "," + assign(rounds)
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: isfinite(e))) = {width}),
comp AS MATERIALIZED (SELECT rid, i, x[i] AS v FROM kept, unnest(range(1, {width + 1})) AS r(i)),
begin AS (SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), x) - 1 AS j, x FROM kept QUALIFY j < {k}),
c0 AS MATERIALIZED (SELECT j, i, x[i] AS v FROM begin, unnest(range(1, {width + 1})) AS r(i)),{steps},
told AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (rid) JOIN told USING (j)
"""


OP12_SQL = _centroid_sql()

#: Every anchor against every row: for small tables.
OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % {MISLABELLED} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, s AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op1_lm_scoring": OP1_SQL, "op6_mixing_sources": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op12_centroid_clustering": OP12_SQL, "op13_hard_negatives": OP13_SQL, "license_base_places": LICENSE_SQL, "personal_data_base": PII_SQL}
