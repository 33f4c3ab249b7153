"""The registered queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, language_id, near_duplicates, one_bit_codes, packing, phrases, pii, quality, secrets, token_counts, top_k, url_filters
from ._runtime import table


URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_digest(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=100, longest=5, first=2000)


_ALL = (
    op1_url_filters, op2_token_counts, op3_top_k, op4_quality, op5_secret_scan, op6_decontamination, op7_near_duplicates, op8_pii, op9_best_fit_packing, op10_language_id,
    op11_nearest_neighbours, op12_filter_audit, op13_phrase_mining,
)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) r WHERE rank <= 10"""

_CONTAMINATION = f"""WITH words AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM starts),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT row_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, lengths WHERE len(w) >= n),
found AS (SELECT p.row_id, p.i, p.n, q.item FROM places p JOIN phrases q ON q.n = p.n AND q.phrase = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hit AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM (SELECT row_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) x GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row_id, item FROM found) y GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)"""

_GROUPS = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || chr(10) || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM words WHERE len(w) > 0) x) y),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN sides e ON e.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM documents d JOIN roots ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""

_AUDIT = """WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
 FROM texts JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
 JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, translate(fails, filter_order[1:step - 1], '') = fails AS reached, contains(fails, filter_order[step]) AS failing, m.*
 FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) s CROSS JOIN masks m),
sums AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN reached AND failing THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN failing AND NOT reached THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN reached AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN reached AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums"""

_PHRASES = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
runs AS (SELECT lang, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS phrase FROM places JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) s ON i + s.size - 1 <= len(w)),
frequent AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY lang, size, phrase HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE size > 1),
cuts AS (SELECT lang, phrase, size, f, w, unnest(generate_series(1, size - 1)) AS k FROM candidates),
scores AS (SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
 FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM scores) z WHERE best = 1),
inner_sizes AS (SELECT lang, w, size, f, unnest(generate_series(2, size - 1)) AS m FROM candidates WHERE size > 2),
inner_starts AS (SELECT lang, w, size, f, m, unnest(generate_series(1, size - m + 1)) AS i FROM inner_sizes),
covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM inner_starts GROUP BY ALL),
left_over AS (SELECT s.* FROM lowest s LEFT JOIN covers c ON c.lang = s.lang AND c.phrase = s.phrase WHERE c.most IS NULL OR 100 * c.most < 100 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

#: What the others give rests on trained models, byte-pair encoding, random codes, or spans that a method adds.
ORACLE_SQL: dict[str, str] = {"op3_top_k": _TOP_K, "op6_decontamination": _CONTAMINATION, "op7_near_duplicates": _GROUPS, "op12_filter_audit": _AUDIT, "op13_phrase_mining": _PHRASES}
