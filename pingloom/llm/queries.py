"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown_lm, importance, jaccard, lexical, licenses, mixing, quality_rules, substring, suffix_array, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level BPE file; its place is a setting of the installation, not of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("cycle")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_corpus(table(spark, sf_dir, "documents")).drop("perplexity")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_quality_rules, op4_mixing, op5_jaccard_join, op6_brown_lm, op7_bpe, op8_substring_dedup, op9_topk, op10_url_filter, op11_importance, op12_lexical_search, op13_license_scan)}


_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"

_OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT source, size, 3.0::DOUBLE * size AS cap,
  CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s),
f AS (SELECT *, row_number() OVER o AS i,
  ((SELECT sum(size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, size AS source_size, round(least(cap, coalesce((SELECT arg_min(line, i) FROM f WHERE line * w <= cap), 0) * w), 6) AS target FROM f),
p AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY h, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d),
q AS (SELECT p.doc_id, p.size, p.source, t.source_size, t.target, p.start, round(t.target)::BIGINT AS quota FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
b AS (SELECT source, source_size, round(target)::BIGINT AS quota, CAST(ceil(source_size / 1024.0::DOUBLE) AS BIGINT) AS blocks FROM t WHERE source_size > 0),
n AS (SELECT source, (quota // source_size) * blocks + least(blocks, CAST(ceil((quota % source_size) / 1024.0::DOUBLE) AS BIGINT)) AS need FROM b),
c AS (SELECT source, need, sum(need) OVER (ORDER BY source COLLATE "C" NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(need) OVER ()::BIGINT AS total FROM n),
i AS (SELECT source, need, total, (upto - need)::DOUBLE / total AS lo, upto::DOUBLE / total AS hi FROM c WHERE need > 0),
u AS (SELECT slot, slot * 0.6180339887498949e0 - floor(slot * 0.6180339887498949e0) AS u FROM (SELECT unnest(range(coalesce((SELECT max(total) FROM c), 0))) AS slot)),
k AS (SELECT i.source, i.need, i.total, u.slot, row_number() OVER (PARTITION BY i.source ORDER BY u.slot) - 1 AS rank FROM u JOIN i ON u.u >= i.lo AND u.u < i.hi),
g AS (SELECT i.source, i.need, i.total, count(k.slot) AS got FROM i LEFT JOIN k ON i.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
z AS (SELECT source, slot, rank FROM k WHERE rank < need UNION ALL SELECT source, total, unnest(range(got, need)) FROM g WHERE got < need),
o AS (SELECT q.*, CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(start + size, quota % source_size) - start) END::BIGINT AS taken FROM q)
SELECT o.doc_id, o.size, o.source_size, o.target, o.taken, CASE WHEN o.taken > 0 THEN z.slot END::BIGINT AS slot
FROM o LEFT JOIN z ON o.source IS NOT DISTINCT FROM z.source AND z.rank = o.start // 1024
"""

_OP9 = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP10 = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT DISTINCT host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND m.k = 1
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP12 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t) CROSS JOIN c),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n CROSS JOIN c),
i AS (SELECT p.doc_id, p.t, f.w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS x FROM p JOIN m ON p.doc_id = m.doc_id JOIN f ON p.t = f.t),
s AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS score FROM q JOIN i ON q.t = i.t GROUP BY ALL HAVING sum(times * x) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def _values(templates: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(label)}, {'true' if i < len(licenses.PHRASES) else 'false'}, {quoted(text)})" for i, (label, text) in enumerate(templates))


_OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT template, label, phrase, {_TERMS} AS w FROM (VALUES {_values([*licenses.PHRASES, *licenses.NOTICES])}) AS v(template, label, phrase, text)),
t AS (SELECT template, label, phrase, len(w) - 2 AS grams, i - 1 AS t_at, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM s)),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, template, label, phrase, grams, pos - t_at AS diagonal, t_at FROM g JOIN t USING (a, b, c)),
v AS (SELECT doc_id, template, label, phrase, grams, diagonal, list(t_at) AS places, min(t_at) AS lo, max(t_at) AS hi FROM h GROUP BY ALL),
m AS (SELECT *, list(places) OVER near AS merged, min(diagonal + lo) OVER near AS first_of, max(diagonal + hi) OVER near AS last_of
  FROM v WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {licenses.REACH} PRECEDING AND {licenses.REACH} FOLLOWING)),
e AS (SELECT *, round(CASE WHEN phrase THEN len(places) ELSE len(list_distinct(flatten(merged))) END::DOUBLE / grams, 6) AS share FROM m),
k AS (SELECT *, CASE WHEN phrase THEN share = 1 ELSE share >= {licenses.LEAST}::DOUBLE END AS good FROM e),
l AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM k WHERE good),
o AS (SELECT *, sum(CASE WHEN phrase OR before IS NULL OR diagonal - before > {licenses.REACH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM l),
b AS (SELECT doc_id, template, label, phrase, grams, share, CASE WHEN phrase THEN diagonal ELSE first_of END AS first, CASE WHEN phrase THEN diagonal + grams + 1 ELSE last_of + 2 END AS last
  FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, template, island ORDER BY share DESC, diagonal) = 1),
y AS (SELECT * FROM b x WHERE phrase OR NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.template <> x.template AND NOT y.phrase AND y.first <= x.last AND x.first <= y.last
  AND (y.share > x.share OR y.share = x.share AND (y.grams > x.grams OR y.grams = x.grams AND y.template < x.template)))),
r AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM y GROUP BY doc_id),
z AS (SELECT doc_id, max(share) AS score FROM e GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN z ON d.doc_id = z.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _OP4, "op9_topk": _OP9, "op10_url_filter": _OP10, "op12_lexical_search": _OP12, "op13_license_scan": _OP13}
