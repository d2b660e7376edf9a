"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import chains, collocations, decontaminate, embeddings, extraction, mixing, neardup, pii, quality, suffixes, toxicity, urls, variants

#: Fixed values of the queries.
MIX_WEIGHTS = [5, 2, 1]
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The session's key for pseudonyms; a public one, for tests, where none is set."""
    return spark.conf.get("spark.quillspan.pii.key", "not a secret")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_words(_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return out.withColumn("n_found", sum(F.col(f"n_{kind}") for kind in pii.KINDS))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_quality, op3_embeddings, op4_chains, op5_pseudonyms, op6_urls, op7_suffixes, op8_toxicity, op9_minhash, op10_decontamination, op11_variants, op12_extraction, op13_collocations, pipeline)
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
dealt AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2 AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2.0e0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(weight) OVER (ORDER BY source_size * 2.0e0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM dealt WHERE source_size > 0),
clamped AS (SELECT *, (total * 3 - above * 2) * weight >= cap * share * 2 AS is_full FROM ranked),
summed AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS c, coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (), 1) AS w FROM clamped),
targets AS (
  SELECT source, least(CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(total * 3 - c * 2 AS DOUBLE) / CAST(w * 2 AS DOUBLE) END, CAST(cap AS DOUBLE)) AS target
  FROM summed),
per AS (
  SELECT d.source, d.source_size, coalesce(t.target, 0) AS target,
         CASE WHEN d.source_size > 0 THEN CAST(floor(t.target / d.source_size) AS BIGINT) ELSE 0 END AS whole,
         CASE WHEN d.source_size > 0 THEN greatest(CAST(floor(t.target - floor(t.target / d.source_size) * d.source_size + 0.5) AS BIGINT), 0) ELSE 0 END AS part
  FROM dealt d LEFT JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(key, 1, 8) AS BIGINT) % 4096, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(p.whole * r.size + greatest(least(p.part - r.before, r.size), 0) AS BIGINT) AS taken
FROM run r JOIN per p ON r.source IS NOT DISTINCT FROM p.source""",
    "op3_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9e0),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.vec_id),
comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = comp.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp""",
    "op9_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{C0}-\x{1FFF}\x{2080}-\x{10FFFF}]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
counts AS (SELECT doc_id, g, count(*) AS n FROM shingles GROUP BY doc_id, g),
totals AS (SELECT doc_id, sum(n) AS total FROM counts GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n FROM counts a JOIN counts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y FROM shared JOIN totals tx ON tx.doc_id = x JOIN totals ty ON ty.doc_id = y WHERE n * 1.8e0 >= 0.8e0 * (tx.total + ty.total)),
links AS (SELECT x AS a, y AS b FROM near UNION ALL SELECT y, x FROM near),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, component_id, doc_id = component_id AS kept FROM comp""",
    "op11_variants": r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) AS BIGINT) - 64] END))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, steps),
cut AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
keys AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM places),
near AS (
  SELECT a.word AS a, b.word AS b FROM keys a JOIN keys b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT keys.word, words.word FROM keys JOIN words ON keys.key = words.word
  UNION SELECT words.word, keys.word FROM keys JOIN words ON keys.key = words.word),
best AS (
  SELECT near.a AS word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = near.b GROUP BY near.a),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
follow(word, root, step) AS (
  SELECT word, word, 0 FROM words UNION ALL SELECT follow.word, formed.form, step + 1 FROM follow JOIN formed ON formed.word = follow.root WHERE formed.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(f.root, f.step) FROM follow f WHERE f.word = formed.word) AS root, n, n_near, form_n FROM formed""",
    # what the rules come to on pages that have one article each, with no other markup in it than headings, paragraphs, bold and breaks
    "op12_extraction": r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
cut AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>', chr(1), 'g'), chr(1)) AS b FROM article),
plain AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x:
      trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM cut)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM plain""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) AS r(k) WHERE len(w) >= k),
freq AS (SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM freq WHERE k = 1 GROUP BY lang),
cands AS (SELECT * FROM freq WHERE k >= 2 AND f >= 30),
inner_parts AS (
  SELECT lang, f, g[i:i + s - 1] AS part FROM (SELECT lang, f, g, k, s, unnest(range(1, k - s + 2)) AS i FROM cands, range(2, 4) AS r(s) WHERE s < k)),
covered AS (SELECT lang, part, max(f) AS inside FROM inner_parts GROUP BY lang, part),
kept AS (SELECT c.* FROM cands c LEFT JOIN covered v ON v.lang = c.lang AND v.part = c.g WHERE inside IS NULL OR 100 * inside < 80 * f),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c
  JOIN freq l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN freq r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op6_urls": rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LETTERS}), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(host || path, 'spam') OR contains(host || path, 'pills') OR contains(host || path, 'casino') OR contains(host || path, 'porn') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""",
}
