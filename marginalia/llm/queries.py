"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, embeds, langid, licenses, lines, mixing, ngrams, pii, urls
from .common import written

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

PII_KEY = b"a key that a deployment keeps to itself"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are those in the pages and the redirects of url variants (www., m., http, fragments, tracking parameters) to one form."""
    pages = _table(spark, sf_dir, "pages")
    return urls.url_filter(pages, RULES, edges=urls.variant_edges(pages))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.license_scan(_table(spark, sf_dir, "documents")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_join(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    parts = [spark.read.schema(docs.schema).parquet(*files[k::4]) for k in range(min(4, len(files)))]
    return lines.line_dedup(docs, batches=parts, digest=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeds.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"), PII_KEY)


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings come from the embeddings (sonified), since no table holds any; every row whose id 20 divides is searched among all."""
    media = audio.sonified(_table(spark, sf_dir, "embeddings"))
    prints = written(audio.fingerprints(media, key="vec_id"), "prints")
    return audio.search_audio(prints, F.col("vec_id") % 20 == 0, key="vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_URL_SQL = """
WITH RECURSIVE
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
hrefs AS (
  SELECT src, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
      ELSE regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END, '&amp;', '&') AS href,
    regexp_extract(src, '^(.*?)://', 1) AS scheme,
    lower(regexp_extract(src, '://([^/?#]*)', 1)) AS shost,
    regexp_extract(src, '://[^/?#]*([^?#]*)', 1) AS spath
  FROM tags WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical|\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh')),
rests AS (
  SELECT url, substr(url, strpos(url, '://') + 3) AS rest FROM pages WHERE strpos(url, '://') > 0),
variants AS (
  SELECT url, rest, regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query FROM rests),
links AS (
  SELECT url AS src, 'https://' || regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\\.', '')
    || coalesce(nullif(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), ''), '/') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS dst
  FROM variants
  UNION ALL
  SELECT src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
      WHEN strpos(src, '://') = 0 THEN NULL
      WHEN href LIKE '//%' THEN scheme || ':' || href
      WHEN href LIKE '/%' THEN scheme || '://' || shost || href
      WHEN href LIKE '?%' THEN scheme || '://' || shost || spath || href
      WHEN href <> '' AND NOT regexp_matches(href, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)')
        THEN scheme || '://' || shost || coalesce(nullif(regexp_replace(spath, '[^/]*$', ''), ''), '/') || href END AS dst
  FROM hrefs),
urls AS (SELECT url FROM pages UNION SELECT src FROM links UNION SELECT dst FROM links),
split AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls),
parts AS (
  SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^#]*') AS tail
  FROM split),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
judged AS (
  SELECT url, host, path, CASE WHEN strpos(url, '://') > 0 THEN lower(split_part(url, '://', 1)) || '://' || host || CASE WHEN tail LIKE '/%' THEN tail ELSE '/' || tail END END AS node,
    (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
        AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule
  FROM parts),
verdicts AS (SELECT j.*, r.verdict FROM judged j LEFT JOIN rules r ON j.rule = r.rule),
edges AS (
  SELECT DISTINCT a.node AS s, b.node AS d FROM links JOIN judged a ON a.url = links.src JOIN judged b ON b.url = links.dst WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT s, d FROM edges UNION SELECT d, s FROM edges),
reach AS (SELECT s, d FROM both_ways UNION SELECT r.s, b.d FROM reach r JOIN both_ways b ON r.d = b.s),
alias AS (
  SELECT r.s AS node, CASE WHEN bool_or(v.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reach r JOIN verdicts v ON v.node = r.d WHERE v.verdict IS NOT NULL GROUP BY r.s)
SELECT p.page_id, coalesce(v.host, '') AS host, coalesce(v.path, '') AS path, v.rule,
  coalesce(v.verdict, a.verdict, 'allow') AS verdict,
  CASE WHEN v.rule IS NOT NULL THEN 'rule' WHEN a.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM pages p LEFT JOIN verdicts v ON p.url = v.url LEFT JOIN alias a ON v.node = a.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _URL_SQL, "op5_line_dedup": lines.SQL, "op7_embedding_dedup": embeds.SQL}
