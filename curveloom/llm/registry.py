"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveloom.llm import (
    alignment, audit, language, lines, mixing, neighbours, packing, rules, secret_spans, set_join,
    simhash, tokens, urls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS stop FROM sources
), levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(stop) OVER (
      ORDER BY stop::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY stop::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS level FROM weighted
), chosen AS (
  SELECT level FROM levels WHERE level * weight <= stop ORDER BY stop::DOUBLE / weight, place LIMIT 1
), targets AS (
  SELECT source, source_size, n_docs, place,
    least(stop::DOUBLE, coalesce((SELECT level FROM chosen) * weight, stop::DOUBLE)) AS target FROM weighted
), seats AS (
  SELECT floor(1.5e0 * sum(source_size) / 32 + 0.5)::BIGINT AS n FROM sources
), source_quota AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r
    FROM (SELECT place, target, unnest(range(0, 2 + (target / 16)::BIGINT)) AS k FROM targets WHERE target > 0)
  ) WHERE r <= (SELECT n FROM seats) GROUP BY place
), drawn AS (
  SELECT s.doc_id, s.size, t.place, t.source_size, t.target,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || '|shard|42'), 1, 15))::BIGINT
      % ceil(t.n_docs / 512e0)::BIGINT AS shard,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || '|order|42'), 1, 15))::BIGINT AS draw
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shards AS (
  SELECT place, shard // 1024 AS part, shard, sum(size)::BIGINT AS shard_size FROM drawn GROUP BY ALL
), parts AS (
  SELECT place, part, sum(shard_size) AS part_size, quota FROM shards LEFT JOIN source_quota USING (place) GROUP BY ALL
), part_quota AS (
  SELECT place, part, count(*) AS part_quota FROM (
    SELECT place, part, quota,
      row_number() OVER (PARTITION BY place ORDER BY part_size / (2 * k + 1) DESC, part) AS r
    FROM (SELECT *, unnest(range(0, coalesce(quota, 0))) AS k FROM parts WHERE part_size > 0)
  ) WHERE r <= quota GROUP BY ALL
), shard_quota AS (
  SELECT place, shard, count(*) AS blocks FROM (
    SELECT place, shard, part_quota,
      row_number() OVER (PARTITION BY place, part ORDER BY shard_size / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(0, part_quota)) AS k FROM shards JOIN part_quota USING (place, part)
          WHERE shard_size > 0)
  ) WHERE r <= part_quota GROUP BY ALL
), runs AS (
  SELECT place, shard, shard_size, least(coalesce(blocks, 0) * 32, 2 * shard_size) AS run,
    ('0x' || substr(md5(place || '|' || shard || '|start|42'), 1, 15))::BIGINT
      % greatest(1, ceil(shard_size / 32e0)::BIGINT) * 32 AS start
  FROM shards LEFT JOIN shard_quota USING (place, shard)
), ring AS (
  SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM drawn JOIN runs USING (place, shard)
), passes AS (
  SELECT *, stop - size AS begin, CASE WHEN shard_size > 0 THEN run // shard_size ELSE 0 END AS whole,
    CASE WHEN shard_size > 0 THEN run % shard_size ELSE 0 END AS rest FROM ring
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * whole + greatest(0, least(stop, start + rest) - greatest(begin, start))
   + greatest(0, least(stop, start + rest - shard_size) - begin))::BIGINT AS taken
FROM passes
"""


@query("op2_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(table(spark, folder, "documents"))


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), known AS (
  SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS address,
    string_split(host, '.') AS names FROM parts
), listed AS (
  SELECT DISTINCT address FROM known WHERE len(names) >= 3 AND address <> '' AND names[-3] IN
    ('casino-win', 'ads-track', 'free-bets', 'spam-farm', 'cheap-pills', 'adult-x')
), rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT k.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (
    PARTITION BY k.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM known k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
)
SELECT k.page_id, k.host, k.path, f.rule,
  coalesce(f.verdict, CASE WHEN l.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.address IS NOT NULL AS listed
FROM known k LEFT JOIN fitting f ON f.page_id = k.page_id AND f.n = 1 LEFT JOIN listed l ON l.address = k.address
"""


@query("op3_url_filter", URL_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judge_urls(pages, urls.listed_pages(pages))


@query("op4_secret_spans")
def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans.find_secrets(table(spark, folder, "documents"))


LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last_doc <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE last_doc IS NULL OR last_doc = doc_id), ''))
    AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_digest(table(spark, folder, "documents"))


@query("op6_nearest_vectors")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, folder, "embeddings"))


@query("op7_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"))


@query("op8_simhash")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op9_packing")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(table(spark, folder, "documents"))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least
  FROM docs
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > least, false)] AS fails
  FROM worded LEFT JOIN marks USING (doc_id)
), patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM judged GROUP BY ALL
), letters AS (SELECT unnest(range(1, 6)) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, 15 - a.i - b.i - c.i - d.i] AS places FROM letters a, letters b, letters c, letters d
  WHERE a.i <> b.i AND a.i <> c.i AND b.i <> c.i AND a.i <> d.i AND b.i <> d.i AND c.i <> d.i
), steps AS (
  SELECT places, array_to_string(list_transform(places, lambda p: 'ABCDE'[p]), '') AS filter_order,
    unnest(range(1, 6)) AS step FROM orders
), counted AS (
  SELECT part, filter_order, step, places[step] AS own,
    sum(n) FILTER (WHERE NOT before AND NOT fails[places[step]]) AS kept,
    sum(n) FILTER (WHERE NOT before AND fails[places[step]]) AS removed,
    sum(n) FILTER (WHERE before AND fails[places[step]]) AS redundant,
    sum(n) FILTER (WHERE fails[places[step]] AND len(list_filter(fails, lambda f: f)) = 1) AS unique_fails,
    sum(n_good) FILTER (WHERE NOT before AND fails[places[step]]) AS good_lost,
    sum(n_toxic) FILTER (WHERE NOT before AND fails[places[step]]) AS toxic_lost
  FROM (SELECT *, len(list_filter(places[1:step - 1], lambda p: fails[p])) > 0 AS before FROM patterns, steps) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_support(table(spark, folder, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


@query("op11_set_join")
def similar_shingle_sets(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.similar_sets(table(spark, folder, "documents"))
