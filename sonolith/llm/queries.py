"""One query for each operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, packing, pivots, rules, secrets, simhash, sketch, tokens, toxicity, urlfilter
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows mixed by op1's weights of the sources."""
    return packing.pack(table(spark, sf_dir, "documents"), weights=mixing.default_weights)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules.SITE_RULES, rules.PATTERN_RULES).drop("pattern")


def op5_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_line_dedup, op3_pack_sequences, op4_url_rules, op5_pivot_near_dedup, op6_toxicity, op7_bottom_k, op8_token_counts, op9_secret_scan, op10_simhash)
}


def _pattern_sql() -> str:
    said = lambda p: f"regexp_matches(low, '{p.regex}')"
    yes = " OR ".join(said(p) for p in rules.PATTERN_RULES if p.verdict == "allow")
    no = " OR ".join(said(p) for p in rules.PATTERN_RULES if p.verdict == "block")
    return f"CASE WHEN {yes} THEN 'allow' WHEN {no} THEN 'block' ELSE 'allow' END"


def _site_sql() -> str:
    cases = sorted(rules.SITE_RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}|{r.verdict}'" for r in cases) + " END"


def _sql_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, bare, count(DISTINCT doc_id) AS n FROM keyed WHERE bare <> '' GROUP BY source, bare),
bad AS (
  SELECT c.source, c.bare FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE p.pages >= {linededup.MIN_SITE_PAGES} AND c.n >= {linededup.MIN_LINE_PAGES} AND c.n > p.pages * {linededup.RATIO}::DOUBLE),
marked AS (SELECT k.*, b.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id, source
UNION ALL SELECT doc_id, source, NULL, 0, 0 FROM documents WHERE text IS NULL""",
    "op4_url_rules": f"""
WITH cut AS (
  SELECT page_id, coalesce({_sql_lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce({_sql_lower("url")}, '') AS low
  FROM pages),
found AS (SELECT *, {_site_sql()} AS site, {_pattern_sql()} AS method FROM cut)
SELECT page_id, host, path, split_part(site, '|', 1) AS rule, coalesce(split_part(site, '|', 2), method) AS verdict FROM found""",
    "op5_pivot_near_dedup": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {pivots.COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM comp c LEFT JOIN deg d USING (vec_id)""",
}
