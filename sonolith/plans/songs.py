"""Queries over songs and files: names, groups of variants, deduplication, listings. Metadata derive from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores
from ..operators import dedupe, report
from ..sources import files
from . import catalogue as prints_of
from .registry import ORACLE_SQL, query, table

# Name, place and encoding of a derived song: five documents in a row are one song, the first of them its base file.
SONGS = """s AS (SELECT doc_id AS soid, '/music/' || (doc_id // 100) AS dir, 'Song ' || (doc_id // 5) AS base, 'Artist ' || (doc_id // 100) AS artist, 'Song ' || (doc_id // 5) AS title,
  CASE WHEN doc_id % 5 = 0 THEN '.mp3' WHEN doc_id % 2 = 0 THEN '_44100_s_' || (64 + 64 * (doc_id % 5)) || '_-50_.mp3' ELSE '_22050_s_' || (64 + 64 * (doc_id % 5)) || '_vbr_-50_.flac' END AS ending FROM documents)"""


def songs(spark, sf_dir) -> DataFrame:
    """(soid, path, artist, title) of the derived files."""
    rate = F.expr("64 + 64 * (doc_id % 5)").cast("string")
    ending = F.when(F.col("doc_id") % 5 == 0, ".mp3").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_44100_s_"), rate, F.lit("_-50_.mp3"))).otherwise(F.concat(F.lit("_22050_s_"), rate, F.lit("_vbr_-50_.flac")))
    title = F.concat(F.lit("Song "), F.expr("doc_id div 5").cast("string"))
    path = F.concat(F.lit("/music/"), F.expr("doc_id div 100").cast("string"), F.lit("/"), title, ending)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("soid"), path.alias("path"), F.concat(F.lit("Artist "), F.expr("doc_id div 100").cast("string")).alias("artist"), title.alias("title"))


@query(f"WITH {SONGS} SELECT soid, dir, base, ending = '.mp3' AS is_base FROM s")
def group_files(spark, sf_dir):
    """Variants and their base file share a folder and a base name."""
    return report.grouped(songs(spark, sf_dir)).select("soid", "dir", "base", "is_base")


@query(prints_of.PRINTS + f""", {SONGS}, m AS (SELECT s.*, f AS fp, CASE WHEN ending LIKE '%.flac' THEN '.flac' ELSE '.mp3' END AS enc, CASE WHEN soid % 3 = 0 THEN 320 ELSE 64 + 64 * (soid % 5) END AS br, CASE WHEN ending LIKE '%_vbr_%' THEN 1 ELSE 0 END AS vbr, CASE WHEN ending = '.mp3' THEN 0 ELSE -50 END AS vol, dir || '/' || base || ending AS fn
  FROM s JOIN fp f USING (soid)),
pairs AS (SELECT x.*, y.fn AS fn2, y.enc AS enc2, y.br AS br2, y.vbr AS vbr2, y.vol AS vol2, x.fp AS fa, y.fp AS fb FROM m x JOIN m y ON x.dir = y.dir AND x.base = y.base AND x.fn < y.fn)
SELECT fn AS fn1, fn2, artist, title, enc AS enc1, br::BIGINT AS br1, 44100::BIGINT AS fq1, 2::BIGINT AS cn1, vbr AS is_vbr1, vol AS vol_change1, enc2, br2::BIGINT AS br2, 44100::BIGINT AS fq2, 2::BIGINT AS cn2, vbr2 AS is_vbr2, vol2 AS vol_change2,
  round({prints_of._cp('fa', 'fb')}, 9) AS cp, round({prints_of._fm('fa', 'fb')}, 9) AS fm FROM pairs""")
def regression_report(spark, sf_dir):
    """All pairs of variants within their group: the sixteen columns of the report."""
    rows = report.grouped(songs(spark, sf_dir)).withColumn("fn", F.col("path")).withColumn("enc", F.regexp_extract("path", r"(\.[a-z0-9]+)$", 1))
    rows = rows.withColumn("bit_rate", F.when(F.col("soid") % 3 != 0, F.expr("64 + 64 * (soid % 5)"))).withColumns({"sample_rate": F.lit(None).cast("long"), "channels": F.lit(None).cast("long")})
    fp = prints_of.prints(spark, sf_dir).select("soid", "r32", "dom16", "cprint")
    out = report.comparison(rows.join(fp, "soid"))
    return out.withColumns({"cp": F.round("cp", 9), "fm": F.round("fm", 9)})


@query("SELECT lang, source, min(doc_id) OVER (PARTITION BY lang, source) AS base, count(*) OVER (PARTITION BY lang, source) AS n, doc_id FROM documents")
def group_variants_report(spark, sf_dir):
    """Every member of a group with the group's base and size, one row a member."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    bases = rows.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.min("doc_id").alias("base"), F.count("*").alias("n"))
    both = rows.join(bases, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    return both.select("lang", "source", "base", "n", "doc_id")


#: Artist, title and album of a document: its source, its first words, the next ones and a remark.
_META = """m AS (SELECT doc_id AS oid, source AS artist, array_to_string(list_slice(string_split(lower(text), ' '), 1, 4), ' ') AS title,
  array_to_string(list_slice(string_split(lower(text), ' '), 5, 7), ' ') || CASE doc_id % 6 WHEN 1 THEN ' (clean edit)' WHEN 2 THEN ' live' WHEN 3 THEN ' [bonus cd2]' ELSE '' END AS album FROM documents)"""


def metadata(spark, sf_dir) -> DataFrame:
    """(oid, artist, artists, title, album, bit_rate, num_errors)."""
    words = lambda a, n: F.array_join(F.slice(F.split(F.lower("text"), " "), a, n), " ")
    remark = F.when(F.col("doc_id") % 6 == 1, " (clean edit)").when(F.col("doc_id") % 6 == 2, " live").when(F.col("doc_id") % 6 == 3, " [bonus cd2]").otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("oid"), F.col("source").alias("artist"), F.array("source", "lang").alias("artists"), words(1, 4).alias("title"), F.concat(words(5, 3), remark).alias("album"),
        F.expr("64 + 64 * (doc_id % 5)").alias("bit_rate"), F.expr("doc_id % 4").alias("num_errors"),
    )


@query(f"WITH {_META} SELECT oid, lower(regexp_replace(artist || title, '\\s+', '', 'g')) AS key, artist || '_' || title AS name FROM m")
def name_key(spark, sf_dir):
    return metadata(spark, sf_dir).select("oid", names.name_key(F.col("artist"), F.col("title")).alias("key"), names.display_name(F.col("artist"), F.col("title")).alias("name"))


@query(f"""WITH {_META} SELECT oid, regexp_matches(album, '(live\\s+in|.+?\\blive\\s*$)') AS live, album LIKE '%(clean edit)%' AS clean, CASE WHEN album LIKE '%(clean edit)%' THEN 'clean edit' ELSE '' END AS remark,
  regexp_extract(album, '((?:dis[ckq]u?e?|track?)\\s*[a-z0-9-]+)', 1) AS disc FROM m""")
def album_remarks(spark, sf_dir):
    """What an album's name says: live, clean edit, disc."""
    told = metadata(spark, sf_dir).select("oid", names.is_live(F.col("album")).alias("live"), names.clean_remark(F.col("album")).alias("c"), names.disc(F.col("album")).alias("disc"))
    return told.select("oid", "live", "c.clean", "c.remark", "disc")


def song_pairs(spark, sf_dir) -> DataFrame:
    """(oid1, oid2, sm): documents with equal keys of 40 letters of their names, and the likeness of their whole names."""
    meta = metadata(spark, sf_dir).select("oid", names.name_key(F.col("artist"), F.col("title")).alias("key"), F.substring("title", 1, 12).alias("head"))
    two = meta.select(F.col("oid").alias("oid2"), F.col("key").alias("key2"), "head")
    pairs = meta.join(two, "head").where("oid < oid2").select(F.col("oid").alias("oid1"), "oid2", names.ratio("key", "key2").alias("sm"))
    return pairs


@query()
def same_songs(spark, sf_dir):
    return dedupe.same_song(dedupe.both_ways(song_pairs(spark, sf_dir), "sm"), metadata(spark, sf_dir))


@query()
def dedupe_songs(spark, sf_dir):
    """Duplicates by name, album, artists and remarks, with the copy to keep."""
    _, dupes, _ = dedupe.dedupe(song_pairs(spark, sf_dir), metadata(spark, sf_dir))
    return dupes.select("oid", F.array_join(F.transform("dupe_of", lambda x: x.cast("string")), ",").alias("dupe_of"))


@query()
def seq_ratio(spark, sf_dir):
    """Likeness of whole names: the address of each page and of the next one."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("name").alias("other"))
    return pages.join(after, "page_id").select("page_id", names.ratio("name", "other").alias("ratio"))


@query("""WITH d AS (SELECT doc_id AS soid, n_chars // 100 AS grp, 64 + 64 * (doc_id % 5) AS bit_rate, doc_id % 4 AS num_errors FROM documents)
SELECT soid, grp, row_number() OVER (PARTITION BY grp ORDER BY (num_errors <= 1) DESC, CASE WHEN num_errors <= 1 THEN bit_rate END DESC NULLS LAST, num_errors, bit_rate DESC, soid) AS place FROM d""")
def best_of_election(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS soid", "n_chars div 100 AS grp", "64 + 64 * (doc_id % 5) AS bit_rate", "doc_id % 4 AS num_errors")
    return dedupe.elect(rows, "grp").select("soid", "grp", F.col("place").cast("long").alias("place"))


@query("""WITH d AS (SELECT doc_id AS soid, n_chars // 100 AS grp, 64 + 64 * (doc_id % 5) AS bit_rate, doc_id % 4 AS num_errors FROM documents),
e AS (SELECT soid, grp, row_number() OVER (PARTITION BY grp ORDER BY (num_errors <= 1) DESC, CASE WHEN num_errors <= 1 THEN bit_rate END DESC NULLS LAST, num_errors, bit_rate DESC, soid) AS place FROM d)
SELECT x.soid AS oid, y.soid AS dupe_of FROM e x JOIN e y ON x.grp = y.grp AND y.place = 1 AND x.place > 1""")
def dupe_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS soid", "n_chars div 100 AS grp", "64 + 64 * (doc_id % 5) AS bit_rate", "doc_id % 4 AS num_errors")
    return dedupe.dupe_table(rows, dedupe.elect(rows, "grp"))


@query(ORACLE_SQL["all_pairs_results"].replace(" SELECT a, b, round(cp, 9) AS cp, round(fm, 9) AS fm FROM scored", f" SELECT a AS oid1, b AS oid2, round({prints_of._poly('cp', 'fm')}, 9) AS weight FROM scored"))
def song_graph(spark, sf_dir):
    """Weighted edges of all results."""
    from ..operators import similarity

    rows = similarity.all_pairs_results(prints_of.prints(spark, sf_dir)).withColumnsRenamed({"a": "oid1", "b": "oid2"})
    return dedupe.graph(rows, scores.polynomial).withColumn("weight", F.round("weight", 9))


@query("""WITH l AS (SELECT x.vec_id // 50 AS song, x.vec_id // 50 = y.vec_id // 50 AS same, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS value FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND y.vec_id % 50 = 1),
s AS (SELECT sum(CASE WHEN same THEN value ELSE 0 END) AS diag, sum(value) AS tot, count(DISTINCT song)::DOUBLE AS n FROM l)
SELECT round(diag / n, 6) AS tp, round((tot - diag) / (n * n - n), 6) AS fp, round(diag / tot, 6) AS score FROM s""")
def confusion_summary(spark, sf_dir):
    """Originals (every fiftieth vector) against their variants (the vectors after them): mean likeness of the right and of
    the wrong pairs. The originals are a query set, held against all variants."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("song"), F.col("embedding").cast("array<double>").alias("v"))
    one = rows.where("vec_id % 50 = 0").select("song", "v")
    two = rows.where("vec_id % 50 = 1").select(F.col("song").alias("song2"), F.col("v").alias("v2"))
    # blocks of originals meet blocks of variants on a key, so no nested loop
    met = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(two.withColumn("block", F.pmod(F.xxhash64("song2"), F.lit(8)).cast("int")), "block")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = met.select("song", (F.col("song") == F.col("song2")).alias("same"), (dot("v", "v2") / F.sqrt(dot("v", "v") * dot("v2", "v2"))).alias("value"))
    return report.confusion(scored).select(*[F.round(c, 6).alias(c) for c in ("tp", "fp", "score")])


@query("""SELECT path, name FROM (SELECT regexp_replace(url, '/+', '/', 'g') AS path, regexp_extract(url, '[^/]*$') AS name FROM pages) WHERE regexp_matches(name, '\\.html$|^[0-9]+$')""")
def file_listing(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(files.normal_path(F.col("url")).alias("path"))
    return files.listing(paths, [r"\.html$", r"^[0-9]+$"]).select("path", "name")


@query("""WITH p AS (SELECT regexp_replace(url, '/+', '/', 'g') AS path FROM pages), d AS (SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS dirs, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT path, name, len(dirs)::BIGINT AS depth FROM d WHERE NOT list_contains(dirs, 'fr') AND len(dirs) <= 3 AND regexp_matches(name, '^[0-9]+$') ORDER BY name DESC, path LIMIT 50""")
def pruned_listing(spark, sf_dir):
    """Names that match wholly, no deeper than three folders, without what lies under pruned folders; by name, backwards.
    The limit is the feature."""
    paths = table(spark, sf_dir, "pages").select(files.normal_path(F.col("url")).alias("path"))
    out = files.listing(paths, [files.whole(r"[0-9]+")], limit=50, descending=True, exclude=["^fr$"], max_depth=3)
    return out.select("path", "name", F.col("depth").cast("long").alias("depth"))


@query("""SELECT page_id, split_part(regexp_extract(url, '[^/]*$'), '-', 1) AS song, count(*) OVER (PARTITION BY split_part(regexp_extract(url, '[^/]*$'), '-', 1)) AS n FROM pages""")
def evaluation_pairs(spark, sf_dir):
    """Files of one song share what stands before the first hyphen."""
    rows = report.paired_names(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")))
    sizes = rows.groupBy(F.col("song").alias("s")).agg(F.count("*").alias("n"))
    return rows.join(sizes, F.col("song").eqNullSafe(F.col("s"))).select("page_id", "song", "n")
