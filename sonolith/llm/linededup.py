"""Line dedup by site-relative frequency (operator 2, native).

For each site the share of its pages that hold a line is the line's page count over the site's page count; lines whose
share exceeds `ratio` are boilerplate and go. Lines travel as 64-bit hashes only: one pass counts (site, line) with
map-side combination, the few boilerplate hashes (at most pages' mean number of lines / ratio for each site) are
written, and a second pass over the texts drops them in place. Up to BROADCAST_LINES hashes no text is ever shuffled;
beyond, texts meet their site's hashes by (site, salt), with as many salts as the site has SALT_PAGES pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, let, materialise, partitions

RATIO = 0.05
MIN_SITE_PAGES = 20
MIN_LINE_PAGES = 3
#: A line of more words than this counts as a passage; the pipeline's stage drops it from MIN_LINE_PAGES pages of a site on.
LONG_WORDS = 20
#: Boilerplate hashes (8 bytes each, grouped by site) up to which their table is broadcast; beyond it a salted join.
BROADCAST_LINES, SALT_PAGES = 4_000_000, 20_000


def _line_key(line: Column, long_words: int | None = None) -> Column:
    """Hash of a line without white space at its ends; null for a blank line, which is structure and never counted.
    With long_words, the lowest bit tells lines of more words."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    if long_words is None:
        return F.when(bare != "", F.xxhash64(bare))
    many = (F.length(bare) > 2 * long_words) & (F.size(F.split(bare, r"[\x20\x09-\x0D]+")) > long_words)
    return F.when(bare != "", F.xxhash64(bare).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(many, 1).otherwise(0).cast("long")))


def boilerplate(docs: DataFrame, site: str, text: str, ratio: float, min_site_pages: int, min_line_pages: int, long_words: int | None = None) -> DataFrame:
    """(site, line long, pages of the site) of the lines that are on more than `ratio` of their site's pages, or longer than long_words."""
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda line: _line_key(line, long_words)), lambda k: k.isNotNull()))
    # one row per page stands for the page itself: line is null there
    rows = docs.select(F.col(site).alias("site"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(keys, F.array().cast("array<bigint>")))).alias("line"))
    counts = materialise(rows.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("line").isNull() | (F.col("n") >= min_line_pages)), "lines")
    pages = materialise(counts.where("line IS NULL").select(F.col("site").alias("s"), F.col("n").alias("pages")), "pages")
    lines = counts.where("line IS NOT NULL")
    small = F.broadcast(pages) if pages.count() <= BROADCAST_ROWS else pages  # a site's lines are spread by AQE beyond
    held = lines.join(small, F.col("site").eqNullSafe(F.col("s")))
    often = F.col("n") > F.col("pages") * ratio
    if long_words is not None:
        often |= F.col("line").bitwiseAND(F.lit(1)) == 1
    return held.where((F.col("pages") >= min_site_pages) & often).select("site", "line", "pages")


def dedup_lines(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO,
    min_site_pages: int = MIN_SITE_PAGES, min_line_pages: int = MIN_LINE_PAGES,
    long_words: int | None = None,
) -> DataFrame:
    """docs with `text` cleaned and two columns more, n_lines and n_dropped (int); every row of docs stays.

    Lines end at '\\n' and compare without white space at their ends; blank lines always stay. Null texts stay null
    with 0 lines, empty texts stay empty with 1 line. A null site is a site of its own. Repeated rows count as pages.
    Sites under min_site_pages and lines on fewer than min_line_pages pages lose nothing. With long_words,
    lines of more words go from min_line_pages pages on, whatever their share of the site. Columns of docs named
    n_lines or n_dropped are replaced.
    """
    bad = materialise(boilerplate(docs, site, text, ratio, min_site_pages, min_line_pages, long_words), "boilerplate")
    n_bad = bad.count()
    site_, bad_, salt_, salt2_, told_ = fresh(docs, "_site", "_bad", "_salt", "_salt2", "_told")
    by_site = bad.groupBy(F.col("site").alias(site_)).agg(F.sort_array(F.collect_set("line")).alias(bad_), F.max("pages").alias("pages"))
    same = F.col(site).eqNullSafe(F.col(site_))
    if n_bad <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(by_site.drop("pages")), same, "left")
    else:
        salts = F.ceil(F.col("pages") / SALT_PAGES).cast("int")
        big = materialise(by_site.where(F.col("pages") > SALT_PAGES).select(site_, salts.alias(salt2_)), "salts")  # a site for SALT_PAGES rows at most
        big = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
        salted = docs.join(big, same, "left").drop(site_)
        salted = salted.withColumn(salt_, F.pmod(F.xxhash64(text), F.coalesce(F.col(salt2_), F.lit(1))).cast("int")).drop(salt2_)
        copies = by_site.withColumn(salt2_, F.explode(F.sequence(F.lit(0), salts - 1))).drop("pages").repartition(partitions(docs), site_, salt2_)
        joined = salted.join(copies, same & (F.col(salt_) == F.col(salt2_)), "left")
    lines = F.split(text, "\n")

    def cleaned(ls: Column, keys: Column) -> Column:
        """Struct (n, gone, kept): lines, dropped ones, and the text of the rest; the few bad hashes of a page are found by
        one hash intersection."""
        here = F.array_intersect(F.array_compact(keys), F.col(bad_))
        keep = let(here, lambda h: F.filter(F.transform(ls, lambda line, k: F.when(F.coalesce(~F.array_contains(h, F.get(keys, k)), F.lit(True)), line)), lambda line: line.isNotNull()))
        return let(keep, lambda kept: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(kept)).alias("gone"), F.array_join(kept, "\n").alias("text")))

    told = let(lines, lambda ls: let(F.transform(ls, lambda line: _line_key(line, long_words)), lambda keys: cleaned(ls, keys)))
    plain = F.struct(F.size(lines).alias("n"), F.lit(0).alias("gone"), F.lit("").alias("text"))
    out = joined.withColumn(told_, F.when(F.col(text).isNull(), F.lit(None)).when(F.col(bad_).isNull(), plain).otherwise(told))
    t = F.col(told_)
    new = F.when(t["gone"] > 0, t["text"]).otherwise(F.col(text)).alias(text)
    numbers = [F.coalesce(t["n"], F.lit(0)).alias("n_lines"), F.coalesce(t["gone"], F.lit(0)).alias("n_dropped")]
    return out.select(*[new if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], *numbers)


def by_host(pages: DataFrame, url: str = "url", text: str = "html", **options) -> DataFrame:
    """dedup_lines with the host of each page's url as its site (a column `host`; pages without a host share one)."""
    from .urlfilter import host_of

    return dedup_lines(pages.withColumn("host", host_of(F.col(url))), "host", text, **options)
