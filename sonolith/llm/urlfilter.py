"""URL verdicts by pattern rules indexed under their rarest literal token (operator 4, native).

Every rule has literal tokens that each URL it fits must contain as whole tokens ([a-z0-9]+ between other characters).
One pass counts the rules' tokens over all URLs; each rule is filed under its rarest. A URL's tokens fetch candidate
rules from a hash-addressed index held as one literal, and only candidates run regular expressions. No shuffle but the
tiny token count; nothing depends on how often a host or a URL repeats. More than MAX_RULES rules make the index a table
(token -> rules) that the URLs' tokens are joined with; hot tokens do not go through that join's shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialise

#: Rules up to which the index is a literal of the plan, and rules of one literal beyond.
MAX_RULES, PART_RULES = 50_000, 20_000
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains where the path starts with `path`; the longest fitting rule decides."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over host + path, where the first '/' ends the host."""
        return rf"^(?:[^/]*\.)?{_escape(self.host)}{_escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        path = re.split(r"[^a-z0-9]", self.path.translate(str.maketrans(_UP, _LOW)))
        return [t for t in [*re.split(r"[^a-z0-9]", self.host), *path[:-1]] if t]  # the last may go on


@dataclass(frozen=True)
class PatternRule:
    """An URL pattern over the lower-cased URL: '*' any text, '^' one separator or an end, else literal. allow wins."""

    pattern: str
    verdict: str = "block"

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def regex(self) -> str:
        return "".join({"*": ".*", "^": "(?:^|[^a-z0-9%]|$)"}.get(c) or _escape(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.pattern)


def _escape(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", s)


def _lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or without '://'."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


ENTRIES = "array<struct<token:string,kind:string,name:string,regex:string,verdict:string,rank:int>>"


def _tokens(url: Column) -> Column:
    return F.filter(F.array_distinct(F.split(_lower(url), "[^a-z0-9]+")), lambda t: t != "")


def judge(pages: DataFrame, sites: list[SiteRule], patterns: list[PatternRule], id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages by its `url`.

    A site rule that fits decides (longest host + path wins); else an allowing pattern, else a blocking pattern, else
    allow. `rule` names the site rule only; `pattern` the deciding pattern. Null URLs: empty host and path, allow.
    Repeated rows stay, and so do null ids; other columns are not read.
    """
    rules = [*sites, *patterns]
    if len(rules) > MAX_RULES:
        return _judge_joined(pages, rules, id_col)
    base = pages.select(F.col(id_col), F.col("url"))
    wanted = sorted({t for r in rules for t in r.tokens})
    seen: dict[str, int] = {}
    if wanted:
        own = F.array_intersect(_tokens(F.col("url")), F.from_json(F.lit(json.dumps(wanted)), "array<string>"))
        counted = base.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        seen = {r["token"]: r["n"] for r in counted.collect()}  # at most one row per token of a rule
    slots = 1
    while slots < len(rules):
        slots *= 2
    everywhere, filed = [], []
    for k, r in enumerate(rules):
        site = isinstance(r, SiteRule)
        entry = {"token": "", "kind": "site" if site else r.verdict, "name": r.name, "regex": r.regex, "verdict": r.verdict, "rank": len(r.name)}
        if r.tokens:
            filed.append(entry | {"token": min(r.tokens, key=lambda t: (seen.get(t, 0), t))})
        else:
            everywhere.append(entry)
    kind = ENTRIES
    spark = pages.sparkSession
    index: list[list[dict]] = [[] for _ in range(slots)]
    if filed:
        tokens = sorted({e["token"] for e in filed})
        at = spark.range(1).select(F.from_json(F.lit(json.dumps(tokens)), "array<string>").alias("t"))
        slot = F.transform("t", lambda t: F.pmod(F.xxhash64(t), F.lit(slots)))
        where = dict(zip(tokens, at.select(slot.alias("s")).head()[0]))
        for e in filed:
            index[where[e["token"]]].append(e)
    table = F.from_json(F.lit(json.dumps(index)), f"array<{kind}>")
    always = F.from_json(F.lit(json.dumps(everywhere)), kind)
    found = F.flatten(F.transform(_tokens(F.col("url")), lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")), lambda r: r["token"] == t)))
    both = F.concat(F.coalesce(found, F.array().cast(kind)), always)
    cut = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "low": F.coalesce(_lower(F.col("url")), F.lit(""))})
    return _decided(cut.withColumn("fits", _fitting(both)), id_col)


def _fitting(entries: Column) -> Column:
    """Those of the entries whose regular expression the URL's host + path, or the whole of it, fits."""
    site_text = F.concat("host", "path")
    return F.filter(entries, lambda r: F.when(r["kind"] == "site", F.regexp(site_text, r["regex"])).otherwise(F.regexp(F.col("low"), r["regex"])))


def _decided(cut: DataFrame, id_col: str) -> DataFrame:
    """The verdict columns from the fitting rules of each row."""
    best = lambda k: F.array_max(F.transform(F.filter("fits", lambda r: r["kind"] == k), lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    cut = cut.withColumns({"site": best("site"), "yes": best("allow"), "no": best("block")})
    by_pattern = F.when(F.col("yes").isNotNull(), "allow").when(F.col("no").isNotNull(), "block").otherwise("allow")
    return cut.select(
        id_col, "host", "path", F.col("site.name").alias("rule"), F.coalesce("site.verdict", by_pattern).alias("verdict"),
        F.when(F.col("site").isNull(), F.coalesce("yes.name", "no.name")).alias("pattern"),
    )


def _judge_joined(pages: DataFrame, rules: list[SiteRule | PatternRule], id_col: str) -> DataFrame:
    """judge() with the index as a table; rules without any token are still tried on every URL."""
    spark = pages.sparkSession
    entry = lambda r: {"token": "", "kind": "site" if isinstance(r, SiteRule) else r.verdict, "name": r.name, "regex": r.regex, "verdict": r.verdict, "rank": len(r.name)}
    filed = [entry(r) | {"tokens": r.tokens} for r in rules if r.tokens]
    parts = [filed[k : k + PART_RULES] for k in range(0, len(filed), PART_RULES)] or [[]]
    kind = ENTRIES.replace("rank:int", "rank:int,tokens:array<string>")
    table = None
    for p in parts:
        part = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(p)), kind)).alias("r")).select("r.*")
        table = part if table is None else table.unionAll(part)
    table = materialise(table.withColumn("rule", F.monotonically_increasing_id()), "rules")
    base = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), "url")
    base = materialise(base.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(_lower(F.col("url")), F.lit("")).alias("low")), "urls")
    asked = base.select("uid", "host", "path", "low", F.explode(_tokens(F.col("url"))).alias("token"))
    own = table.select("rule", F.explode("tokens").alias("token")).distinct()
    asked = materialise(asked.join(own.select("token").distinct(), "token", "left_semi"), "asked")
    seen = asked.groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    fields = [c.split(":")[0] for c in ENTRIES[len("array<struct<") : -2].split(",")]
    index = table.drop("token").join(rarest, "rule").groupBy("token").agg(F.collect_list(F.struct(*fields)).alias("entries"))
    met = join_unique(asked, materialise(index, "index"), "token", "inner").select("uid", F.explode(_fitting(F.col("entries"))).alias("r"))
    fits = met.groupBy("uid").agg(*[F.max(F.when(F.col("r.kind") == k, F.struct("r.rank", "r.name", "r.verdict", "r.kind", "r.token", "r.regex"))).alias(k) for k in ("site", "allow", "block")])
    always = F.from_json(F.lit(json.dumps([entry(r) for r in rules if not r.tokens])), ENTRIES)
    found = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(*[F.col(f"{k}.{f}").alias(f) for f in fields])) for k in ("site", "allow", "block")]))
    cut = base.join(fits, "uid", "left").select(F.col("id").alias(id_col), "url", "host", "path", "low", found.cast(ENTRIES).alias("found"))
    return _decided(cut.withColumn("fits", F.concat("found", _fitting(always))), id_col)
