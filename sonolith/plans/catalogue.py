"""Queries over the driver's tables and the DuckDB SQL that says the same: fingerprints and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literal, names, scores, unions
from ..operators import alignment, dedupe, index, signal, similarity
from ..schema import FIELDS
from ..storage import materialise
from .registry import ORACLE_SQL, QUERIES, query, table

# -- derived fingerprints -------------------------------------------------------------------------------------------------

PRINTS = """
WITH tok AS (SELECT doc_id, n_chars, lang, source, list_transform(string_split(lower(text), ' '), lambda t: md5(t)) AS m FROM documents),
fp AS (SELECT doc_id AS soid, n_chars AS songlen, 64 + 64 * (doc_id % 5) AS bit_rate, doc_id % 4 AS num_errors, lang, source,
  list_transform(range(1, 88), lambda i: coalesce(('0x' || substr(m[i], 1, 8))::BIGINT, 0)) AS r32,
  list_transform(range(1, 34), lambda i: coalesce(('0x' || substr(m[i], 9, 4))::BIGINT, 0)) AS dom16,
  list_transform(m, lambda t: ('0x' || substr(t, 1, 8))::BIGINT) AS cprint FROM tok)"""


def derived(docs: DataFrame) -> DataFrame:
    """Fingerprints derived from documents: soid, the six fields, lang, source; cprint has a word for each word of the text."""
    docs = docs.selectExpr("doc_id", "n_chars", "lang", "source", "transform(split(lower(text), ' '), t -> md5(t)) AS m")
    word = lambda t, at, n: f"CAST(conv(substr({t}, {at}, {n}), 16, 10) AS BIGINT)"
    return docs.selectExpr(
        "doc_id AS soid", "n_chars AS songlen", "64 + 64 * (doc_id % 5) AS bit_rate", "doc_id % 4 AS num_errors", "lang", "source",
        f"transform(sequence(0, 86), i -> coalesce({word('get(m, i)', 1, 8)}, 0L)) AS r32", f"transform(sequence(0, 32), i -> coalesce({word('get(m, i)', 9, 4)}, 0L)) AS dom16",
        f"transform(m, t -> {word('t', 1, 8)}) AS cprint",
    )


_stored: dict[tuple[str, str], DataFrame] = {}


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of fingerprints: derived once in a session and written as the documents lie. In order of song length the
    longest would be the work of one task."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = materialise(derived(table(spark, sf_dir, "documents")), "prints")
    return _stored[key]


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each print with the one of the next id: a, b and structs fa, fb. An equi-join."""
    fp = prints(spark, sf_dir).select("soid", F.struct(*FIELDS).alias("fp"))
    right = fp.select(F.col("soid").alias("b"), (F.col("soid") - 1).alias("a"), F.col("fp").alias("fb"))
    return fp.select(F.col("soid").alias("a"), F.col("fp").alias("fa")).join(right, "a")


NEXT = PRINTS + ", pairs AS (SELECT l.soid AS a, r.soid AS b, l AS fa, r AS fb FROM fp l JOIN fp r ON r.soid = l.soid + 1)"
_SUM = "coalesce(list_sum(list_transform({0}, lambda i: {1})), 0)::BIGINT"


def _dibit(x: str) -> str:
    return f"(bit_count({x} & 1431655765) + 4 * bit_count({x} & 2863311530) + 4 * bit_count({x} & ({x} >> 1) & 1431655765))::BIGINT"


def _r(a: str, b: str, op: str = "xor({0}, {1})") -> str:
    return _SUM.format("range(1, 88)", _dibit("(" + op.format(f"{a}.r32[i]", f"{b}.r32[i]") + ")"))


def _dom(a: str, b: str, op: str = "xor({0}, {1})") -> str:
    return _SUM.format("range(1, 34)", "bit_count(" + op.format(f"{a}.dom16[i]", f"{b}.dom16[i]") + ")::BIGINT")


def _conf(r: str, d: str) -> str:
    return f"greatest(least(2::DOUBLE * ((1::DOUBLE - ({r} + {d}) / 25584::DOUBLE) - 0.5::DOUBLE), 1::DOUBLE), 0::DOUBLE)"


def _fm(a: str, b: str) -> str:
    return _conf(_r(a, b), _dom(a, b))


def _n(a: str, b: str) -> str:
    return f"least(len({a}.cprint), len({b}.cprint))"


def _cp(a: str, b: str) -> str:
    hits = _SUM.format(f"range(1, {_n(a, b)} + 1)", f"CASE WHEN ({a}.cprint[i] & -{a}.cprint[i]) = ({b}.cprint[i] & -{b}.cprint[i]) THEN 1 ELSE 0 END")
    return f"(CASE WHEN {_n(a, b)} = 0 THEN 0::DOUBLE ELSE {hits} / greatest(len({a}.cprint), len({b}.cprint))::DOUBLE END)"


def _poly(cp: str, fm: str) -> str:
    return f"((0.012985::DOUBLE + 0.263439::DOUBLE * {fm} - 0.683234::DOUBLE * {cp} + 1.592623::DOUBLE * {cp} * {cp} * {cp} + 0.06348::DOUBLE) / 1.2489::DOUBLE)"


def _gate(a: str, b: str) -> str:
    return f"10 * abs({a}.songlen - {b}.songlen) <= least({a}.songlen, {b}.songlen)"


def _scored(pairs: str) -> str:
    """cp, fm and score of a relation with fa and fb."""
    return f"""(SELECT a, b, cp, fm, CASE WHEN inside THEN {_poly('cp', 'fm')} ELSE 0::DOUBLE END AS score
  FROM (SELECT a, b, {_gate('fa', 'fb')} AS inside, {_cp('fa', 'fb')} AS cp, {_fm('fa', 'fb')} AS fm FROM {pairs}))"""


GATED = PRINTS + f", gated AS (SELECT fa.soid AS a, fb.soid AS b, fa, fb FROM fp fa JOIN fp fb ON fa.soid < fb.soid AND {_gate('fa', 'fb')}), scored AS {_scored('gated')}"


@query(PRINTS + " SELECT soid, songlen, bit_rate, num_errors, len(cprint) AS cprint_len, list_sum(r32)::BIGINT AS r_sum, list_sum(dom16)::BIGINT AS dom_sum FROM fp")
def fp_accessors(spark, sf_dir):
    total = scores.total
    return prints(spark, sf_dir).selectExpr("soid", "songlen", "bit_rate", "num_errors", "CAST(size(cprint) AS BIGINT) AS cprint_len", f"{total('r32')} AS r_sum", f"{total('dom16')} AS dom_sum")


@query(PRINTS + """ SELECT soid, md5('(' || songlen || ',' || bit_rate || ',' || num_errors || ',' || list_aggregate(list_transform(r32, lambda w: printf('%08X', w)), 'string_agg', '') || ','
  || list_aggregate(list_transform(dom16, lambda w: printf('%04X', w)), 'string_agg', '') || ',' || list_aggregate(list_transform(cprint, lambda x: (CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END)::VARCHAR), 'string_agg', ' ') || ')') AS digest, true AS same FROM fp""")  # fmt: skip
def fp_literal_roundtrip(spark, sf_dir):
    fp = prints(spark, sf_dir).select("soid", F.struct(*FIELDS).alias("fp")).withColumn("t", F.expr(literal.text_of("fp")))
    return fp.selectExpr("soid", "md5(t) AS digest", f"fp = {literal.parsed('t')} AS same")


@query(NEXT + f" SELECT a, b, {_r('fa', 'fb')} AS r_distance, {_dom('fa', 'fb')} AS dom_distance FROM pairs")
def popcount_dibit_distance(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"{scores.r_distance('fa.r32', 'fb.r32')} AS r_distance", f"{scores.dom_distance('fa.dom16', 'fb.dom16')} AS dom_distance")


@query(NEXT + f" SELECT a, b, round({_fm('fa', 'fb')}, 9) AS fm FROM pairs")
def fooid_confidence(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"round({scores.fm('fa', 'fb')}, 9) AS fm")


@query(NEXT + f" SELECT a, b, round({_cp('fa', 'fb')}, 9) AS cp FROM pairs")
def lowbit_score(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"round({scores.cp('fa.cprint', 'fb.cprint')}, 9) AS cp")


@query(NEXT + f" SELECT a, b, round(score, 9) AS score, score > 0.98::DOUBLE AS eq, score <= 0.98::DOUBLE AS neq, score > 0.6::DOUBLE AS match FROM {_scored('pairs')}")
def blend_score_operators(spark, sf_dir):
    scores.register(spark)
    rows = neighbours(spark, sf_dir).selectExpr("a", "b", "fprint_cmp(fa, fb) AS score")
    return rows.selectExpr("a", "b", "round(score, 9) AS score", "score > 0.98D AS eq", "score <= 0.98D AS neq", "score > 0.6D AS match")


@query(GATED + " SELECT a, b, round(score, 9) AS score FROM scored WHERE score > 0.6::DOUBLE")
def similarity_matches(spark, sf_dir):
    return similarity.similarity_join(prints(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


PROBES = GATED.split(", gated AS")[0] + f", pairs AS (SELECT fa.soid AS a, fb.soid AS b, fa, fb FROM fp fa JOIN fp fb ON fa.soid % 100 = 0 AND fb.soid <> fa.soid AND {_gate('fa', 'fb')}), hits AS (SELECT a, b, score FROM {_scored('pairs')} WHERE score > 0.6::DOUBLE)"


def probes(spark, sf_dir) -> DataFrame:
    """The query set of searches: every print whose id is divisible by 100."""
    return prints(spark, sf_dir).where("soid % 100 = 0")


@query(PROBES + " SELECT a AS soid, b AS match, round(score, 9) AS score FROM hits")
def self_match_by_id(spark, sf_dir):
    return similarity.probe(prints(spark, sf_dir), probes(spark, sf_dir)).select("soid", "match", F.round("score", 9).alias("score"))


@query(PROBES + " SELECT a AS soid, b AS match, round(score, 9) AS score FROM hits")
def probe_by_literal(spark, sf_dir):
    """Searches by text literals: each is parsed, then matched like a stored print."""
    texts = probes(spark, sf_dir).select("soid", F.struct(*FIELDS).alias("fp")).selectExpr("soid", f"{literal.text_of('fp')} AS t")
    asked = texts.selectExpr("soid", f"{literal.parsed('t')} AS fp").select("soid", "fp.*")
    return similarity.probe(prints(spark, sf_dir), materialise(asked, "asked")).select("soid", "match", F.round("score", 9).alias("score"))


@query(PROBES + f""", second AS (SELECT fa.soid AS a, fb.soid AS b, fa, fb FROM fp fa JOIN fp fb ON fa.soid IN (SELECT b FROM hits) AND fb.soid <> fa.soid AND {_gate('fa', 'fb')}),
hops AS (SELECT a, b, score FROM {_scored('second')} WHERE score > 0.6::DOUBLE)
SELECT h.a AS origin, s.a AS soid, s.b AS match, round(s.score, 9) AS score FROM hits h JOIN hops s ON s.a = h.b AND s.b <> h.a""")
def second_hop(spark, sf_dir):
    return similarity.second_hop(prints(spark, sf_dir), probes(spark, sf_dir)).select("origin", "soid", "match", F.round("score", 9).alias("score"))


BOTH = GATED + ", hits AS (SELECT a, b, score FROM scored WHERE score > 0.6::DOUBLE), both_ AS (SELECT a, b AS m, score FROM hits UNION ALL SELECT b, a, score FROM hits)"


@query(BOTH + """ SELECT x.a, x.m, round(x.score, 9) AS score FROM both_ x WHERE NOT EXISTS
  (SELECT 1 FROM both_ y WHERE y.a = x.m AND y.m <> x.a AND y.score > 1.05::DOUBLE * x.score)""")
def overreach_filter(spark, sf_dir):
    hits = materialise(similarity.similarity_join(prints(spark, sf_dir)), "hits")  # read several times
    return similarity.without_overreach(hits).select("a", "m", F.round("score", 9).alias("score"))


@query(GATED + " SELECT a, b, round(cp, 9) AS cp, round(fm, 9) AS fm FROM scored WHERE cp > 0.72::DOUBLE AND fm > 0.72::DOUBLE")
def all_pairs_results(spark, sf_dir):
    return similarity.all_pairs_results(prints(spark, sf_dir)).select("a", "b", F.round("cp", 9).alias("cp"), F.round("fm", 9).alias("fm"))


@query("""WITH v AS (SELECT x.vec_id AS oid, round(abs(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) AS value FROM embeddings x JOIN embeddings y ON y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 6)
SELECT oid, round(avg(value), 9) AS mean, count(*) AS n, list_aggregate(list_transform(list_sort(list(value)), lambda v: printf('%.6f', v)), 'string_agg', ' ') AS "values" FROM v GROUP BY oid HAVING avg(value) < 0.7::DOUBLE AND count(*) > 3""")
def suspects(spark, sf_dir):
    """Vectors of more than three comparisons (with the six after them) whose mean likeness stays low, with all of it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = rows.select(F.explode(F.expr("sequence(vec_id - 6, vec_id - 1)")).alias("vec_id"), F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    value = F.round(F.abs(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))), 6).alias("value")
    scored = rows.join(after, "vec_id").select(F.col("vec_id").alias("oid"), value)
    text = F.array_join(F.transform("values", lambda v: F.format_string("%.6f", v)), " ")
    return dedupe.suspects(scored, "oid", "value").select("oid", F.round("mean", 9).alias("mean"), "n", text.alias("values"))


_OR_FOLD = """, cells AS (SELECT source, 'r32' AS part, unnest(r32) AS word, generate_subscripts(r32, 1) AS pos FROM fp UNION ALL SELECT source, 'dom16', unnest(dom16), generate_subscripts(dom16, 1) FROM fp
  UNION ALL SELECT source, 'cprint', unnest(cprint), generate_subscripts(cprint, 1) FROM fp),
folded AS (SELECT source, part, pos, bit_or(word) AS word FROM cells GROUP BY source, part, pos),
arrays AS (SELECT source, list(word ORDER BY pos) FILTER (WHERE part = 'r32') AS r32, list(word ORDER BY pos) FILTER (WHERE part = 'dom16') AS dom16, list(word ORDER BY pos) FILTER (WHERE part = 'cprint') AS cprint FROM folded GROUP BY source),
u AS (SELECT a.source, a.r32, a.dom16, a.cprint, s.lo AS min_songlen, s.hi AS max_songlen FROM arrays a JOIN (SELECT source, min(songlen) AS lo, max(songlen) AS hi FROM fp GROUP BY source) s ON s.source IS NOT DISTINCT FROM a.source)"""


@query(PRINTS + _OR_FOLD + " SELECT source, min_songlen, max_songlen, list_sum(r32)::BIGINT AS r_sum, list_sum(dom16)::BIGINT AS dom_sum, len(cprint) AS cprint_len, list_sum(cprint)::BIGINT AS cprint_sum FROM u")
def union_merge(spark, sf_dir):
    rows = unions.folded(prints(spark, sf_dir), "source").select("source", "u.*")
    total = scores.total
    return rows.selectExpr("source", "min_songlen", "max_songlen", f"{total('r32')} AS r_sum", f"{total('dom16')} AS dom_sum", "CAST(size(cprint) AS BIGINT) AS cprint_len", f"{total('cprint')} AS cprint_sum")


_CONTAINED = "greatest(0::DOUBLE, least(1::DOUBLE, " + _poly("share", "conf") + "))"
_MERGED = """(SELECT a, b, fa, fb, {'r32': list_transform(range(1, 88), lambda i: fa.r32[i] | fb.r32[i]), 'dom16': list_transform(range(1, 34), lambda i: fa.dom16[i] | fb.dom16[i]),
  'cprint': list_transform(range(1, greatest(len(fa.cprint), len(fb.cprint)) + 1), lambda i: coalesce(fa.cprint[i], 0) | coalesce(fb.cprint[i], 0))} AS u FROM pairs)"""


def _contained_sql(rows: str, a: str, u: str) -> str:
    hits = _SUM.format(f"range(1, {_n(a, u)} + 1)", f"CASE WHEN ({a}.cprint[i] & ~{u}.cprint[i]) = 0 OR ({a}.cprint[i] & -{a}.cprint[i]) = ({u}.cprint[i] & -{u}.cprint[i]) THEN 1 ELSE 0 END")
    op = "{0} & ~{1}"
    return f"SELECT a, b, round({_CONTAINED}, 9) AS score FROM (SELECT a, b, CASE WHEN len({a}.cprint) = 0 THEN 0::DOUBLE ELSE {hits} / len({a}.cprint)::DOUBLE END AS share, {_conf(_r(a, u, op), _dom(a, u, op))} AS conf FROM {rows})"


def _with_union(pairs: DataFrame) -> DataFrame:
    part = lambda f: f"'{f}', {scores.merged(f'fa.{f}', f'fb.{f}')}"
    return pairs.withColumn("u", F.expr(f"named_struct({part('r32')}, {part('dom16')}, {part('cprint')})"))


@query(NEXT + " " + _contained_sql(_MERGED, "fa", "u"))
def containment_score(spark, sf_dir):
    return _with_union(neighbours(spark, sf_dir)).selectExpr("a", "b", f"round({scores.contained('fa', 'u')}, 9) AS score")


#: Unions of ten prints each, in order of id.
_TENS = _OR_FOLD.replace("source", "ten")
_TEN_PRINTS = PRINTS.replace("SELECT doc_id AS soid", "SELECT doc_id // 10 AS ten, doc_id AS soid")


def tens(spark, sf_dir) -> DataFrame:
    """(ten, u): unions of ten prints."""
    rows = unions.folded(prints(spark, sf_dir).withColumn("ten", F.expr("soid div 10")), "ten")
    return materialise(rows, "unions")


_APART = "fa.max_songlen < fb.min_songlen OR fb.max_songlen < fa.min_songlen"


@query(_TEN_PRINTS + _TENS + ", pairs AS (SELECT l.ten AS a, r.ten AS b, l AS fa, r AS fb FROM u l JOIN u r ON r.ten = l.ten + 1 UNION ALL SELECT l.ten, r.ten, l, r FROM u l JOIN u r ON r.ten = l.ten + 2) "
       + _contained_sql("pairs", "fa", "fb").replace("SELECT a, b, round(", f"SELECT a, b, round(CASE WHEN apart THEN 0::DOUBLE ELSE 1::DOUBLE END * ", 1).replace("(SELECT a, b, CASE", f"(SELECT a, b, ({_APART}) AS apart, CASE", 1))
def union_against_union(spark, sf_dir):
    u = tens(spark, sf_dir)
    left = u.select(F.col("ten").alias("a"), F.col("u").alias("fa"), F.explode(F.array(F.col("ten") + 1, F.col("ten") + 2)).alias("b"))
    rows = left.join(u.select(F.col("ten").alias("b"), F.col("u").alias("fb")), "b")
    return rows.selectExpr("a", "b", f"round({unions.against('fa', 'fb')}, 9) AS score")


_GROWN = """(SELECT p.a, p.b, p.fa, {'r32': list_transform(range(1, 88), lambda i: p.fb.r32[i] | x.r32[i]), 'dom16': list_transform(range(1, 34), lambda i: p.fb.dom16[i] | x.dom16[i]),
  'cprint': list_transform(range(1, greatest(len(p.fb.cprint), len(x.cprint)) + 1), lambda i: coalesce(p.fb.cprint[i], 0) | coalesce(x.cprint[i], 0))} AS u FROM pairs p JOIN fp x ON x.soid = p.a * 10)"""


@query(_TEN_PRINTS + _TENS + ", pairs AS (SELECT l.ten AS a, r.ten AS b, l AS fa, r AS fb FROM u l JOIN u r ON r.ten = l.ten + 1) " + _contained_sql(_GROWN, "fa", "u"))
def what_if_union(spark, sf_dir):
    """How far a union would lie in the next one if its own first print joined that."""
    u = tens(spark, sf_dir)
    rows = u.select(F.col("ten").alias("a"), F.col("u").alias("fa"), (F.col("ten") + 1).alias("b")).join(u.select(F.col("ten").alias("b"), F.col("u").alias("fb")), "b")
    one = prints(spark, sf_dir).where("soid % 10 = 0").select(F.expr("soid div 10").alias("a"), F.struct("songlen", "r32", "dom16", "cprint").alias("x"))
    return rows.join(one, "a").selectExpr("a", "b", f"round({unions.what_if('fa', 'fb', 'x')}, 9) AS score")


@query(NEXT + f""" SELECT a, b, round(CASE WHEN {_n('fa', 'fb')} = 0 THEN 1::DOUBLE ELSE 1::DOUBLE - {_SUM.format('range(1, ' + _n('fa', 'fb') + ' + 1)', 'bit_count(xor(fa.cprint[i], fb.cprint[i]))')} / (32 * {_n('fa', 'fb')})::DOUBLE END, 9) AS score FROM pairs""")
def whole_hamming(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"round({scores.whole_hamming('fa.cprint', 'fb.cprint')}, 9) AS score")


_AND, _OR = (_SUM.format(f"range(1, {_n('fa', 'fb')} + 1)", f"bit_count(fa.cprint[i] {op} fb.cprint[i])") for op in "&|")


@query(NEXT + f" SELECT a, b, round(CASE WHEN {_n('fa', 'fb')} = 0 THEN 0::DOUBLE WHEN {_OR} = 0 THEN 1::DOUBLE ELSE {_AND} / {_OR}::DOUBLE END, 9) AS score FROM pairs")
def tanimoto(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"round({scores.tanimoto('fa.cprint', 'fb.cprint')}, 9) AS score")


@query(NEXT + f""", w AS (SELECT a, b, unnest(range(1, {_n('fa', 'fb')} + 1)) AS i, fa, fb FROM pairs),
v AS (SELECT a, b, (CASE WHEN fa.cprint[i] >= 2147483648 THEN fa.cprint[i] - 4294967296 ELSE fa.cprint[i] END)::DOUBLE AS x, (CASE WHEN fb.cprint[i] >= 2147483648 THEN fb.cprint[i] - 4294967296 ELSE fb.cprint[i] END)::DOUBLE AS y FROM w)
SELECT a, b, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN abs(corr(x, y)) ELSE 'NaN'::DOUBLE END, 6) AS score FROM v GROUP BY a, b""")  # fmt: skip
def pearson_abs(spark, sf_dir):
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"round({scores.pearson('fa.cprint', 'fb.cprint')}, 6) AS score")


def _diagonals(pairs: str, bits: str, score: str) -> str:
    return NEXT + f""", s AS ({pairs}),
i AS (SELECT a, b, y, x, unnest(range(1, len(x) + 1)) AS i FROM s),
j AS (SELECT a, b, x[i] AS u, y, i, unnest(range(greatest(1, i - 120), least(len(y), i + 119) + 1)) AS j FROM i),
d AS (SELECT a, b, j - i AS diag, count(*) AS n FROM j WHERE bit_count(xor(u, y[j])) {bits} GROUP BY a, b, j - i),
t AS (SELECT a, b, max(n) AS top FROM d GROUP BY a, b)
SELECT s.a, s.b, round({score}, 9) AS score FROM s LEFT JOIN t ON s.a = t.a AND s.b = t.b"""


_WHOLE_PAIRS = "SELECT a, b, fa.cprint AS x, fb.cprint AS y FROM pairs"
_SEEK = (40, 168)
_SEEK_PAIRS = f"SELECT a, b, CASE WHEN len(fb.cprint) > len(fa.cprint) THEN fb.cprint ELSE fa.cprint END[{_SEEK[0] + 1}:{_SEEK[1]}] AS x, CASE WHEN len(fb.cprint) > len(fa.cprint) THEN fa.cprint ELSE fb.cprint END[{_SEEK[0] + 1}:{_SEEK[1]}] AS y FROM pairs"


def _words(spark, sf_dir) -> DataFrame:
    return neighbours(spark, sf_dir).selectExpr("a", "b", "fa.cprint AS x", "fb.cprint AS y")


@query(_diagonals(_WHOLE_PAIRS, "<= 2", "coalesce(t.top, 0) / least(len(s.x), len(s.y))::DOUBLE"))
def alignment_topcount(spark, sf_dir):
    return alignment.aligned(_words(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


@query(_diagonals(_SEEK_PAIRS, "<= 2", "CASE WHEN len(s.y) = 0 THEN 0::DOUBLE ELSE coalesce(t.top, 0) / len(s.y)::DOUBLE END"))
def alignment_seek(spark, sf_dir):
    """The longer print against the shorter one, between two places only."""
    return alignment.aligned(_words(spark, sf_dir), seek=_SEEK).select("a", "b", F.round("score", 9).alias("score"))


@query(_diagonals(_WHOLE_PAIRS, "< 2", "CASE WHEN t.top IS NULL THEN 0::DOUBLE ELSE 1 - t.top / least(len(s.x), len(s.y))::DOUBLE END"))
def alignment_distance(spark, sf_dir):
    return alignment.aligned(_words(spark, sf_dir), strict=True).select("a", "b", F.round("score", 9).alias("score"))


@query(PRINTS + " SELECT soid, len(k) AS n, coalesce(list_sum(k), 0)::BIGINT AS word_sum FROM (SELECT soid, list_slice(cprint, CASE WHEN len(cprint) >= 944 THEN 705 WHEN len(cprint) >= 704 THEN 465 ELSE 1 END, CASE WHEN len(cprint) >= 944 THEN 944 WHEN len(cprint) >= 704 THEN 704 ELSE 240 END) AS k FROM fp)")
def key_window(spark, sf_dir):
    return prints(spark, sf_dir).selectExpr("soid", f"{scores.key_window('cprint')} AS k").selectExpr("soid", "CAST(size(k) AS BIGINT) AS n", f"{scores.total('k')} AS word_sum")


@query(PRINTS + " SELECT soid, CASE WHEN list_sum(dom16) = 0 THEN 'silent track: dom is 0' WHEN len(cprint) < floor(least(CASE WHEN soid % 2 = 0 THEN songlen // 2 ELSE songlen END, 60) * 15.8::DOUBLE) THEN 'small print' END AS problem FROM fp")
def bad_prints(spark, sf_dir):
    """Every other song has a length of its own in the metadata; the print's counts for the rest."""
    rows = prints(spark, sf_dir).withColumn("length", F.when(F.col("soid") % 2 == 0, F.expr("songlen div 2")))
    return rows.selectExpr("soid", f"{scores.problem('dom16', 'cprint', 'length', 'songlen')} AS problem")


@query(PRINTS + " SELECT soid, coalesce(list_sum(list_transform(range(1, len(cprint) + 1), lambda i: bit_count(xor(cprint[i], CASE WHEN i = 1 THEN 0 ELSE cprint[i - 1] END)))), 0)::BIGINT AS bits FROM fp")
def delta_xor(spark, sf_dir):
    return prints(spark, sf_dir).selectExpr("soid", "aggregate(transform(cprint, (x, i) -> CAST(bit_count(x ^ IF(i = 0, 0L, get(cprint, i - 1))) AS BIGINT)), 0L, (s, v) -> s + v) AS bits")


_STEPS = """, changed AS (SELECT soid, unnest(list_transform(range(1, len(cprint) + 1), lambda i: xor(cprint[i], CASE WHEN i = 1 THEN 0 ELSE cprint[i - 1] END))) AS x, generate_subscripts(cprint, 1) AS w FROM fp),
placed AS (SELECT soid, w, p, lag(p, 1, 0) OVER (PARTITION BY soid, w ORDER BY p) AS q FROM (SELECT soid, w, x, unnest(range(1, 33)) AS p FROM changed) WHERE (x >> (p - 1)) & 1 = 1),
steps AS (SELECT soid, w, p, p - q AS v FROM placed UNION ALL SELECT soid, w, 99, 0 FROM changed),
shorts AS (SELECT soid, least(v, 7) AS v, row_number() OVER (PARTITION BY soid ORDER BY w, p) - 1 AS k FROM steps),
longs AS (SELECT soid, v - 7 AS v, row_number() OVER (PARTITION BY soid ORDER BY w, p) - 1 AS k FROM steps WHERE v >= 7),
bits AS (SELECT soid, 0 AS part, 3 * k + b AS pos, (v >> b) & 1 AS bit FROM shorts, range(0, 3) r(b) UNION ALL SELECT soid, 1, 5 * k + b, (v >> b) & 1 FROM longs, range(0, 5) r(b)),
bytes AS (SELECT soid, part, pos // 8 AS k, sum(bit << (pos % 8))::BIGINT AS byte FROM bits GROUP BY soid, part, pos // 8),
bodies AS (SELECT soid, string_agg(printf('%02X', byte), '' ORDER BY part, k) AS body FROM bytes GROUP BY soid)"""


@query(PRINTS + _STEPS + " SELECT f.soid, md5(printf('%08X', len(f.cprint)) || coalesce(b.body, '')) AS digest FROM fp f LEFT JOIN bodies b ON b.soid = f.soid")
def compress_print(spark, sf_dir):
    code = prints(spark, sf_dir).selectExpr("soid", f"{signal.compressed('cprint')} AS code")
    return code.select("soid", F.md5(F.encode(F.hex("code"), "UTF-8")).alias("digest"))


# -- what an index does ---------------------------------------------------------------------------------------------------

_TEN_PAIRS = ", pairs AS (SELECT x.soid AS a, u.ten AS b, x AS fa, u AS fb FROM fp x JOIN u ON u.ten = x.ten + 1)"


def _print_in_ten(spark, sf_dir) -> DataFrame:
    """Each print (fa) with the union of the ten after its own (fb)."""
    one = prints(spark, sf_dir).select(F.col("soid").alias("a"), (F.expr("soid div 10") + 1).alias("b"), F.struct(*FIELDS).alias("fa"))
    return one.join(tens(spark, sf_dir).select(F.col("ten").alias("b"), F.col("u").alias("fb")), "b")


_DESCEND = """CASE WHEN q BETWEEN lo AND hi THEN score > CASE WHEN q > 150 THEN 0.10::DOUBLE WHEN q > 40 AND q < 46 THEN 0.03::DOUBLE ELSE 0.08::DOUBLE END
  WHEN q < 61 THEN gap < CASE WHEN q < 30 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AND score > 0.08::DOUBLE
  WHEN q < 155 THEN gap < CASE WHEN q < 110 THEN 0.07::DOUBLE ELSE 0.05::DOUBLE END AND score > CASE WHEN q > 150 THEN 0.15::DOUBLE ELSE 0.08::DOUBLE END ELSE false END"""
_SCORED_IN = _contained_sql("pairs", "fa", "fb").replace("SELECT a, b, round(", "SELECT a, b, q, lo, hi, (", 1).replace(", 9) AS score", ") AS score", 1).replace("(SELECT a, b, CASE", "(SELECT a, b, fa.songlen AS q, fb.min_songlen AS lo, fb.max_songlen AS hi, CASE", 1)


@query(_TEN_PRINTS + _TENS + _TEN_PAIRS + f", s AS ({_SCORED_IN}), g AS (SELECT *, CASE WHEN q < lo THEN (lo - q) / lo::DOUBLE ELSE (q - hi) / q::DOUBLE END AS gap FROM s) SELECT a, b, {_DESCEND} AS descend FROM g")
def node_prune_rule(spark, sf_dir):
    rows = _print_in_ten(spark, sf_dir).selectExpr("a", "b", "fa.songlen AS q", "fb.min_songlen AS lo", "fb.max_songlen AS hi", f"{scores.contained('fa', 'fb')} AS share")
    return rows.selectExpr("a", "b", f"{index.descend('q', 'lo', 'hi', 'share')} AS descend")


@query(_TEN_PRINTS + _TENS + _TEN_PAIRS + f", s AS ({_SCORED_IN}), g AS (SELECT *, greatest(hi, q) - least(lo, q) AS grown FROM s) SELECT a, b, round(CASE WHEN score > 0 THEN (1 - score) * 100 ELSE 100 END + CASE WHEN grown > 0 THEN (grown - (hi - lo)) / grown::DOUBLE * 2000 ELSE 0 END, 6) AS penalty FROM g")
def insert_penalty(spark, sf_dir):
    return _print_in_ten(spark, sf_dir).selectExpr("a", "b", f"round({index.penalty('fb', 'fa')}, 6) AS penalty")


@query("""WITH e AS (SELECT doc_id // 10 AS node, doc_id AS soid, n_chars AS songlen FROM documents),
w AS (SELECT node, soid, songlen, min(songlen) OVER (PARTITION BY node) AS lo, max(songlen) OVER (PARTITION BY node) AS hi, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY songlen, soid) AS pos FROM e)
SELECT node, soid, CASE WHEN lo = hi THEN CASE WHEN pos * 2 <= n + n % 2 THEN 0 ELSE 1 END WHEN songlen - lo <= hi - songlen THEN 0 ELSE 1 END AS side FROM w""")
def node_split(spark, sf_dir):
    return index.split(prints(spark, sf_dir).selectExpr("soid div 10 AS node", "soid", "songlen"), "node").select("node", "soid", "side")


@query(NEXT + " SELECT a, b, (fa.r32 = fb.r32 AND fa.dom16 = fb.dom16 AND fa.cprint = fb.cprint AND fa.songlen = fb.songlen AND fa.bit_rate = fb.bit_rate AND fa.num_errors = fb.num_errors) AS same, fa.r32 = fb.r32 AND fa.dom16 = fb.dom16 AND fa.cprint = fb.cprint AS same_words FROM pairs")
def print_same(spark, sf_dir):
    part = lambda f: f"struct({f}.r32, {f}.dom16, {f}.cprint)"
    return neighbours(spark, sf_dir).selectExpr("a", "b", f"{index.same('fa', 'fb')} AS same", f"{index.same(part('fa'), part('fb'))} AS same_words")
