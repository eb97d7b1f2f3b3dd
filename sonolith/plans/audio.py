"""Signal queries: vectors of `embeddings` as frames of songs (label: song, vec_id: time), `events` as a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bark, confusion, extract, features, frames, signal
from .registry import query, table

COMPONENTS = "SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::BIGINT - 1 AS component FROM embeddings"
#: Values of every component in time, numbered within the song.
FRAMES = f"WITH c AS ({COMPONENTS}), f AS (SELECT label, vec_id, component, v, row_number() OVER (PARTITION BY label, component ORDER BY vec_id) - 1 AS frame FROM c)"
#: The 12 notes of a frame: energies of the components that are equal modulo 12.
NOTES = f"WITH c AS ({COMPONENTS}), n AS (SELECT label, vec_id, component % 12 AS note, sum(v * v) AS e FROM c GROUP BY label, vec_id, component % 12), f AS (SELECT label, vec_id, note, e, row_number() OVER (PARTITION BY label, note ORDER BY vec_id) - 1 AS frame FROM n)"


def vectors(spark, sf_dir) -> DataFrame:
    """embeddings with their frame number within the label."""
    return frames.numbered(table(spark, sf_dir, "embeddings"), "label", "vec_id")


def components(spark, sf_dir) -> DataFrame:
    """(label, vec_id, frame, component, v)."""
    rows = vectors(spark, sf_dir).selectExpr("label", "vec_id", "frame", "posexplode(embedding) AS (component, v)")
    return rows.select("label", "vec_id", "frame", F.col("component").cast("long").alias("component"), F.col("v").cast("double").alias("v"))


def images(spark, sf_dir) -> DataFrame:
    """(song, frame, chroma): twelve note energies a frame."""
    notes = [F.expr(f"aggregate(filter(transform(embedding, (x, i) -> IF(i % 12 = {k}, CAST(x AS DOUBLE), 0D)), x -> x <> 0), 0D, (s, x) -> s + x * x)") for k in range(features.NOTES)]
    return vectors(spark, sf_dir).select(F.col("label").alias("song"), "frame", F.array(*notes).alias("chroma"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN CASE WHEN x < -0.1::FLOAT THEN 0 ELSE 1 END ELSE CASE WHEN x < 0.1::FLOAT THEN 2 ELSE 3 END END) AS q FROM embeddings)
SELECT vec_id, w, list_reduce(list_prepend(0::BIGINT, list_transform(q[w * 16 + 1:w * 16 + 16], lambda v: [0, 1, 3, 2][v + 1]::BIGINT)), lambda s, g: s * 4 + g) AS word FROM (SELECT vec_id, q, unnest(range(0, 4)) AS w FROM q)""")
def quantize_pack(spark, sf_dir):
    q = "transform(embedding, x -> IF(x < CAST(0 AS FLOAT), IF(x < CAST(-0.1 AS FLOAT), 0, 1), IF(x < CAST(0.1 AS FLOAT), 2, 3)))"
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{q} AS q").selectExpr("vec_id", "q", "explode(sequence(0L, 3L)) AS w")
    return rows.selectExpr("vec_id", "w", f"{signal.pack_gray('slice(q, CAST(w * 16 + 1 AS INT), 16)')} AS word")


_NOTE_SQL = "12 * (ln(bin * 1000::DOUBLE / 256 / (440::DOUBLE / 16)) / ln(2::DOUBLE) - floor(ln(bin * 1000::DOUBLE / 256 / (440::DOUBLE / 16)) / ln(2::DOUBLE)))"
_BINS = "WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS bin FROM embeddings), r AS (SELECT vec_id, x, " + _NOTE_SQL + " AS real_note FROM b WHERE bin >= 8)"


@query(_BINS + " SELECT vec_id, floor(real_note)::INTEGER AS note, round(sum(x * x), 9) AS energy FROM r GROUP BY vec_id, floor(real_note)::INTEGER")
def chroma_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)").selectExpr("vec_id", "p + 1 AS bin", "CAST(x AS DOUBLE) AS x").where("bin >= 8")
    return rows.withColumn("note", F.expr(signal.note_of("bin", 1000, 256))).groupBy("vec_id", "note").agg(F.round(F.sum(F.col("x") * F.col("x")), 9).alias("energy"))


@query(_BINS + """, p AS (SELECT vec_id, x * x AS e, floor(real_note)::INTEGER AS own, real_note - floor(real_note) AS part FROM r),
s AS (SELECT vec_id, own AS note, e * (1 - abs(part - 0.5)) AS e FROM p UNION ALL SELECT vec_id, (own + CASE WHEN part < 0.5 THEN 11 ELSE 1 END) % 12, e * abs(part - 0.5) FROM p)
SELECT vec_id, note, round(sum(e), 9) AS energy FROM s GROUP BY vec_id, note""")
def chroma_interpolated(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)").selectExpr("vec_id", "p + 1 AS bin", "CAST(x AS DOUBLE) AS x").where("bin >= 8")
    parts = rows.withColumn("parts", F.expr(signal.note_parts("bin", "x * x", 1000, 256))).select("vec_id", F.explode("parts").alias("p"))
    return parts.groupBy("vec_id", "p.note").agg(F.round(F.sum("p.energy"), 9).alias("energy"))


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n * (x / n))), 9) AS squares, round(v[1] / n, 9) AS first FROM
  (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v").selectExpr("vec_id", f"{signal.normalised('v')} AS v")
    return rows.selectExpr("vec_id", "round(aggregate(v, 0D, (s, x) -> s + x * x), 9) AS squares", "round(v[0], 9) AS first")


@query(FRAMES + """ SELECT label, vec_id, component, round(s, 9) AS smooth FROM (SELECT label, vec_id, component, frame, 0.25::DOUBLE * lag(v, 4) OVER w + 0.75::DOUBLE * lag(v, 3) OVER w + lag(v, 2) OVER w + 0.75::DOUBLE * lag(v, 1) OVER w + 0.25::DOUBLE * v AS s
  FROM f WINDOW w AS (PARTITION BY label, component ORDER BY vec_id)) WHERE frame >= 4""")
def fir_smooth(spark, sf_dir):
    out = signal.fir(components(spark, sf_dir), ["label", "component"], "frame", "v")
    return out.select("label", "vec_id", "component", F.round("smooth", 9).alias("smooth"))


@query(FRAMES + " SELECT label, component, frame // 3 AS block, round(avg(v), 9) AS mean FROM f GROUP BY label, component, frame // 3 HAVING count(*) = 3")
def decimate(spark, sf_dir):
    return signal.decimate(components(spark, sf_dir), ["label", "component"], "frame", "v", 3).select("label", "component", "block", F.round("mean", 9).alias("mean"))


@query(FRAMES + " SELECT label, vec_id, component, round(sum(v) OVER (PARTITION BY label, component ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 6) AS prefix FROM f")
def prefix_sum(spark, sf_dir):
    out = frames.prefix_sums(components(spark, sf_dir), ["label", "component"], "frame", "v")
    return out.select("label", "vec_id", "component", F.round("prefix", 6).alias("prefix"))


@query(FRAMES + """, rows_ AS (SELECT label, vec_id, component, sum(v) OVER (PARTITION BY label, component ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT label, vec_id, component, round(sum(s) OVER (PARTITION BY label, vec_id ORDER BY component ROWS UNBOUNDED PRECEDING), 5) AS area FROM rows_""")
def integral_image(spark, sf_dir):
    """Prefix sums over time and components."""
    rows = frames.prefix_sums(components(spark, sf_dir), ["label", "component"], "frame", "v", "s")
    w = Window.partitionBy("label", "vec_id").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("label", "vec_id", "component", F.round(F.sum("s").over(w), 5).alias("area"))


@query(FRAMES + """ SELECT label, vec_id, component, round(ln(1 + abs(late)) - ln(1 + abs(early)), 9) AS contrast FROM (SELECT label, vec_id, component, frame, sum(v) OVER (PARTITION BY label, component ORDER BY vec_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS late,
  sum(v) OVER (PARTITION BY label, component ORDER BY vec_id ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING) AS early FROM f) WHERE frame >= 15""")
def rect_filters(spark, sf_dir):
    keys = ["label", "component"]
    w = frames.over(keys, "frame")
    sums = {"late": F.sum("v").over(w.rowsBetween(-7, 0)), "early": F.sum("v").over(w.rowsBetween(-15, -8))}
    rows = frames.windowed(components(spark, sf_dir), keys, "frame", 15, sums).where("frame >= 15")
    return rows.select("label", "vec_id", "component", F.round(F.log1p(F.abs("late")) - F.log1p(F.abs("early")), 9).alias("contrast"))


def _box_sql(box: features.Box, pitch: int) -> str:
    x0, x1, y0, y1 = box
    if x1 <= x0 or y1 <= y0:
        return "0::DOUBLE"
    notes = " + ".join(f"e[{y + pitch + 1}]" for y in range(y0, y1))
    return f"sum({notes}) OVER (PARTITION BY label ORDER BY frame ROWS BETWEEN {x0} FOLLOWING AND {x1 - 1} FOLLOWING)"


def _filter_sql(kind: int, pitch: int, pitches: int, length: int) -> str:
    a, b = (" + ".join(_box_sql(x, pitch) for x in side) or "0::DOUBLE" for side in features.regions(kind, length, pitches))
    return f"ln(1 + ({a})) - ln(1 + ({b}))"


def _word_sql() -> str:
    values = ", ".join(f"{_filter_sql(*c[:4])} AS v{k}" for k, c in enumerate(features.CLASSIFIERS))
    gray = lambda k, c: f"CASE WHEN v{k} < {c[4]}::DOUBLE THEN 0 WHEN v{k} < {c[5]}::DOUBLE THEN 1 WHEN v{k} < {c[6]}::DOUBLE THEN 3 ELSE 2 END"
    word = " + ".join(f"({gray(k, c)})::BIGINT * {4 ** (15 - k)}" for k, c in enumerate(features.CLASSIFIERS))
    return f"{NOTES}, i AS (SELECT label, frame, list(e ORDER BY note) AS e FROM f GROUP BY label, frame), w AS (SELECT label, frame, count(*) OVER (PARTITION BY label) AS n, {values} FROM i) SELECT label AS song, frame, {word} AS word FROM w WHERE frame < n - 15"


@query(_word_sql())
def classifier_bank(spark, sf_dir):
    """The sixteen filters over a summed-area table, quantised and packed."""
    return extract.sub_prints(images(spark, sf_dir))


@query(NOTES + ", i AS (SELECT label, frame, list(e ORDER BY note) AS e FROM f GROUP BY label, frame), w AS (SELECT label, frame, count(*) OVER (PARTITION BY label) AS n, "
       + ", ".join(f"{_filter_sql(k, 2, 6, 9)} AS f{k}" for k in range(6)) + " FROM i) SELECT label AS song, frame, " + ", ".join(f"round(f{k}, 9) AS f{k}" for k in range(6)) + " FROM w WHERE frame < n - 15")
def filters_0_to_5(spark, sf_dir):
    """Each kind of filter, 9 frames by 6 notes from note 2 on, as windows over the frames."""
    w = frames.over(["song"], "back")
    count = images(spark, sf_dir).groupBy(F.col("song").alias("s")).agg(F.count("*").alias("n"))
    rows = images(spark, sf_dir).join(count, F.col("song").eqNullSafe(F.col("s"))).withColumn("back", F.col("n") - 1 - F.col("frame"))  # windows look back

    def box(b: features.Box):
        x0, x1, y0, y1 = b
        if x1 <= x0 or y1 <= y0:
            return F.lit(0.0)
        return F.sum(sum((F.get("chroma", y + 2) for y in range(y0, y1)), F.lit(0.0))).over(w.rowsBetween(-(x1 - 1), -x0))

    def value(kind: int):
        a, b = (sum((box(x) for x in side), F.lit(0.0)) for side in features.regions(kind, 9, 6))
        return F.round(F.log1p(a) - F.log1p(b), 9)

    out = frames.windowed(rows, ["song"], "back", 15, {f"f{k}": value(k) for k in range(6)}).where("frame < n - 15")
    return out.select("song", "frame", *[f"f{k}" for k in range(6)])


@query("""WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::DOUBLE AS bin FROM embeddings) SELECT vec_id, round(pow(regr_r2(x, bin), 0.25), 6) AS fit FROM b GROUP BY vec_id""")
def linear_fit_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)")
    return rows.groupBy("vec_id").agg(F.round(F.pow(F.regr_r2(F.col("x").cast("double"), (F.col("p") + 1).cast("double")), F.lit(0.25)), 6).alias("fit"))


@query("WITH b AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS bin FROM embeddings) SELECT vec_id, (arg_max(bin, x) - 1)::BIGINT AS bin FROM b GROUP BY vec_id")
def dominant_bin(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)")
    return rows.groupBy("vec_id").agg(F.max_by("p", "x").cast("long").alias("bin"))


_HARMONIC_CUTS = ", ".join(f"{v}::DOUBLE" for v in bark.HARMONIC_CUTS)


@query(f"""WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings), d AS (SELECT vec_id, 4000::DOUBLE * arg_max(bin, x * x) / 4096 AS hz FROM b GROUP BY vec_id)
SELECT vec_id, len(list_filter([{_HARMONIC_CUTS}], lambda c: c <= hz))::INTEGER AS level FROM d""")
def dominant_harmonic(spark, sf_dir):
    """Level of the strongest of a frame's first 64 lines."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)").selectExpr("vec_id", "p", "CAST(x AS DOUBLE) * CAST(x AS DOUBLE) AS e")
    hz = rows.groupBy("vec_id").agg((F.lit(4000.0) * F.max_by("p", "e") / 4096).alias("hz"))
    return hz.selectExpr("vec_id", f"{bark.harmonic_level_sql('hz')} AS level")


def _fit_case(fit: str, band: str) -> str:
    cut = lambda k: f"[{', '.join(f'{v}::DOUBLE' for v in bark.FIT_CUTS[k])}][{band} + 1]"
    return f"CASE WHEN {fit} IS NULL OR isnan({fit}) THEN 3 WHEN {fit} < {cut(0)} THEN 0 WHEN {fit} < {cut(1)} THEN 1 WHEN {fit} < {cut(2)} THEN 2 ELSE 3 END"


@query(f"""WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
r AS (SELECT vec_id, p // 4 + 1 AS band, round(pow(regr_r2(x, p::DOUBLE), 0.25), 9) AS fit FROM b GROUP BY vec_id, p // 4 + 1),
q AS (SELECT vec_id, band, {_fit_case('fit', 'band')} AS level FROM r)
SELECT vec_id, sum(level::BIGINT << (2 * (16 - band)))::BIGINT AS word, round(avg(level), 6) AS mean FROM q GROUP BY vec_id""")
def band_fits(spark, sf_dir):
    """Fit levels of sixteen bands of four lines, packed into a word, and their mean."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)").selectExpr("vec_id", "CAST(p AS DOUBLE) AS p", "CAST(x AS DOUBLE) AS x", "p div 4 + 1 AS band")
    fit = F.round(F.pow(F.regr_r2("x", "p"), F.lit(0.25)), 9)
    levels = rows.groupBy("vec_id", "band").agg(fit.alias("fit")).selectExpr("vec_id", "CAST(band AS INT) AS band", f"{bark.fit_level_sql('fit', 'CAST(band AS INT)')} AS level")
    return levels.groupBy("vec_id").agg(F.expr("sum(shiftleft(CAST(level AS BIGINT), 2 * (16 - band)))").alias("word"), F.round(F.avg("level"), 6).alias("mean"))


_BARK = "CASE WHEN z < 2 THEN z + 0.15::DOUBLE * (2 - z) WHEN z > 20.1::DOUBLE THEN z + 0.22::DOUBLE * (z - 20.1::DOUBLE) ELSE z END"


@query(f"""WITH l AS (SELECT i, (i * 8000::DOUBLE + 4096) / 8192 AS f FROM range(0, 4096) r(i)), z AS (SELECT i, 26.81::DOUBLE * f / (1960::DOUBLE + f) - 0.53::DOUBLE AS z FROM l),
b AS (SELECT i, least(16, trunc({_BARK}))::BIGINT AS band FROM z) SELECT band, min(i) AS first, count(*) AS lines FROM b GROUP BY band""")
def bark_bands(spark, sf_dir):
    """First line and number of lines of each Bark band."""
    of = bark.lines()
    rows = [(int(b), int((of == b).argmax()), int((of == b).sum())) for b in sorted(set(of.tolist()))]
    return spark.createDataFrame(rows, "band long, first long, lines long")


_EDGES = features.band_edges(8, 200, 480, 128, 1000)


@query("WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), c AS (SELECT vec_id, p, x * x AS e, e.band, e.first, e.last FROM b JOIN (VALUES "
       + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + ") e(band, first, last) ON p >= e.first AND p < e.last) "
       "SELECT vec_id, band, round((CASE WHEN sum(e) > 0 THEN sum(p * e) / sum(e) ELSE (first + last) / 2::DOUBLE END - first) / greatest(1, last - first), 9) AS centroid FROM c GROUP BY vec_id, band, first, last")  # fmt: skip
def spectral_centroid(spark, sf_dir):
    """Place of the centre of mass within bands of equal Bark width."""
    edges = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(a).alias("first"), F.lit(b).alias("last")) for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))])
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (p, x)").withColumn("e", F.col("x").cast("double") ** 2)
    rows = rows.withColumn("b", F.explode(F.filter(edges, lambda b: (b["first"] <= F.col("p")) & (F.col("p") < b["last"]))))
    mass = F.sum("e")
    centre = F.when(mass > 0, F.try_divide(F.sum(F.col("p") * F.col("e")), mass)).otherwise((F.col("first") + F.col("last")) / 2.0)
    out = rows.select("vec_id", "p", "e", "b.*").groupBy("vec_id", "band", "first", "last")
    return out.agg(F.round((centre - F.col("first")) / F.greatest(F.lit(1), F.col("last") - F.col("first")), 9).alias("centroid")).select("vec_id", "band", "centroid")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS on_ FROM events) WHERE on_ = 1""")
def silence_trim(spark, sf_dir):
    """What follows a user's first loud event, that event included: one row a user decides."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    first = rows.where("value > 50").groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("first"))
    return rows.join(first, F.col("user_id").eqNullSafe(F.col("u"))).where("event_id >= first").select("user_id", "event_id")


_TICKS = "WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events)"


def ticks(spark, sf_dir) -> DataFrame:
    return frames.numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query(_TICKS + """, h AS (SELECT user_id, frame AS start, sum(value * value) OVER w AS energy, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT user_id, start, round(energy, 6) AS energy FROM h WHERE n = 8 AND start % 3 = 0""")
def overlapped_frames(spark, sf_dir):
    """Windows of 8 events, one each 3."""
    cut = frames.hops(ticks(spark, sf_dir), "user_id", "frame", "value", 8, 3)
    return cut.select("user_id", "start", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


@query(_TICKS + " SELECT user_id, frame // 16 AS block, round(sum(value), 6) AS total FROM t GROUP BY user_id, frame // 16 HAVING count(*) = 16")
def tumbling_frames(spark, sf_dir):
    cut = frames.hops(ticks(spark, sf_dir), "user_id", "frame", "value", 16, 16)
    return cut.select("user_id", (F.col("start") / 16).cast("long").alias("block"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(_TICKS + " SELECT user_id, frame // 2 AS at, trunc(sum(trunc(value) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) / 2)::BIGINT AS mono FROM t GROUP BY user_id, frame // 2 HAVING count(*) = 2")
def downmix(spark, sf_dir):
    """Two events as the two channels of a sample; the mean is cut toward zero."""
    rows = ticks(spark, sf_dir).withColumn("v", F.expr("CAST(value AS BIGINT) * IF(event_id % 3 = 0, -1, 1)"))
    pairs = rows.groupBy("user_id", F.floor(F.col("frame") / 2).alias("at")).agg(F.sum("v").alias("sum"), F.count("*").alias("n"))
    return pairs.where("n = 2").selectExpr("user_id", "at", "sum div 2 AS mono")


@query(f"""WITH t AS ({COMPONENTS}),
p AS (SELECT x.component, x.label = y.label AS same, abs(x.v - y.v) AS d FROM t x JOIN t y ON x.component = y.component AND x.vec_id < y.vec_id)
SELECT component, same, count(*) AS pairs, sum(CASE WHEN d < 0.1::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS near FROM p GROUP BY component, same""")
def confusion_eval(spark, sf_dir):
    """Pairs and near pairs of equal and of different songs, over all pairs and every component."""
    return confusion.all_pairs(table(spark, sf_dir, "embeddings"))


@query()
def lloyd_quantizer(spark, sf_dir):
    cuts = signal.lloyd(table(spark, sf_dir, "events"), "value", 4)
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(cuts)], "k int, threshold double")
