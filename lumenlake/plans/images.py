"""Queries over pixels, boxes and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import pixels
from lumenlake.operators import evaluate
from lumenlake.plans.registry import DERIVED, query
from lumenlake.sources.catalog import Catalog


def images(c: Catalog) -> DataFrame:
    """An 8 x 8 image of each vector: its components set the three channels."""
    byte = lambda k: f"right(hex(pmod(abs(cast(floor(cast(x as double) * 1000) as int)) * {k}, 256) + 256), 2)"
    data = F.expr(f"unhex(array_join(transform(embedding, x -> concat({byte(7)}, {byte(3)}, {byte(1)})), ''))")
    return c.table("embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data"))


DERIVED["px"] = "SELECT vec_id, i // 8 AS y, i % 8 AS x, v % 256 AS r, (v * 3) % 256 AS g, (v * 7) % 256 AS b FROM (SELECT vec_id, abs(floor(v::DOUBLE * 1000)::INTEGER) AS v, i FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings))"
DERIVED["lum"] = "SELECT *, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5::DOUBLE)::INTEGER AS l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px"


@query("B02_image_measures", """
WITH e AS (SELECT c.vec_id, (SELECT sum(l) FROM lum n WHERE n.vec_id = c.vec_id AND abs(n.x - c.x) + abs(n.y - c.y) = 1) - 4 * c.l AS e FROM lum c WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6),
s AS (SELECT vec_id, var_pop(e) AS v FROM e GROUP BY 1), o AS (SELECT vec_id, l, row_number() OVER (PARTITION BY vec_id ORDER BY l) AS k FROM lum),
m AS (SELECT vec_id, avg(l) AS mean, stddev_pop(l) AS sigma, least(255 * avg(CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0 END), 100) AS saturation, 100.0 * avg((l >= 250)::INTEGER) AS high, 100.0 * avg((l <= 5)::INTEGER) AS low FROM lum GROUP BY 1)
SELECT m.vec_id, CASE WHEN v <= 0 THEN 0 ELSE 100 / (1 + exp(-(log10(v) - 3.5) / 0.6)) END AS sharpness, 100 * mean / 255 AS brightness,
  60 * least(sigma / 70, 1) + 40 * least(((SELECT l FROM o WHERE o.vec_id = m.vec_id AND k = 61) - (SELECT l FROM o WHERE o.vec_id = m.vec_id AND k = 4)) / 180.0, 1) AS contrast,
  saturation, high AS highlight_clipping, low AS shadow_clipping, (100 * mean / 255 < 35)::INTEGER AS is_dark, (100 * mean / 255 > 65)::INTEGER AS is_bright
FROM m JOIN s ON s.vec_id = m.vec_id""", "px lum", rounded="sharpness brightness contrast saturation highlight_clipping shadow_clipping")
def image_measures(c: Catalog) -> DataFrame:
    return pixels.measured(images(c), "vec_id").drop("is_monochrome", "color_signature", "phash")


@query("B11_signatures_and_hashes", """
WITH f AS (SELECT vec_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, hi / 255.0::DOUBLE AS hi, hi / 255.0::DOUBLE - lo / 255.0::DOUBLE AS d FROM lum),
q AS (SELECT vec_id, floor((CASE WHEN hi = r THEN (g - b) / d + (CASE WHEN g < b THEN 6 ELSE 0 END) WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 + 15) / 30)::INTEGER % 12 AS hue FROM f WHERE hi >= 0.08::DOUBLE AND d > 0 AND d >= 0.2::DOUBLE * hi),
c AS (SELECT vec_id, hue, count(*) AS k, sum(count(*)) OVER (PARTITION BY vec_id) AS n FROM q GROUP BY 1, 2),
sig AS (SELECT vec_id, sum(1 << hue) FILTER (k / n::DOUBLE >= 0.04 AND k / 64.0 >= 0.01) AS bits, CASE WHEN max(n) / 64.0 >= 0.01 THEN 1 << max_by(hue, (k, hue)) END AS main_hue FROM c GROUP BY 1),
sinc AS (SELECT j, k, CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0 END AS w FROM (SELECT j, k, (j + 0.5::DOUBLE) * 8 / 9 - (k + 0.5::DOUBLE) AS x FROM range(9) a(j), range(8) b(k))),
weight AS (SELECT j, k, round(16384 * w / sum(w) OVER (PARTITION BY j))::BIGINT AS w FROM sinc),
small AS (SELECT vec_id, y, j, sum(l * w) AS s FROM lum JOIN weight ON k = x GROUP BY 1, 2, 3),
bit AS (SELECT vec_id, sum(CASE WHEN s < more THEN CASE WHEN y * 8 + j = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (y * 8 + j)::INTEGER END ELSE 0 END)::BIGINT AS phash FROM (SELECT *, lead(s) OVER (PARTITION BY vec_id, y ORDER BY j) AS more FROM small) WHERE j < 8 GROUP BY 1),
m AS (SELECT vec_id, avg(CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0 END) < 0.06 AND greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b)) < 8 AS mono FROM lum GROUP BY 1)
SELECT m.vec_id, mono::INTEGER AS is_monochrome, coalesce(bits, main_hue, 0)::INTEGER AS color_signature, phash FROM m JOIN bit ON bit.vec_id = m.vec_id LEFT JOIN sig ON sig.vec_id = m.vec_id""", "px lum")
def signatures(c: Catalog) -> DataFrame:
    return pixels.measured(images(c), "vec_id").select("vec_id", "is_monochrome", "color_signature", "phash")


@query("B04_level_percentiles", "SELECT o_custkey AS key, min(l) AS level FROM (SELECT o_custkey, l, sum(n) OVER (PARTITION BY o_custkey ORDER BY l) AS run, sum(n) OVER (PARTITION BY o_custkey) AS whole FROM (SELECT o_custkey, (o_orderkey % 256)::INTEGER AS l, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE run >= whole * 0.95 GROUP BY 1")
def level_percentiles(c: Catalog) -> DataFrame:
    levels = c.table("orders").groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 256).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return pixels.level_percentile(levels, "key", 95)


@query("B18_eye_summary", """
SELECT photo_id, sum((left_eye_open_prob IS NOT NULL)::INTEGER + (right_eye_open_prob IS NOT NULL)::INTEGER)::BIGINT AS eye_evaluated_count, count(*) FILTER (left_eye_open_prob <= 0.2 AND right_eye_open_prob <= 0.2) AS closed_eye_face_count,
  max(CASE WHEN left_eye_open_prob IS NOT NULL AND right_eye_open_prob IS NOT NULL THEN 100 * (1 - greatest(left_eye_open_prob, right_eye_open_prob)) END) AS max_eye_closure_confidence FROM face_observations GROUP BY 1""", "face_observations", rounded="max_eye_closure_confidence")
def eye_summaries(c: Catalog) -> DataFrame:
    return pixels.eye_summary(c.view("face_observations"))


def boxes(c: Catalog) -> DataFrame:
    """Candidate boxes: the lines of each order, placed by their numbers."""
    return c.table("lineitem").selectExpr("l_orderkey as photo_id", "cast(l_extendedprice % 1000 as double) / 1000 as score", "cast(l_partkey % 40 as double) as x", "cast(l_suppkey % 40 as double) as y", "20 + cast(l_quantity as double) / 5 as w", "20 + cast(l_linenumber as double) as h")


@query("B17_suppressed_boxes", """
WITH RECURSIVE b AS (SELECT l_orderkey AS photo_id, l_extendedprice::DOUBLE % 1000 / 1000 AS score, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, 20 + l_quantity::DOUBLE / 5 AS w, 20 + l_linenumber::DOUBLE AS h FROM lineitem),
r AS (SELECT photo_id, list({'score': score, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY score DESC, x, y, w, h) AS boxes FROM b GROUP BY 1),
walk AS (
  SELECT photo_id, boxes, 1 AS i, [boxes[1]] AS kept FROM r
  UNION ALL
  SELECT photo_id, boxes, i + 1, CASE WHEN len(kept) < 100 AND len([o FOR o IN [{'both': greatest(0, least(k.x + k.w, boxes[i + 1].x + boxes[i + 1].w) - greatest(k.x, boxes[i + 1].x)) * greatest(0, least(k.y + k.h, boxes[i + 1].y + boxes[i + 1].h) - greatest(k.y, boxes[i + 1].y)),
      'area': boxes[i + 1].w * boxes[i + 1].h + k.w * k.h} FOR k IN kept] IF o.both > 0.3::DOUBLE * (o.area - o.both)]) = 0 THEN list_append(kept, boxes[i + 1]) ELSE kept END
  FROM walk WHERE i < len(boxes)),
o AS (SELECT photo_id, unnest(kept) AS k FROM walk WHERE i = len(boxes))
SELECT photo_id, k.score AS score, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM o""")
def suppressed_boxes(c: Catalog) -> DataFrame:
    return pixels.suppressed(boxes(c))


@query("B16_box_overlaps", """
WITH k AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey, l_suppkey, l_quantity, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, 20 + l_quantity / 5 AS w, 20 + l_linenumber::DOUBLE AS h FROM lineitem),
p AS (SELECT a.id, a.w * a.h + b.w * b.h AS area, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS common FROM k a JOIN k b ON a.id = b.id AND a.n < b.n)
SELECT id, count(*) AS pairs, count(*) FILTER (common / (area - common) > 0.3) AS overlapping FROM p GROUP BY 1""")
def box_overlaps(c: Catalog) -> DataFrame:
    k = c.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.struct((F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"), (20 + F.col("l_quantity") / 5).alias("w"), (20 + F.col("l_linenumber").cast("double")).alias("h")).alias("box"))
    a, b = k.select("id", F.col("n").alias("i"), F.col("box").alias("a")), k.select("id", F.col("n").alias("j"), F.col("box").alias("b"))
    return a.join(b, "id").where("i < j").groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(pixels.iou("a", "b") > 0.3).alias("overlapping"))


@query("B12_channel_histograms", "SELECT vec_id, 'luma' AS channel, l AS level, count(*) AS n FROM lum GROUP BY 1, 3 UNION ALL SELECT vec_id, 'red', r, count(*) FROM lum GROUP BY 1, 3 UNION ALL SELECT vec_id, 'green', g, count(*) FROM lum GROUP BY 1, 3 UNION ALL SELECT vec_id, 'blue', b, count(*) FROM lum GROUP BY 1, 3", "px lum")
def channel_histograms(c: Catalog) -> DataFrame:
    """Non-zero cells of the luma, red, green and blue histograms."""
    return pixels.histogram_cells(images(c), "vec_id")


@query("B19_applicable_eyes", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN sqrt(pow(l_partkey % 9, 2) + pow(l_suppkey % 9, 2)) >= 6 THEN l_discount END AS left_open FROM lineitem")
def applicable_eyes(c: Catalog) -> DataFrame:
    """Eye values of faces whose eyes lie at least six pixels apart."""
    return c.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), pixels.applicable(F.col("l_partkey") % 9, F.col("l_suppkey") % 9, F.col("l_discount")).alias("left_open"))


@query("B21_merged_groups", "SELECT CASE event_type WHEN 'purchase' THEN 'people' WHEN 'error' THEN 'nature' WHEN 'signup' THEN 'people' ELSE 'other' END AS merged, count(*) AS n FROM events GROUP BY 1")
def merged_groups(c: Catalog) -> DataFrame:
    """Labels to groups by a fixed map; unknown labels are other."""
    named = F.create_map(*map(F.lit, ["purchase", "people", "error", "nature", "signup", "people"]))
    return c.table("events").select(F.coalesce(named[F.col("event_type")], F.lit("other")).alias("merged")).groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


@query("B22_size_guard", "SELECT id, CASE WHEN size_bytes > 5000000 OR width * height > 9000000 THEN 0 END AS face_count, size_bytes > 5000000 OR coalesce(width * height > 9000000, false) AS refused FROM photos", "photos")
def size_guard(c: Catalog) -> DataFrame:
    """Files and images beyond a size are stamped as having no faces and count as done."""
    refused = pixels.too_large(F.col("size_bytes"), F.col("width"), F.col("height"), 5_000_000, 9_000_000)
    return c.photos.select("id", F.when(refused, 0).alias("face_count"), refused.alias("refused"))


@query("B15_detections", """
WITH k AS (SELECT l_orderkey AS photo_id, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS s, l_partkey % 400 AS cell, 0.5 + 5 * l_discount AS o, 0.6 + 5 * l_tax AS c, l_discount AS a, l_tax AS b, l_quantity / 50 AS p, l_linenumber / 10.0::DOUBLE AS q FROM lineitem)
SELECT photo_id, sqrt(o * c) AS score, (a + cell % (640 // s)) * s - exp(p) * s / 2 AS x, (b + cell // (640 // s)) * s - exp(q) * s / 2 AS y, exp(p) * s AS w, exp(q) * s AS h FROM k WHERE sqrt(o * c) >= 0.7""", rounded="score x y w h")
def detections(c: Catalog) -> DataFrame:
    heads = c.table("lineitem").selectExpr("l_orderkey as photo_id", "case l_linenumber % 3 when 0 then 8 when 1 then 16 else 32 end as stride", "l_partkey % 400 as cell", "0.5D + 5 * l_discount as obj", "0.6D + 5 * l_tax as cls", "array(l_discount, l_tax, l_quantity / 50, l_linenumber / 10.0D) as box")
    return pixels.detections(heads)


#: Raw labels by number; the last two are no scene groups.
RAW = [*evaluate.MERGED_GROUPS, "unheard_of", "Nature"]
_MERGED = "CASE raw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evaluate.MERGED_GROUPS.items()) + " ELSE 'other' END"


@query("B21_scene_groups", f"SELECT raw, {_MERGED} AS merged, count(*) AS n FROM (SELECT CASE WHEN photo_id % 9 > 0 THEN ({RAW})[photo_id % {len(RAW)} + 1] END AS raw FROM analysis) GROUP BY 1, 2", "analysis")
def scene_groups(c: Catalog) -> DataFrame:
    """Photos of each raw scene group with the merged group it falls into."""
    raw = F.when(F.col("photo_id") % 9 > 0, F.get(F.array(*map(F.lit, RAW)), (F.col("photo_id") % len(RAW)).cast("int")))
    return c.analysis.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", evaluate.merged_group(F.col("raw")).alias("merged"), "n")


def enlarged(c: Catalog, times: int = 8) -> DataFrame:
    """The images with every pixel repeated in both directions, large enough for faces."""
    row = lambda y: f"concat(array_join(transform(sequence(0, 7), x -> repeat(substr(h, 6 * (8 * {y} + x) + 1, 6), {times})), ''))"
    data = F.expr(f"unhex(array_join(transform(sequence(0, 7), y -> repeat({row('y')}, {times})), ''))")
    return images(c).withColumn("h", F.hex("data")).select("vec_id", F.lit(8 * times).alias("width"), F.lit(8 * times).alias("height"), data.alias("data"))


def face_boxes(c: Catalog) -> DataFrame:
    """The faces left of each order's candidate boxes, as those of the image of the same number; orders without an image have none."""
    held = c.table("embeddings").select(F.col("vec_id").alias("photo_id"))
    return pixels.suppressed(boxes(c).join(held, "photo_id", "left_semi")).withColumnRenamed("photo_id", "vec_id")


@query("B14_face_hashes")
def face_hashes(c: Catalog) -> DataFrame:
    """Appearance of the faces of each image, by boxes that overlap little; tests compare it with a plain loop."""
    return pixels.face_hashes(enlarged(c), face_boxes(c), "vec_id")
