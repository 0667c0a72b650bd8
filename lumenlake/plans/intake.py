"""Queries over what a crawl or a scan brings in: image heads, licences, search results, class names, corpus files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import names, pixels
from lumenlake.operators import corpus, evaluate
from lumenlake.operators.tables import shared_dir
from lumenlake.plans.corpora import tops
from lumenlake.plans.registry import query
from lumenlake.plans.sequences import members
from lumenlake.sources.catalog import Catalog
from lumenlake.sources.files import header_dimensions, scan_summary


def heads(c: Catalog) -> DataFrame:
    """Heads of PNG and JPEG files that state each photo's dimensions; of every tenth, cut before they do."""
    code = lambda name, digits: F.lpad(F.hex(F.coalesce(name, F.lit(0))), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), code("width", 8), code("height", 8))
    jpeg = F.concat(F.lit("FFD8FFE0001000000000000000000000000000000000"[:40] + "FFC0001108"), code("height", 4), code("width", 4))
    whole = F.when(F.col("id") % 2 == 0, png).otherwise(jpeg)
    cut = F.when(F.col("id") % 10 == 0, F.substring(whole, 1, 36)).otherwise(whole)
    return c.photos.select("id", "path", F.unhex(cut).alias("content"))


@query("A05_header_dimensions", "SELECT id, CASE WHEN id % 10 <> 0 THEN width END AS width, CASE WHEN id % 10 <> 0 THEN height END AS height FROM photos", "photos")
def header_sizes(c: Catalog) -> DataFrame:
    return header_dimensions(heads(c)).select("id", "width", "height")


@query("A03_scan_errors", """
SELECT count(*) AS total_files, count(*) FILTER (k) AS indexed, count(*) FILTER (NOT k) AS ignored, count(*) FILTER (k AND (id % 10 = 0 OR width IS NULL OR height IS NULL)) AS errors
FROM (SELECT *, id % 7 <> 0 AS k FROM photos)""", "photos")
def scan_errors(c: Catalog) -> DataFrame:
    """The scan's counts, with the files whose head states no dimensions; every seventh file has an ending of no image."""
    sized = header_dimensions(heads(c))
    path = F.when(F.col("id") % 7 == 0, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    return scan_summary(sized.select(path.alias("path"), F.col("width").isNull().alias("failed")))


@query("B22_size_guards", """
SELECT id, size_bytes * 60 > 268435456 OR coalesce(width * 5 * height * 5 > 250000000, false) AS refused FROM photos""", "photos")
def size_guards(c: Catalog) -> DataFrame:
    """Which photos are too large to be searched for faces, by the limits of the library."""
    return c.photos.select("id", pixels.too_large(F.col("size_bytes") * 60, F.col("width") * 5, F.col("height") * 5).alias("refused"))


@query("B15_landmarks", """
WITH k AS (SELECT l_orderkey AS photo_id, l_linenumber AS line, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS s, l_partkey % 400 AS cell,
  0.5 + 5 * l_discount AS o, 0.6 + 5 * l_tax AS c, l_discount AS a, l_tax AS b, l_quantity / 50 AS p, l_linenumber / 10.0::DOUBLE AS q FROM lineitem)
SELECT photo_id, sqrt(o * c) AS score, (p + cell % (640 // s)) * s AS right_x, (q + cell // (640 // s)) * s AS right_y,
  (b + cell % (640 // s)) * s AS left_x, (a + cell // (640 // s)) * s AS left_y FROM k WHERE sqrt(o * c) >= 0.7""", rounded="score right_x right_y left_x left_y")
def landmarks(c: Catalog) -> DataFrame:
    """Eyes of the faces that the detector's heads hold."""
    sizes = "array(l_discount, l_tax, l_quantity / 50, l_linenumber / 10.0D) as box"
    points = "array(l_quantity / 50, l_linenumber / 10.0D, l_tax, l_discount) as points"
    stride = "case l_linenumber % 3 when 0 then 8 when 1 then 16 else 32 end as stride"
    scores = ["0.5D + 5 * l_discount as obj", "0.6D + 5 * l_tax as cls"]
    found = pixels.detections(c.table("lineitem").selectExpr("l_orderkey as photo_id", stride, "l_partkey % 400 as cell", *scores, sizes, points))
    eye = lambda side: [F.col(f"{side}_eye.{k}").alias(f"{side}_{k}") for k in "xy"]
    return found.select("photo_id", "score", *eye("right"), *eye("left"))


@query("F26_all_formats", """
SELECT id, CASE WHEN sharpness IS NULL THEN 'unavailable' ELSE printf('%.1f', sharpness) END AS metric,
  CASE WHEN sharpness IS NULL THEN 'unavailable' ELSE round(sharpness)::BIGINT::VARCHAR || '%' END AS share,
  CASE WHEN aperture IS NULL THEN 'unavailable' ELSE round(aperture / 16 * 100)::BIGINT::VARCHAR || '%' END AS ratio,
  CASE WHEN d IS NULL THEN 'unknown' WHEN d * 24 < 1 THEN '< 1 hour' WHEN d < 1 THEN round(d * 24)::BIGINT::VARCHAR || ' hours'
    WHEN d < 10 THEN printf('%.1f', round(d, 1)) || ' days' ELSE round(d)::BIGINT::VARCHAR || ' days' END AS duration,
  CASE WHEN iso IS NULL THEN 'unavailable' ELSE iso::VARCHAR END AS iso,
  CASE WHEN id % 4 = 0 THEN m ELSE (['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])[substr(m, 6, 2)::INTEGER] || ' ' || substr(m, 1, 4) END AS month
FROM (SELECT p.*, a.sharpness, CASE WHEN id % 9 <> 0 THEN (id % 400) / 32.0::DOUBLE END AS d,
  CASE WHEN id % 4 = 0 THEN 'month ' || (id % 13)::VARCHAR ELSE substr(coalesce(capture_datetime, indexed_at), 1, 7) END AS m
  FROM photos p LEFT JOIN analysis a ON a.photo_id = p.id)""", "photos analysis")
def all_formats(c: Catalog) -> DataFrame:
    """Measures, shares, ratios, lengths of time, ISO values and months as they are shown."""
    days = F.when(F.col("id") % 9 != 0, (F.col("id") % 400) / F.lit(32.0))
    month = F.when(F.col("id") % 4 == 0, F.concat(F.lit("month "), (F.col("id") % 13).cast("string"))).otherwise(F.substring(F.coalesce("capture_datetime", "indexed_at"), 1, 7))
    shown = {
        "metric": names.metric(F.col("sharpness")),
        "share": names.percent(F.col("sharpness")),
        "ratio": names.percent(F.col("aperture") / 16, 100),
        "duration": names.duration(days),
        "iso": names.iso(F.col("iso")),
        "month": names.month_label(month),
    }
    return c.joined.select("id", *[v.alias(k) for k, v in shown.items()])


@query("F27_group_labels", """
SELECT group_type, group_id, CASE WHEN group_type = 'burst' THEN 'burst · ' || n ELSE n || ' similar photographs' END AS label FROM (
  SELECT group_type, group_id, count(*) AS n FROM members GROUP BY 1, 2) WHERE group_type = 'burst' OR n > 2
UNION ALL SELECT group_type, group_id, '2 similar' FROM (SELECT group_type, group_id, count(*) AS n FROM members GROUP BY 1, 2) WHERE group_type <> 'burst' AND n = 2""", "photos bursts members")
def group_labels(c: Catalog) -> DataFrame:
    sizes = members(c).groupBy("group_type", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where("group_type = 'burst' or n > 1").select("group_type", "group_id", names.group_label(F.col("group_type"), F.col("n")).alias("label"))


@query("G02_class_map")
def class_map(c: Catalog) -> DataFrame:
    """Names of places, derived from names of parts, mapped to the classes that those name, with all curated steps.

    The ratio of two names has no SQL; test_class_map_against_plain_loop compares the operator with a plain version.
    """
    parts = c.table("part")
    classes = parts.groupBy(F.col("p_name").alias("name")).agg(F.format_string("/m/%06d", F.min("p_partkey")).alias("mid"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" "), "p_type"))
    places = parts.select(F.coalesce(name, "p_name").alias("name"))
    one = lambda k, **columns: parts.where(F.col("p_partkey") == k).select(*[v.alias(n) for n, v in columns.items()])
    additions = one(5, name=F.concat("p_name", F.lit(" indoor")), class_name=F.upper("p_name"))
    drops = one(2, name=F.col("p_name"))
    overrides = one(3, name=F.col("p_name"), mid=F.lit("/m/override"), class_name=F.lit("Override"))
    groups = parts.where("p_size < 10").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("class_name"), F.split("p_name", " ")[1].alias("coarse"))
    return corpus.class_map(places, classes, additions, drops, overrides, groups)


_ADDRESSES = ["https://creativecommons.org/licenses/by/2.0/", "https://creativecommons.org/licenses/by-sa/2.0/", "http://creativecommons.org/publicdomain/zero/1.0/", ""]


def image_rows(c: Catalog) -> DataFrame:
    """Pages as rows of an image list with a licence's address."""
    licence = F.get(F.array(*map(F.lit, _ADDRESSES)), (F.col("page_id") % 4).cast("int"))
    said = lambda word: F.concat(F.lit(f"{word} "), F.col("page_id").cast("string"))
    return c.table("pages").select(F.col("page_id").alias("image_id"), F.concat("url", F.lit("#small")).alias("thumbnail"), "url", said("author").alias("author"), licence.alias("licence"), said("page").alias("title"))


@query("G09_licence_addresses", f"SELECT page_id AS image_id, ({_ADDRESSES})[page_id % 4 + 1] AS licence, page_id % 4 IN (0, 2) AS free FROM pages")
def licence_addresses(c: Catalog) -> DataFrame:
    return image_rows(c).select("image_id", "licence", corpus.free_address("licence").alias("free"))


@query("G10_wanted_images", f"""
SELECT page_id AS image_id, url || '#small' AS url, 'author ' || page_id AS author, ({_ADDRESSES})[page_id % 4 + 1] AS licence, 'page ' || page_id AS title
FROM pages WHERE page_id % 4 IN (0, 2) AND page_id IN (SELECT doc_id FROM labels)""")
def wanted_images(c: Catalog) -> DataFrame:
    """The manifest of labelled images, with author and licence."""
    return corpus.image_manifest(image_rows(c), c.table("labels").select(F.col("doc_id").alias("image_id")))


_LICENCES = ["CC BY 4.0", " cc0 ", "CC BY-SA 4.0", "Public domain", "PD-old", "", "CC BY-NC 2.0", "No restrictions"]


@query("G16_crawled_images", f"""
WITH r AS (SELECT page_id // 2 AS page_id, page_id AS place, page_id % 5 <> 0 AND 400 + page_id % 300 >= 480 AND url IS NOT NULL AND page_id % 8 IN (0, 1, 3, 4, 7) AS good,
  trim(({_LICENCES})[page_id % 8 + 1]) AS licence, url AS thumb, 'Ann & Co ' || page_id AS artist FROM pages)
SELECT page_id, place, 'lake' AS fine, 'lake ' || place % 3 AS query, 'page ' || place AS title, licence, thumb, artist FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM r WHERE good AND page_id NOT IN (SELECT doc_id FROM labels)) WHERE n = 1""")
def crawled_images(c: Catalog) -> DataFrame:
    """Search results cleaned: pages repeat, are of other kinds, too small, seen before or not free."""
    said = lambda word: F.concat(F.lit(word), F.col("page_id").cast("string"))
    rows = c.table("pages").select(
        F.floor(F.col("page_id") / 2).alias("page_id"),
        F.col("page_id").alias("place"),
        F.lit("lake").alias("fine"),
        F.concat(F.lit("lake "), (F.col("page_id") % 3).cast("string")).alias("query"),
        said("page ").alias("title"),
        F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("image/jpeg").alias("mime"),
        (400 + F.col("page_id") % 300).alias("width"),
        F.lit(500).alias("height"),
        F.col("url").alias("thumb"),
        F.get(F.array(*map(F.lit, _LICENCES)), (F.col("page_id") % 8).cast("int")).alias("licence"),
        F.concat(said(" <a href='x'>Ann</a> &amp; Co "), F.lit("<br/> ")).alias("artist"),
    )
    return corpus.crawled_images(rows, c.table("labels").select(F.col("doc_id").alias("page_id")), 480)


@query("G16_searched_images", """
WITH r AS (SELECT 'img' || (page_id // 3)::VARCHAR AS id, page_id AS place, CASE page_id % 4 WHEN 0 THEN url || '#s' WHEN 1 THEN url WHEN 2 THEN url || '#s' END AS url, CASE page_id % 2 WHEN 0 THEN 'CC BY 2.0' ELSE 'CC CC0' END AS licence FROM pages WHERE page_id % 7 <> 0)
SELECT id, place, 'sea' AS fine, 'sea' AS query, url, licence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM r WHERE url IS NOT NULL AND id NOT IN (SELECT 'img' || doc_id::VARCHAR FROM labels)) WHERE n = 1""")
def searched_images(c: Catalog) -> DataFrame:
    """Results of a search with a small copy, an address, both or neither."""
    k = F.col("page_id") % 4
    rows = c.table("pages").select(
        F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("img"), F.floor(F.col("page_id") / 3).cast("string"))).alias("id"),
        F.col("page_id").alias("place"),
        F.lit("sea").alias("fine"),
        F.lit("sea").alias("query"),
        F.when(k < 2, F.col("url")).alias("url"),
        F.when(k % 2 == 0, F.concat("url", F.lit("#s"))).when(k == 1, "").alias("thumbnail"),
        F.when(F.col("page_id") % 2 == 0, "by").otherwise("cc0").alias("licence"),
        F.when(F.col("page_id") % 2 == 0, "2.0").alias("version"),
    )
    return corpus.searched_images(rows, c.table("labels").select(F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("id")))


_AUDIT = "list_reduce(list_prepend(0, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(sha1(seq::VARCHAR), i::INTEGER, 1)) - 1)), lambda a, d: (a * 16 + d) % 10) = 0"


@query("A28_corpus_files", f"""
WITH k AS (SELECT *, {_AUDIT} AS held_out FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY list_position(['human', 'machine', 'openverse', 'commons'], source), seq) AS n FROM corpus) WHERE n = 1),
t AS (SELECT path, fine, printf('%.3f', (seq % 100) / 100.0::DOUBLE) AS detail, source FROM k WHERE NOT held_out)
SELECT 'train' AS split, path, fine, detail FROM t UNION ALL SELECT 'train_clean', path, fine, detail FROM t WHERE source = 'human'
UNION ALL SELECT 'audit', path, fine, 'thai ' || fine FROM k WHERE held_out
UNION ALL SELECT 'val', 'img/' || image_id || '.jpg', coarse, printf('%.3f', confidence) FROM label_rows WHERE coarse IN (SELECT fine FROM corpus WHERE source = 'human') AND 'img/' || image_id || '.jpg' IN (SELECT path FROM corpus)""", "corpus label_rows")
def corpus_files(c: Catalog) -> DataFrame:
    """The four files of a corpus, written and read back."""
    rows = c.view("corpus")
    kept = corpus.without_copies(rows).withColumn("confidence", (F.col("seq") % 100) / 100.0).withColumn("held_out", corpus.audit("seq"))
    audited = kept.where("held_out").select("path", "fine", F.concat(F.lit("thai "), "fine").alias("region_query"))
    validation = corpus.validation_rows(c.view("label_rows").select("image_id", F.col("coarse").alias("fine"), "confidence"), corpus.clean_subset(rows), rows)
    folder = f"{shared_dir(c.spark)}/corpus-{uuid.uuid4().hex}"
    corpus.write_corpus(folder, kept.where("not held_out"), validation, audited)
    head = lambda name: c.spark.read.option("header", True).schema("path string, fine string, detail string" + (", source string" if name != "audit" else "")).csv(f"{folder}/{name}")
    splits = [head(n).select(F.lit(n).alias("split"), "path", "fine", "detail") for n in ("train", "train_clean", "val", "audit")]
    return splits[0].union(splits[1]).union(splits[2]).union(splits[3])


_QUERIES = ["indian market", "japanese temple", "night market", "thailand beach", "", "thai beach"]


def by_region(c: Catalog) -> DataFrame:
    asked = F.when(F.col("vec_id") % 7 != 0, F.get(F.array(*map(F.lit, _QUERIES)), (F.col("vec_id") % 6).cast("int")))
    return tops(c).withColumn("query", asked).withColumn("region", evaluate.region_of("query"))


_REGION = "CASE WHEN vec_id % 7 = 0 THEN 'global' WHEN vec_id % 6 = 0 THEN 'indian' WHEN vec_id % 6 = 1 THEN 'japanese' WHEN vec_id % 6 = 5 THEN 'thai' ELSE 'global' END"


@query("G27_query_regions", f"SELECT {_REGION} AS region, count(*) AS n, avg((truth // 8 = top // 8)::INTEGER) AS accuracy FROM tops GROUP BY 1", "ranks tops", rounded="accuracy")
def query_regions(c: Catalog) -> DataFrame:
    """Coarse accuracy by the region that a row's query names."""
    eighths = {k: F.floor(F.col(k) / 8) for k in ("truth", "top")}
    return evaluate.region_audit(by_region(c).withColumns(eighths)).select("region", "n", "accuracy")


@query("G27_region_delta", f"SELECT count(*) AS regions, max(a) - min(a) AS delta FROM (SELECT avg((truth // 8 = top // 8)::INTEGER) AS a FROM tops GROUP BY {_REGION})", "ranks tops", rounded="delta")
def region_delta(c: Catalog) -> DataFrame:
    return evaluate.region_delta(query_regions(c))


_GROUPS = list(evaluate.MERGED_GROUPS)
_MERGE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evaluate.MERGED_GROUPS.items()) + " END"
_NAME = f"({_GROUPS})[{{0}} % {len(_GROUPS)} + 1]"


@query("G24_scene_group_accuracy", f"""
SELECT count(*) AS n, 100.0 * avg(({_MERGE.format('top')} IN ({_MERGE.format('a')}, {_MERGE.format('b')}))::INTEGER) AS accuracy
FROM (SELECT {_NAME.format('top')} AS top, {_NAME.format('truth')} AS a, {_NAME.format('(truth + 5)')} AS b FROM tops)""", "ranks tops", rounded="accuracy")
def scene_group_accuracy(c: Catalog) -> DataFrame:
    """Accuracy of the ten merged groups over photos with two true groups each."""
    name = lambda k: F.get(F.array(*map(F.lit, _GROUPS)), (k % len(_GROUPS)).cast("int"))
    rows = tops(c).select(F.array(name(F.col("truth")), name(F.col("truth") + 5)).alias("truth"), name(F.col("top")).alias("top"))
    return evaluate.merged_accuracy(rows)
