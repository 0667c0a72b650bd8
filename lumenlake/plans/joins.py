"""The join shapes of the catalog, one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.tables import replaced_by_session, shared_dir
from lumenlake.plans.registry import query
from lumenlake.plans.sequences import members
from lumenlake.sources.catalog import Catalog


@query("D01_photos_left_analysis", "SELECT id, sharpness, face_count FROM photos LEFT JOIN analysis ON photo_id = id", "photos analysis")
def photos_left_analysis(c: Catalog) -> DataFrame:
    return c.joined.select("id", "sharpness", "face_count")


def bucketed(c: Catalog, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Photos and analysis as tables bucketed and sorted by the photo's id, so that joins on it move no rows."""
    out = []
    for name, rows, key in (("photos", c.photos, "id"), ("analysis", c.analysis, "photo_id")):
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(c.spark)}/{table}"
        # a task for each bucket, else every task writes a file for each
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        out.append(c.spark.table(table))
    return out[0], out[1]


@query("D01_bucketed_join", "SELECT id, path, sharpness, face_count FROM photos LEFT JOIN analysis ON photo_id = id", "photos analysis")
def bucketed_join(c: Catalog) -> DataFrame:
    photos, analysis = bucketed(c)
    return photos.join(analysis.hint("merge"), F.col("id") == F.col("photo_id"), "left").select("id", "path", "sharpness", "face_count")


@query("D02_analyzed_photos", "SELECT id, path, sharpness FROM photos JOIN analysis ON photo_id = id", "photos analysis")
def analyzed_photos(c: Catalog) -> DataFrame:
    return c.photos.join(c.analysis, F.col("id") == F.col("photo_id")).select("id", "path", "sharpness")


@query("D03_review_state", "SELECT id, (SELECT state FROM selections s WHERE s.photo_id = photos.id) AS state FROM photos", "photos selections")
def review_state(c: Catalog) -> DataFrame:
    return c.photos.join(c.view("selections"), F.col("id") == F.col("photo_id"), "left").select("id", "state")


@query("D04_selections_in_scope", "SELECT photo_id, state, session_id FROM selections JOIN photos ON id = photo_id WHERE session_id BETWEEN 3 AND 40", "photos selections")
def selections_in_scope(c: Catalog) -> DataFrame:
    return c.view("selections").join(c.photos.where("session_id between 3 and 40"), F.col("id") == F.col("photo_id")).select("photo_id", "state", "session_id")


@query("D05_collection_members", "SELECT collection_id, id, sharpness FROM collection_photos m JOIN photos p ON p.id = m.photo_id LEFT JOIN analysis a ON a.photo_id = p.id", "photos analysis collection_photos")
def collection_members(c: Catalog) -> DataFrame:
    return c.view("collection_photos").select("collection_id", F.col("photo_id").alias("_photo")).join(c.joined, F.col("_photo") == F.col("id")).select("collection_id", "id", "sharpness")


@query("D06_group_members", """
WITH g AS (SELECT group_type, group_id, count(*) AS photo_count FROM members GROUP BY 1, 2)
SELECT m.group_type, m.group_id, p.id, photo_count, sharpness FROM members m JOIN photos p ON p.id = m.id LEFT JOIN analysis a ON a.photo_id = p.id JOIN g ON g.group_id = m.group_id AND g.group_type = m.group_type""", "photos analysis bursts members")
def group_members(c: Catalog) -> DataFrame:
    m = members(c).drop("session_id")
    sizes = m.groupBy("group_type", "group_id").agg(F.count(F.lit(1)).alias("photo_count"))
    return m.join(c.joined, "id").join(sizes, ["group_type", "group_id"]).select("group_type", "group_id", "id", "photo_count", "sharpness")


@query("D07_photos_by_ids", "SELECT id, path FROM photos WHERE id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)", "photos")
def photos_by_ids(c: Catalog) -> DataFrame:
    ids = c.table("orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"))
    return c.photos.join(ids, "id", "left_semi").select("id", "path")


@query("D08_sessions_with_flags", "SELECT id, name FROM sessions s WHERE EXISTS (SELECT 1 FROM photos p WHERE p.session_id = s.id AND flag = 1)", "photos sessions")
def sessions_with_flags(c: Catalog) -> DataFrame:
    flagged = c.photos.where("flag = 1").select(F.col("session_id").alias("id"))
    return c.view("sessions").join(flagged, "id", "left_semi").select("id", "name")


@query("D09_images_not_held", "SELECT image_id, mid FROM label_rows WHERE image_id NOT IN (SELECT doc_id::VARCHAR FROM labels)", "label_rows")
def images_not_held(c: Catalog) -> DataFrame:
    held = c.table("labels").select(F.col("doc_id").cast("string").alias("image_id"))
    return c.view("label_rows").join(held, "image_id", "left_anti").select("image_id", "mid")


@query("D10_pairs_in_session", "SELECT count(*) AS pairs, sum(bit_count(xor(a.phash, b.phash)))::BIGINT AS bits FROM photos a JOIN photos b ON a.session_id = b.session_id AND a.id < b.id AND bit_count(xor(a.phash, b.phash)) <= 6", "photos")
def pairs_in_session(c: Catalog) -> DataFrame:
    from lumenlake.plans.sequences import hash_pairs

    return hash_pairs(c).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("distance"), F.lit(0)).alias("bits"))


@query("D11_pairs_across_sessions", """
SELECT a.id AS a, b.id AS b FROM photos a JOIN photos b ON a.session_id <> b.session_id AND a.id < b.id AND bit_count(xor(a.phash, b.phash)) <= 4
WHERE bit_count(a.phash) BETWEEN 3 AND 61 AND bit_count(b.phash) BETWEEN 3 AND 61""", "photos")
def pairs_across_sessions(c: Catalog) -> DataFrame:
    from lumenlake.operators import simjoin

    rows = c.photos.where(~simjoin.degenerate("phash")).select(F.col("id").alias("vertex"), F.col("session_id").alias("scope"), F.col("phash").alias("hash"))
    return simjoin.pairs(rows, 4, across=True).select("a", "b")


@query("D12_licensed_images", "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND regexp_matches(url, '^https?://[^/]*example\\.(com|org)')")
def licensed_images(c: Catalog) -> DataFrame:
    wanted = c.table("labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return c.table("pages").where(F.col("url").rlike(r"^https?://[^/]*example\.(com|org)")).join(wanted, "page_id", "left_semi").select("page_id", "url")


@query("D14_dimension_names", "SELECT c_custkey, n_name AS fine, r_name AS coarse FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def dimension_names(c: Catalog) -> DataFrame:
    """Fixed dimensions of 25 and 5 rows; Spark broadcasts them by their size."""
    nation = c.table("nation").join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("fine"), F.col("r_name").alias("coarse"))


@query("E09_replaced_groups", "SELECT session_id, id, CASE WHEN session_id % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM bursts", "photos bursts")
def replaced_groups(c: Catalog) -> DataFrame:
    """New groups of some sessions over a stored table; the others' stay."""
    rows = members(c).select("session_id", "id").withColumn("run", F.lit("old"))
    stored = replaced_by_session(rows, lambda old: old.where("session_id % 2 = 0").withColumn("run", F.lit("new")))
    return stored.select("session_id", "id", "run")


@query("E26_group_kinds", "SELECT group_type, count(DISTINCT group_id) AS groups, count(*) AS photos FROM members GROUP BY 1", "photos bursts members")
def group_kinds(c: Catalog) -> DataFrame:
    return members(c).groupBy("group_type").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("photos"))
