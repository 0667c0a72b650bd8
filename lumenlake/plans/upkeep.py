"""Queries over curation tables, plans and incremental upkeep of the catalog."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import names
from lumenlake.operators import curation
from lumenlake.operators.tables import shared_dir, write_table
from lumenlake.plans.registry import query
from lumenlake.sources.catalog import Catalog, capture_provenance as provenance, known_time, merge_rows
from lumenlake.sources import exif
from lumenlake.sources.files import extension_class, manifest, orientation_of, scan_summary, with_names

_CHANGES = "SELECT o_orderkey % 10000 AS photo_id, CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'rejected' END AS state, lpad(CAST(o_orderkey AS STRING), 12, '0') AS updated_at FROM {orders}"


def changes(c: Catalog) -> DataFrame:
    return c.spark.sql(_CHANGES, orders=c.table("orders"))


@query("F01_set_states", f"""
WITH c AS ({_CHANGES.format(orders="orders")}), l AS (SELECT photo_id, arg_max_null(state, updated_at) AS state, max(updated_at) AS updated_at FROM c GROUP BY 1)
SELECT coalesce(s.photo_id, l.photo_id) AS photo_id, coalesce(l.state, s.state) AS state, CASE WHEN l.photo_id IS NOT NULL THEN l.updated_at ELSE s.updated_at END AS updated_at
FROM selections s FULL JOIN l ON l.photo_id = s.photo_id WHERE l.photo_id IS NULL OR l.state IS NOT NULL""", "selections")
def set_states(c: Catalog) -> DataFrame:
    return curation.set_states(c.view("selections"), changes(c))


@query("F03_recent_decisions", "SELECT * FROM selections ORDER BY updated_at DESC, photo_id LIMIT 500", "selections")
def recent_decisions(c: Catalog) -> DataFrame:
    return c.view("selections").orderBy(F.desc("updated_at"), "photo_id").limit(500)


@query("F04_keyset_page", "SELECT id, path, 3000::BIGINT AS next_cursor FROM (SELECT id, path FROM photos WHERE id > 1000 ORDER BY id LIMIT 2000)", "photos")
def keyset_page(c: Catalog) -> DataFrame:
    return curation.keyset_page(c.photos.select("id", "path"), "id", 1000, 2000)


@query("F05_marks", """
WITH c AS (SELECT o_orderkey AS photo_id, o_orderkey % 6 AS r, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS f, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'blue' END AS k FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey % 2 = 0)
SELECT id, CASE WHEN r IS NULL THEN rating ELSE nullif(r, 0) END AS rating, coalesce(f, flag) AS flag, CASE WHEN k IS NULL THEN color_label ELSE nullif(k, '') END AS color_label FROM photos LEFT JOIN c ON c.photo_id = id""", "photos")
def marks(c: Catalog) -> DataFrame:
    new = c.table("orders").select(F.col("o_orderkey").alias("photo_id")).distinct().where("photo_id % 2 = 0")
    new = new.selectExpr("photo_id", "photo_id % 6 as rating", "case when photo_id % 3 = 0 then 1 end as flag", "case photo_id % 4 when 0 then '' when 1 then 'blue' end as color_label")
    return curation.marked(c.photos, new).select("id", "rating", "flag", "color_label")


@query("F07_collection_list", "SELECT k.id, k.name, count(m.photo_id) AS photos FROM collections k LEFT JOIN collection_photos m ON m.collection_id = k.id GROUP BY 1, 2", "collections collection_photos")
def collection_list(c: Catalog) -> DataFrame:
    return curation.collection_list(c.view("collections"), c.view("collection_photos"))


@query("F08_added_members", """
SELECT 1::BIGINT AS collection_id, id AS photo_id, min(file_mtime) AS added_at FROM photos WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM collection_photos m WHERE m.collection_id = 1 AND m.photo_id = photos.id) GROUP BY id""", "photos collection_photos")
def added_members(c: Catalog) -> DataFrame:
    wanted = c.photos.where("id % 3 = 0").select(F.lit(1).cast("long").alias("collection_id"), F.col("id").alias("photo_id"), F.col("file_mtime").alias("added_at"))
    return curation.added_members(c.view("collection_photos"), wanted)


@query("F10_collection_page", """
SELECT collection_id, p.id, added_at, sharpness FROM collection_photos m JOIN photos p ON p.id = m.photo_id LEFT JOIN analysis a ON a.photo_id = p.id WHERE collection_id = 2 ORDER BY added_at, p.id LIMIT 200""", "photos analysis collection_photos")
def collection_page(c: Catalog) -> DataFrame:
    m = c.view("collection_photos").withColumnRenamed("photo_id", "_photo").where("collection_id = 2")
    return m.join(c.joined, F.col("_photo") == F.col("id")).select("collection_id", "id", "added_at", "sharpness").orderBy("added_at", "id").limit(200)


@query("F11_collections_of", "SELECT DISTINCT collection_id FROM collection_photos WHERE photo_id IN (SELECT id FROM photos WHERE rating = 5)", "photos collection_photos")
def collections_of(c: Catalog) -> DataFrame:
    return c.view("collection_photos").join(c.photos.where("rating = 5").select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("collection_id").distinct()


@query("F12_delete_cascade", """
SELECT 'analysis' AS child, count(*) AS n FROM analysis WHERE photo_id % 7 <> 0 UNION ALL SELECT 'selections', count(*) FROM selections WHERE photo_id % 7 <> 0
UNION ALL SELECT 'collection_photos', count(*) FROM collection_photos WHERE photo_id NOT IN (SELECT id FROM photos WHERE id % 7 = 0)
UNION ALL SELECT 'face_observations', count(*) FROM face_observations WHERE photo_id % 7 <> 0""", "photos analysis selections collection_photos face_observations")
def delete_cascade(c: Catalog) -> DataFrame:
    gone = c.photos.where("id % 7 = 0").select("id")
    parts = [curation.without_photos(c.view(t), "photo_id", gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("child"), "n") for t in ("analysis", "selections", "collection_photos", "face_observations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("F14_recent_operations", "SELECT * FROM file_operations ORDER BY created_at DESC, id DESC LIMIT 500", "file_operations")
def recent_operations(c: Catalog) -> DataFrame:
    return c.view("file_operations").orderBy(F.desc("created_at"), F.desc("id")).limit(500)


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace({0}, '[\x00-\x1f\x7f /\\:*?"<>|{{}}]+', '-', 'g'), '^[. \-_]+', ''), '[. \-_]+$', '')"""


@query("F16_sanitized_names", f"SELECT p_partkey, CASE WHEN n = '' THEN 'renamed' ELSE n END AS name FROM (SELECT p_partkey, {_CLEAN.format('p_name || chr(58) || p_type || chr(32)')} AS n FROM part)")
def sanitized_names(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", names.sanitized(F.concat("p_name", F.lit(":"), "p_type", F.lit(" "))).alias("name"))


TEMPLATE = "{date} {time} {camera} {iso} {focal} {sequence}"


@query("F20_rename_plan", f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY capture_datetime NULLS FIRST, filename, id) AS place, count(*) OVER () AS n FROM photos), m AS (
  SELECT id, path AS source, regexp_replace(path, '[^/]*$', '') || regexp_replace({_CLEAN.format("substr(coalesce(capture_datetime, file_mtime, indexed_at), 1, 10) || ' ' || replace(substr(coalesce(capture_datetime, file_mtime, indexed_at), 12, 8), ':', '-') || ' ' || coalesce(" + _CLEAN.format('camera_model') + ", '') || ' ' || coalesce(iso::VARCHAR, '') || ' ' || coalesce(round(focal_length)::BIGINT::VARCHAR, '') || ' ' || lpad(place::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0')")}, '^(.+)\\.[^.]*$', '\\1') || '.' || extension AS destination FROM o)
SELECT id, source, destination, destination = source OR NOT EXISTS (SELECT 1 FROM photos e WHERE e.path = destination) AS ok, (SELECT count(*) > count(DISTINCT destination) FROM m) AS aborted FROM m""", "photos")
def rename_plan(c: Catalog) -> DataFrame:
    return curation.rename_plan(c.photos, TEMPLATE, "Shoot", c.photos.select("path"))


_TAKEN = "SELECT '/backup/' || filename AS path FROM photos WHERE id % 2 = 0 UNION SELECT '/backup/' || regexp_replace(filename, '^(.+)\\.([^.]*)$', '\\1-1.\\2') FROM photos WHERE id % 4 = 0"


def taken(c: Catalog) -> DataFrame:
    """Names that the destination already holds."""
    some = c.photos.where("id % 2 = 0").select(F.concat(F.lit("/backup/"), "filename").alias("path"))
    more = c.photos.where("id % 4 = 0").select(F.concat(F.lit("/backup/"), F.regexp_replace("filename", r"^(.+)\.([^.]*)$", r"$1-1.$2")).alias("path"))
    return some.union(more).distinct()


@query("F21_move_plan_skip", f"SELECT id, path AS source, '/backup/' || filename AS destination, NOT coalesce(t, false) AS ok, CASE WHEN t THEN 'exists' END AS note FROM photos LEFT JOIN (SELECT path AS taken_path, true AS t FROM ({_TAKEN})) k ON taken_path = '/backup/' || filename", "photos")
def move_plan_skip(c: Catalog) -> DataFrame:
    return curation.move_plan(c.photos, "/backup", taken(c), False)


@query("F21_move_plan_rename", rf"""
WITH k AS (SELECT DISTINCT path AS taken_path FROM ({_TAKEN})), p AS (SELECT id, path AS source, '/backup/' || filename AS d, regexp_replace(filename, '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(filename, '^.+(\.[^.]*)$', 1) AS tail FROM photos),
s AS (SELECT p.*, (SELECT count(*) FROM k WHERE taken_path = d) > 0 AS t FROM p),
f AS (SELECT s.id, min(n) AS n FROM s, range(1, 5) r(n) WHERE t AND NOT EXISTS (SELECT 1 FROM k WHERE taken_path = '/backup/' || stem || '-' || n::VARCHAR || tail) GROUP BY s.id)
SELECT s.id, source, CASE WHEN t THEN '/backup/' || stem || '-' || f.n::VARCHAR || tail ELSE d END AS destination, true AS ok, CASE WHEN t THEN 'renamed' END AS note FROM s LEFT JOIN f ON f.id = s.id""", "photos")
def move_plan_rename(c: Catalog) -> DataFrame:
    return curation.move_plan(c.photos, "/backup", taken(c), True)


@query("F21_move_plan_unique", rf"""
WITH k AS (SELECT DISTINCT substr(path, 9) AS name FROM ({_TAKEN})), p AS (
  SELECT id, path AS source, filename, regexp_replace(filename, '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(filename, '^.+(\.[^.]*)$', 1) AS tail, filename IN (SELECT name FROM k) AS held,
    row_number() OVER (PARTITION BY filename ORDER BY capture_datetime NULLS FIRST, id) AS turn, row_number() OVER (ORDER BY capture_datetime NULLS FIRST, filename, id) AS place FROM photos
), m AS (
  SELECT *, row_number() OVER (PARTITION BY stem, tail ORDER BY place) AS k FROM p WHERE held OR turn > 1
), f AS (
  SELECT stem, tail, n, row_number() OVER (PARTITION BY stem, tail ORDER BY n) AS k FROM (SELECT DISTINCT stem, tail FROM m), range(1, 2000) r(n)
  WHERE stem || '-' || n || tail NOT IN (SELECT name FROM k UNION SELECT filename FROM photos) AND n <= 2 * (SELECT max(k) FROM m) + 50
)
SELECT p.id, p.source, '/backup/' || coalesce(p.stem || '-' || f.n || p.tail, p.filename) AS destination, true AS ok, CASE WHEN f.n IS NOT NULL THEN 'renamed' END AS note
FROM p LEFT JOIN m ON m.id = p.id LEFT JOIN f ON f.stem = m.stem AND f.tail = m.tail AND f.k = m.k""", "photos")
def move_plan_unique(c: Catalog) -> DataFrame:
    """As F21_move_plan_rename, but no two photos of the plan get one name."""
    return curation.unique_move_plan(c.photos, "/backup", taken(c))


@query("F22_delete_plan", "SELECT id, path AS source, id % 4 <> 0 AND id % 9 <> 0 AS ok, CASE WHEN id % 4 = 0 THEN 'missing' WHEN id % 9 = 0 THEN 'not a file' END AS note FROM photos", "photos")
def delete_plan(c: Catalog) -> DataFrame:
    return curation.delete_plan(c.photos, c.photos.where("id % 4 <> 0").select("path", (F.col("id") % 9 != 0).alias("is_file")))


@query("F23_outcomes", "SELECT op_type, count(*) AS total, count(*) FILTER (status IN ('ok', 'failed')) AS processed, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS cancelled FROM file_operations GROUP BY 1", "file_operations")
def outcomes(c: Catalog) -> DataFrame:
    return curation.outcome_summary(c.view("file_operations"))


@query("F25_sheet_cells", """
SELECT id, i // 12 AS page, (i % 12) // 4 AS row, i % 4 AS column, CASE WHEN length(filename) > 24 THEN substr(filename, 1, 23) || '…' ELSE filename END AS caption
FROM (SELECT *, row_number() OVER (ORDER BY capture_datetime NULLS LAST, id) - 1 AS i FROM photos) WHERE i < 500""", "photos")
def sheet_cells(c: Catalog) -> DataFrame:
    return curation.sheet_cells(c.photos)


@query("F26_shown_values", """
SELECT id, CASE WHEN aperture IS NULL THEN 'unavailable' ELSE 'f/' || printf('%.1f', aperture) END AS aperture,
  CASE WHEN shutter_speed IS NULL THEN 'unavailable' WHEN shutter_speed = 1 THEN '1s' WHEN shutter_speed > 1 THEN printf('%.1f', shutter_speed) || 's'
       ELSE '1/' || round(1 / shutter_speed)::BIGINT::VARCHAR END AS shutter, substr(coalesce(capture_datetime, indexed_at), 1, 7) AS month FROM photos""", "photos")
def shown_values(c: Catalog) -> DataFrame:
    return c.photos.select("id", names.aperture(F.col("aperture")).alias("aperture"), names.shutter(F.col("shutter_speed")).alias("shutter"), F.substring(known_time(), 1, 7).alias("month"))


@query("A02_extension_classes", """
SELECT extension, CASE WHEN extension IN ('jpg', 'jpeg', 'png', 'webp', 'tif', 'tiff') THEN 'decodable' WHEN extension IN ('heic', 'heif') THEN 'heic' ELSE 'raw' END AS kind, count(*) AS n FROM photos GROUP BY 1, 2""", "photos")
def extension_classes(c: Catalog) -> DataFrame:
    return c.photos.groupBy("extension", extension_class("extension").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("A04_orientation", "SELECT id, CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' WHEN width = height THEN 'square' END AS orientation FROM photos", "photos")
def orientation(c: Catalog) -> DataFrame:
    return c.photos.select("id", orientation_of("width", "height").alias("orientation"))


@query("A06_photo_upsert", """
WITH d AS (SELECT path, size_bytes + 1 AS size_bytes, '2026-01-01T00:00:00Z' AS file_mtime, CASE WHEN id % 2 = 0 THEN 111 END AS width FROM photos WHERE id % 3 = 0
  UNION ALL SELECT '/new/' || id::VARCHAR || '.jpg', id, '2026-01-01T00:00:00Z', NULL FROM photos WHERE id % 100 = 0)
SELECT coalesce(p.path, d.path) AS path, coalesce(d.size_bytes, p.size_bytes) AS size_bytes, coalesce(d.file_mtime, p.file_mtime) AS file_mtime, coalesce(d.width, p.width) AS width, p.indexed_at
FROM photos p FULL JOIN d ON d.path = p.path""", "photos")
def photo_upsert(c: Catalog) -> DataFrame:
    """A re-scan: sizes and times are replaced, dimensions kept where the scan has none, the first index time stays."""
    base = c.photos.select("path", "size_bytes", "file_mtime", "width", "indexed_at")
    stamp = F.lit("2026-01-01T00:00:00Z").alias("file_mtime")
    again = c.photos.where("id % 3 = 0").select("path", (F.col("size_bytes") + 1).alias("size_bytes"), stamp, F.when(F.col("id") % 2 == 0, 111).cast("long").alias("width"))
    new = c.photos.where("id % 100 = 0").select(F.concat(F.lit("/new/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.col("id").alias("size_bytes"), stamp, F.lit(None).cast("long").alias("width"))
    return merge_rows(base, again.unionByName(new), "path", {"size_bytes": "new", "file_mtime": "new", "width": "new_first"})


@query("A13_exif_merge", """
SELECT p.id, coalesce(p.width, e.width) AS width, coalesce(e.iso, p.iso) AS iso, p.gps_present OR coalesce(e.gps, false) AS gps_present,
  coalesce(e.taken, p.capture_datetime) AS capture_datetime, CASE WHEN e.taken IS NOT NULL THEN 'exif' ELSE p.capture_datetime_source END AS capture_datetime_source
FROM photos p LEFT JOIN (SELECT id, 640 AS width, CASE WHEN id % 4 = 0 THEN 99 END AS iso, id % 3 = 0 AS gps, CASE WHEN id % 5 = 0 THEN '2020-02-02T02:02:02Z' END AS taken FROM photos WHERE id % 2 = 0) e ON e.id = p.id""", "photos")
def exif_merge(c: Catalog) -> DataFrame:
    """Geometry keeps the old value, read fields take the new one where there is one, the GPS bit only rises."""
    base = c.photos.select("id", "width", "iso", "gps_present", "capture_datetime", "capture_datetime_source")
    taken_at = F.when(F.col("id") % 5 == 0, "2020-02-02T02:02:02Z")
    read = c.photos.where("id % 2 = 0").select("id", F.lit(640).cast("long").alias("width"), F.when(F.col("id") % 4 == 0, 99).cast("long").alias("iso"), (F.col("id") % 3 == 0).alias("gps_present"), taken_at.alias("capture_datetime"), F.when(taken_at.isNotNull(), "exif").alias("capture_datetime_source"))
    return merge_rows(base, read, "id", {"width": "old_first", "iso": "new_first", "gps_present": "or", "capture_datetime": "new_first", "capture_datetime_source": "new_first"})


#: The date that the names of these photos state, each of four kinds.
_NAMED = """CASE id % 4 WHEN 0 THEN substr(filename, 5, 4) || '-' || substr(filename, 9, 2) || '-' || substr(filename, 11, 2) || 'T' || substr(filename, 14, 2) || ':' || substr(filename, 16, 2) || ':' || substr(filename, 18, 2) || 'Z'
    WHEN 1 THEN substr(filename, 12, 10) || 'T' || replace(substr(filename, 26, 8), '.', ':') || 'Z'
    WHEN 2 THEN substr(filename, 1, 4) || '-' || substr(filename, 5, 2) || '-' || substr(filename, 7, 2) || 'T00:00:00Z' END"""


@query("A15_dates_from_names", f"SELECT id, filename, {_NAMED} AS capture_datetime FROM photos", "photos")
def dates_from_names(c: Catalog) -> DataFrame:
    return c.photos.select("id", "filename", names.name_dates()("filename").alias("capture_datetime"))


@query("A16_estimated_dates", f"""
SELECT id, coalesce(n, file_mtime) AS capture_datetime, CASE WHEN n IS NOT NULL THEN 'filename' WHEN file_mtime IS NOT NULL THEN 'mtime' END AS source FROM (
  SELECT *, {_NAMED} AS n FROM photos)""", "photos")
def estimated_dates(c: Catalog) -> DataFrame:
    rows = c.photos.select("id", "file_mtime", names.name_dates()("filename").alias("capture_datetime"))
    return rows.select("id", F.coalesce("capture_datetime", "file_mtime").alias("capture_datetime"), F.when(F.col("capture_datetime").isNotNull(), "filename").when(F.col("file_mtime").isNotNull(), "mtime").alias("source"))


_QUEUES = {
    "A17_metadata_queue": "exif_at IS NULL OR file_mtime > exif_at",
    "A18_analysis_queue": "extension IN ('jpg', 'jpeg', 'png', 'webp', 'tif', 'tiff') AND (photo_id IS NULL OR algorithm_version < 2 OR file_mtime IS DISTINCT FROM source_mtime)",
    "A19_hash_queue": "phash IS NULL OR phash_source_mtime < file_mtime",
    "A20_face_queue": "face_count IS NULL OR eye_algorithm_version IS NULL OR eye_algorithm_version < 2 OR faces_at < file_mtime",
    "A21_scene_queue": "scene_fine IS NULL OR scene_at < file_mtime",
}


def _queue(test: str):
    return lambda c: c.joined.where(test).select("id", "path", "capture_datetime").orderBy(F.col("capture_datetime").asc_nulls_last(), "id")


for _n, _t in _QUEUES.items():
    query(_n, f"SELECT id, path, capture_datetime FROM photos LEFT JOIN analysis ON photo_id = id WHERE {_t}", "photos analysis")(_queue(_t))


@query("A23_progress", "SELECT count(*) AS decodable, count(photo_id) AS analyzed FROM photos LEFT JOIN analysis ON photo_id = id WHERE extension IN ('jpg', 'jpeg', 'png', 'webp', 'tif', 'tiff')", "photos analysis")
def progress(c: Catalog) -> DataFrame:
    return c.joined.where(extension_class("extension") == "decodable").agg(F.count(F.lit(1)).alias("decodable"), F.count("photo_id").alias("analyzed"))


@query("A01_file_rows", """
SELECT p AS path, regexp_extract(p, '[^/]*$') AS filename, lower(regexp_extract(p, '\\.([^./]+)$', 1)) AS extension, CASE WHEN lower(regexp_extract(p, '\\.([^./]+)$', 1)) IN ('jpg', 'png') THEN 'decodable' WHEN lower(regexp_extract(p, '\\.([^./]+)$', 1)) = 'heic' THEN 'heic' ELSE 'raw' END AS class
FROM (SELECT CASE WHEN id % 9 = 0 THEN replace(path, '/shoot/', '/.trash/') ELSE path END AS p FROM photos) WHERE NOT regexp_matches(p, '/\\.[^/]')""", "photos")
def file_rows(c: Catalog) -> DataFrame:
    """The scan's rules over a listing: hidden folders out, names, endings and classes."""
    listing = c.photos.select(F.when(F.col("id") % 9 == 0, F.replace("path", F.lit("/shoot/"), F.lit("/.trash/"))).otherwise(F.col("path")).alias("path"))
    return with_names(listing).where("class <> 'ignored'")


@query("A03_scan_summary", "SELECT count(*) FILTER (id % 9 <> 0) AS total_files, count(*) FILTER (id % 9 <> 0 AND id % 5 <> 0) AS indexed, count(*) FILTER (id % 9 <> 0 AND id % 5 = 0) AS ignored FROM photos", "photos")
def scan_totals(c: Catalog) -> DataFrame:
    listing = c.photos.select(F.concat(F.when(F.col("id") % 9 == 0, "/.x").otherwise("/x"), F.regexp_replace("path", r"\.[^.]*$", ""), F.when(F.col("id") % 5 == 0, ".txt").otherwise(".jpg")).alias("path"))
    return scan_summary(listing)


def exif_files(c: Catalog) -> DataFrame:
    """Small JPEG heads that carry each photo's camera columns."""

    @F.pandas_udf(T.BinaryType())
    def encode(make: pd.Series, lens: pd.Series, iso: pd.Series, aperture: pd.Series, taken: pd.Series, gps: pd.Series) -> pd.Series:
        plain = lambda v: None if pd.isna(v) else v
        return pd.Series([exif.write_tags({"make": plain(m), "lens": plain(n), "iso_photographic": None if pd.isna(i) else int(i), "aperture": plain(a), "taken": plain(t), "gps": bool(g)}) for m, n, i, a, t, g in zip(make, lens, iso, aperture, taken, gps, strict=True)])

    clock = F.replace(F.replace(F.translate("capture_datetime", "-T", ": "), F.lit("Z"), F.lit("")), F.lit("x"), F.lit(""))
    return c.photos.select("id", encode("camera_make", "lens", "iso", "aperture", clock, "gps_present").alias("content"))


@query("A09_exif_fields", "SELECT id, nullif(trim(camera_make), '') AS camera_make, nullif(trim(lens), '') AS lens, iso, aperture, capture_datetime, gps_present, coalesce(nullif(trim(camera_make), ''), lens, iso::VARCHAR, aperture::VARCHAR, capture_datetime) IS NOT NULL OR gps_present AS has_metadata FROM photos", "photos")
def exif_fields(c: Catalog) -> DataFrame:
    rows = exif.fields(exif.raw_tags(exif_files(c), "id")).withColumn("has_metadata", exif.has_metadata())
    return rows.select("id", "camera_make", "lens", "iso", "aperture", "capture_datetime", "gps_present", "has_metadata")


@query("A14_capture_provenance", f"""
SELECT id, coalesce(e, n, m, capture_datetime) AS capture_datetime, CASE WHEN e IS NOT NULL THEN 'exif' WHEN n IS NOT NULL THEN 'filename' WHEN m IS NOT NULL THEN 'mtime' WHEN s IS NOT NULL THEN s WHEN capture_datetime IS NOT NULL THEN 'exif' END AS source
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN exif_at END AS e, CASE WHEN id % 2 = 0 THEN {_NAMED} END AS n, CASE WHEN id % 10 = 0 THEN file_mtime END AS m, CASE WHEN id % 5 > 1 THEN capture_datetime_source END AS s FROM photos)""", "photos")
def capture_provenance(c: Catalog) -> DataFrame:
    """A read date before one from the name, before the file's time, before what is stored; some stored dates have no source."""
    named = F.when(F.col("id") % 2 == 0, names.name_dates()("filename"))
    rows = c.photos.withColumns({"_named": named, "_time": F.when(F.col("id") % 10 == 0, F.col("file_mtime")), "_source": F.when(F.col("id") % 5 > 1, F.col("capture_datetime_source"))})
    guess, whence = F.coalesce("_named", "_time"), F.when(F.col("_named").isNotNull(), "filename").otherwise("mtime")
    return rows.select("id", *provenance(F.when(F.col("id") % 3 == 0, F.col("exif_at")), guess, whence, "capture_datetime", "_source"))


@query("A25_owned_columns", "SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 50.0::DOUBLE ELSE sharpness END AS sharpness, face_count, scene_fine FROM analysis", "analysis")
def owned_columns(c: Catalog) -> DataFrame:
    """An analysis pass replaces its own columns and leaves those of the face and scene passes."""
    base = c.analysis.select("photo_id", "sharpness", "face_count", "scene_fine")
    return merge_rows(base, base.where("photo_id % 2 = 0").select("photo_id", F.lit(50.0).alias("sharpness"), F.lit(9).alias("face_count")), "photo_id", {"sharpness": "new"})


@query("A26_csv_round_trip", "SELECT image_id, mid, fine, coarse, confidence FROM label_rows", "label_rows", rounded="confidence")
def csv_round_trip(c: Catalog) -> DataFrame:
    """Label rows written as sorted CSV with a header, and read back with their types."""
    path = f"{shared_dir(c.spark)}/labels-{uuid.uuid4().hex}"
    c.view("label_rows").orderBy("mid", "image_id").write.option("header", True).csv(path)
    return c.spark.read.schema("image_id string, mid string, fine string, coarse string, confidence double").option("header", True).csv(path)


@query("A27_tolerant_manifest", "SELECT count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS malformed, count(DISTINCT CASE WHEN event_id % 7 <> 0 THEN event_id END) AS ids FROM events")
def tolerant_manifest(c: Catalog) -> DataFrame:
    """A JSON-lines manifest with broken lines, which are counted."""
    path = f"{shared_dir(c.spark)}/manifest-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("status")))
    c.table("events").select(F.when(F.col("event_id") % 7 == 0, F.concat(line, F.lit("}{"))).otherwise(line).alias("value")).select(F.when(F.endswith("value", F.lit("}{")), F.lit("{broken")).otherwise(F.col("value")).alias("value")).write.text(path)
    rows = manifest(c.spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt").alias("malformed"), F.countDistinct("id").alias("ids"))


@query("F02_cleared_states", "SELECT * FROM selections WHERE photo_id % 5 <> 0", "selections")
def cleared_states(c: Catalog) -> DataFrame:
    return curation.cleared_states(c.view("selections"), c.photos.where("id % 5 = 0").select(F.col("id").alias("photo_id")))


@query("F06_review_progress", "SELECT session_id, max(id) AS focused_photo_id, count(*) AS unit_index FROM photos WHERE session_id IS NOT NULL AND session_id % 3 = 0 GROUP BY 1", "photos")
def review_progress(c: Catalog) -> DataFrame:
    """New progress rows; a focus that is no photo of its session, and a negative index, are refused."""
    own = c.photos.where("session_id is not null")
    asked = own.groupBy("session_id").agg(F.max("id").alias("focused_photo_id"), F.count(F.lit(1)).alias("unit_index"))
    sound = asked.where("session_id % 3 = 0")
    # the focus of one session is no photo of the next, however many photos there are
    wrong = sound.selectExpr("session_id + 1 as session_id", "focused_photo_id", "unit_index")
    rows = sound.unionByName(wrong)
    return curation.sound_progress(rows, own)


@query("F06_saved_progress", """
WITH s AS (SELECT session_id, min(id) AS lo, max(id) AS hi, count(*) AS n FROM photos WHERE session_id IS NOT NULL GROUP BY 1),
b AS (SELECT session_id, 1::BIGINT AS unit_index, lo AS focused_photo_id, '2024-01-01T00:00:00Z' AS updated_at FROM s WHERE session_id % 4 = 0),
d AS (SELECT session_id, n AS unit_index, CASE WHEN session_id % 5 > 0 THEN hi END AS focused_photo_id, '2025-01-01T00:00:00Z' AS updated_at FROM s WHERE session_id % 5 <> 1 AND session_id % 7 > 0
  UNION ALL SELECT session_id, 0, lo, '2024-06-01T00:00:00Z' FROM s WHERE session_id % 5 IN (1, 2) AND (session_id % 7 = 0 OR session_id % 5 = 1))
SELECT coalesce(d.session_id, b.session_id) AS session_id, CASE WHEN d.session_id IS NULL THEN b.unit_index ELSE d.unit_index END AS unit_index,
  CASE WHEN d.session_id IS NULL THEN b.focused_photo_id ELSE d.focused_photo_id END AS focused_photo_id, coalesce(d.updated_at, b.updated_at) AS updated_at FROM b FULL JOIN d ON d.session_id = b.session_id""", "photos")
def saved_progress(c: Catalog) -> DataFrame:
    """Stored progress after changes: some have no focus, some a focus of another session, a negative index or a later change of their session."""
    own = c.photos.where("session_id is not null")
    s = own.groupBy("session_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    stored = s.where("session_id % 4 = 0").selectExpr("session_id", "1L as unit_index", "lo as focused_photo_id", "'2024-01-01T00:00:00Z' as updated_at")
    late = s.selectExpr("session_id", "if(session_id % 7 = 0, -1L, n) as unit_index", "case when session_id % 5 = 1 then hi + 1000000 when session_id % 5 > 0 then hi end as focused_photo_id", "'2025-01-01T00:00:00Z' as updated_at")
    early = s.where("session_id % 5 in (1, 2)").selectExpr("session_id", "0L as unit_index", "lo as focused_photo_id", "'2024-06-01T00:00:00Z' as updated_at")
    return curation.saved_progress(stored, late.unionByName(early), own)


@query("F09_removed_members", "SELECT * FROM collection_photos WHERE NOT (collection_id = 3 AND photo_id % 2 = 0)", "collection_photos")
def removed_members(c: Catalog) -> DataFrame:
    m = c.view("collection_photos")
    return curation.removed_members(m, m.where("collection_id = 3 and photo_id % 2 = 0"))


@query("F13_moved_paths", "SELECT id, CASE WHEN id % 4 = 0 THEN '/moved' || path ELSE path END AS path, CASE WHEN id % 8 = 0 THEN 1 ELSE size_bytes END AS size_bytes FROM photos", "photos")
def moved_paths(c: Catalog) -> DataFrame:
    moves = c.photos.where("id % 4 = 0").select("id", F.concat(F.lit("/moved"), "path").alias("path"), F.when(F.col("id") % 8 == 0, 1).cast("long").alias("size_bytes"))
    return merge_rows(c.photos.select("id", "path", "size_bytes"), moves, "id", {"path": "new_first", "size_bytes": "new_first"})


@query("F15_plan_order", "SELECT id, row_number() OVER (ORDER BY capture_datetime NULLS FIRST, filename, id) AS place FROM photos", "photos")
def plan_places(c: Catalog) -> DataFrame:
    return curation.numbered(c.photos).select("id", F.col("place").cast("long").alias("place"))


@query("F24_applied_outcomes", """
SELECT id, CASE WHEN id % 5 = 1 THEN '/new' || path ELSE path END AS path FROM photos WHERE id % 5 <> 2 UNION ALL SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY id), '/copy' || path FROM photos WHERE id % 5 = 3""", "photos")
def applied_outcomes(c: Catalog) -> DataFrame:
    """Outcomes of operations: renames and moves change the path, copies add a row, trash and deletion remove one."""
    op = F.when(F.col("id") % 5 == 1, "move").when(F.col("id") % 5 == 2, "trash").when(F.col("id") % 5 == 3, "copy")
    to = F.concat(F.when(F.col("id") % 5 == 1, "/new").otherwise("/copy"), F.col("path"))
    done = c.photos.select(F.col("id").alias("photo_id"), op.alias("op_type"), to.alias("destination")).where("op_type is not null")
    return curation.applied(c.photos.select("id", "path"), done)


_DONE = """SELECT id AS photo_id, path AS source, CASE id % 7 WHEN 1 THEN 'move' WHEN 2 THEN 'trash' WHEN 3 THEN 'copy' WHEN 4 THEN 'rename' ELSE 'delete' END AS op_type,
  CASE id % 7 WHEN 1 THEN '/new' || path WHEN 3 THEN '/copy/' || CAST(id AS STRING) || '.jpg' WHEN 4 THEN replace(path, '.', '-x.') END AS destination,
  CASE WHEN id % 2 = 0 THEN id END AS size_bytes, CASE WHEN id % 3 = 0 THEN '2026-01-01T00:00:00Z' END AS file_mtime, id % 11 > 0 AS ok FROM {photos} WHERE id % 7 > 0 AND id % 7 < 6"""


def done_operations(c: Catalog) -> DataFrame:
    return c.spark.sql(_DONE, photos=c.photos)


@query("F24_applied_catalog", f"""
WITH d AS ({_DONE.format(photos="photos").replace("STRING", "VARCHAR")})
SELECT p.id, coalesce(destination, path) AS path, regexp_extract(coalesce(destination, path), '[^/]*$') AS filename, p.extension, coalesce(d.size_bytes, p.size_bytes) AS size_bytes, width, height, orientation, session_id, coalesce(d.file_mtime, p.file_mtime) AS file_mtime
FROM photos p LEFT JOIN (SELECT * FROM d WHERE ok AND op_type <> 'copy') d ON photo_id = id WHERE op_type IS NULL OR op_type IN ('move', 'rename')
UNION ALL SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY destination), destination, regexp_extract(destination, '[^/]*$'), p.extension, d.size_bytes, width, height, orientation, NULL, d.file_mtime FROM photos p JOIN d ON photo_id = id WHERE ok AND op_type = 'copy'""", "photos")
def applied_catalog(c: Catalog) -> DataFrame:
    """The catalog after operations: new paths and names, copies with the dimensions of their source and no session, trashed photos gone."""
    photos = c.photos.select("id", "path", "filename", "extension", "size_bytes", "width", "height", "orientation", "session_id", "file_mtime")
    return curation.applied_catalog(photos, done_operations(c))


@query("F24_logged_outcomes", f"SELECT op_type, source AS source_path, destination AS dest_path, 'done' AS status, '2026-01-02T00:00:00Z' AS created_at FROM ({_DONE.format(photos='photos').replace('STRING', 'VARCHAR')}) WHERE ok UNION ALL SELECT op_type, source_path, NULL, status, created_at FROM file_operations", "photos file_operations")
def logged_outcomes(c: Catalog) -> DataFrame:
    """The operation log after a row for each operation that was carried out."""
    path = f"{shared_dir(c.spark)}/operations-{uuid.uuid4().hex}"
    log = c.view("file_operations").select("op_type", "source_path", F.lit(None).cast("string").alias("dest_path"), "status", "created_at")
    curation.log_operations(path, log)
    curation.log_operations(path, curation.outcome_rows(done_operations(c), F.lit("2026-01-02T00:00:00Z")))
    return c.spark.read.schema(log.schema).parquet(path)


@query("F27_clean_labels", "SELECT p_partkey, CASE WHEN length(trim(p_name)) BETWEEN 1 AND 12 THEN trim(p_name) END AS label FROM part")
def clean_labels(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", names.cleaned("p_name", 12).alias("label"))


@query("A07_upserted_sessions", """
SELECT id, CASE WHEN id % 2 = 0 AND id > 0 THEN 'Scan ' || id ELSE name END AS name, root_path FROM sessions
UNION ALL SELECT (SELECT max(id) FROM sessions) + row_number() OVER (ORDER BY '/new/' || c_custkey), c_name, '/new/' || c_custkey FROM customer""", "sessions")
def upserted_sessions(c: Catalog) -> DataFrame:
    """A scan of known folders under new names and of as many unknown ones as there are customers."""
    known = c.view("sessions").where("id % 2 = 0 and id > 0").select("root_path", F.concat(F.lit("Scan "), F.col("id").cast("string")).alias("name"))
    fresh = c.table("customer").select(F.concat(F.lit("/new/"), F.col("c_custkey").cast("string")).alias("root_path"), F.col("c_name").alias("name"))
    return curation.upserted_sessions(c.view("sessions"), known.unionByName(fresh))


@query("F07_edited_collections", """
WITH n AS (SELECT DISTINCT trim(p_brand) AS name FROM part), k AS (
  SELECT id, CASE WHEN id = 2 THEN 'Two' ELSE name END AS name FROM collections
  UNION ALL SELECT 99 + row_number() OVER (ORDER BY name), name FROM n WHERE name NOT IN (SELECT name FROM collections)
)
SELECT k.id, k.name, count(m.photo_id) AS photos FROM k LEFT JOIN collection_photos m ON m.collection_id = k.id WHERE k.id <> 3 GROUP BY 1, 2""", "collections collection_photos")
def edited_collections(c: Catalog) -> DataFrame:
    """Collections after some were created, one renamed, one refused its new name, and one deleted with its members."""
    made = write_table(curation.created(c.view("collections"), c.table("part").select(F.col("p_brand").alias("name"))), "collections")
    taken = made.where("id = 1").select(F.lit(4).cast("long").alias("id"), F.col("name").alias("new_name"))
    changes = made.where("id = 2").select("id", F.lit("Two").alias("new_name")).unionByName(taken)
    gone = made.where("id = 3").select("id")
    left = curation.without_photos(curation.renamed(made, changes), "id", gone)
    return curation.collection_list(left, curation.without_photos(c.view("collection_photos"), "collection_id", gone))


@query("F14_appended_operations", "SELECT * FROM file_operations ORDER BY created_at DESC, id DESC LIMIT 200", "file_operations")
def appended_operations(c: Catalog) -> DataFrame:
    """The log written in two appends and read back."""
    path = f"{shared_dir(c.spark)}/operations-{uuid.uuid4().hex}"
    log = c.view("file_operations")
    for part in (log.where("id % 2 = 0"), log.where("id % 2 = 1")):
        curation.log_operations(path, part)
    return curation.recent_operations(c.spark.read.schema(log.schema).parquet(path), 200)
