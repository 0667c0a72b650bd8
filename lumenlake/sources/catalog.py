"""The catalog: table schemas, and views that bind its tables to the given star-schema tables.

Each view's text runs unchanged in Spark and in DuckDB.  Photos come from events and part, all
else from rules on their ids, so every view grows with its table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAMP = "substr(CAST({0} AS STRING), 1, 10) || 'T' || substr(CAST({0} AS STRING), 12, 8) || 'Z'"

VIEWS = {
    "photos": ("events part", """
SELECT event_id AS id, '/shoot/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.' || ext AS path,
  CASE event_id % 4 WHEN 0 THEN 'IMG_' || replace(d, '-', '') || '_' || replace(h, ':', '') || '.jpg'
                    WHEN 1 THEN 'Screenshot ' || d || ' at ' || replace(h, ':', '.') || '.png'
                    WHEN 2 THEN replace(d, '-', '') || '.jpg'
                    ELSE 'DSC_' || CAST(event_id % 10000 AS STRING) || '.NEF' END AS filename,
  ext AS extension, 1000000 + (event_id * 7919) % 5000000 AS size_bytes, w AS width, ht AS height,
  CASE WHEN w > ht THEN 'landscape' WHEN w < ht THEN 'portrait' WHEN w = ht THEN 'square' END AS orientation,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ' ELSE p_brand END AS camera_make,
  CASE WHEN event_id % 12 = 0 THEN NULL ELSE p_type END AS camera_model,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE p_name END AS lens,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 18.0E0 + (event_id * 7) % 150 END AS focal_length,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(25 * power(2, event_id % 10) AS BIGINT) END AS iso,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE 1.0E0 + (event_id % 20) / 2.0E0 END AS aperture,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 2.0E0 / power(2.0E0, event_id % 14) END AS shutter_speed,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE d || 'T' || h || 'Z' END AS capture_datetime,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'filename' ELSE 'exif' END AS capture_datetime_source,
  event_id % 4 = 0 AS gps_present, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS session_id,
  '2024-06-01T00:00:00Z' AS indexed_at, """ + _STAMP.format("ts") + """ AS file_mtime,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2020-01-01T00:00:00Z' ELSE '2030-01-01T00:00:00Z' END AS exif_at,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE
    (((CAST((event_id - event_id % 3) / 3 AS BIGINT) * 1103515245 + 12345) % 2147483648) * 2147483648)
     + ((CAST((event_id - event_id % 3) / 3 AS BIGINT) * 69069 + 1) % 268435456) * 8 + event_id % 3 END AS phash,
  CASE event_id % 5 WHEN 2 THEN '2020-01-01T00:00:00Z' ELSE '2030-01-01T00:00:00Z' END AS phash_source_mtime,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 6 END AS rating, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS flag,
  CASE event_id % 8 WHEN 0 THEN 'red' WHEN 3 THEN 'green' END AS color_label
FROM (
  SELECT b.*, substr(CAST(cap AS STRING), 1, 10) AS d, substr(CAST(cap AS STRING), 12, 8) AS h,
    CASE WHEN event_id % 12 = 0 THEN NULL ELSE 2000 + (event_id % 3) * 1000 END AS w, CASE WHEN event_id % 12 = 0 THEN NULL ELSE 3000 END AS ht,
    CASE event_id % 10 WHEN 7 THEN 'png' WHEN 8 THEN 'heic' WHEN 9 THEN 'cr2' ELSE 'jpg' END AS ext
  FROM (SELECT e.*, p.p_brand, p.p_name, p.p_type, e.ts + (e.user_id % 40) * INTERVAL '30' DAY AS cap
        FROM {events} e LEFT JOIN {part} p ON p.p_partkey = e.event_id % 200) b) s"""),
    "analysis": ("events", """
SELECT event_id AS photo_id,
  CASE WHEN f THEN NULL ELSE ((event_id * 37) % 1000) / 10.0E0 END AS sharpness, CASE WHEN f THEN NULL ELSE ((event_id * 53) % 1000) / 10.0E0 END AS brightness,
  CASE WHEN f THEN NULL ELSE ((event_id * 71) % 1000) / 10.0E0 END AS contrast, CASE WHEN f THEN NULL ELSE ((event_id * 91) % 1000) / 10.0E0 END AS saturation,
  CASE WHEN f THEN NULL ELSE ((event_id * 13) % 200) / 10.0E0 END AS highlight_clipping, CASE WHEN f THEN NULL ELSE ((event_id * 17) % 200) / 10.0E0 END AS shadow_clipping,
  CASE WHEN f THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_monochrome, CASE WHEN f THEN 0 WHEN (event_id * 53) % 1000 < 350 THEN 1 ELSE 0 END AS is_dark,
  CASE WHEN f THEN 0 WHEN (event_id * 53) % 1000 > 650 THEN 1 ELSE 0 END AS is_bright, CASE WHEN f THEN NULL ELSE CAST((event_id * 7) % 4096 AS INTEGER) END AS color_signature,
  CASE WHEN n THEN NULL ELSE event_id % 3 END AS face_count, CASE WHEN n THEN NULL ELSE (event_id % 3) * (event_id % 2) END AS smile_count,
  CASE WHEN n THEN NULL WHEN event_id % 13 = 0 THEN 1 ELSE 2 * (event_id % 3) END AS eye_evaluated_count,
  CASE WHEN n THEN NULL WHEN event_id % 4 = 0 AND event_id % 3 > 0 THEN 1 ELSE 0 END AS closed_eye_face_count,
  CASE WHEN n OR event_id % 3 = 0 THEN NULL ELSE ((event_id * 29) % 1000) / 10.0E0 END AS max_eye_closure_confidence,
  CASE WHEN n THEN NULL WHEN event_id % 10 = 3 THEN 1 ELSE 2 END AS eye_algorithm_version,
  CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS possible_blink,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'people' WHEN 2 THEN 'nature' WHEN 3 THEN 'city' ELSE 'other' END AS scene_coarse,
  CASE event_id % 7 WHEN 0 THEN NULL ELSE 'scene' || CAST(event_id % 21 AS STRING) END AS scene_fine, '2024-03-01T00:00:00Z' AS scene_at,
  CASE WHEN f THEN 0 ELSE 1 + event_id % 3 END AS algorithm_version,
  CASE WHEN event_id % 9 = 4 THEN '2020-01-01T00:00:00Z' ELSE """ + _STAMP.format("ts") + """ END AS source_mtime, '2024-02-01T00:00:00Z' AS faces_at
FROM (SELECT e.*, event_id % 5 = 1 AS f, event_id % 5 = 2 AS n FROM {events} e WHERE event_id % 5 <> 0) s"""),
    "sessions": ("events", """
SELECT user_id AS id, 'Shoot ' || CAST(user_id AS STRING) AS name, '/shoot/' || CAST(user_id AS STRING) AS root_path FROM (SELECT DISTINCT user_id FROM {events}) s
UNION ALL SELECT -1 AS id, 'Empty' AS name, '/shoot/empty' AS root_path"""),
    "selections": ("events", """
SELECT event_id AS photo_id, CASE event_type WHEN 'purchase' THEN 'selected' WHEN 'error' THEN 'rejected' ELSE 'needs_attention' END AS state,
  """ + _STAMP.format("ts") + """ AS updated_at
FROM {events} WHERE event_type IN ('purchase', 'error', 'signup')"""),
    "face_observations": ("events", """
SELECT event_id AS photo_id, i AS face_index, ((CAST((event_id - event_id % 6) / 6 AS BIGINT) * 2654435761) % 4294967296) * 1048576 + event_id % 6 + i * 64 AS appearance_hash,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 4 = 0 THEN 0.05E0 ELSE 0.95E0 END AS left_eye_open_prob,
  CASE WHEN event_id % 10 = 8 THEN 0.5E0 WHEN event_id % 4 = 0 THEN 0.1E0 ELSE 0.9E0 END AS right_eye_open_prob
FROM {events} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i) n WHERE i < event_id % 3"""),
    "file_operations": ("orders", """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'trash' WHEN 'O' THEN 'move' ELSE 'rename' END AS op_type,
  '/shoot/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 4000 AS STRING) || '.jpg' AS source_path,
  CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, """ + _STAMP.format("o_orderdate") + """ AS created_at
FROM {orders}"""),
    "collections": ("orders", """
SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, o_orderpriority AS name FROM (SELECT DISTINCT o_orderpriority FROM {orders}) s
UNION ALL SELECT 99 AS id, 'Empty' AS name"""),
    "collection_photos": ("orders", """
SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS collection_id, o_orderkey AS photo_id, min(""" + _STAMP.format("o_orderdate") + """) AS added_at
FROM {orders} GROUP BY 1, 2"""),
    "corpus": ("documents", """
SELECT doc_id AS seq, 'img/' || CAST(doc_id AS STRING) || '.jpg' AS path, text AS content, lang AS fine,
  CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'machine' WHEN 2 THEN 'openverse' ELSE 'commons' END AS source
FROM {documents}"""),
    "label_rows": ("documents labels", """
SELECT CAST(d.doc_id AS STRING) AS image_id, d.lang || CAST(d.doc_id % 11 AS STRING) AS mid, d.lang || CAST(d.doc_id % 11 AS STRING) AS fine, d.lang AS coarse,
  ((d.n_chars * 31) % 100) / 100.0E0 AS confidence FROM {documents} d
UNION ALL
SELECT CAST(l.doc_id AS STRING), 'q' || CAST(l.quality AS STRING), 'q' || CAST(l.quality AS STRING), 'quality', ((l.doc_id * 17) % 100) / 100.0E0 FROM {labels} l"""),
}


def view_sql(name: str) -> str:
    tables, text = VIEWS[name]
    return text.format(**{t: t for t in tables.split()}).strip()


class Catalog:
    """Given tables and catalog views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        tables, text = VIEWS[name]
        return self.spark.sql(text, **{t: self.table(t) for t in tables.split()})

    @cached_property
    def photos(self) -> DataFrame:
        return self.view("photos")

    @cached_property
    def analysis(self) -> DataFrame:
        return self.view("analysis")

    @cached_property
    def joined(self) -> DataFrame:
        """Photos with their analysis, where there is one."""
        return self.photos.join(self.analysis, F.col("id") == F.col("photo_id"), "left")


def known_time() -> Column:
    return F.coalesce("capture_datetime", "indexed_at")


def capture_provenance(read: Column, guessed: Column, guessed_from: Column, stored: str, source: str) -> list[Column]:
    """capture_datetime and source: a date that was read before an estimate before the stored one.

    An estimate keeps its own source, filename or mtime; a stored date without a source counts as read.
    """
    kept = F.coalesce(F.col(source), F.when(F.col(stored).isNotNull(), "exif"))
    whence = F.when(read.isNotNull(), "exif").when(guessed.isNotNull(), guessed_from).otherwise(kept)
    return [F.coalesce(read, guessed, stored).alias("capture_datetime"), whence.alias("source")]


def merge_rows(base: DataFrame, delta: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """base brought up to date by delta, one row per key, by one full outer join.

    rules: for each column `new` (delta where it has the key, nulls included), `new_first`, `old_first` (coalesced) or `or`
    (true once true); columns without a rule keep their value and are null in added rows.  Keys of delta must be unique.
    """
    left, right = base.alias("l"), delta.alias("r")
    out = [F.coalesce(f"l.{key}", f"r.{key}").alias(key)]
    for c in base.columns:
        if c == key:
            continue
        old, rule = F.col(f"l.{c}"), rules.get(c)
        new = F.col(f"r.{c}") if c in delta.columns else F.lit(None)
        out.append({None: old, "new": F.when(F.col(f"r.{key}").isNotNull(), new).otherwise(old), "new_first": F.coalesce(new, old), "old_first": F.coalesce(old, new), "or": F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))}[rule].alias(c) if rule else old.alias(c))
    return left.join(right, F.col(f"l.{key}") == F.col(f"r.{key}"), "full").select(*out)
