"""Queries over filters, joins and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import filters, stats
from lumenlake.plans.registry import DERIVED, query
from lumenlake.sources.catalog import Catalog, known_time


def grid(c: Catalog) -> DataFrame:
    """Photos with analysis and review state, each where there is one."""
    states = c.view("selections").select(F.col("photo_id").alias("_photo"), F.col("state").alias("review_state"))
    return c.joined.join(states, F.col("id") == F.col("_photo"), "left").drop("_photo")


GRID = "SELECT p.*, a.*, s.state AS review_state FROM photos p LEFT JOIN analysis a ON a.photo_id = p.id LEFT JOIN selections s ON s.photo_id = p.id"
DERIVED["g"] = GRID
ALL = "photos analysis selections"

#: Filters of every kind and operator, with the condition each stands for.
CASES = {
    "real": ((("sharpness", ">=", 40), ("sharpness", "<", 90.5)), "sharpness >= 40 AND sharpness < 90.5"),
    "real_eq": ((("aperture", "=", 2.5),), "aperture = 2.5"),
    "real_neq": ((("aperture", "!=", 2.5),), "aperture <> 2.5"),
    "real_between": ((("contrast", "between", [20, 50]),), "contrast BETWEEN 20 AND 50"),
    "real_in": ((("focal_length", "in", [25, 32, 39]),), "focal_length IN (25, 32, 39)"),
    "int": ((("iso", "<", 1600), ("iso", ">", 50)), "iso < 1600 AND iso > 50"),
    "int_between": ((("rating", "between", [2, 4]),), "rating BETWEEN 2 AND 4"),
    "int_null": ((("face_count", "is-null"),), "face_count IS NULL"),
    "int_known": ((("smile_count", "not-null"), ("smile_count", "<=", 0)), "smile_count <= 0"),
    "text": ((("orientation", "=", "landscape"),), "orientation = 'landscape'"),
    "text_neq": ((("color_label", "!=", "red"),), "color_label <> 'red'"),
    "text_in": ((("scene_group", "in", ["people", " city "]),), "scene_coarse IN ('people', 'city')"),
    "text_blank": ((("camera_make", "is-null"),), "camera_make IS NULL OR trim(camera_make) = ''"),
    "text_state": ((("review_state", "in", ["selected", "rejected"]),), "review_state IN ('selected', 'rejected')"),
    "text_unreviewed": ((("review_state", "is-null"),), "review_state IS NULL"),
    "no_faces": ((("faces_present", "=", False),), "NOT coalesce(face_count > 0, false)"),
    "smiling": ((("smiling", "=", True),), "smile_count > 0"),
    "not_monochrome": ((("monochrome", "=", False),), "is_monochrome <> 1"),
    "color": ((("color", "=", True),), "is_monochrome = 0"),
    "no_blink": ((("possible_blink", "!=", True),), "NOT possible_blink"),
    "flagged": ((("flagged", "=", True), ("dark", "=", True)), "flag = 1 AND is_dark = 1"),
    "palette": ((("palette_color", "in", ["red", "blue"]),), "(color_signature & 257) <> 0"),
    "date_between": ((("capture_datetime", "between", ["2024-03-01", "2024-12-31"]),), "capture_datetime BETWEEN '2024-03-01' AND '2024-12-31'"),
    "date_after": ((("capture_datetime", ">", "2025-01-01T00:00:00Z"),), "capture_datetime > '2025-01-01T00:00:00Z'"),
}


@query("C02_filter_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS n FROM g" for n, (_, w) in CASES.items()) + ")", ALL + " g")
def filter_counts(c: Catalog) -> DataFrame:
    return filters.matches(grid(c), {n: filters.as_json(*conditions) for n, (conditions, _) in CASES.items()})


PAGE = filters.as_json(("sharpness", ">=", 40), ("iso", "<", 1600), ("camera_make", "in", ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31", "Brand#32"]))
PAGE_WHERE = "sharpness >= 40 AND iso < 1600 AND trim(camera_make) IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#31', 'Brand#32')"
COLUMNS = ", ".join(filters.GRID)


@query("C11_filtered_page", f"SELECT {COLUMNS} FROM ({GRID}) WHERE {PAGE_WHERE} ORDER BY capture_datetime NULLS LAST, id LIMIT 96", ALL)
def filtered_page(c: Catalog) -> DataFrame:
    return filters.page(grid(c), PAGE, 96)


@query("C11_filtered_total", f"SELECT count(*) AS total FROM ({GRID}) WHERE {PAGE_WHERE}", ALL)
def filtered_total(c: Catalog) -> DataFrame:
    return filters.total(grid(c), PAGE)


@query("C12_unfiltered_page", f"SELECT {COLUMNS} FROM ({GRID}) ORDER BY capture_datetime NULLS LAST, id LIMIT 96 OFFSET 96", ALL)
def unfiltered_page(c: Catalog) -> DataFrame:
    return filters.page(grid(c), "", 96, 96)


@query("C13_full_rows", f"SELECT * EXCLUDE (photo_id) FROM ({GRID})", ALL)
def full_rows(c: Catalog) -> DataFrame:
    return grid(c).drop("photo_id")


@query("C14_value_options", """
SELECT * FROM (SELECT 'camera_make' AS field, camera_make AS value, count(*) AS n FROM photos WHERE trim(camera_make) <> '' GROUP BY 2
UNION ALL SELECT 'camera_model', camera_model, count(*) FROM photos WHERE trim(camera_model) <> '' GROUP BY 2
UNION ALL SELECT 'lens', lens, count(*) FROM photos WHERE trim(lens) <> '' GROUP BY 2
UNION ALL SELECT 'unidentified', NULL, count(*) FROM photos WHERE coalesce(trim(camera_make), '') = '' AND coalesce(trim(camera_model), '') = '')""", "photos")
def value_options(c: Catalog) -> DataFrame:
    """Distinct raw values with counts, most frequent first, and the photos without make and model."""
    named = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    rows = c.photos.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.when(named(f), F.col(f)).alias("value")) for f in ("camera_make", "camera_model", "lens")])))
    counts = rows.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    none = c.photos.where(~named("camera_make") & ~named("camera_model")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unidentified").alias("field"), F.lit(None).cast("string").alias("value"), "n")
    return counts.unionByName(none).orderBy("field", F.desc("n"), F.lower("value"))


NUMBERS = ["iso", "aperture", "focal_length", "shutter_speed", "sharpness", "brightness", "highlight_clipping", "shadow_clipping"]


@query("C15_numeric_stats", " UNION ALL ".join(f"SELECT '{n}' AS field, count({n}) AS recorded, count(*) - count({n}) AS missing, min({n})::DOUBLE AS lowest, max({n})::DOUBLE AS highest FROM ({GRID})" for n in NUMBERS), ALL)
def numeric_stats(c: Catalog) -> DataFrame:
    """All fields from one aggregate."""
    one = c.joined.agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{n}_{k}") for n in NUMBERS for k, f in (("count", F.count), ("min", F.min), ("max", F.max))])
    row = lambda n: F.struct(F.lit(n).alias("field"), F.col(f"{n}_count").alias("recorded"), (F.col("n") - F.col(f"{n}_count")).alias("missing"), F.col(f"{n}_min").cast("double").alias("lowest"), F.col(f"{n}_max").cast("double").alias("highest"))
    return one.select(F.inline(F.array(*map(row, NUMBERS))))


PRESET_WHERE = {"potentially-soft": "sharpness < 40", "highlight-clipping": "highlight_clipping >= 5", "shadow-clipping": "shadow_clipping >= 5", "closed-eye-candidate": "closed_eye_face_count > 0", "possible-blink": "possible_blink", "monochrome": "is_monochrome = 1", "color": "is_monochrome = 0", "dark": "is_dark = 1", "bright": "is_bright = 1", "landscape": "orientation = 'landscape'", "portrait": "orientation = 'portrait'", "faces": "face_count > 0"}


@query("C18_preset_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS n FROM g" for n, w in PRESET_WHERE.items()) + ")", ALL + " g")
def preset_counts(c: Catalog) -> DataFrame:
    return filters.matches(grid(c), {n: filters.as_json(x) for n, x in filters.PRESETS.items()})


JOINED = "photos p LEFT JOIN analysis a ON a.photo_id = p.id"
TIME = "coalesce(capture_datetime, indexed_at)"
TOTALS = """count(*) AS photos, count(DISTINCT session_id) AS sessions, count(*) / nullif(count(DISTINCT session_id), 0) AS photos_per_session, count(photo_id) AS analyzed,
  avg(sharpness) AS avg_sharpness, avg(brightness) AS avg_brightness, avg(contrast) AS avg_contrast, avg(saturation) AS avg_saturation,
  100.0 * sum(is_monochrome) / nullif(count(photo_id), 0)::DOUBLE AS monochrome_share, 100.0 * count(*) FILTER (is_monochrome = 0) / nullif(count(photo_id), 0)::DOUBLE AS color_share,
  100.0 * count(*) FILTER (face_count > 0) / nullif(count(face_count), 0)::DOUBLE AS face_share, 100.0 * count(*) FILTER (smile_count > 0) / nullif(count(smile_count), 0)::DOUBLE AS smile_share"""
YEAR = ("2024-01-01T00:00:00Z", "2024-12-31T23:59:59Z")


@query("S02_totals", f"SELECT {TOTALS} FROM {JOINED}", "photos analysis", rounded="photos_per_session avg_sharpness avg_brightness avg_contrast avg_saturation monochrome_share color_share face_share smile_share")
def totals(c: Catalog) -> DataFrame:
    return c.joined.agg(*stats.totals())


@query("S18_period_totals", f"SELECT {TOTALS} FROM {JOINED} WHERE {TIME} BETWEEN '{YEAR[0]}' AND '{YEAR[1]}'", "photos analysis", rounded="photos_per_session avg_sharpness avg_brightness avg_contrast avg_saturation monochrome_share color_share face_share smile_share")
def period_totals(c: Catalog) -> DataFrame:
    return c.joined.where(stats.in_period(YEAR)).agg(*stats.totals())


def _histogram_sql() -> str:
    parts = []
    for name, (labels, edges) in stats.HISTOGRAMS.items():
        up = edges[0] < edges[-1]
        for i, label in enumerate(labels):
            low, high = (edges[i - 1] if i else None, edges[i] if i < len(edges) else None)
            tests = [f"{name} {'>=' if up else '<'} {low!r}::DOUBLE"] * (low is not None) + [f"{name} {'<' if up else '>='} {high!r}::DOUBLE"] * (high is not None)
            parts.append(f"SELECT '{name}' AS histogram, {i} AS bin, '{label}' AS label, count(*) FILTER ({' AND '.join(tests)}) AS n FROM photos")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query("S06_histograms", _histogram_sql(), "photos")
def histograms(c: Catalog) -> DataFrame:
    return stats.histograms(c.photos)


def _usage_sql(column: str, unknown: str) -> str:
    return f"""SELECT coalesce(nullif(trim({column}), ''), '{unknown}') AS name, count(*) AS photos, avg(sharpness) AS avg_sharpness, avg(iso) AS avg_iso,
  100.0 * count(*) / (SELECT count(*) FROM photos)::DOUBLE AS share FROM {JOINED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""


@query("S10_camera_usage", _usage_sql("camera_make", "Unknown camera"), "photos analysis", rounded="avg_sharpness avg_iso share")
def camera_usage(c: Catalog) -> DataFrame:
    return stats.usage(c.joined, "camera_make", "Unknown camera")


@query("S11_lens_usage", _usage_sql("lens", "Unknown lens"), "photos analysis", rounded="avg_sharpness avg_iso share")
def lens_usage(c: Catalog) -> DataFrame:
    return stats.usage(c.joined, "lens", "Unknown lens")


@query("S12_monthly_trend", f"""
SELECT substr({TIME}, 1, 7) AS month, count(*) AS photos, count(DISTINCT session_id) AS sessions, avg(sharpness) AS avg_sharpness, avg(iso) AS avg_iso,
  100.0 * count(*) FILTER (is_monochrome = 0) / nullif(count(photo_id), 0)::DOUBLE AS color_share
FROM {JOINED} GROUP BY 1 ORDER BY 1 DESC LIMIT 36""", "photos analysis", rounded="avg_sharpness avg_iso color_share")
def monthly_trend(c: Catalog) -> DataFrame:
    return stats.trend(c.joined)


@query("S13_selection_stats", f"""
SELECT count(*) AS imported, count(*) FILTER (state = 'selected') AS selected, count(*) FILTER (state = 'rejected') AS rejected,
  (SELECT count(DISTINCT source_path) FROM file_operations WHERE op_type = 'trash') AS trashed, count(*) FILTER (state = 'selected') / count(*)::DOUBLE AS kept_ratio
FROM photos p LEFT JOIN selections s ON s.photo_id = p.id WHERE {TIME} BETWEEN '{YEAR[0]}' AND '{YEAR[1]}'""", "photos selections file_operations", rounded="kept_ratio")
def selection_stats(c: Catalog) -> DataFrame:
    return stats.selection(c.photos.where(stats.in_period(YEAR)), c.view("selections"), c.view("file_operations"))


_BY_SESSION = f"""
WITH b AS (
  SELECT session_id, min({TIME}) AS start_time, max({TIME}) AS end_time, {TOTALS}, avg(iso) AS avg_iso, avg(aperture) AS avg_aperture, avg(shutter_speed) AS avg_shutter_speed
  FROM {JOINED} WHERE session_id IS NOT NULL GROUP BY session_id
)
SELECT s.*, b.* EXCLUDE (session_id, photos, sessions, photos_per_session), coalesce(photos, 0) AS photos, (epoch(end_time::TIMESTAMP) - epoch(start_time::TIMESTAMP)) / 86400.0 AS duration_days
FROM sessions s LEFT JOIN b ON b.session_id = s.id"""


@query("S16_session_summaries", _BY_SESSION, "photos analysis sessions", rounded="avg_sharpness avg_brightness avg_contrast avg_saturation monochrome_share color_share face_share smile_share avg_iso avg_aperture avg_shutter_speed duration_days")
def session_summaries(c: Catalog) -> DataFrame:
    return stats.sessions_summary(c.joined, c.view("sessions"))


@query("S17_compare_sessions", f"""
WITH r AS (SELECT unnest([7, 3, 11, 20]) AS session_id, unnest([1, 2, 3, 4]) AS position)
SELECT position, session_id, count(id) AS photos, avg(sharpness) AS avg_sharpness, avg(iso) AS avg_iso, avg(aperture) AS avg_aperture, avg(shutter_speed) AS avg_shutter_speed
FROM r LEFT JOIN (SELECT session_id, id, iso, aperture, shutter_speed, sharpness FROM {JOINED}) g USING (session_id) GROUP BY 1, 2""", "photos analysis", rounded="avg_sharpness avg_iso avg_aperture avg_shutter_speed")
def compare_sessions(c: Catalog) -> DataFrame:
    """Up to eight sessions side by side, in the order asked for."""
    asked = c.spark.createDataFrame([(7, 1), (3, 2), (11, 3), (20, 4)], "session_id long, position int")
    rows = c.joined.join(F.broadcast(asked.select("session_id")), "session_id", "left_semi")
    by = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("photos"), F.avg("sharpness").alias("avg_sharpness"), *stats.camera_averages())
    return asked.join(by, "session_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0))).orderBy("position")


@query("S19_subtotals", f"""
SELECT session_id, substr({TIME}, 1, 7) AS month, coalesce(nullif(trim(camera_make), ''), 'Unknown camera') AS camera,
  grouping(session_id, substr({TIME}, 1, 7), coalesce(nullif(trim(camera_make), ''), 'Unknown camera')) AS level, count(*) AS photos, avg(sharpness) AS avg_sharpness, avg(iso) AS avg_iso
FROM {JOINED} GROUP BY ROLLUP (1, 2, 3)""", "photos analysis", rounded="avg_sharpness avg_iso")
def subtotals(c: Catalog) -> DataFrame:
    return stats.subtotals(c.joined)


@query("S20_lens_by_month", f"""
SELECT substr({TIME}, 1, 7) AS month, coalesce(nullif(trim(lens), ''), 'Unknown lens') AS name, count(*) AS photos,
  100.0 * count(*) / (sum(count(*)) OVER (PARTITION BY substr({TIME}, 1, 7)))::DOUBLE AS share FROM photos GROUP BY 1, 2""", "photos", rounded="share")
def lens_by_month(c: Catalog) -> DataFrame:
    return stats.usage_by_month(c.photos, "lens", "Unknown lens")


@query("A08_session_rollup", f"""
SELECT s.id, count(p.id) AS photo_count, min({TIME}) AS start_time, max({TIME}) AS end_time FROM sessions s LEFT JOIN photos p ON p.session_id = s.id GROUP BY s.id""", "photos sessions")
def session_rollup(c: Catalog) -> DataFrame:
    by = c.photos.groupBy("session_id").agg(F.count(F.lit(1)).alias("photo_count"), F.min(known_time()).alias("start_time"), F.max(known_time()).alias("end_time"))
    return c.view("sessions").select("id").join(by, F.col("id") == F.col("session_id"), "left").select("id", F.coalesce("photo_count", F.lit(0)).alias("photo_count"), "start_time", "end_time")


@query("A24_catalog_status", """
SELECT count(*) AS photos, (SELECT count(*) FROM sessions) AS sessions, count(photo_id) AS analyzed, count(*) FILTER (exif_at IS NULL OR file_mtime > exif_at) AS metadata_pending,
  count(*) FILTER (review_state = 'selected') AS selected, count(*) FILTER (review_state = 'rejected') AS rejected, count(face_count) AS faces_done,
  count(*) FILTER (eye_algorithm_version = 2) AS eyes_done, count(scene_fine) AS scenes_done FROM g""", "photos analysis selections g sessions")
def catalog_status(c: Catalog) -> DataFrame:
    """The whole status from one pass over the joined rows."""
    one = grid(c).agg(F.count(F.lit(1)).alias("photos"), F.count("photo_id").alias("analyzed"), F.count_if(F.expr("exif_at is null or file_mtime > exif_at")).alias("metadata_pending"), F.count_if(F.col("review_state") == "selected").alias("selected"), F.count_if(F.col("review_state") == "rejected").alias("rejected"), F.count("face_count").alias("faces_done"), F.count_if(F.col("eye_algorithm_version") == 2).alias("eyes_done"), F.count("scene_fine").alias("scenes_done"))
    return one.crossJoin(c.view("sessions").agg(F.count(F.lit(1)).alias("sessions")))


VIEWS = {"sharp": (filters.as_json(("sharpness", ">=", 80)), "sharpness >= 80"), "best": (filters.as_json(("rating", "=", 5), ("flagged", "=", True)), "rating = 5 AND flag = 1"), "all": ("", "true")}


@query("C17_saved_view_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS n FROM g" for n, (_, w) in VIEWS.items()) + ")", ALL + " g")
def saved_view_counts(c: Catalog) -> DataFrame:
    """All saved views counted in one pass."""
    return filters.matches(grid(c), {n: f for n, (f, _) in VIEWS.items()})


@query("S14_session_camera_averages", "SELECT session_id, avg(iso) AS avg_iso, avg(aperture) AS avg_aperture, avg(shutter_speed) AS avg_shutter_speed FROM photos GROUP BY 1", "photos", rounded="avg_iso avg_aperture avg_shutter_speed")
def session_camera_averages(c: Catalog) -> DataFrame:
    return c.photos.groupBy("session_id").agg(*stats.camera_averages())


def saved_views(c: Catalog) -> DataFrame:
    """A view of each nation: photos of at least as many stars as its region's number, whose name orders its conditions."""
    rating = F.concat(F.lit('{"field": "rating", "operator": ">=", "value": '), F.col("n_regionkey").cast("string"), F.lit("}"))
    flag = F.lit('{"operator": "=", "value": true, "field": "flagged"}')
    both = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(", ", rating, flag)).otherwise(F.concat_ws(",", flag, rating))
    return c.table("nation").select(F.col("n_name").alias("name"), F.concat(F.lit('{"operator": "AND", "conditions": ['), both, F.lit("]}")).alias("filter_json"))


@query("C16_upserted_views", "SELECT n_name AS name, n_nationkey % 5 = 0 AS replaced FROM nation UNION ALL SELECT 'Best', true")
def upserted_views(c: Catalog) -> DataFrame:
    """Views saved again by name replace the old ones; broken filters are refused before."""
    base = saved_views(c).withColumn("replaced", F.lit(False))
    again = c.table("nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name")).unionByName(c.table("region").limit(1).select(F.lit("Best").alias("name")))
    new = again.withColumn("filter_json", F.lit(filters.as_json(("rating", "=", 5)))).withColumn("replaced", F.lit(True))
    return filters.saved(base, new).select("name", "replaced")


@query("C21_equal_views", "SELECT string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def equal_views(c: Catalog) -> DataFrame:
    """Views that hold the same conditions in whatever order."""
    return saved_views(c).groupBy(filters.canonical_key("filter_json").alias("key")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).select("names")


@query("C16_edited_views", """
SELECT CASE WHEN n_nationkey % 3 = 1 AND n_nationkey <> 4 THEN 'best ' || n_name ELSE n_name END AS name FROM nation WHERE n_nationkey % 7 <> 0""")
def edited_views(c: Catalog) -> DataFrame:
    """The list after some views were renamed, one to a name that is taken, and others deleted."""
    nation = c.table("nation").withColumnRenamed("n_name", "name")
    taken = nation.where("n_nationkey = 5").select(F.lower("name").alias("taken"))
    changes = nation.where("n_nationkey % 3 = 1").crossJoin(F.broadcast(taken)).select("name", F.when(F.col("n_nationkey") == 4, F.col("taken")).otherwise(F.concat(F.lit(" best "), "name")).alias("new_name"))
    kept = filters.listed(saved_views(c), nation.where("n_nationkey % 7 = 0"))
    return filters.renamed(kept, changes).select("name")
