"""Statistics of whole sessions and periods, all of them at once."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import stats
from lumenlake.plans.browse import _BY_SESSION, JOINED, TIME, TOTALS
from lumenlake.plans.registry import DERIVED, query
from lumenlake.sources.catalog import Catalog

#: The moment that the named periods are taken at, and the days of the custom one.
NOW, CUSTOM = datetime(2024, 6, 15, 12, tzinfo=UTC), (date(2024, 2, 1), date(2024, 4, 30))
PERIODS = {n: stats.period(n, NOW, *CUSTOM) for n in ("all", "today", "this-week", "this-month", "this-year", "custom")}
_PERIODS = {
    "all": ("0000", "9999"), "today": ("2024-06-15T00:00:00Z", "2024-06-15T23:59:59Z"), "this-week": ("2024-06-10T00:00:00Z", "2024-06-16T23:59:59Z"),
    "this-month": ("2024-06-01T00:00:00Z", "2024-06-30T23:59:59Z"), "this-year": ("2024-01-01T00:00:00Z", "2024-12-31T23:59:59Z"), "custom": ("2024-02-01T00:00:00Z", "2024-04-30T23:59:59Z"),
}
_AVERAGES = "avg_sharpness avg_brightness avg_contrast avg_saturation monochrome_share color_share face_share smile_share"
_SECTION_ROUNDED = "share avg_sharpness avg_iso color_share"
_ROWS = f"SELECT p.*, a.* EXCLUDE (photo_id), a.photo_id, {TIME} AS known FROM {JOINED}"
DERIVED["period_rows"] = " UNION ALL ".join(f"SELECT '{n}' AS period, * FROM ({_ROWS}) WHERE known BETWEEN '{a}' AND '{b}'" for n, (a, b) in _PERIODS.items())


def _sections_sql(rows: str, scope: str, scopes: str) -> str:
    parts, bins = [], []
    for name, (labels, edges) in stats.HISTOGRAMS.items():
        up = edges[0] < edges[-1]
        whens = " ".join(f"WHEN {name} {'<' if up else '>='} {e!r}::DOUBLE THEN '{labels[i]}'" for i, e in enumerate(edges))
        parts.append(f"SELECT {scope}, '{name}' AS section, CASE WHEN {name} IS NOT NULL THEN CASE {whens} ELSE '{labels[-1]}' END END AS name, sharpness, iso, is_monochrome, photo_id FROM {rows}")
        bins += [f"SELECT '{name}' AS section, {i} AS place, '{x}' AS name" for i, x in enumerate(labels)]
    for name, text in (("camera", "coalesce(nullif(trim(camera_make), ''), 'Unknown camera')"), ("lens", "coalesce(nullif(trim(lens), ''), 'Unknown lens')"), ("month", f"substr({TIME}, 1, 7)")):
        parts.append(f"SELECT {scope}, '{name}', {text}, sharpness, iso, is_monochrome, photo_id FROM {rows}")
    return f"""
WITH x AS (
  SELECT {scope}, section, name, count(*) AS photos, avg(sharpness) AS avg_sharpness, avg(iso) AS avg_iso, 100.0 * count(*) FILTER (is_monochrome = 0) / nullif(count(photo_id), 0)::DOUBLE AS color_share
  FROM ({' UNION ALL '.join(parts)}) WHERE name IS NOT NULL AND {scope} IS NOT NULL GROUP BY 1, 2, 3
), b AS ({' UNION ALL '.join(bins)}), t AS (
  SELECT *, 100.0 * photos / (sum(photos) OVER (PARTITION BY {scope}, section))::DOUBLE AS share,
    row_number() OVER (PARTITION BY {scope}, section ORDER BY CASE WHEN section <> 'month' THEN photos END DESC, CASE WHEN section = 'month' THEN name END DESC, name) - 1 AS place
  FROM x WHERE section IN ('camera', 'lens', 'month')
)
SELECT s.{scope}, b.section, b.place::INTEGER AS place, b.name, coalesce(photos, 0) AS photos, NULL::DOUBLE AS share, avg_sharpness, avg_iso, color_share
FROM {scopes} s CROSS JOIN b LEFT JOIN x ON x.{scope} = s.{scope} AND x.section = b.section AND x.name = b.name
UNION ALL SELECT {scope}, section, place::INTEGER, name, photos, share, avg_sharpness, avg_iso, color_share FROM t WHERE place < CASE section WHEN 'month' THEN 36 ELSE 20 END"""


@query("S01_periods", "SELECT period, count(*) AS photos, min(known) AS first, max(known) AS last FROM period_rows GROUP BY 1", "photos analysis period_rows")
def periods(c: Catalog) -> DataFrame:
    """Photos of each named period and what they span."""
    rows = stats.in_periods(c.photos.withColumn("known", stats.known_time()), PERIODS)
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("photos"), F.min("known").alias("first"), F.max("known").alias("last"))


@query("S18_period_bundle", f"SELECT period, {TOTALS} FROM period_rows GROUP BY 1", "photos analysis period_rows", rounded=f"photos_per_session {_AVERAGES}")
def period_bundle(c: Catalog) -> DataFrame:
    """Totals and shares of every period in one grouping."""
    return stats.in_periods(c.joined, PERIODS).groupBy("period").agg(*stats.totals())


@query("S18_period_sections", _sections_sql("period_rows", "period", f"(SELECT unnest({list(_PERIODS)}) AS period)"), "photos analysis period_rows", rounded=_SECTION_ROUNDED)
def period_sections(c: Catalog) -> DataFrame:
    """Histograms, cameras, lenses and months of every period."""
    names = c.spark.range(1).select(F.explode(F.array(*map(F.lit, PERIODS))).alias("period"))
    return stats.sections(stats.in_periods(c.joined, PERIODS), "period", names)


@query("S16_session_sections", _sections_sql(f"(SELECT * FROM {JOINED})", "session_id", "(SELECT id AS session_id FROM sessions)"), "photos analysis sessions", rounded=_SECTION_ROUNDED)
def session_sections(c: Catalog) -> DataFrame:
    """Histograms, cameras, lenses and months of every session."""
    return stats.sections(c.joined, "session_id", c.view("sessions").select(F.col("id").alias("session_id")))


@query("S16_session_selection", """
SELECT session_id, count(*) FILTER (state = 'selected') AS selected, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'selected') / count(*)::DOUBLE AS kept_ratio
FROM photos LEFT JOIN selections ON photo_id = id WHERE session_id IS NOT NULL GROUP BY 1""", "photos selections", rounded="kept_ratio")
def session_selection(c: Catalog) -> DataFrame:
    return stats.session_selection(c.photos, c.view("selections"))


@query("S17_compared_summaries", f"""
SELECT position, x.* FROM (SELECT unnest([7, 3, 11, 20]) AS wanted, unnest([1, 2, 3, 4]) AS position) JOIN ({_BY_SESSION}) x ON x.id = wanted""", "photos analysis sessions", rounded=f"{_AVERAGES} avg_iso avg_aperture avg_shutter_speed duration_days")
def compared_summaries(c: Catalog) -> DataFrame:
    """The summary rows of up to eight sessions side by side, in the order asked for."""
    asked = c.spark.createDataFrame([(7, 1), (3, 2), (11, 3), (20, 4)], "id long, position int")
    rows = c.joined.join(F.broadcast(asked.select(F.col("id").alias("session_id"))), "session_id", "left_semi")
    return stats.sessions_summary(rows, c.view("sessions").join(F.broadcast(asked), "id")).orderBy("position")
