"""Statistics over photos of a period, a session, or all sessions at once; nothing measured stays null, never 0."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.sources.catalog import known_time

#: Labels of each histogram and the edges between its bins, in label order.
HISTOGRAMS = {
    "iso": (["100–400", "400–800", "800–1600", "1600–3200", "3200+"], [400, 800, 1600, 3200]),
    "aperture": (["f/1.4–2.0", "f/2.0–2.8", "f/2.8–4.0", "f/4–8", "f/8+"], [2.0, 2.8, 4.0, 8.0]),
    "focal_length": (["24 mm", "35 mm", "50 mm", "85 mm", "135 mm"], [29.5, 42.5, 67.5, 110.0]),
    "shutter_speed": (["1s+", "1/2–1", "1/30–1/2", "1/125–1/30", "1/1000–1/125", "1/4000–1/1000", "1/8000+"], [1.0, 0.5, 1 / 30, 1 / 125, 1 / 1000, 1 / 4000]),
}


def period(name: str, now: datetime, start: date | None = None, end: date | None = None) -> tuple[str, str] | None:
    """First and last included stamp of a named period; null for all time.

    Calendar periods end before the next one begins; a custom one includes its whole last day.
    """
    day = now.astimezone(UTC).date()
    if name == "all":
        return None
    if name == "custom":
        first, after = start, end + timedelta(days=1)
    elif name == "today":
        first, after = day, day + timedelta(days=1)
    elif name == "this-week":
        first = day - timedelta(days=day.weekday())
        after = first + timedelta(days=7)
    elif name == "this-month":
        first = day.replace(day=1)
        after = (first + timedelta(days=31)).replace(day=1)
    elif name == "this-year":
        first, after = date(day.year, 1, 1), date(day.year + 1, 1, 1)
    else:
        raise ValueError(f"unknown period {name!r}")
    last = datetime(after.year, after.month, after.day, tzinfo=UTC) - timedelta(seconds=1)
    return f"{first.isoformat()}T00:00:00Z", last.strftime("%Y-%m-%dT%H:%M:%SZ")


def in_period(bounds: tuple[str, str] | None) -> Column:
    return F.lit(True) if bounds is None else known_time().between(*bounds)


def share(hits: Column, of: Column) -> Column:
    """Percentage; null where there is nothing to share."""
    return F.try_divide(F.lit(100.0) * hits, of)


def totals() -> list[Column]:
    """One aggregate's worth of totals, averages and shares over photos left-joined with analysis."""
    analyzed = F.count("photo_id")
    return [
        F.count(F.lit(1)).alias("photos"),
        F.countDistinct("session_id").alias("sessions"),
        F.try_divide(F.count(F.lit(1)), F.countDistinct("session_id")).alias("photos_per_session"),
        analyzed.alias("analyzed"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("sharpness", "brightness", "contrast", "saturation")],
        share(F.sum("is_monochrome"), analyzed).alias("monochrome_share"),
        share(F.count_if(F.col("is_monochrome") == 0), analyzed).alias("color_share"),
        share(F.count_if(F.col("face_count") > 0), F.count("face_count")).alias("face_share"),
        share(F.count_if(F.col("smile_count") > 0), F.count("smile_count")).alias("smile_share"),
    ]


def camera_averages() -> list[Column]:
    return [F.avg(c).alias(f"avg_{c}") for c in ("iso", "aperture", "shutter_speed")]


def bin_number(name: str) -> Column:
    """Bin of a value, from 0; null where there is none.  A value on an edge belongs to the bin above, or the slower one."""
    edges = HISTOGRAMS[name][1]
    if edges[0] < edges[-1]:
        passed = [F.col(name) >= e for e in edges]
    else:
        passed = [(F.col(name) < e) | F.isnan(name) for e in edges]
    return sum((p.cast("int") for p in passed), F.lit(0))


def histograms(rows: DataFrame) -> DataFrame:
    """(histogram, bin, label, n) of all four, zero bins kept, from one aggregate."""
    numbered = rows.select(*[bin_number(n).alias(n) for n in HISTOGRAMS])
    cells = [(n, i, label) for n, (labels, _) in HISTOGRAMS.items() for i, label in enumerate(labels)]
    counts = numbered.agg(*[F.count_if(F.col(n) == i).alias(f"{n}_{i}") for n, i, _ in cells])
    cell = lambda n, i, label: F.struct(F.lit(n).alias("histogram"), F.lit(i).alias("bin"), F.lit(label).alias("label"), F.col(f"{n}_{i}").alias("n"))
    return counts.select(F.inline(F.array(*[cell(*c) for c in cells])))


def usage(rows: DataFrame, name: str, unknown: str, most: int = 20) -> DataFrame:
    """Photos by a trimmed name with share and averages, the most used first."""
    label = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(unknown))
    by = rows.groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("photos"), F.avg("sharpness").alias("avg_sharpness"), F.avg("iso").alias("avg_iso"))
    whole = by.agg(F.sum("photos").alias("_all"))
    return by.crossJoin(F.broadcast(whole)).withColumn("share", share(F.col("photos"), F.col("_all"))).drop("_all").orderBy(F.desc("photos"), "name").limit(most)


def trend(rows: DataFrame, most: int = 36) -> DataFrame:
    """The latest months that have photos, in order."""
    by = rows.groupBy(F.substring(known_time(), 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("photos"), F.countDistinct("session_id").alias("sessions"), F.avg("sharpness").alias("avg_sharpness"), F.avg("iso").alias("avg_iso"),
        share(F.count_if(F.col("is_monochrome") == 0), F.count("photo_id")).alias("color_share"))
    return by.orderBy(F.desc("month")).limit(most).orderBy("month")


def selection(scoped: DataFrame, states: DataFrame, operations: DataFrame) -> DataFrame:
    """Imported, selected, rejected, trashed (over all time) and the kept ratio from 0 to 1; no row without any signal."""
    met = scoped.select("id").join(states, F.col("id") == F.col("photo_id"), "left")
    one = met.agg(F.count(F.lit(1)).alias("imported"), F.count_if(F.col("state") == "selected").alias("selected"), F.count_if(F.col("state") == "rejected").alias("rejected"))
    ops = operations.agg(F.countDistinct(F.when(F.col("op_type") == "trash", F.col("source_path"))).alias("trashed"), F.count_if(F.col("op_type").isin("move", "copy", "rename")).alias("_others"))
    out = one.crossJoin(ops).where("selected + rejected + trashed + _others > 0")
    return out.select("imported", "selected", "rejected", "trashed", F.try_divide("selected", "imported").alias("kept_ratio"))


def sessions_summary(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session with its rollup, averages and duration in days, by one grouping; empty ones keep a row."""
    seconds = lambda c: F.unix_timestamp(F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    time = known_time()
    by = rows.where("session_id is not null").groupBy("session_id").agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), totals()[0], *totals()[3:], *camera_averages())
    by = by.withColumn("duration_days", (seconds("end_time") - seconds("start_time")) / 86400.0)
    return sessions.join(by, sessions["id"] == by["session_id"], "left").drop("session_id").withColumn("photos", F.coalesce("photos", F.lit(0)))


def subtotals(rows: DataFrame) -> DataFrame:
    """Photos and averages by session, month and camera with all their subtotals, in one pass."""
    make = F.coalesce(F.nullif(F.trim("camera_make"), F.lit("")), F.lit("Unknown camera"))
    keyed = rows.select("session_id", F.substring(known_time(), 1, 7).alias("month"), make.alias("camera"), "sharpness", "iso")
    return keyed.rollup("session_id", "month", "camera").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("photos"), F.avg("sharpness").alias("avg_sharpness"), F.avg("iso").alias("avg_iso"))


def usage_by_month(rows: DataFrame, name: str, unknown: str) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(unknown))
    by = rows.groupBy(F.substring(known_time(), 1, 7).alias("month"), label.alias("name")).agg(F.count(F.lit(1)).alias("photos"))
    return by.withColumn("share", share(F.col("photos"), F.sum("photos").over(Window.partitionBy("month"))))


#: Rows kept of each section that is not a histogram: names by photos, months by date.
SECTION_ROWS = {"camera": 20, "lens": 20, "month": 36}


def sections(rows: DataFrame, scope: str, scopes: DataFrame) -> DataFrame:
    """(scope, section, place, name, photos, share, avg_sharpness, avg_iso, color_share) of every scope at once.

    The sections are the four histograms, whose empty bins are kept for each of scopes, the most used cameras and lenses, and the latest
    months.  share is of the scope's photos, null for histograms.  One grouping counts all sections.
    """
    label = lambda c, unknown: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(unknown))
    binned = [F.struct(F.lit(n).alias("section"), F.when(F.col(n).isNotNull(), F.get(F.array(*map(F.lit, labels)), bin_number(n))).alias("name")) for n, (labels, _) in HISTOGRAMS.items()]
    named = [("camera", label("camera_make", "Unknown camera")), ("lens", label("lens", "Unknown lens")), ("month", F.substring(known_time(), 1, 7))]
    each = F.array(*binned, *[F.struct(F.lit(n).alias("section"), c.alias("name")) for n, c in named])
    long = rows.where(F.col(scope).isNotNull()).select(scope, "sharpness", "iso", "is_monochrome", "photo_id", F.inline(each)).where("name is not null")
    by = long.groupBy(scope, "section", "name").agg(
        F.count(F.lit(1)).alias("photos"), F.avg("sharpness").alias("avg_sharpness"), F.avg("iso").alias("avg_iso"),
        share(F.count_if(F.col("is_monochrome") == 0), F.count("photo_id")).alias("color_share"))
    cells = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(i).alias("place"), F.lit(x).alias("name")) for n, (labels, _) in HISTOGRAMS.items() for i, x in enumerate(labels)])
    bins = scopes.select(scope, F.inline(cells)).join(by, [scope, "section", "name"], "left").withColumn("photos", F.coalesce("photos", F.lit(0))).withColumn("share", F.lit(None).cast("double"))
    group = Window.partitionBy(scope, "section")
    order = group.orderBy(F.when(F.col("section") != "month", F.col("photos")).desc_nulls_last(), F.when(F.col("section") == "month", F.col("name")).desc_nulls_last(), "name")
    tops = by.where(F.col("section").isin(list(SECTION_ROWS))).withColumn("place", F.row_number().over(order) - 1).withColumn("share", share(F.col("photos"), F.sum("photos").over(group)))
    most = F.create_map(*[F.lit(x) for pair in SECTION_ROWS.items() for x in pair])
    return bins.unionByName(tops.where(F.col("place") < most[F.col("section")]))


def session_selection(photos: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, selected, rejected, kept_ratio) of every session with photos."""
    met = photos.where("session_id is not null").select("id", "session_id").join(states, F.col("id") == F.col("photo_id"), "left")
    by = met.groupBy("session_id").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("state") == "selected").alias("selected"), F.count_if(F.col("state") == "rejected").alias("rejected"))
    return by.withColumn("kept_ratio", F.try_divide("selected", "_all")).drop("_all")


def in_periods(rows: DataFrame, periods: dict[str, tuple[str, str] | None]) -> DataFrame:
    """rows once for each named period that holds them, as column period; periods come from `period` and are few."""
    hit = [F.when(in_period(bounds), F.lit(name)) for name, bounds in periods.items()]
    return rows.withColumn("period", F.explode(F.array_compact(F.array(*hit))))
