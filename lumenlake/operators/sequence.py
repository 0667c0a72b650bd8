"""Bursts, blinks, review units: operators over photos in order of capture."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.curation import numbered
from lumenlake.operators.tables import drop_table, exchanged, write_table

#: How open an eye is, and the version of the eye measurement that counts.
OPEN, CLOSED, EYE_VERSION, SAME_FACE_BITS = 0.8, 0.2, 2, 10
#: Different times of a session that are walked as one array; longer sessions are spread over rows.
SESSION_TIMES = 4096


def seconds(name: str) -> Column:
    return F.unix_timestamp(F.to_timestamp(name, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _starts(gap: int):
    """Column function of a session's times in order: the start that each belongs to."""

    @F.pandas_udf("array<bigint>")
    def run(times: pd.Series) -> pd.Series:
        out = []
        for t in times:
            after, at, found = np.searchsorted(t, t + gap, "right"), 0, np.zeros(len(t), "int64")
            while at < len(t):
                found[at : after[at]] = t[at]
                at = int(after[at])
            out.append(found)
        return pd.Series(out)

    return run


def _next_starts(times: DataFrame, gap: int) -> DataFrame:
    """(session_id, t, next): for each time the first one of its session more than gap seconds later, null if there is none.

    Times and the marks t + gap + 1 are ordered together by ranges; a mark takes the first time behind it, from
    its own range or, at a range's end, from the first later range that has one.
    """
    shot = times.select("session_id", F.col("t").alias("at"), F.col("t").alias("shot"), F.lit(None).cast("long").alias("t"))
    mark = times.select("session_id", (F.col("t") + gap + 1).alias("at"), F.lit(None).cast("long").alias("shot"), "t")
    both = shot.unionByName(mark)
    ranged = write_table(both.repartitionByRange("session_id", "at").withColumn("_part", F.spark_partition_id()), "marks")
    place = F.when(F.col("shot").isNotNull(), F.struct("session_id", "shot"))
    firsts = ranged.groupBy("_part").agg(F.min(place).alias("_own"))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range: as many as there are shuffle partitions
    firsts = firsts.select("_part", F.last("_own", ignorenulls=True).over(later).alias("_later"))
    behind = Window.partitionBy("_part").orderBy(F.desc("session_id"), F.desc("at"), F.col("shot").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.withColumn("_found", F.last(place, ignorenulls=True).over(behind)).where("t is not null").join(F.broadcast(firsts), "_part")
    found = F.coalesce("_found", "_later")
    return met.select("session_id", "t", F.when(found["session_id"] == F.col("session_id"), found["shot"]).alias("next"))


def _reached(times: DataFrame, gap: int) -> DataFrame:
    """(session_id, start): the first time of each session and all that are reached from it by going to the next start.

    Pointers are doubled: after k rounds the first 2^k starts are known and each pointer leads 2^k starts on.  A row holds
    one pointer, so neither a long session nor a long gap makes any row or group large.
    """
    jump = write_table(_next_starts(times, gap).where("next is not null"), "jumps")
    known = write_table(times.groupBy("session_id").agg(F.min("t").alias("start")), "starts")
    while True:
        more = write_table(known.join(exchanged(jump.withColumnRenamed("t", "start")), ["session_id", "start"]).select("session_id", F.col("next").alias("start")), "starts")
        if more.isEmpty():
            return known
        known, old = write_table(known.unionByName(more), "starts"), (known, more)
        further = jump.alias("x").join(exchanged(jump.alias("y")), (F.col("x.session_id") == F.col("y.session_id")) & (F.col("x.next") == F.col("y.t")))
        jump, old = write_table(further.select("x.session_id", "x.t", "y.next"), "jumps"), (*old, jump)
        for table in old:
            drop_table(table)


def _placed(times: DataFrame, starts: DataFrame) -> DataFrame:
    """(session_id, start, t, n): each time (session_id, t, n) with the last start at or before it."""
    rows = times.join(exchanged(starts.select("session_id", F.col("start").alias("t"), F.col("start"))), ["session_id", "t"], "left")
    ranged = write_table(rows.repartitionByRange("session_id", "t").withColumn("_part", F.spark_partition_id()), "placed")
    lasts = ranged.groupBy("_part").agg(F.max(F.when(F.col("start").isNotNull(), F.struct("session_id", "start"))).alias("_own"))
    lasts = lasts.select("_part", F.last("_own", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    run = Window.partitionBy("_part").orderBy("session_id", "t").rowsBetween(Window.unboundedPreceding, 0)
    # a session begins with a start, so what comes before in a range is of the same session
    met = ranged.withColumn("_start", F.last("start", ignorenulls=True).over(run)).join(F.broadcast(lasts), "_part")
    return met.select("session_id", F.coalesce("_start", "_before.start").alias("start"), "t", "n")


def bursts(photos: DataFrame, gap: int = 3) -> DataFrame:
    """(session_id, start, id): photos within `gap` seconds of their burst's first photo, two at least.

    Only different times matter.  Sessions of up to SESSION_TIMES of them are walked as one array; the starts of longer ones
    are found by doubling pointers from each time to the next possible start, whatever the gap, and times take the last start before
    them range by range.  Both ways give the same starts.
    """
    rows = photos.where("session_id is not null and capture_datetime is not null").select("session_id", "id", seconds("capture_datetime").alias("t"))
    times = write_table(rows.groupBy("session_id", "t").agg(F.count(F.lit(1)).alias("n")), "times")
    long = write_table(times.groupBy("session_id").agg(F.count(F.lit(1)).alias("_times")).where(F.col("_times") > SESSION_TIMES).select("session_id"), "long-sessions")
    short = times.join(long, "session_id", "left_anti").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("shots"))
    found = short.select("session_id", F.explode(F.arrays_zip("shots", _starts(gap)("shots.t").alias("starts"))).alias("s"))
    found = found.select("session_id", F.col("s.starts").alias("start"), F.col("s.shots.t").alias("t"), F.col("s.shots.n").alias("n"))
    if not long.isEmpty():
        own = times.join(long, "session_id", "left_semi")
        found = found.unionByName(_placed(own, _reached(own, gap)))
    large = found.groupBy("session_id", "start").agg(F.sum("n").alias("photos")).where("photos > 1").select("session_id", "start")
    kept = found.join(exchanged(large), ["session_id", "start"]).select("session_id", "t", "start")
    return rows.join(exchanged(kept), ["session_id", "t"]).select("session_id", "start", "id")


def eye_state(left: str, right: str) -> Column:
    """open, closed, or null where the pair cannot be told."""
    l, r = F.col(left), F.col(right)
    return F.when((l >= OPEN) & (r >= OPEN), "open").when((l <= CLOSED) & (r <= CLOSED), "closed")


def frames(photos: DataFrame, analysis: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos with their faces (hash, state) and whether every eye of the frame was evaluated."""
    by = faces.groupBy("photo_id").agg(F.collect_list(F.struct(F.col("appearance_hash").alias("hash"), eye_state("left_eye_open_prob", "right_eye_open_prob").alias("state"))).alias("faces"))
    met = photos.select("id", "session_id", "capture_datetime").join(analysis.select("photo_id", "face_count", "eye_evaluated_count", "eye_algorithm_version"), F.col("id") == F.col("photo_id"), "left").drop("photo_id")
    met = met.join(by, F.col("id") == F.col("photo_id"), "left").drop("photo_id")
    none = F.array().cast(by.schema["faces"].dataType)
    met = met.withColumn("faces", F.coalesce("faces", none))
    whole = (F.col("eye_algorithm_version") == EYE_VERSION) & (F.col("face_count") >= 0) & (F.col("eye_evaluated_count") == 2 * F.col("face_count")) & (F.size("faces") == F.col("face_count"))
    return met.withColumn("evaluable", F.coalesce(whole & F.forall("faces", lambda f: f["state"].isNotNull()), F.lit(False)))


def blinks(members: DataFrame, shots: DataFrame) -> DataFrame:
    """(id, possible_blink) of the frames of bursts (start, session_id, id) that can be told.

    A closed face with an open one like it in both neighbouring frames is a possible blink; the first and last
    frame of a burst, and frames beside one that was not evaluated, stay out.
    """
    order = Window.partitionBy("session_id", "start").orderBy(F.col("capture_datetime").asc_nulls_last(), "id")
    rows = members.join(shots.drop("session_id"), "id")
    for name, step in (("before", F.lag), ("after", F.lead)):
        rows = rows.withColumn(f"{name}_faces", step("faces").over(order)).withColumn(f"{name}_ok", step("evaluable").over(order))
    like = lambda faces, f: F.exists(faces, lambda o: (o["state"] == "open") & (F.bit_count(o["hash"].bitwiseXOR(f["hash"])) <= SAME_FACE_BITS))
    blink = F.exists("faces", lambda f: (f["state"] == "closed") & like("before_faces", f) & like("after_faces", f))
    known = rows.where("before_ok and evaluable and after_ok").withColumn("possible_blink", blink)
    return known.groupBy("id").agg(F.bool_or("possible_blink").alias("possible_blink"))


def group_list(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Each group with its size, sessions and eye counts from one aggregate, larger ones first within bursts and others."""
    met = members.drop("session_id").join(exchanged(rows), "id")
    by = met.groupBy("group_type", "group_id").agg(
        F.count(F.lit(1)).alias("photo_count"), F.countDistinct("session_id").alias("sessions"), F.count_if("possible_blink").alias("blinks"), F.count_if(F.col("closed_eye_face_count") > 0).alias("closed_eyes"),
        F.count_if(F.col("closed_eye_face_count").isNull()).alias("unevaluated"))
    return by.orderBy(F.when(F.col("group_type") == "burst", 0).otherwise(1), F.desc("photo_count"), "group_id")


def of_kinds(members: DataFrame, kinds: list[str]) -> DataFrame:
    """Members of the groups of some kinds; of all if none is named."""
    return members.where(F.col("group_type").isin(kinds)) if kinds else members


def similarity_summary(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(group_type, groups, photos, hashed, failed): the last two count all photos with and without a hash."""
    by = members.groupBy("group_type").agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("photos"))
    return by.crossJoin(F.broadcast(photos.agg(F.count("phash").alias("hashed"), F.count_if(F.col("phash").isNull()).alias("failed"))))


def comparison_window(rows: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """Of each group up to `most` neighbours in order of capture, from the one before its focus on, clamped to its ends.

    rows: keys, id, capture_datetime, focus (true for one photo of a group at most; without one the group's beginning is shown).
    """
    group = Window.partitionBy(*keys)
    placed = rows.withColumn("place", F.row_number().over(group.orderBy(F.col("capture_datetime").asc_nulls_last(), "id")) - 1)
    at, n = F.coalesce(F.max(F.when(F.col("focus"), F.col("place"))).over(group), F.lit(0)), F.count(F.lit(1)).over(group)
    first = F.greatest(F.lit(0), F.least(at - 1, n - most))
    return placed.withColumn("_first", first).where((F.col("place") >= F.col("_first")) & (F.col("place") < F.col("_first") + most)).drop("_first")


def covers(members: DataFrame, photos: DataFrame, most: int = 4) -> DataFrame:
    """The first photos of each group in order of capture."""
    order = Window.partitionBy("group_type", "group_id").orderBy(F.col("capture_datetime").asc_nulls_last(), "id")
    met = members.drop("session_id").join(photos.select("id", "capture_datetime"), "id").withColumn("place", F.row_number().over(order))
    return met.where(F.col("place") <= most).select("group_type", "group_id", "place", "id")


def page_order(name: str) -> list[Column]:
    """Orders of a group's page."""
    open_first = F.when(F.col("closed_eye_face_count") > 0, 2).when(F.col("eye_evaluated_count") > 0, 0).otherwise(1)
    time = [F.col("capture_datetime").asc_nulls_last(), F.col("id")]
    first = {"chronology": [], "sharpness": [F.col("sharpness").desc_nulls_last()], "clipping": [(F.col("highlight_clipping") + F.col("shadow_clipping")).asc_nulls_last()], "eyes": [open_first]}
    return [*first[name], *time]


def placed_within(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 0 within a key, as column `name`; a key may hold most rows, as all are numbered range by range."""
    all_ = numbered(rows, [F.col(key), *order])
    first = all_.groupBy(key).agg(F.min("place").alias("_first"))
    return all_.join(exchanged(first), key).withColumn(name, (F.col("place") - F.col("_first")).cast("int")).drop("_first", *({"place"} - {name}))


def _claims(flat: DataFrame) -> DataFrame | None:
    """Photos that sequences claim (session_id, id, index, rank); null if there are no sequences.

    flat: session_id, id, index, rank; sequences claim in order of rank what is free of their photos, if that is two at least.
    Each round settles every sequence that comes first at all its free photos: no earlier one can take any of them.
    Sequences left with one free photo go at once.
    """
    live, units = write_table(flat, "claims"), None
    while not live.isEmpty():
        first = live.groupBy("id").agg(F.min("rank").alias("_first"))
        size = live.join(exchanged(first), "id").groupBy("session_id", "rank").agg(F.count(F.lit(1)).alias("_n"), F.min((F.col("rank") == F.col("_first")).cast("int")).alias("_mine"))
        settled = write_table(size.where("_n < 2 or _mine = 1"), "settled")
        got = write_table(live.join(exchanged(settled.where("_n > 1").select("session_id", "rank")), ["session_id", "rank"]).select(*flat.columns), "claimed")
        units = got if units is None else units.unionByName(got)
        rest = live.join(exchanged(settled.select("session_id", "rank")), ["session_id", "rank"], "left_anti").join(exchanged(got.select("id")), "id", "left_anti")
        live, old = write_table(rest.select(*flat.columns), "claims"), live
        drop_table(old)
    return units


def review_units(queue: DataFrame) -> DataFrame:
    """(session_id, unit, kind, place, id): sequences claim photos in turn, the rest stand alone.

    queue: session_id, id, index (order in the session), and sequences (array of kind, group_id), in which a photo may be in
    any number of sequences.  Bursts claim first, then similar and face groups together by the index of their first photo,
    both as kind `similar`; equal places go to similar groups before face groups, then to the smaller group_id.  Sequences of
    one photo of the session are none.
    """
    flat = queue.select("session_id", "id", "index", F.explode("sequences").alias("s")).select("session_id", "id", "index", "s.kind", "s.group_id").distinct()
    heads = flat.groupBy("session_id", "kind", "group_id").agg(F.min("index").alias("_at"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tier = F.when(F.col("kind") == "burst", 0).otherwise(1)
    rank = F.struct(tier.alias("tier"), F.col("_at").alias("at"), (F.col("kind") != "similar").cast("int").alias("face"), "group_id")
    flat = flat.join(exchanged(heads), ["session_id", "kind", "group_id"]).select("session_id", "id", "index", rank.alias("rank"))
    units = _claims(flat)
    alone = queue.select("session_id", "id", "index").distinct()
    rows = alone.select("*", F.lit("single").alias("kind"), F.col("index").alias("first"))
    if units is not None:
        first = units.groupBy("session_id", "rank").agg(F.min("index").alias("first"))
        kind = F.when(F.col("rank.tier") == 0, "burst").otherwise("similar")
        taken = units.join(exchanged(first), ["session_id", "rank"]).select("session_id", "id", "index", kind.alias("kind"), "first")
        rows = rows.join(exchanged(units.select("id")), "id", "left_anti").select(*taken.columns).unionByName(taken)
    rows = numbered(rows, [F.col("session_id"), F.col("first"), F.col("index")])
    firsts = rows.groupBy("session_id", "first").agg(F.min("place").alias("_at"))
    firsts = placed_within(firsts, "session_id", [F.col("first")], "unit")
    return rows.join(exchanged(firsts), ["session_id", "first"]).select("session_id", "unit", "kind", (F.col("place") - F.col("_at")).cast("int").alias("place"), "id")
