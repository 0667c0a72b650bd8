"""Curation tables and plans of file operations; nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import names
from lumenlake.operators.tables import write_table
from lumenlake.sources.catalog import merge_rows

STATES = ("selected", "rejected", "needs_attention")


def set_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Review states after changes (photo_id, state, updated_at); of several changes of a photo the last counts, a null state clears."""
    last = changes.where(F.col("state").isNull() | F.col("state").isin(*STATES)).groupBy("photo_id").agg(F.max_by(F.struct("state", "updated_at"), "updated_at").alias("c")).select("photo_id", "c.*")
    kept = merge_rows(states, last.where("state is not null"), "photo_id", {"state": "new", "updated_at": "new"})
    return kept.join(last.where("state is null"), "photo_id", "left_anti")


def marked(photos: DataFrame, changes: DataFrame) -> DataFrame:
    """Photos with rating, flag and color label as changed: null leaves a field, rating 0 and label '' clear it."""
    c = changes.select(F.col("photo_id").alias("_photo"), F.col("rating").alias("_r"), F.col("flag").alias("_f"), F.col("color_label").alias("_c"))
    met = photos.join(c, F.col("id") == F.col("_photo"), "left")
    return met.withColumns({
        "rating": F.when(F.col("_r").isNull(), F.col("rating")).when(F.col("_r") > 0, F.col("_r")),
        "flag": F.coalesce("_f", "flag"),
        "color_label": F.when(F.col("_c").isNull(), F.col("color_label")).when(F.col("_c") != "", F.col("_c")),
    }).drop("_photo", "_r", "_f", "_c")


def keyset_page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The rows whose key follows `after`, with the next cursor on each: null unless the page is full."""
    size = min(max(limit, 1), 5000)
    page = rows.where(F.col(key) > after).orderBy(key).limit(size)
    cursor = page.agg(F.when(F.count(F.lit(1)) == size, F.max(key)).alias("next_cursor"))
    return page.crossJoin(cursor)


def collection_list(collections: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("photos"))
    return collections.join(counts, F.col("id") == F.col("collection_id"), "left").select("id", "name", F.coalesce("photos", F.lit(0)).alias("photos"))


def created(collections: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with those of new (name) whose trimmed name of 1 to 60 characters none has yet; ids go on from the largest."""
    named = new.select(F.trim("name").alias("name")).where(F.length("name").between(1, 60)).distinct()
    free = named.join(collections.select(F.col("name").alias("_taken")), F.col("name") == F.col("_taken"), "left_anti")
    last = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return collections.unionByName(numbered(free, ["name"]).crossJoin(F.broadcast(last)).select((F.col("place") + F.col("_last")).alias("id"), "name"))


def renamed(collections: DataFrame, changes: DataFrame) -> DataFrame:
    """Collections after changes (id, new_name); a name that another one has is refused."""
    free = changes.join(collections.select(F.col("name").alias("_taken")), F.col("new_name") == F.col("_taken"), "left_anti")
    once = free.groupBy("new_name").agg(F.min("id").alias("id"))
    return collections.join(once, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"))


def upserted_sessions(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Sessions after a scan's folders (root_path, name): a known folder keeps its id and takes the name, others get the next ids in order of path."""
    new = found.groupBy("root_path").agg(F.min("name").alias("name"))
    kept = sessions.join(new.withColumnRenamed("name", "_name"), "root_path", "left").select("id", F.coalesce("_name", "name").alias("name"), "root_path")
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = numbered(new.join(sessions.select("root_path"), "root_path", "left_anti"), ["root_path"]).crossJoin(F.broadcast(last))
    return kept.unionByName(fresh.select((F.col("place") + F.col("_last")).alias("id"), "name", "root_path"))


def log_operations(path: str, operations: DataFrame) -> None:
    """Append operations to the log, a table at path; rows that are there stay as they are."""
    operations.write.mode("append").parquet(path)


def recent_operations(log: DataFrame, most: int = 100) -> DataFrame:
    """The latest 1 to 500 operations."""
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(most, 1), 500))


def added_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (collection_id, photo_id, added_at) that are not members yet, each once."""
    return wanted.groupBy("collection_id", "photo_id").agg(F.min("added_at").alias("added_at")).join(members, ["collection_id", "photo_id"], "left_anti")


def cleared_states(states: DataFrame, photos: DataFrame) -> DataFrame:
    """Review states without those of the given photo_ids."""
    return states.join(photos.select("photo_id"), "photo_id", "left_anti").select(*states.columns)


def removed_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Collection members without the given pairs of collection_id and photo_id."""
    pair = ["collection_id", "photo_id"]
    return members.join(gone.select(*pair), pair, "left_anti").select(*members.columns)


def without_photos(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """A child table after photos (id) were deleted."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def plan_order() -> list:
    """Order of a plan: unknown capture first, then time, name, id."""
    return [F.col("capture_datetime").asc_nulls_first(), F.col("filename"), F.col("id")]


def rename_plan(photos: DataFrame, template: str, group_name: str, existing: DataFrame) -> DataFrame:
    """(id, source, destination, ok, aborted): new names in plan order.

    The sequence has three digits at least and as many as the count needs.  A destination that is taken by another file blocks its
    row; two equal destinations abort the whole plan.
    """
    n = photos.agg(F.count(F.lit(1)).alias("_n"))
    place = numbered(photos)
    time = F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")) for c in ("capture_datetime", "file_mtime", "indexed_at")])
    width = F.greatest(F.lit(3), F.length(F.col("_n").cast("string")))
    values = {
        "name": names.sanitized(F.lit(group_name)), "original": names.stem("filename", "extension"), "camera": names.sanitized("camera_model"), "lens": names.sanitized("lens"),
        "focal": F.round("focal_length").cast("long").cast("string"), "iso": F.col("iso").cast("string"), "sequence": F.lpad(F.col("place").cast("string"), width, F.lit("0")),
        "date": F.date_format(time, "yyyy-MM-dd"), "time": F.date_format(time, "HH-mm-ss"),
    }
    name = names.sanitized(names.expanded(template, values))
    cut = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    target = F.concat(F.regexp_replace("path", r"[^/]*$", ""), cut, F.when(F.col("extension") != "", F.concat(F.lit("."), F.col("extension"))).otherwise(""))
    rows = place.crossJoin(n).select("id", F.col("path").alias("source"), target.alias("destination"))
    rows = rows.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("destination")))
    taken = existing.select(F.col("path").alias("destination"), F.lit(True).alias("_taken"))
    rows = rows.join(taken, "destination", "left")
    aborted = rows.agg((F.max("_same") > 1).alias("aborted"))
    return rows.crossJoin(aborted).select("id", "source", "destination", (F.col("_taken").isNull() | (F.col("destination") == F.col("source"))).alias("ok"), "aborted")


def numbered(photos: DataFrame, order: list | None = None) -> DataFrame:
    """photos with their place in an order, plan order by default, from 1, without ordering all in one task.

    Rows are range-partitioned by the order and written, so that counts and numbers see the same ranges; each partition
    counts itself and starts after those before it.
    """
    order = order or plan_order()
    ranged = write_table(photos.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_row", inner).join(F.broadcast(before), "_part").withColumn("place", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def move_plan(photos: DataFrame, folder: str, existing: DataFrame, rename: bool) -> DataFrame:
    """(id, source, destination, ok, note): a taken name is skipped, or gets the first free suffix -1, -2 and so on."""
    rows = photos.select("id", F.col("path").alias("source"), "filename", F.concat(F.lit(f"{folder}/"), "filename").alias("destination"))
    here = existing.where(F.startswith(F.col("path"), F.lit(f"{folder}/"))).select(F.substring("path", len(folder) + 2, 1 << 20).alias("filename")).distinct()
    rows = rows.join(here.withColumn("_taken", F.lit(True)), "filename", "left")
    if not rename:
        return rows.select("id", "source", "destination", F.col("_taken").isNull().alias("ok"), F.when(F.col("_taken"), "exists").alias("note"))
    used = _used_numbers(here)
    # the first gap: numbers that stand where they would without one, and one more
    free = used.groupBy("_stem", "_end").agg((F.count_if(F.col("_k") == F.col("_at") + 1) + 1).alias("_free"))
    rows = rows.withColumns({"_stem": _stem("filename"), "_end": _ending("filename")}).join(free, ["_stem", "_end"], "left")
    other = F.concat(F.lit(f"{folder}/"), "_stem", F.lit("-"), F.coalesce("_free", F.lit(1)).cast("string"), "_end")
    return rows.select("id", "source", F.when(F.col("_taken"), other).otherwise(F.col("destination")).alias("destination"), F.lit(True).alias("ok"), F.when(F.col("_taken"), "renamed").alias("note"))


def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def _ending(name: str) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def _placed_by(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """rows with their place from 0 within the keys, numbered range by range."""
    all_ = numbered(rows, [*map(F.col, keys), *order])
    first = all_.groupBy(*keys).agg(F.min("place").alias("_first"))
    return all_.join(first, keys).withColumn(name, F.col("place") - F.col("_first")).drop("_first", "place")


def _used_numbers(names_: DataFrame) -> DataFrame:
    """(_stem, _end, _k, _at): numbers that distinct names (filename) have behind a stem, with their place from 0 among these."""
    stem, number = (F.regexp_extract(_stem("filename"), r"^(.*)-([1-9][0-9]{0,8})$", i) for i in (1, 2))
    used = names_.select(stem.alias("_stem"), number.try_cast("long").alias("_k"), _ending("filename").alias("_end")).where("_k is not null")
    return _placed_by(used, ["_stem", "_end"], [F.col("_k")], "_at")


def unique_move_plan(photos: DataFrame, folder: str, existing: DataFrame) -> DataFrame:
    """(id, source, destination, ok, note): no two photos of the plan get one name, and none that the folder holds.

    Of photos with one name the first in plan order keeps it, if the folder has no such file.  The others of a stem and ending take
    in plan order the free numbers -1, -2 and so on; those of files in the folder and of the plan's own names are not free.
    The k-th free number is k plus the used numbers with fewer than k free ones before them, which is what stands before k when both
    are ordered together; so places, not sets of numbers, are computed, range by range.
    """
    here = existing.where(F.startswith(F.col("path"), F.lit(f"{folder}/"))).select(F.substring("path", len(folder) + 2, 1 << 20).alias("filename")).distinct()
    keys = ["_stem", "_end"]
    rows = photos.select("id", F.col("path").alias("source"), "filename", "capture_datetime").withColumns({"_stem": _stem("filename"), "_end": _ending("filename")})
    rows = rows.join(here.withColumn("_taken", F.lit(True)), "filename", "left")
    rows = write_table(_placed_by(rows, ["filename"], [F.col("capture_datetime").asc_nulls_first(), F.col("id")], "_turn"), "moves")
    movers = rows.where("_taken or _turn > 0")
    movers = write_table(_placed_by(movers.select("id", "filename", "capture_datetime", *keys), keys, plan_order(), "_k"), "movers").select("id", *keys, (F.col("_k") + 1).alias("_k"))
    used = _used_numbers(here.unionByName(photos.select("filename")).distinct())
    both = movers.select(*keys, "id", F.col("_k").alias("_v"), F.lit(0).alias("_kind")).unionByName(used.select(*keys, F.lit(None).cast("long").alias("id"), (F.col("_k") - F.col("_at") - 1).alias("_v"), F.lit(1).alias("_kind")))
    both = _placed_by(both, keys, [F.col("_v"), F.col("_kind")], "_at").where("_kind = 0")
    # before the k-th mover stand k - 1 movers; all others before it are used numbers
    number = both.select("id", (F.col("_v") + F.col("_at") - (F.col("_v") - 1)).cast("long").alias("_number"))
    met = rows.join(number, "id", "left")
    name = F.when(F.col("_number").isNull(), F.col("filename")).otherwise(F.concat("_stem", F.lit("-"), F.col("_number").cast("string"), "_end"))
    return met.select("id", "source", F.concat(F.lit(f"{folder}/"), name).alias("destination"), F.lit(True).alias("ok"), F.when(F.col("_number").isNotNull(), "renamed").alias("note"))


def delete_plan(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, source, ok, note): files that are there can go, missing ones and folders cannot."""
    there = existing.select(F.col("path").alias("_path"), F.col("is_file").alias("_file"))
    met = photos.select("id", F.col("path").alias("source")).join(there, F.col("source") == F.col("_path"), "left")
    return met.select("id", "source", F.coalesce("_file", F.lit(False)).alias("ok"), F.when(F.col("_file").isNull(), "missing").when(~F.col("_file"), "not a file").alias("note"))


def outcome_summary(operations: DataFrame) -> DataFrame:
    done = F.col("status").isin("ok", "failed")
    return operations.groupBy("op_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "cancelled").alias("cancelled"))


def sheet_cells(photos: DataFrame, most: int = 500, columns: int = 4, rows: int = 3) -> DataFrame:
    """Page, row and column of each photo of a contact sheet, with a caption of 24 characters."""
    first = photos.orderBy(F.col("capture_datetime").asc_nulls_last(), "id").limit(most)
    at = F.row_number().over(Window.orderBy(F.col("capture_datetime").asc_nulls_last(), "id")) - 1
    cell = first.withColumn("_i", at)
    caption = F.when(F.length("filename") > 24, F.concat(F.substring("filename", 1, 23), F.lit("…"))).otherwise(F.col("filename"))
    return cell.select("id", F.floor(F.col("_i") / (columns * rows)).alias("page"), F.floor(F.col("_i") % (columns * rows) / columns).alias("row"), (F.col("_i") % columns).cast("long").alias("column"), caption.alias("caption"))


def sound_progress(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """Progress rows whose index is not negative and whose focus, if they have one, is a photo of their session."""
    own = photos.select(F.col("session_id").alias("_session"), F.col("id").alias("_photo"))
    whole = rows.where("unit_index >= 0")
    held = whole.join(own, (F.col("session_id") == F.col("_session")) & (F.col("focused_photo_id") == F.col("_photo")), "left_semi")
    return whole.where("focused_photo_id is null").unionByName(held)


def saved_progress(progress: DataFrame, changes: DataFrame, photos: DataFrame) -> DataFrame:
    """progress (session_id, unit_index, focused_photo_id, updated_at) after the sound ones of changes: of a session the last counts, nulls included."""
    parts = ["updated_at", "unit_index", "focused_photo_id"]
    last = sound_progress(changes, photos).groupBy("session_id").agg(F.max(F.struct(*parts)).alias("c")).select("session_id", "c.*")
    return merge_rows(progress, last, "session_id", dict.fromkeys(parts, "new"))


def outcome_rows(done: DataFrame, now: Column) -> DataFrame:
    """A row of the operation log for each operation that was carried out."""
    return done.where("ok").select("op_type", F.col("source").alias("source_path"), F.col("destination").alias("dest_path"), F.lit("done").alias("status"), now.alias("created_at"))


def applied_catalog(photos: DataFrame, done: DataFrame) -> DataFrame:
    """photos after done operations (photo_id, op_type, destination, size_bytes, file_mtime, ok), failed ones left out.

    A rename or move changes path and name, and size and time where they are known.  A copy is a photo of its own: it
    has its source's extension and dimensions, the outcome's size and time, and no session; ids go on from the largest in order of path.
    Trash and deletion remove the photo.  A photo has one operation that is no copy at most.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    made = done.where("ok").select("photo_id", "op_type", "destination", F.col("size_bytes").alias("_size"), F.col("file_mtime").alias("_time"))
    met = photos.join(made.where("op_type <> 'copy'"), F.col("id") == F.col("photo_id"), "left").where(~F.coalesce("op_type", F.lit("")).isin("trash", "delete"))
    new = {"path": F.coalesce("destination", "path"), "size_bytes": F.coalesce("_size", "size_bytes"), "file_mtime": F.coalesce("_time", "file_mtime")}
    kept = met.withColumns(new).withColumn("filename", name).select(*photos.columns)
    copies = photos.drop("path").join(made.where("op_type = 'copy'"), F.col("id") == F.col("photo_id")).withColumnRenamed("destination", "path")
    inherited = ("extension", "width", "height", "orientation", "path")
    known = {"size_bytes": F.col("_size"), "file_mtime": F.col("_time"), "filename": name}
    empty = {c: F.lit(None).cast(photos.schema[c].dataType) for c in photos.columns if c not in (*inherited, *known, "id")}
    top = photos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    copies = numbered(copies.withColumns(known | empty), [F.col("path")]).crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("place"))
    return kept.unionByName(copies.select(*photos.columns))


def applied(photos: DataFrame, done: DataFrame) -> DataFrame:
    """photos (id, path) after done operations (photo_id, op_type, destination)."""
    met = photos.join(done, F.col("id") == F.col("photo_id"), "left")
    kept = met.where(~F.coalesce("op_type", F.lit("")).isin("trash", "delete"))
    kept = kept.select("id", F.when(F.col("op_type").isin("rename", "move"), F.col("destination")).otherwise(F.col("path")).alias("path"))
    top = photos.agg(F.max("id").alias("_top"))
    copies = numbered(met.where("op_type = 'copy'"), [F.col("id")]).crossJoin(top)
    return kept.unionByName(copies.select((F.col("_top") + F.col("place")).alias("id"), F.col("destination").alias("path")))
