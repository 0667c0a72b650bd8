"""Small cases with known answers."""

from __future__ import annotations

from datetime import UTC, date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import names, pixels
from lumenlake.operators import corpus, curation, filters, sequence, simjoin, stats
from lumenlake.operators.tables import components
from lumenlake.sources.catalog import merge_rows
from lumenlake.sources.files import scan, scan_summary

NOW = datetime(2026, 8, 17, 12, tzinfo=UTC)


def photo(spark, rows):
    schema = "id long, session_id long, camera_make string, lens string, focal_length double, iso long, aperture double, shutter_speed double, capture_datetime string, indexed_at string, photo_id long, sharpness double, brightness double, contrast double, saturation double, is_monochrome int, face_count long, smile_count long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def shoot(spark):
    at = "2026-08-01T00:00:00Z"
    return photo(spark, [
        (1, 1, "Sony", "50mm F1.4", 50.0, 100, 2.8, 0.004, "2026-06-15T10:00:00Z", at, 1, 85.0, 55.0, 50.0, 60.0, 0, 2, 0),
        (2, 1, "Sony", "50mm F1.4", 50.0, 400, 2.8, 0.004, "2026-06-20T15:00:00Z", at, 2, 40.0, 80.0, 50.0, 2.0, 1, None, None),
        (3, 2, "Canon", None, None, 1600, 4.0, 0.5, "2026-07-01T12:00:00Z", at, None, None, None, None, None, None, None, None),
        (4, 2, None, None, None, None, None, None, None, "2026-07-05T09:00:00Z", 4, 60.0, 45.0, 50.0, 60.0, 0, None, None),
    ])


def test_totals(shoot):
    r = shoot.agg(*stats.totals()).first()
    assert (r.photos, r.sessions, r.analyzed) == (4, 2, 3)
    assert r.avg_sharpness == pytest.approx(185 / 3) and r.avg_brightness == 60 and r.monochrome_share == pytest.approx(100 / 3)
    assert (r.face_share, r.smile_share) == (100, 0)
    none = shoot.where("id = 99").agg(*stats.totals()).first()
    assert none.photos == 0 and none.avg_sharpness is None and none.face_share is None


def test_histograms(shoot):
    got: dict = {}
    for r in stats.histograms(shoot).orderBy("histogram", "bin").collect():
        got.setdefault(r.histogram, []).append(r.n)
    assert got == {"iso": [1, 1, 0, 1, 0], "aperture": [0, 0, 2, 1, 0], "focal_length": [0, 0, 2, 0, 0], "shutter_speed": [0, 1, 0, 0, 2, 0, 0]}


def test_usage_and_trend(shoot):
    assert [(r.name, r.photos, r.share) for r in stats.usage(shoot, "camera_make", "Unknown camera").collect()] == [("Sony", 2, 50.0), ("Canon", 1, 25.0), ("Unknown camera", 1, 25.0)]
    assert [r.month for r in stats.trend(shoot).collect()] == ["2026-06", "2026-07"]


@pytest.mark.parametrize("name, want", [
    ("today", ("2026-08-17T00:00:00Z", "2026-08-17T23:59:59Z")), ("this-week", ("2026-08-17T00:00:00Z", "2026-08-23T23:59:59Z")),
    ("this-month", ("2026-08-01T00:00:00Z", "2026-08-31T23:59:59Z")), ("this-year", ("2026-01-01T00:00:00Z", "2026-12-31T23:59:59Z")), ("all", None),
])
def test_periods(name, want):
    assert stats.period(name, NOW) == want


def test_custom_period_holds_its_last_day():
    assert stats.period("custom", NOW, date(2026, 6, 1), date(2026, 6, 30)) == ("2026-06-01T00:00:00Z", "2026-06-30T23:59:59Z")


@pytest.mark.parametrize("bad", [
    "[]", '{"operator": "OR", "conditions": []}', filters.as_json(("nothing", "=", 1)), filters.as_json(("monochrome", "in", [True])), filters.as_json(("iso", "=", 1.5)),
    filters.as_json(("sharpness", "between", [1])), filters.as_json(("palette_color", "in", ["pink"])), filters.as_json(*[("iso", "=", 1)] * 51), filters.as_json(("iso", "in", [])),
])
def test_bad_filters(spark, bad):
    with pytest.raises(filters.FilterError):
        filters.compile_filter(bad)


def test_values_stay_values(spark):
    rows = spark.createDataFrame([("x' OR '1'='1",), ("a",)], "orientation string")
    assert rows.where(filters.compile_filter(filters.as_json(("orientation", "=", "x' OR '1'='1")))).count() == 1


def test_filters_with_the_same_conditions_are_equal():
    a, b = ("iso", ">", 3), ("rating", "=", 5)
    assert filters.canonical(filters.as_json(a, b)) == filters.canonical(filters.as_json(b, a)) != filters.canonical(filters.as_json(a))


def test_burst_blinks_and_orders(spark):
    probs = [0.95, 0.05, 0.95, 0.95, None, 0.95]
    photos = spark.createDataFrame([(i + 1, 1, f"2026-01-01T00:00:0{i}Z") for i in range(6)], "id long, session_id long, capture_datetime string")
    analysis = spark.createDataFrame([(i + 1, 1, 2 if p is not None else 0, 2) for i, p in enumerate(probs)], "photo_id long, face_count long, eye_evaluated_count long, eye_algorithm_version long")
    faces = spark.createDataFrame([(i + 1, 0, 77, p, p) for i, p in enumerate(probs)], "photo_id long, face_index int, appearance_hash long, left_eye_open_prob double, right_eye_open_prob double")
    burst = sequence.bursts(photos, 10)
    assert burst.count() == 6
    got = {r.id: r.possible_blink for r in sequence.blinks(burst, sequence.frames(photos, analysis, faces)).collect()}
    assert got == {2: True, 3: False}


def test_bursts_are_measured_from_the_first_frame(spark):
    at = [0, 1, 2, 20, 40, 41, 50, 52, 54]
    photos = spark.createDataFrame([(i + 1, 1, f"2026-01-01T00:00:{t:02d}Z") for i, t in enumerate(at)] + [(99, 1, None), (98, None, "2026-01-01T00:00:00Z")], "id long, session_id long, capture_datetime string")
    by: dict = {}
    for r in sequence.bursts(photos, 3).collect():
        by.setdefault(r.start, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [[1, 2, 3], [5, 6], [7, 8]]


def test_nonstop_shooting_against_a_plain_loop(spark):
    import random

    draw = random.Random(5)
    rows = []
    for session, steps in ((1, [1]), (2, [0, 1, 2, 3]), (3, [1, 2, 3, 4, 5, 4000])):
        t = 1_767_225_000
        for _ in range(30_000 if session == 1 else 6_000):
            t += draw.choice(steps)
            rows.append((len(rows), session, t))
    photos = spark.createDataFrame(rows, "id long, session_id long, t long").selectExpr("id", "session_id", "date_format(timestamp_seconds(t), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS capture_datetime")
    for gap in (3, 3700):
        want, at = {}, {}
        for id_, session, t in rows:
            if session not in at or t - at[session] > gap:
                at[session] = t
            want.setdefault((session, at[session]), set()).add(id_)
        got: dict = {}
        for r in sequence.bursts(photos, gap).collect():
            got.setdefault((r.session_id, r.start), set()).add(r.id)
        assert got == {k: v for k, v in want.items() if len(v) > 1}


def test_review_units_claim_in_turn(spark):
    kinds = "array<struct<kind:string,group_id:long>>"
    held = {0: [("burst", 7), ("similar", 1)], 1: [("similar", 1)], 2: [("burst", 7), ("similar", 1)], 3: [("similar", 1), ("face", 4)], 4: [("face", 4), ("similar", 9)], 5: None, 6: [], 7: [("similar", 9)]}
    queue = spark.createDataFrame([(1, 100 + i, i, s) for i, s in held.items()] + [(2, 200, 0, [("burst", 7)])], f"session_id long, id long, index int, sequences {kinds}")
    got = {(r.session_id, r.unit, r.kind, r.place, r.id) for r in sequence.review_units(queue).collect()}
    assert got == {(1, 0, "burst", 0, 100), (1, 0, "burst", 1, 102), (1, 1, "similar", 0, 101), (1, 1, "similar", 1, 103), (1, 2, "similar", 0, 104), (1, 2, "similar", 1, 107), (1, 3, "single", 0, 105), (1, 4, "single", 0, 106), (2, 0, "single", 0, 200)}


def test_stream_results_over_several_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from lumenlake.streaming import ingest

    for n, rows in enumerate(([("a", 5, 10), ("b", 2, 20)], [("a", 1, 30)], [("b", 9, 15), ("c", 3, 40)])):
        spark.createDataFrame(rows, "path string, id long, s long").selectExpr("path", "id", "timestamp_seconds(s) AS t", "1L AS session_id").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    stream = lambda: spark.readStream.schema("path string, id long, t timestamp, session_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    kept = ingest.folded(stream(), "path", {"id": F.min("id"), "t": F.max("t")}).collect()
    assert {(r.path, r.id, int(r.t.timestamp())) for r in kept} == {("a", 1, 30), ("b", 2, 20), ("c", 3, 40)}
    windows = ingest.settled(ingest.activity(stream()), "update", ["start", "session_id"]).collect()
    assert [(r.session_id, r.frames) for r in windows] == [(1, 5)]


def test_hash_groups(spark):
    base = 0x1234567890ABCDEF
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(1, 1, base), (2, 1, base ^ 3), (3, 1, base ^ 7), (4, 1, base ^ (2**64 - 1)), (5, None, base), (6, 2, base), (7, 2, 0), (8, 3, 0)]
    photos = spark.createDataFrame([(i, s, signed(h)) for i, s, h in rows], "id long, session_id long, phash long")
    assert sorted((r.group_id, r.id) for r in simjoin.groups_within(photos).collect()) == [(1, 1), (1, 2), (1, 3)]
    assert sorted(r.id for r in simjoin.groups_across(photos).collect()) == [1, 2, 3, 6]
    assert simjoin.groups_within(photos.where("id < 0")).count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 400, (260, 2)).tolist() + [[i, i + 1] for i in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("name, want", [
    ("IMG_20250101_143022.jpg", "2025-01-01T14:30:22Z"), ("PXL_20250101_143022123.jpg", "2025-01-01T14:30:22Z"), ("Screenshot 2025-01-09 at 14.30.22.png", "2025-01-09T14:30:22Z"),
    ("Screenshot_2025-01-09-143022.png", "2025-01-09T14:30:22Z"), ("20250109.jpg", "2025-01-09T00:00:00Z"), ("2025-01-09.jpg", "2025-01-09T00:00:00Z"), ("202501091430.jpg", None),
    ("20251399.jpg", None), ("99999999 2025-01-09.jpg", None), ("DSC_0001.NEF", None), ("noextension20250101", None), (None, None), ("IMG20250109143022.jpg", "2025-01-09T14:30:22Z"),
])
def test_dates_from_names(name, want):
    assert names.date_from_name(name) == want


def test_names_and_templates(spark):
    rows = spark.createDataFrame([("a/b: c..", "x {date}"), ("***", "y")], "n string, o string")
    got = rows.select(names.sanitized("n").alias("s"), names.expanded("{original}-{date}-{other}", {t: F.col("o") if t == "original" else F.lit("D") for t in names.TOKENS}).alias("t")).collect()
    assert [r.s for r in got] == ["a-b-c", "renamed"]
    assert got[0].t == "x {date}-D-{other}"


def test_duplicate_destinations_abort_a_plan(spark):
    schema = "id long, path string, filename string, extension string, capture_datetime string, file_mtime string, indexed_at string, camera_model string, lens string, focal_length double, iso long"
    photos = spark.createDataFrame([(i, f"/a/{i}.jpg", f"{i}.jpg", "jpg", "2026-01-01T00:00:00Z", None, "2026-01-01T00:00:00Z", "M", None, None, None) for i in (1, 2)], schema)
    none = spark.createDataFrame([], "path string")
    assert all(r.aborted for r in curation.rename_plan(photos, "{date}", "g", none).collect())
    rows = curation.rename_plan(photos, "{camera}.v{sequence}.png", "g", none).orderBy("id").collect()
    assert [(r.destination, r.aborted) for r in rows] == [("/a/M.v001.jpg", False), ("/a/M.v002.jpg", False)]


def test_merge_rules(spark):
    base = spark.createDataFrame([(1, "a", 1, False), (2, "b", None, True)], "k long, x string, y int, z boolean")
    delta = spark.createDataFrame([(2, None, 5, False), (3, "c", 7, None)], "k long, x string, y int, z boolean")
    got = merge_rows(base, delta, "k", {"x": "new_first", "y": "old_first", "z": "or"}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, False), (2, "b", 5, True), (3, "c", 7, False)]


def test_pixels():
    flat = np.full((16, 16, 3), 128, np.uint8)
    assert pixels.measure(flat)["sharpness"] == 0 and pixels.measure(flat)["color_signature"] == 0 and pixels.measure(flat)["is_monochrome"] == 1
    board = np.zeros((16, 16, 3), np.uint8)
    board[::2, ::2] = board[1::2, 1::2] = 255
    m = pixels.measure(board)
    assert m["sharpness"] > 90 and m["highlight_clipping"] == 50 and m["shadow_clipping"] == 50
    two = np.zeros((10, 10, 3), np.uint8)
    two[:5], two[5:] = (255, 0, 0), (0, 0, 255)
    assert pixels.measure(two)["color_signature"] == 1 | 1 << 8
    ramp = np.repeat(np.arange(0, 252, 4, dtype=np.uint8)[None, :, None], 40, axis=0).repeat(3, axis=2)
    assert pixels.difference_hash(pixels.luma(ramp)) == -1


def test_scan(spark, tmp_path):
    for name in ("a.JPG", "b.nef", "c.txt", ".hidden.jpg", "d/e.heic", ".dot/f.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    rows = scan(spark, str(tmp_path)).collect()
    assert [(r.filename, r["class"], r.size_bytes) for r in rows] == [("a.JPG", "decodable", 3), ("b.nef", "raw", 3), ("e.heic", "heic", 3)]
    s = scan_summary(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")).first()
    assert (s.total_files, s.indexed, s.ignored) == (4, 3, 1)


def test_face_hash_needs_enough_pixels():
    ramp = np.repeat(np.arange(0, 252, 4, dtype=np.uint8)[None, :, None], 40, axis=0).repeat(3, axis=2)
    assert pixels.face_hash(ramp, 10, 10, 20, 20) == -1
    assert pixels.face_hash(ramp, 10, 10, 5, 5) is None and pixels.face_hash(ramp, 60, 10, 20, 20) is None


def test_damaged_metadata_is_empty():
    from lumenlake.sources import exif

    whole = exif.write_tags({"make": "Sony", "focal": 50.0, "iso_photographic": 100, "taken": "2026:01:02 03:04:05", "gps": True})
    assert exif.read_tags(whole) == {"make": "Sony", "focal": 50.0, "iso_photographic": 100, "taken": "2026:01:02 03:04:05", "gps": True}
    for cut in range(len(whole)):
        exif.read_tags(whole[:cut])
    assert exif.read_tags(b"junk") == exif.read_tags(None) == exif.read_tags(b"") == {}


def test_metadata_rules(spark):
    from lumenlake.sources import exif

    rows = [("Sony ", "0000:00:00 00:00:00", 5000.0, None, 0, None, 200), (" ", "2026:01:02 03:04:05,5", None, 35.0, 64, 50, 200), (None, "garbage", None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "make string, taken string, focal double, focal_35mm double, iso_speed long, iso_index long, iso_photographic long")
    raw = raw.withColumns({k: F.lit(None).cast(t) for k, t in (c.split() for c in exif.RAW.split(", ")) if k not in raw.columns})
    got = exif.fields(raw).withColumn("some", exif.has_metadata()).collect()
    assert [(r.camera_make, r.capture_datetime, r.focal_length, r.iso, r.some) for r in got] == [("Sony", None, 50.0, 200, True), (None, "2026-01-02T03:04:05Z", 35.0, 64, True), (None, None, None, None, False)]


def test_image_dimensions(spark, tmp_path):
    import struct
    import zlib

    from lumenlake.sources.files import dimensions

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"\x10\x20\x30" * 3 for _ in range(2)))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in dimensions(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (3, 2), "b.png": (None, None)}


def test_names_that_hold_one_another_match_without_a_shared_word(spark):
    left = spark.createDataFrame([(1, "street"), (2, "restaurants"), (3, "ab"), (4, "love"), (5, "sea")], "id long, name string")
    right = spark.createDataFrame([(1, "Streets"), (2, "/restaurant"), (3, "abc"), (4, "alcove"), (5, "seaside")], "id long, name string")
    assert {(r.left_id, r.right_id, round(r.score, 2)) for r in corpus.fuzzy_matches(left, right).collect()} == {(1, 1, 0.92), (2, 2, 0.95)}


def test_faces_past_the_sixty_fourth_link_their_own_photo(spark):
    faces = spark.createDataFrame([(1, 70, 5), (9, 0, 5), (2, 0, 2**40 - 1)], "photo_id long, face_index int, appearance_hash long")
    photos = spark.createDataFrame([(1, 1), (2, 1), (9, 1)], "id long, session_id long")
    assert {tuple(r) for r in simjoin.face_groups(faces, photos).collect()} == {(1, 1, 1), (1, 1, 9)}
