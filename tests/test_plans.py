"""Crawl quotas, move plans, containers, file heads, streamed bursts and bucketed joins against plain loops."""

from __future__ import annotations

import html
import math
import random
import struct
import zlib
from collections import defaultdict
from datetime import UTC

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import pixels
from lumenlake.operators import corpus, curation
from lumenlake.plans import QUERIES
from lumenlake.plans import images as image_plans
from lumenlake.sources import exif, heads
from lumenlake.sources.catalog import Catalog
from lumenlake.streaming import ingest


def crawl_by_loop(results, seen, per_query, per_class, page):
    """A crawl one query after the other; results by turn: (class, ids in order of place)."""
    seen, counts, out = set(seen), {}, set()
    for turn in sorted(results):
        fine, ids = results[turn]
        quota = per_query if per_query is not None else len(ids)
        for start in range(0, max(len(ids), 1), page):
            for place, i in enumerate(ids[start : start + page], start):
                if i is None or i in seen or quota <= 0:
                    continue
                seen.add(i)
                out.add((fine, turn, place, i))
                quota -= 1
                counts[fine] = counts.get(fine, 0) + 1
            if per_class is not None and counts.get(fine, 0) >= per_class:
                break
    return out


@pytest.mark.parametrize(("per_query", "per_class"), [(3, None), (None, 12), (4, 9), (None, None)])
def test_crawl_quotas_against_a_loop(spark, per_query, per_class):
    rng = random.Random(per_query or 0)
    results = {turn: (f"c{turn // 4}", [rng.randrange(60) for _ in range(rng.randrange(0, 30))]) for turn in range(14)}
    rows = [(fine, turn, place, i) for turn, (fine, ids) in results.items() for place, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "fine string, turn long, place long, id long")
    seen = spark.createDataFrame([(i,) for i in (3, 14, 15)], "id long")
    got = corpus.crawled_within_quotas(frame, seen, per_query, per_class, 5).collect()
    assert {tuple(r) for r in got} == crawl_by_loop(results, {3, 14, 15}, per_query, per_class, 5) and len(got) == len({tuple(r) for r in got})
    assert corpus.crawled_within_quotas(frame.limit(0), seen, per_query, per_class, 5).collect() == []


def test_entities_are_read_as_the_standard_says(spark):
    texts = ["<b>A&amp;B</b>", "&nbsp;x&eacute;&#233;&#xE9;", "&lt;i&gt;", "a &amp b", None, "no entity", "&notanentity; &copy", "  <i> </i>"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", corpus.stripped_markup("t").alias("t")).orderBy("i").collect()]
    import re

    assert [t.strip() for t in got] == [html.unescape(re.sub(r"<[^>]+>", "", t or "")).strip() for t in texts]


def test_unique_names_of_a_plan(spark):
    rng = random.Random(6)
    names = [rng.choice(["a.jpg", "b.jpg", "a-1.jpg", "a-3.jpg", "c", "a-b.tar.gz", "a-1-1.jpg"]) for _ in range(80)]
    held = ["a.jpg", "a-2.jpg", "a-4.jpg", "b-1.jpg", "c-1", "a-07.jpg", "x-1.jpg"]
    rows = [(i, f"/p/{i}/{n}", n, None if i % 5 == 0 else f"2024-01-{1 + i % 20:02d}T00:00:00Z") for i, n in enumerate(names)]
    photos = spark.createDataFrame(rows, "id long, path string, filename string, capture_datetime string")
    existing = spark.createDataFrame([(f"/to/{n}",) for n in held] + [("/other/a-5.jpg",)], "path string")
    got = {r.id: r.destination for r in curation.unique_move_plan(photos, "/to", existing).collect()}
    taken, want = set(held), {}
    reserved = set(held) | set(names)
    for i, _, n, _ in sorted(rows, key=lambda r: (r[3] is not None, r[3] or "", r[2], r[0])):
        if n not in taken:
            want[i] = n
            taken.add(n)
            continue
        stem, dot, end = n.rpartition(".") if "." in n[1:] else (n, "", "")
        k = next(k for k in range(1, 999) if f"{stem}-{k}{dot}{end}" not in reserved | taken)
        want[i] = f"{stem}-{k}{dot}{end}"
        taken.add(want[i])
    assert got == {i: f"/to/{n}" for i, n in want.items()} and len(set(got.values())) == len(rows)


TAGS = {"make": "Canon", "model": "R5", "lens": "RF 50", "taken": "2024:05:06 07:08:09", "aperture": 2.8, "iso_speed": 400, "gps": 1}


@pytest.mark.parametrize("container", ["jpeg", "tiff", "png", "webp", "heic"])
def test_same_tags_in_every_container(container):
    data = exif.write_tags(TAGS, container)
    assert exif.read_tags(data) == {**TAGS, "gps": True}
    rng = random.Random(1)
    for n in range(0, len(data), 3):
        exif.read_tags(data[:n])
        damaged = bytearray(data)
        for _ in range(4):
            damaged[rng.randrange(len(data))] = rng.randrange(256)
        exif.read_tags(bytes(damaged))
    assert exif.read_tags(data[: len(data) // 3]).keys() <= {*TAGS, "gps"} and exif.read_tags(b"") == {}


def test_tags_in_the_item_data_and_in_two_parts():
    tiff = exif.write_tags(TAGS, "tiff")
    payload = struct.pack(">I", 0) + tiff
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    item = box(b"infe", struct.pack(">IHH4s", 2 << 24, 1, 0, b"hvc1") + b"\0") + box(b"infe", struct.pack(">IIH4s", 3 << 24, 9, 0, b"Exif") + b"\0")
    names = box(b"iinf", struct.pack(">IH", 0, 2) + item)
    half = len(payload) // 2
    place = box(b"iloc", struct.pack(">IHI", 2 << 24, 0x4440, 1) + struct.pack(">IHHIH", 9, 1, 0, 0, 2) + struct.pack(">IIII", 0, half, half, len(payload) - half))
    data = box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", bytes(4) + box(b"hdlr", bytes(12)) + names + place + box(b"idat", payload))
    assert exif.read_tags(data) == {**TAGS, "gps": True}


def test_dimensions_from_heads(spark, tmp_path):
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    riff = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    frame = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 500) + bytes(10)
    segment = b"\xff\xe1" + struct.pack(">H", 65_000) + bytes(64_998)
    tall = bytearray(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x0100, 3, 1, 70) + struct.pack("<HHII", 0x0101, 3, 1, 90) + bytes(4))
    files = {
        "a.png": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 480) + bytes(5)) + bytes(3_000_000), (640, 480), 4096),
        "d/b.jpg": (b"\xff\xd8" + frame + bytes(50_000), (500, 300), 4096),
        "d/late.jpg": (b"\xff\xd8" + segment * 2 + frame + bytes(2_000_000), (500, 300), 262_144),
        "x.webp": (riff(b"VP8X" + struct.pack("<I", 10) + bytes(4) + (1919).to_bytes(3, "little") + (1079).to_bytes(3, "little")), (1920, 1080), 30),
        "l.webp": (riff(b"VP8L" + struct.pack("<I", 5) + b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")), (100, 50), 25),
        "t.tif": (bytes(tall), (70, 90), len(tall)),
        "zero.png": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 0, 480) + bytes(5)), None, None),
        "no.jpg": (b"not an image" * 1000, None, None), "empty.jpg": (b"", None, None), "cut.jpg": (b"\xff\xd8" + segment[:50], None, None),
    }
    for name, (data, *_) in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.removeprefix(f"{tmp_path}/"): r for r in heads.image_heads(spark, str(tmp_path), 3).collect()}
    assert rows.keys() == files.keys()
    for name, (data, size, read) in files.items():
        r = rows[name]
        assert r.size_bytes == len(data) and ((r.width, r.height) == size if size else r.width is None and r.height is None), name
        assert read is None or r.read_bytes <= read
    (tmp_path / "none").mkdir()
    assert heads.image_heads(spark, str(tmp_path / "none")).collect() == []
    assert heads.image_heads(spark, f"file://{tmp_path}").count() == len(files)


def test_streamed_bursts_over_batches_and_late_frames(spark, tmp_path):
    rng = random.Random(3)
    frames, at = [], {1: 0, 2: 5}
    for _ in range(400):
        s = rng.choice((1, 2))
        at[s] += rng.choice([0, 1, 2, 3, 4, 9, 30])
        frames.append((s, 10_000 + at[s]))
    # within the minute that the watermark waits frames come in any order
    order = sorted(frames, key=lambda f: f[1] + rng.randrange(50))
    batches = [order[i : i + 40] for i in range(0, len(order), 40)]
    batches.append([(1, 10_000), (2, 10_001), (3, 10_002)])
    batches.append([(9, 200_000)])
    batches.append([(9, 300_000)])
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, "session_id long, s long").select("session_id", F.timestamp_seconds("s").alias("t"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress: list = []
    got = ingest.settled(ingest.bursts(stream, 3, "1 minute"), store=ingest.ROCKSDB, progress=progress)
    want = set()
    for s in (1, 2):
        times, start, n = sorted(t for k, t in frames if k == s), None, 0
        for t in [*times, 10**9]:
            if start is None or t - start > 3:
                if n > 1:
                    want.add((s, start, n))
                start, n = t, 0
            n += 1
    assert {(r.session_id, int(r.start.timestamp()), r.photos) for r in got.collect()} == want and len(want) > 20
    assert ingest.late_rows(progress) == 3 and len(progress) >= len(batches)
    # frames and bursts that the watermark has passed are forgotten
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_bucketed_join_moves_no_rows(spark, small):
    from lumenlake.plans.joins import bucketed_join
    from lumenlake.sources.catalog import Catalog

    found = bucketed_join(Catalog(spark, small))
    assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan


def test_limits_of_pixels(spark):
    # an image of 300 megapixels is measured, though it is not searched for faces
    assert pixels.measurable(20_000, 15_000, 900_000_000) and not pixels.measurable(25_000, 20_001, 3 * 25_000 * 20_001)
    assert not pixels.measurable(10, 10, 299) and not pixels.measurable(0, 10, 0) and not pixels.measurable(10, 10, None)
    assert spark.range(1).select(pixels.too_large(F.lit(1), F.lit(20_000), F.lit(15_000)).alias("x")).first().x


def test_face_hashes_against_a_plain_loop(spark, small):
    """Each image's faces one by one, from its pixels."""
    c = Catalog(spark, small)
    seen = {r.vec_id: (r.width, r.height, bytes(r.data)) for r in image_plans.enlarged(c).collect()}
    plain = {r.vec_id: bytes(r.data) for r in image_plans.images(c).collect()}
    for key, (width, height, data) in seen.items():
        big = np.frombuffer(data, np.uint8).reshape(height, width, 3)
        assert (width, height) == (64, 64) and (big == np.frombuffer(plain[key], np.uint8).reshape(8, 8, 3).repeat(8, 0).repeat(8, 1)).all()
    found = defaultdict(list)
    for r in image_plans.face_boxes(c).collect():
        found[r.vec_id].append((-r.score, r.x, r.y, r.w, r.h))
    want = {}
    for key in seen.keys() & found.keys():
        rgb = np.frombuffer(seen[key][2], np.uint8).reshape(64, 64, 3)[:, :, ::-1]
        for n, (_, x, y, w, h) in enumerate(sorted(found[key])):
            x0, x1, y0, y1 = max(0, math.floor(x - 0.18 * w)), min(64, math.ceil(x + 1.18 * w)), max(0, math.floor(y - 0.18 * h)), min(64, math.ceil(y + 1.18 * h))
            part = rgb[y0:y1, x0:x1]
            want[key, n] = pixels.difference_hash(pixels.luma(part)) if min(part.shape[:2]) >= 12 else None
    got = {(r.vec_id, r.face): r.hash for r in QUERIES["B14_face_hashes"](spark, small).collect()}
    assert got == want and len({v for v in got.values() if v is not None}) > 20


def test_face_hashes_of_odd_rows(spark):
    ramp = bytes(v for y in range(20) for x in range(20) for v in (10 * x, 10 * x, 10 * x))
    images = spark.createDataFrame([(1, 20, 20, ramp), (2, 20, 20, None), (3, 20, 20, b"short"), (4, None, 20, ramp), (5, 20, 20, ramp), (None, 20, 20, ramp)], "id long, width int, height int, data binary")
    box = [(1, 0.9, 2.0, 2.0, 15.0, 15.0), (1, 0.9, 2.0, 2.0, 3.0, 3.0), (1, 0.5, None, 2.0, 9.0, 9.0), (1, 0.4, float("nan"), 2.0, 9.0, 9.0), (6, 0.9, 2.0, 2.0, 9.0, 9.0), (None, 0.9, 2.0, 2.0, 9.0, 9.0)]
    box += [(k, 0.9, 2.0, 2.0, 15.0, 15.0) for k in (2, 3, 4)]
    boxes = spark.createDataFrame(box, "id long, score double, x double, y double, w double, h double")
    got = {(r.id, r.face): r.hash for r in pixels.face_hashes(images, boxes, "id").collect()}
    assert got == {(1, 0): None, (1, 1): -1, (1, 2): None, (1, 3): None, (2, 0): None, (3, 0): None, (4, 0): None}
    assert pixels.face_hashes(images.limit(0), boxes, "id").count() == 0 and pixels.face_hashes(images, boxes.limit(0), "id").count() == 0


def test_refused_focus_at_any_number_of_photos(spark, tmp_path):
    rows = [(n, 4 if n in (1, 1000001) else 3, "view") for n in (1, 1000001, 2, 1000002)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "user_id", "event_type", "1D as value", "'' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "n", "b", "t")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["F06_review_progress"](spark, str(tmp_path)).collect()] == [(3, 1000002, 2)]


def test_all_shoots_of_several_files(spark, tmp_path):
    start = 1_700_000_000
    # the later file holds earlier times; the last shoot of each session is still open at the end
    files = [[(1, start + 90_000), (1, start + 93_000), (2, start + 93_500)], [(1, start), (1, start + 7_199), (1, start + 14_500), (2, start + 60)]]
    for k, rows in enumerate(files):
        made = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "event_id long, user_id long, s long").coalesce(1)
        made.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id", "'view' as event_type", "1D as value", "'' as props").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {(r.session_id, int(r.start.replace(tzinfo=UTC).timestamp()) - start, r.frames) for r in QUERIES["E28_shoots"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 2), (1, 14_500, 1), (1, 90_000, 2), (2, 60, 1), (2, 93_500, 1)}


def test_rounds_of_a_crawl_broadcast_nothing(spark, monkeypatch):
    plans, plain = [], corpus.write_table
    monkeypatch.setattr(corpus, "write_table", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    frame = spark.createDataFrame([("a", t, p, t + p) for t in range(4) for p in range(6)], "fine string, turn long, place long, id long")
    corpus.crawled_within_quotas(frame, spark.createDataFrame([(3,)], "id long"), 2, 4, 3).collect()
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoop" in p for p in plans)


def test_suppressed_boxes_of_mixed_lengths(spark):
    pick = random.Random(11)
    by = {}
    for photo in range(60):
        own = by[photo] = []
        for _ in range(pick.choice([1, 2, 3, 7, 40])):
            own.append((pick.random(), *(float(pick.randrange(60)) for _ in range(2)), *(float(pick.randrange(5, 30)) for _ in range(2))))
    by[60] = [(0.9, None, 1.0, 5.0, 5.0), (0.8, 1.0, 1.0, 5.0, 5.0), (0.7, 1.0, 1.0, 5.0, 5.0)]
    frame = spark.createDataFrame([(k, *b) for k, own in by.items() for b in own], "photo_id long, score double, x double, y double, w double, h double")

    def overlap(a, b):
        if None in a or None in b:
            return False
        (_, x, y, w, h), (_, p, q, u, v) = a, b
        both = max(0, min(x + w, p + u) - max(x, p)) * max(0, min(y + h, q + v) - max(y, q))
        return both > 0.3 * (w * h + u * v - both)

    for most in (3, 100):
        want = set()
        for k, own in by.items():
            kept = []
            for b in sorted(own, key=lambda b: (-b[0], *(v if v is not None else -1 for v in b[1:]))):
                if len(kept) < most and not any(overlap(b, o) for o in kept):
                    kept.append(b)
            want |= {(k, *b) for b in kept}
        assert {tuple(r) for r in pixels.suppressed(frame, most=most).collect()} == want


def test_only_boxes_of_images_are_suppressed(spark, small):
    plan = QUERIES["B14_face_hashes"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


class CountedState:
    """A state value and its timers, with the calls that a processor makes on them."""

    def __init__(self):
        self.held, self.calls, self.timers = None, 0, set()

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def clear(self):
        self.update(None)

    def exists(self):
        return self.get() is not None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return max(self.timers)


def test_a_session_of_a_stream_takes_few_calls():
    state, run = CountedState(), ingest.BurstProcessor(3)
    run.init(state)
    frames = pd.DataFrame({"t": pd.to_datetime([100.5, 101.2, 900], unit="s")})
    assert list(run.handleInputRows((1,), iter([frames]), None)) == []
    assert state.calls <= 4 and state.timers == {101_000}
    state.timers, state.calls = {800_000}, 0
    sent = pd.concat(run.handleExpiredTimer((1,), state, None))
    assert state.calls <= 4 and [(t.timestamp(), n) for t, n in zip(sent["start"], sent["photos"], strict=True)] == [(100, 2)]
    assert 901_000 in state.timers


def test_fuzzy_names_read_the_right_table_once(spark, small):
    # ids of the right table are read where its different names are written, not by the plan that compares them
    plan = QUERIES["D13_fuzzy_names"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "c_mktsegment" not in plan
