"""Bursts, review units and face links against plain loops, and their bounds."""

from __future__ import annotations

import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import sequence, simjoin, tables
from lumenlake.plans import QUERIES


def photo_rows(times: dict[int, list[int]]):
    stamp = lambda t: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    n = 0
    for session, own in times.items():
        for t in own:
            n += 1
            yield n, session, stamp(t), t


def plain_bursts(rows, gap):
    out, start, session = {}, None, None
    for i, s, _, t in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        if session != s or t - start > gap:
            start, session = t, s
        out.setdefault((s, start), set()).add(i)
    return {(s, start, i) for (s, start), ids in out.items() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("gap", [0, 3, 40, 7200])
def test_bursts_by_arrays_and_by_pointers(spark, monkeypatch, gap):
    rng = random.Random(gap)
    times = {1: [1000], 2: [5, 5, 5], 3: list(range(0, 9000, 7)), 9: list(range(100))}
    for session in range(20, 40):
        at, own = rng.randrange(1000), []
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice([0, 1, 2, 3, 4, 5, 39, 41, 500, 7100, 7300])
            own += [at] * rng.choice([1, 1, 2])
        times[session] = own
    rows = list(photo_rows(times))
    photos = spark.createDataFrame(rows, "id long, session_id long, capture_datetime string, t long")
    photos = photos.unionByName(spark.createDataFrame([(-1, None, "1970-01-01T00:00:00Z", 0), (-2, 1, None, 0)], photos.schema))
    want = plain_bursts(rows, gap)
    for most in (4096, 4):
        monkeypatch.setattr(sequence, "SESSION_TIMES", most)
        got = sequence.bursts(photos, gap).collect()
        assert {(r.session_id, r.start, r.id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("gap", [6, 7200])
def test_one_nonstop_session_is_spread(spark, gap):
    # a second has a photo each, so starts lie gap + 1 seconds apart
    n = 60_000
    photos = spark.range(n).select("id", F.lit(1).cast("long").alias("session_id"), F.date_format(F.timestamp_seconds("id"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_datetime"))
    got = sequence.bursts(photos, gap)
    assert got.where(F.col("start") != F.floor(F.col("id") / (gap + 1)) * (gap + 1)).count() == 0
    assert got.count() == n - (n % (gap + 1) == 1)
    times = photos.select("session_id", F.col("id").alias("t"))
    # a row is one pointer
    assert all(not k.startswith("array") for _, k in sequence._next_starts(times, gap).dtypes)


def plain_units(ids, sequences):
    """The claims as they are defined: sequences (kind, id, photos) of a session whose photos ids are in order of capture."""
    place = {p: i for i, p in enumerate(ids)}
    ordered = [(kind, group, sorted({p for p in held if p in place}, key=place.get)) for kind, group, held in sequences]
    ordered = sorted((s for s in ordered if len(s[2]) > 1), key=lambda s: (s[0] != "burst", place[s[2][0]], s[0] != "similar", s[1]))
    used, units = set(), []
    for kind, _, held in ordered:
        free = [p for p in held if p not in used]
        if len(free) > 1:
            used |= set(free)
            units.append(("burst" if kind == "burst" else "similar", free))
    units += [("single", [p]) for p in ids if p not in used]
    return sorted(units, key=lambda u: place[u[1][0]])


def queue_of(spark, sessions):
    rows = []
    for session, (ids, sequences) in sessions.items():
        for i, p in enumerate(ids):
            rows.append((session, p, i, [(kind, group) for kind, group, held in sequences if p in held]))
    return spark.createDataFrame(rows, "session_id long, id long, index int, sequences array<struct<kind:string,group_id:long>>")


def test_review_units_as_defined(spark):
    rng = random.Random(5)
    sessions = {
        # a face group that begins before a similar one claims before it
        1: ([1, 2, 3, 4, 5], [("similar", 3, [2, 3, 4]), ("face", 1, [1, 3, 4]), ("burst", 9, [4, 5])]),
        2: ([11, 12], []),
        # sequences of one kind that overlap in a chain
        3: (list(range(21, 33)), [("similar", g, [g, g + 1, g + 2]) for g in range(21, 31)]),
        4: ([41, 42, 43], [("burst", 1, [41]), ("face", 2, [43, 42]), ("similar", 2, [42, 43])]),
    }
    for session in range(10, 30):
        ids = rng.sample(range(1000 * session, 1000 * session + 999), rng.randrange(1, 40))
        sessions[session] = (ids, [(rng.choice(["burst", "similar", "face"]), g, rng.sample(ids, min(len(ids), rng.randrange(1, 7)))) for g in range(rng.randrange(0, 25))])
    want = {(s, n, kind, k, p) for s, (ids, sequences) in sessions.items() for n, (kind, held) in enumerate(plain_units(ids, sequences)) for k, p in enumerate(held)}
    got = sequence.review_units(queue_of(spark, sessions)).collect()
    assert {(r.session_id, r.unit, r.kind, r.place, r.id) for r in got} == want and len(got) == len(want)


def test_review_units_of_nothing(spark):
    empty = queue_of(spark, {1: ([1, 2], [])})
    assert {(r.unit, r.kind, r.id) for r in sequence.review_units(empty).collect()} == {(0, "single", 1), (1, "single", 2)}
    assert sequence.review_units(empty.limit(0)).collect() == []


def faces_of(spark, rows):
    """Faces (photo_id, appearance_hash) and their photos, with the photo's session in the hundreds."""
    faces = spark.createDataFrame([(p, i, h) for i, (p, h) in enumerate(rows)], "photo_id long, face_index int, appearance_hash long")
    photos = spark.createDataFrame([(p, p // 100_000) for p in sorted({p for p, _ in rows})], "id long, session_id long")
    return faces, photos


@pytest.mark.parametrize("chunk", [1024, 16])
def test_face_groups_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simjoin, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = []
    for session in (1, 2):
        kinds = [rng.getrandbits(63) - (1 << 62) for _ in range(25)]
        for p in range(150):
            for _ in range(rng.randrange(0, 4)):
                h = rng.choice(kinds)
                for bit in rng.sample(range(63), rng.randrange(0, 9)):
                    h ^= 1 << bit
                rows.append((session * 100_000 + p, h))
        rows += [(session * 100_000 + 500, 7), (session * 100_000 + 500, 7), (session * 100_000 + 501, 1 << 40), (session * 100_000 + 502, 1 << 40)]
    label = {p: p for p, _ in rows}
    changed = True
    while changed:
        changed = False
        for p, x in rows:
            for q, y in rows:
                if p // 100_000 == q // 100_000 and p != q and bin((x ^ y) & (2**64 - 1)).count("1") <= 10 and label[p] != label[q]:
                    label[p] = label[q] = min(label[p], label[q])
                    changed = True
    sizes = {v: sum(w == v for w in label.values()) for v in label.values()}
    want = {(v, p) for p, v in label.items() if sizes[v] > 1}
    got = simjoin.face_groups(*faces_of(spark, rows)).collect()
    assert {(r.group_id, r.id) for r in got} == want and len(got) == len(want)


def test_links_stay_linear(spark):
    same = faces_of(spark, [(100_000 + p, 12345) for p in range(2000)])
    assert simjoin.face_links(*same).count() < 4000
    assert simjoin.face_groups(*same).count() == 2000
    near = faces_of(spark, [(100_000 + p, 1 << (p % 60) | 1 << (p // 60)) for p in range(3000)])
    assert simjoin.face_links(*near).count() < 3000 * 16
    assert simjoin.face_groups(*near).agg(F.countDistinct("group_id"), F.count("id")).first() == (1, 3000)


def test_near_hashes_meet_through_exchanges(spark):
    rows = spark.range(50).select(F.col("id").alias("vertex"), (F.col("id") % 3).alias("scope"), (F.col("id") * F.lit(0x9E3779B97F4A7)).alias("hash"))
    for most, across in ((6, False), (4, True)):
        plan = simjoin.pairs(rows, most, across)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", [4, 6])
def test_near_pairs_against_all_pairs(spark, monkeypatch, most):
    pick = random.Random(most)
    rows = [(v, v % 3, pick.getrandbits(64) - (1 << 63)) for v in range(300)]
    rows += [(1000 + v, v % 3, v << 40 | v >> 2) for v in range(300)]
    for v in range(300):
        h = pick.choice(rows)[2] & (1 << 64) - 1
        for bit in pick.sample(range(64), pick.randrange(0, most + 3)):
            h ^= 1 << bit
        rows.append((2000 + v, v % 3, h - (1 << 64) if h >> 63 else h))
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    want = {across: sorted((v, w, s, t, bits(x, y)) for v, s, x in rows for w, t, y in rows if v < w and (s != t) == across and bits(x, y) <= most) for across in (False, True)}
    frame = spark.createDataFrame(rows, "vertex long, scope long, hash long").repartition(3).persist()
    # groups in pieces and in one task, and some or all of them by a join
    for shared, step in ((1 << 16, 1 << 17), (40, 100), (1, 2)):
        monkeypatch.setattr(simjoin, "MOST_SHARED", shared)
        monkeypatch.setattr(simjoin, "STEP", step)
        for across, pairs in want.items():
            assert sorted(tuple(r) for r in simjoin.pairs(frame, most, across).collect()) == pairs


def test_near_hashes_are_shuffled_once_a_block(spark):
    rows = spark.range(5000).select(F.col("id").alias("vertex"), (F.col("id") % 900).alias("scope"), F.xxhash64("id").alias("hash"))
    for most, across in ((6, False), (4, True)):
        assert shuffled_rows(spark, lambda: simjoin.pairs(rows, most, across).count()) < 5000 * (most + 2)  # noqa: B023


def shuffled_rows(spark, run) -> int:
    """Rows that the stages of run() wrote to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = lambda: {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for found in [listed()] for i in range(found.size())}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for stage, n in stages().items() if stage not in before)


def test_similarity_summary_shuffles_few_rows_a_photo(spark, small):
    photos = spark.read.parquet(f"{small}/events.parquet").count()
    assert shuffled_rows(spark, lambda: QUERIES["E26_similarity_summary"](spark, small).collect()) < 60 * photos


def test_masks_spread_and_lose_nothing():
    pick = random.Random(5)
    for most in (4, 6, 10):
        known = [m & (1 << 64) - 1 for m in simjoin.masks(most)]
        # the low and the high half weigh alike in each key
        assert all(abs((m >> 32).bit_count() - (m & 0xFFFFFFFF).bit_count()) <= 3 for m in known)
        for _ in range(500):
            differ = sum(1 << b for b in pick.sample(range(64), most))
            assert any(not differ & m for m in known)


def test_replaced_sessions_in_few_folders(spark):
    rows = spark.range(3000).selectExpr("id % 700 as session_id", "id", "'old' as run")
    got = tables.replaced_by_session(rows, lambda old: old.where("session_id % 5 = 0 and id < 2500").withColumn("run", F.lit("new")))
    want = {(i % 700, i, "new" if i % 700 % 5 == 0 else "old") for i in range(3000) if i % 700 % 5 or i < 2500}
    assert {(r.session_id, r.id, r.run) for r in got.collect()} == want
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert 1 < len(folders) <= tables.SESSION_PARTS


def broadcast_keys(spark, run):
    """Keys by which the executions of run() met a broadcast table."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = lambda: {(x := found.apply(i)).executionId(): x.physicalPlanDescription() for found in [store.executionsList()] for i in range(found.size())}
    before = max(known(), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [text for i, text in known().items() if i > before]
    assert any("SortMergeJoin" in text for text in plans)
    return {tuple(re.findall(r"(\w+)#", keys)) for text in plans for keys in re.findall(r"BroadcastHashJoin.*\nLeft keys.*\nRight keys \[\d+\]: (.*)", text)}


@pytest.mark.parametrize("name", ["E02_cross_session_groups", "E08_all_groups", "E24_groups_of_tab", "E19_review_queue", "E20_review_units"])
def test_groups_send_no_photos_to_the_driver(spark, small, name):
    keys = broadcast_keys(spark, lambda: QUERIES[name](spark, small).collect())
    # parts, counts of ranges, and sessions of over SESSION_TIMES different times
    assert keys <= {("p_partkey",), ("_part",), ("session_id",)}
