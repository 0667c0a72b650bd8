"""Every registered query of the catalog runs; those with SQL give the same rows as it does."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from lumenlake.operators import corpus
from lumenlake.plans import ORACLE_SQL, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), ORACLE_SQL[name], small) == []


def test_streaming_bursts_equal_batch(spark, small):
    from pyspark.sql import functions as F

    live = {(r.session_id, int(r.start.timestamp()), r.photos) for r in QUERIES["E27_streaming_bursts"](spark, small).collect()}
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("s"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).orderBy("s", "t").collect()
    want, start, n, last = set(), None, 0, None
    for s, t in [*((r.s, r.t) for r in events), (None, None)]:
        if start is not None and s == last and t - start <= 7200:
            n += 1
            continue
        if n > 1:
            want.add((last, start, n))
        start, n, last = t, 1, s
    late = max(r.t for r in events) - 3600 - 7200
    assert {w for w in want if w[1] < late} <= live <= want


def test_review_units_hold_each_photo_once(spark, small):
    rows = QUERIES["E20_review_units"](spark, small).collect()
    assert len({r.id for r in rows}) == len(rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r.session_id, r.unit), []).append(r)
    assert all((len(v) >= 2) == (v[0].kind != "single") for v in by.values())


def test_suppressed_boxes_against_plain_loop(spark, small):
    from lumenlake.plans.images import boxes, suppressed_boxes
    from lumenlake.sources.catalog import Catalog

    c = Catalog(spark, small)
    by: dict = {}
    for r in boxes(c).collect():
        by.setdefault(r.photo_id, []).append(r)

    def iou(a, b):
        both = max(0, min(a.x + a.w, b.x + b.w) - max(a.x, b.x)) * max(0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))
        return both / (a.w * a.h + b.w * b.h - both)

    want = 0
    for rows in by.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.score, r.x, r.y, r.w, r.h)):
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want += len(kept)
    assert suppressed_boxes(c).count() == want


def test_fuzzy_names_against_all_pairs(spark):
    import difflib

    from lumenlake.operators import corpus

    left = ["street", "the old mill", "Restaurant/Bar", "ox", "the sea", "red_barn", "", "a b c"]
    right = ["streets", "old mill", "restaurant bar", "the seas", "barn red", "ox", "the", "reads", "red barns"]
    frame = lambda names: spark.createDataFrame(list(enumerate(names)), "id long, name string")
    plain = [[r.n for r in frame(x).orderBy("id").select(corpus.normalized("name").alias("n")).collect()] for x in (left, right)]
    for least in (0.5, 0.8):
        want = {}
        for i, x in enumerate(plain[0]):
            words = {w for w in x.split(" ") if len(w) > 2}
            near = [(-difflib.SequenceMatcher(None, x, y).ratio(), j) for j, y in enumerate(plain[1]) if words and (words & {w for w in y.split(" ") if len(w) > 2} or x in y or (y and y in x))]
            if near and -min(near)[0] >= least:
                want[i] = min(near)[1]
        assert {r.left_id: r.right_id for r in corpus.fuzzy_matches(frame(left), frame(right), least).collect()} == want


def test_review_units_against_a_plain_loop(spark, small):
    from lumenlake.plans.sequences import all_members
    from lumenlake.sources.catalog import Catalog

    c = Catalog(spark, small)
    photos = sorted((r for r in c.photos.where("session_id is not null").collect()), key=lambda r: (r.capture_datetime is None, r.capture_datetime or "", r.id))
    by: dict = {}
    for m in all_members(c, across=False).collect():
        by.setdefault((m.session_id, m.group_type, m.group_id), set()).add(m.id)
    want = set()
    for session in {r.session_id for r in photos}:
        ids = [r.id for r in photos if r.session_id == session]
        # bursts first, then similar and face groups by their first photo
        groups = [(kind != "burst", min(map(ids.index, held)), kind != "similar", group, kind, held) for (s, kind, group), held in by.items() if s == session]
        claimed, units = set(), []
        for *_, kind, held in sorted(groups, key=lambda g: g[:4]):
            left = [i for i in ids if i in held and i not in claimed]
            if len(left) > 1:
                claimed |= set(left)
                units.append(("burst" if kind == "burst" else "similar", left))
        units += [("single", [i]) for i in ids if i not in claimed]
        for n, (kind, held) in enumerate(sorted(units, key=lambda u: ids.index(u[1][0]))):
            want |= {(session, n, kind, p, i) for p, i in enumerate(held)}
    assert {(r.session_id, r.unit, r.kind, r.place, r.id) for r in QUERIES["E20_review_units"](spark, small).collect()} == want


def test_class_map_against_plain_loop(spark):
    import difflib
    import re

    from lumenlake.operators import corpus

    plain = lambda n: re.sub(r"[^a-z0-9 ]+", " ", n.strip().lstrip("/").replace("_", " ").lower())
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    places = ["street", "streets", "Street", "movie theater indoor", "old_mill", "the mill", "church", "grotto", "zen garden", "unheard of", "city", "city"]
    classes = {"/m/1": "Street", "/m/2": "Movie theater", "/m/3": "Old mill", "/m/4": "Church", "/m/5": "Garden", "/m/6": "grotto", "/m/7": "church"}
    additions, drops = {"zen garden": "GARDEN", "old_mill": "church", "lost": "Nowhere"}, ["grotto", "city"]
    overrides, groups = {"city": ("/m/9", "City Centre"), "church": ("/m/4", "Church")}, {"church": "religious", "city_centre": "urban"}

    want = {}
    for label in dict.fromkeys(places):
        equal = sorted(m for m, n in classes.items() if plain(n) == plain(label))
        words = {w for w in plain(label).split() if len(w) > 2}
        near = sorted((-ratio(plain(label), plain(n)), m) for m, n in classes.items() if words & {w for w in plain(n).split() if len(w) > 2} or plain(n) in plain(label) or plain(label) in plain(n))
        if equal:
            want[label] = (equal[0], classes[equal[0]], 1.0, "exact")
        elif near and -near[0][0] >= 0.8:
            want[label] = (near[0][1], classes[near[0][1]], round(-near[0][0], 3), "fuzzy")
    for label, name in additions.items():
        if found := sorted(m for m, n in classes.items() if n.lower() == name.lower()):
            want[label] = (found[0], classes[found[0]], round(ratio(plain(label), plain(classes[found[0]])), 3), "added")
    want = {k: v for k, v in want.items() if k not in drops} | {k: (m, n, 1.0, "override") for k, (m, n) in overrides.items()}
    want = {k: (*v[:3], groups.get(v[1].lower().replace(" ", "_"), "other"), v[3]) for k, v in want.items()}

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = corpus.class_map(
        frame([(p,) for p in places], "name string"),
        frame(list(classes.items()), "mid string, name string"),
        frame(list(additions.items()), "name string, class_name string"),
        frame([(d,) for d in drops], "name string"),
        frame([(k, *v) for k, v in overrides.items()], "name string, mid string, class_name string"),
        frame(list(groups.items()), "class_name string, coarse string"),
    )
    assert {r["name"]: (r.mid, r.class_name, r.score, r.coarse, r.how) for r in got.collect()} == want
    assert {"exact", "fuzzy", "added", "override"} == {v[4] for v in want.values()}


def test_fuzzy_names_that_all_share_a_word(spark):
    """With one word in every name, pairs meet by their letters: the same matches as all pairs, and few candidates."""
    rng = random.Random(5)
    name = lambda: "camera " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(4, 12)))
    right = [(i, name()) for i in range(400)]
    left = [(1000 + i, n[:-1] + "x" if i % 2 else n + "s") for i, n in right[:60]] + [(2000 + i, name()) for i in range(60)] + [(3000, None), (3001, ""), (3002, "camera")]
    left, right = left + [(4000, left[0][1])], right + [(9000, right[3][1]), (9001, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    for least in (0.8, 0.9, 0.5):
        want = {}
        for i, x in left:
            near = sorted((-SequenceMatcher(None, x, y).ratio(), j) for j, y in right if x and y)
            if near and -near[0][0] >= least:
                want[i] = (near[0][1], round(-near[0][0], 9))
        got = corpus.fuzzy_matches(frame(left), frame(right), least, common=8)
        assert {r.left_id: (r.right_id, round(r.score, 9)) for r in got.collect()} == want
    words = lambda rows: frame(rows).where("name like 'camera %'").selectExpr("name as norm", "'camera' as word").distinct()
    met = corpus._alike(words(left), words(right), 0.8).count()
    assert 60 <= met < 0.2 * 121 * 400
