"""Each operator against a plain version on small data, and its defined cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import common, cotraining, edit_join, impact_index, langid, line_hash_dedup, mixing, order_minhash, pii, spaced_seed, warc_store
from lumenlake.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

#: Names that the operators use themselves, as extra columns of the input.
CLASH = ("size", "copies", "target", "z", "k", "line", "digest", "class", "n", "shift", "_doc", "_gone", "words", "score", "copy", "key", "text_key")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def odd_documents(spark, empty: bool = False):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    prose = "The quick brown fox jumps over the lazy dog while the seven wise owls watch from the old oak tree."
    rows = [
        (1, prose, "en", "a", 10), (1, prose, "en", "a", 10), (2, prose, None, None, None), (None, prose, "en", "a", 3), (None, None, None, None, None),
        (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \n\t\n ", "de", "b", 4), (6, LONG, "en", "a", 1), (7, "123 456", "en", "a", 7), (8, prose + "\n" + prose, "en", None, 5),
    ]
    docs = spark.createDataFrame([] if empty else rows, DOCS)
    return docs.withColumns({n: F.lit("x") for n in CLASH})


OPERATORS = {
    "mix": lambda d, s: mixing.pareto_mix(d), "mixed": lambda d, s: mixing.mixed_documents(d), "repeats": lambda d, s: line_hash_dedup.repeated_units(d), "cut": lambda d, s: line_hash_dedup.deduplicated(d),
    "lines": lambda d, s: edit_join.removed_lines(d), "without lines": lambda d, s: edit_join.deduplicated(d), "near": lambda d, s: order_minhash.near_duplicates(d), "one of each": lambda d, s: order_minhash.deduplicated(d),
    "quality": lambda d, s: cotraining.quality(d, s.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int").withColumn("y", F.lit(1))),
    "leaks": lambda d, s: spaced_seed.contaminated(d, s.createDataFrame([(1, None), (None, "a b"), (2, "the quick brown fox jumps over the lazy dog while the seven wise")], "item_id long, text string")),
    "languages": lambda d, s: langid.identified(d), "known": lambda d, s: langid.known_language(d), "personal": lambda d, s: pii.personal_data(d),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("empty", [True, False])
def test_odd_and_empty_tables(spark, name, empty):
    docs = odd_documents(spark, empty)
    rows = OPERATORS[name](docs, spark).collect()
    if empty:
        assert rows == []
    elif name in ("mix", "near", "quality", "languages", "personal"):
        assert len(rows) == docs.count()
    elif name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 2), (2, 2), (8, 2)}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), ORACLE_SQL[name], small) == []


# 1: mixing


def test_targets_by_water_filling(spark):
    rows = [(c, n) for c, n in zip("abcdefg", [5, 900, 40, 7, 300, 11, 0], strict=True)]
    sized = spark.createDataFrame([*rows, (None, 60)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    sizes = {s: n for s, n in rows} | {None: 60}
    names = [*"abcdefg", None]
    left, full, target = float(sum(sizes.values())), set(), {}
    while True:
        weights = {s: i % 3 + 1 for i, s in enumerate(names) if s not in full}
        over = [s for s, w in weights.items() if left * w / sum(weights.values()) > 3 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        full |= set(over)
        left = sum(sizes.values()) - sum(target[s] for s in full)
    assert got == pytest.approx(target)


def test_mix_is_near_its_targets_and_repeats(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    mixed = mixing.pareto_mix(docs)
    again = mixing.pareto_mix(docs.repartition(7), narrow=True)
    key = lambda df: sorted((r.doc_id, r.copies) for r in df.select("doc_id", "copies").collect())
    assert key(mixed) == key(again)
    for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w"), F.max("copies").alias("c"), F.max("size").alias("m")).collect():
        assert abs(r.w - r.t) <= r.m / 2 + 1 and r.c <= 3
    assert mixing.mixed_documents(docs).count() == sum(c for _, c in key(mixed))


# 2: line hashing


def test_line_hashing_against_a_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, want = {}, set()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id in sorted(texts):
        for n, start, end, digest, words in line_hash_dedup.units(texts[doc_id], "sentence", line_hash_dedup.MIN_WORDS):
            if words >= line_hash_dedup.MIN_WORDS:
                if digest in first:
                    want.add((doc_id, n, start, end, first[digest]))
                first.setdefault(digest, doc_id)
    got = line_hash_dedup.repeated_units(docs).collect()
    assert {(r.doc_id, r.unit, r.start, r.end, r.kept_doc_id) for r in got} == want and len(got) == len(want)
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.end))
    for r in line_hash_dedup.deduplicated(docs).collect():
        t = texts[r.doc_id]
        for a, b in sorted(spans[r.doc_id], reverse=True):
            t = t[:a] + t[b:]
        assert r.text == t and (r.n_chars == len(t) or not spans[r.doc_id])


def test_passage_inside_longer_lines_is_found(spark):
    passage = "One sentence of eight words stands here now. Another sentence of eight words follows it here. "
    docs = spark.createDataFrame([(1, "Alpha beta. " + passage + "Gamma."), (2, "Nothing at all of this is shared by others. Left " + passage + "right.")], "doc_id long, text string")
    assert {(r.doc_id, r.kept_doc_id) for r in line_hash_dedup.repeated_units(docs).collect()} == {(2, 1)}


def test_short_units_are_matched_in_runs(spark):
    run = "He came. He saw. He won a lot."
    docs = spark.createDataFrame([(1, "A first sentence of seven words stands here. " + run), (2, run + " A second sentence of seven words stands here."), (3, "He came. He saw."), (4, "Stop.")], "doc_id long, text string")
    got = lambda n: {(r.doc_id, r.unit, r.start, r.end, r.words) for r in line_hash_dedup.repeated_units(docs, min_words=n).collect()}
    assert got(6) == {(2, 0, 0, 30, 8)}
    assert got(1) == {(2, 0, 0, 8, 2), (2, 1, 9, 16, 2), (2, 2, 17, 30, 4), (3, 0, 0, 8, 2), (3, 1, 9, 16, 2)}


# 3: edit join


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def varied(rng: random.Random, text: str, n: int, letters: str) -> str:
    s = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice(letters))
        elif kind == 1 and len(s) > 1:
            s.pop(i)
        else:
            s[i] = rng.choice(letters)
    return "".join(s)


def test_banded_edit_distance():
    rng = random.Random(5)
    left = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 40))) for _ in range(1500)]
    right = [varied(rng, a, rng.randint(0, 4), "abc") for a in left]
    pairs = [(a, b) for a, b in zip(left, right, strict=True) if len(b) >= 3]
    assert edit_join.within(*map(list, zip(*pairs, strict=True))).tolist() == [edits(a, b) <= 2 for a, b in pairs]


@pytest.mark.parametrize("chunk, wide", [(128, 2048), (3, 4)])
def test_lines_against_all_pairs(spark, monkeypatch, chunk, wide):
    monkeypatch.setattr(edit_join, "CHUNK", chunk)
    monkeypatch.setattr(edit_join, "WIDE", wide)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 70))).strip() + "z" * 10 for _ in range(40)]
    texts = ["\n".join(varied(rng, rng.choice(base), rng.randint(0, 3), "abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    lines = [(d, n, line) for d, t in enumerate(texts) for n, line in edit_join._lines(t)]
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (_, _, a)), (j, (_, _, b)) in combinations(enumerate(lines), 2):
        if a == b or abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, min(len(a), len(b)) // 16):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    want = defaultdict(list)
    for i, (d, n, _) in enumerate(lines):
        if root(i) != i:
            want[d].append(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed for r in edit_join.removed_lines(docs).collect() if r.removed} == dict(want)
    kept = {r.doc_id: r.text for r in edit_join.deduplicated(docs).collect()}
    for d, t in enumerate(texts):
        rest = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in want[d])
        assert kept.get(d, "") == rest or not rest.strip()


def test_short_lines_are_compared_for_equality(spark):
    docs = spark.createDataFrame([(1, "And ornd.\n\nOne"), (2, " And ornd. \n\n}\n}"), (3, "And ornt.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in edit_join.deduplicated(docs).collect()} == {1: "And ornd.\n\nOne", 2: "\n}", 3: "And ornt."}


def test_shorter_lines_are_near_within_fewer_edits(spark):
    docs = spark.createDataFrame([(1, "Are is anwh reenen."), (2, "Are, is anwh reenen."), (3, "Are, is anwh reenen!!"), (4, "Fifteen letters"), (5, "Fifteen letterz")], "doc_id long, text string")
    assert {r.doc_id for r in edit_join.deduplicated(docs).collect()} == {1, 3, 4, 5}


def test_many_near_lines_give_few_links(spark):
    base = "one line of some forty characters or a few more than that"
    lines = sorted({base[:i] + c + base[i + 1 :] for i in range(len(base)) for c in "ABCDEFGHI"})
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, base])], "doc_id long, text string")
    assert len(lines) > 500 and edit_join.near_lines(docs).count() < 2 * len(lines)
    assert [r.doc_id for r in edit_join.deduplicated(docs).collect()] == [0]


def test_far_lines_of_a_group_are_verified_together(monkeypatch):
    rng = random.Random(4)
    base = "".join(map(chr, range(33, 113)))
    # one segment of eight in another order: same characters, far apart but for some neighbours swapped
    lines = sorted({"".join(rng.sample(base[:10], 10)) + base[10:] for _ in range(50)} | {base, base[:4] + base[5] + base[4] + base[6:]})
    calls, band = [], edit_join._band
    monkeypatch.setattr(edit_join, "_band", lambda left, right, most: calls.append(len(left)) or band(left, right, most))
    want = {(i, j) for i, j in combinations(range(len(lines)), 2) if edits(lines[i], lines[j]) <= 2}
    assert want
    rows = pd.DataFrame({"id": range(len(lines)), "line": lines, "own": True, "class": range(len(lines))})
    got = edit_join._crossed(rows)
    assert set(zip(got["a"], got["b"], strict=True)) <= want and len(got) == len(lines) - n_classes(len(lines), want)
    # 51 lines each waited for those before it
    assert sum(calls) > 1000 and len(calls) <= 2
    calls.clear()
    found = edit_join.spanning(np.zeros(len(lines), np.int64), edit_join._Lines(list(range(len(lines))), lines, np.ones(len(lines), bool)))
    assert set(found) <= want and len(found) == len(got)
    assert sum(calls) > 1000 and len(calls) <= 2


def n_classes(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return len(set(label))


def test_small_components_take_no_join_exchanges(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 3)], "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()

    def run():
        known = lambda: {(x := found.apply(i)).executionId(): x.physicalPlanDescription() for found in [store.executionsList()] for i in range(found.size())}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = max(known(), default=-1)
        rows = {r.node: r.label for r in common.components(edges).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return rows, sum("SortMergeJoin" in text for i, text in known().items() if i > before)

    small = run()
    monkeypatch.setattr(common, "SENT_EDGES", 0)
    large = run()
    assert small[0] == large[0] and small[0][100] == 1 and small[0][8] == 8
    assert small[1] == 0 < large[1]


def test_lines_of_a_repeated_row_count_once(spark):
    docs = spark.createDataFrame([(1, "a line"), (1, "a line"), (1, "another"), (2, "a line")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.removed) for r in edit_join.removed_lines(docs).collect()) == [(1, 1, []), (1, 1, []), (2, 1, [0])]


# 4: Order MinHash


def test_banded_alignment_is_the_longest_common_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert order_minhash.banded_matches(a, b, 100) == table[-1, -1]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0].upper() + "!", texts[0]]
    hashes = order_minhash.WordHashes()
    sets = [hashes(order_minhash._WORD.findall(t.lower())) for t in texts]
    parent = list(range(len(texts)))

    def root(x, parent):
        while parent[x] != x:
            x = parent[x]
        return x

    # shingles aligned at 0.8 are found for sure, words aligned at 0.8 are all that may be
    certain = [[order_minhash.shingles(x) for x in sets], list(range(len(texts)))]
    for i, j in combinations(range(len(texts)), 2):
        for items, up in ((sets, parent), certain):
            if order_minhash.similar(items[i], items[j]):
                x, y = (root(v, up) for v in (i, j))
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    for i, j in combinations(range(len(texts)), 2):
        assert root(i, certain[1]) != root(j, certain[1]) or got[i] == got[j]
        assert got[i] != got[j] or root(i, parent) == root(j, parent)
    assert all(got[i] == min(j for j in got if got[j] == got[i]) for i in got)
    assert sorted(r.doc_id for r in order_minhash.deduplicated(docs).collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("wide", [400, 100_000])
def test_pools_are_compared_in_chunks(spark, monkeypatch, wide):
    monkeypatch.setattr(order_minhash, "CHUNK_SHINGLES", 400)
    monkeypatch.setattr(order_minhash, "WIDE_SHINGLES", wide)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(2, 98, 4)]
    # as many that are all within the pool, of which each is near one other alone
    half = [" ".join([*base[:60], *(f"{k}x{i}" for i in range(30))]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate([*texts, *half, *(t + f" end{i}" for i, t in enumerate(half))])), "doc_id long, text string")
    want = {i: 0 for i in range(24)} | {24 + i: 24 + i for i in range(12)} | {36 + i: 24 + i for i in range(12)}
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == want


def test_copies_with_changed_words_are_found(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    texts, want = [], []
    for share in (0.02, 0.05, 0.08):
        for _ in range(40):
            base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
            copy = [rng.choice(words) if rng.random() < share else w for w in base]
            table = np.zeros((len(base) + 1, len(copy) + 1), int)
            for i, x in enumerate(base):
                for j, y in enumerate(copy):
                    table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
            m = table[-1, -1]
            if m / (len(base) + len(copy) - m) >= 0.8:
                want.append((share, len(texts)))
            texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    met = [got[i] == got[i + 1] for _, i in want]
    assert len(want) > 100 and np.mean(met) >= 0.9 and np.mean([m for m, (s, _) in zip(met, want, strict=True) if s <= 0.05]) >= 0.97
    assert all(got[i] >= i - 1 for i in got)


def test_one_row_of_each_class_with_shared_and_missing_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a"), "x"), (2, text("b"), "x"), (2, text("a"), "x"), (2, text("c"), "x"), (3, text("b"), "x"), (None, text("c"), "x"), (None, text("d"), "y"), (None, text("d"), "x"), (4, text("e"), "y"), (4, text("e"), "x"), (None, "", "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter([rows[0], rows[1], rows[3], rows[7], rows[9], *rows[10:]])
    for n in (1, 5):
        assert Counter(map(tuple, order_minhash.deduplicated(docs.repartition(n)).collect())) == want


# 5: top-k


def test_top_k_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).round(1)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [9.0] * 6), (204, [3.0] * 5), (205, []), (7, rows[9][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in impact_index.top_k(frame, frame.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    sound = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, v in sound:
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            assert got[q] == [(i, -s) for s, i in scores]
    assert set(got) == {0, 50, 100}


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(0, 0.12, (3000, 64))).astype(np.int64)
    v[:1500] += v[0] // 2
    index = impact_index.ShardIndex(np.arange(3000), v)
    for own, (_, scores) in zip(range(40), index.top(v[:40], np.arange(40), 5), strict=True):
        assert scores.tolist() == sorted((int(v[own] @ w) for i, w in enumerate(v) if i != own), reverse=True)[:5]


def test_index_leaves_postings_out_where_few_impacts_decide():
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (2000, 32))
    v[np.arange(2000), rng.integers(0, 32, 2000)] = rng.integers(200, 250, 2000)
    v[:40, 5] = 240 + np.arange(40)
    index = impact_index.ShardIndex(np.arange(2000), v)
    assert index.postings == np.count_nonzero(v)
    q = np.zeros((1, 32), np.int64)
    q[0, 5] = 256
    (_, scores), = index.top(q, np.array([-1]), 5)
    assert scores.tolist() == sorted((int(q[0] @ w) for w in v), reverse=True)[:5] and index.touched < index.postings / 4


@pytest.mark.parametrize("rows", [0, 3])
def test_top_k_of_small_tables_with_clashing_columns(spark, rows):
    frame = spark.createDataFrame([(50 * i, [float(i), 0.0]) for i in range(rows)], "vec_id long, embedding array<double>")
    frame = frame.withColumns({c: F.lit("x") for c in ("v", "dims", "shard", "block", "batch", "ids", "packed", "q_ids", "score", "query_id")})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in impact_index.top_k(frame, frame, 5).collect())
    assert got == ([(0, 1, 50, 0), (0, 2, 100, 0), (50, 1, 100, 256 * 512), (50, 2, 0, 0), (100, 1, 50, 256 * 512), (100, 2, 0, 0)] if rows else [])


# 6: co-training


def test_quality_scores_separate_held_out_documents(spark, small):
    sf = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.fit(docs, labels, 2000, 1000)
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id", "quality")
    rows = cotraining.scored(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([g > b for g in good for b in bad])
    assert auc > 0.9 and np.mean([r.good for r in rows if r.quality == 1]) > 0.95


def test_exchange_rounds_against_a_plain_loop():
    rng = np.random.default_rng(3)
    y = np.r_[np.ones(20), np.zeros(20), -np.ones(60)].astype(np.int64)
    side = np.where(np.arange(100) % 2, 1.0, -1.0)
    side[:40] = np.where(y[:40] == 1, 1.0, -1.0)
    views = [cotraining.Rows([np.arange(2)] * 100, [np.array([s + n, 1.0]) for s, n in zip(side, rng.normal(0, 0.4, 100), strict=True)], 2) for _ in range(2)]
    held = np.zeros(100, dtype=bool)
    learned, pool = [{i: int(y[i]) for i in range(40)} for _ in range(2)], list(range(40, 100))
    learn = lambda v: cotraining.logistic(views[v].take(np.array(list(learned[v]))), np.array(list(learned[v].values()), dtype=float))
    for _ in range(cotraining.ROUNDS):
        n = len(pool) // 10
        high, picks = round(n * 0.5), []
        for v in (0, 1):
            w, b = learn(v)
            order = sorted(pool, key=lambda i: (views[v].values[i] @ w + b, i))  # noqa: B023
            picks.append({i: 0 for i in order[: n - high]} | {i: 1 for i in order[len(order) - high :]})
        for v in (0, 1):
            for i, label in picks[v].items():
                learned[1 - v].setdefault(i, label)
        pool = [i for i in pool if i not in picks[0] and i not in picks[1]]
    model = cotraining.cotrain(views, y, held)
    for v in (0, 1):
        w, b = learn(v)
        assert np.allclose(model.views[v][0], w) and np.isclose(model.views[v][1], b)


def test_views_share_nothing():
    a, b = ("Some text.", "s", "en", 10), ("Другой text, 7 lines\n" * 7, "s", "en", 10)
    assert (cotraining.meta_features(*a[1:]) == cotraining.meta_features(*b[1:])).all()


def test_a_repeated_id_takes_its_smallest_text(spark):
    docs = spark.createDataFrame([(i, t, "s", "en", 5) for i in range(30) for t in ("b", "a")], DOCS.replace("lang string, source string", "source string, lang string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert cotraining.quality(docs, labels).count() == 60


def test_quality_without_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotraining.quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in cotraining.quality(docs, one).collect()} == {1.0}


# 7: spaced seeds


def test_masks_are_lossless():
    for wrong in combinations(range(spaced_seed.WINDOW), spaced_seed.MOST):
        assert any(not {p + at for p in mask} & set(wrong) for mask in spaced_seed.MASKS for at in range(spaced_seed.WINDOW - mask[-1]))


def test_substitutions_and_the_shuffled_way(spark, monkeypatch):
    words = [f"t{i}" for i in range(40)]
    texts = {1: "x " * 5 + " ".join(words[3:15]) + " y" * 5, 2: " ".join([*words[3:6], "q", *words[7:12], "r", *words[13:15]]), 3: " ".join([*words[3:6], "q", *words[7:9], "s", words[10], "r", *words[12:15]]), 4: " ".join(words[3:14])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    want = {(1, 12), (2, 10)}
    assert {(r.doc_id, r.best) for r in spaced_seed.contaminated(docs, items).collect()} == want
    monkeypatch.setattr(spaced_seed, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.best) for r in spaced_seed.contaminated(docs, items).collect()} == want
    assert sorted(r.doc_id for r in spaced_seed.decontaminated(docs, items).collect()) == [3, 4]


def test_items_below_a_window_are_found_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "They asked: what is the capital, then?"), (2, "what is THE Capital"), (3, "what is a capital"), (4, "the capital"), (5, None), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "What is the capital?"), (2, "Never said before now"), (3, ""), (4, None), (5, "a capital")], "item_id long, text string")
    want = {(1, 1, 4), (2, 1, 4), (3, 5, 2)}
    assert {(r.doc_id, r.item_id, r.best) for r in spaced_seed.contaminated(docs, items).collect()} == want
    assert sorted(r.doc_id for r in spaced_seed.decontaminated(docs, items).collect()) == [4, 5, 6]
    monkeypatch.setattr(spaced_seed, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id, r.best) for r in spaced_seed.contaminated(docs, items).collect()} == want


def test_decontamination_by_row_with_shared_and_missing_ids(spark):
    passage = " ".join(f"t{i}" for i in range(20))
    rows = [(1, passage), (1, "a clean text of this id"), (None, f"left {passage} right"), (None, "a clean text without one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert Counter(map(tuple, spaced_seed.decontaminated(docs, items).collect())) == Counter([rows[1], *rows[3:]])
    assert [(r.doc_id, r.item_id) for r in spaced_seed.contaminated(docs, items).collect()] == [(1, 9)]


# 8: language


def test_held_out_languages(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_are_und(spark):
    got = {r.doc_id: r.lang_pred for r in langid.identified(odd_documents(spark).where("doc_id in (3, 4, 5, 7)")).collect()}
    assert set(got.values()) == {"und"}
    assert [langid.has_letter(t) for t in ("½ ² ³ ¾", "٣ Ⅷ _", "1 a", "字", "")] == [False, False, True, True, False]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    whole = langid.features(LONG)
    monkeypatch.setattr(langid, "_CHUNK", 1000)
    assert np.abs(whole - langid.features(LONG)).max() < 0.02


# 9: personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        s = "".join(rng.choice("a1 2@.+-(9é") for _ in range(rng.randint(0, 24)))
        kept, refused = pii.base_spans(s)
        assert sorted(kept + refused) == sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(s))


@pytest.mark.parametrize("text, want", [
    ("me@x.org, 10.0.0.255 and 10.0.0.256", "email:0:8,ip:10:20"), ("card 4111 1111 1111 1111.", "card:5:24"), ("card 4111 1111 1111 1112", ""), ("call +1 (415) 555-0199 now", "phone:5:22"), ("é a@b.c", "email:2:7"), ("9" * 5000, ""),
])
def test_checked_spans(text, want):
    assert pii.spelled(pii.base_spans(text)[0]) == want


def test_gradients_of_the_tagger():
    t, r = pii.Tagger(size=4, width=3), np.random.default_rng(0)
    x, y = r.integers(0, pii.CLASSES, (3, 7)), r.integers(0, pii.TAGS, (3, 7))
    _, g = t.gradients(x, y)
    for k in g:
        for _ in range(4):
            i = tuple(int(r.integers(0, s)) for s in g[k].shape)
            old = t.p[k][i]
            losses = []
            for e in (1e-5, -1e-5):
                t.p[k][i] = old + e
                losses.append(t.gradients(x, y)[0])
            t.p[k][i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[k][i]) < 1e-5


def test_tagger_learns_and_base_spans_stay():
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["the", "of", f"a{rng.randrange(99)}@m{rng.randrange(9)}.org", "10.2.3.4", "und", "7"]) for _ in range(9))
    texts = [text() for _ in range(500)]
    x = np.concatenate([pii._windowed(t, pii.windows(t)) for t in texts if pii.windows(t)])
    y = np.concatenate([[np.pad(v := pii.labels(len(t), pii.base_spans(t)[0])[a : a + pii.WINDOW], (0, pii.WINDOW - len(v))) for a in pii.windows(t)] for t in texts if pii.windows(t)])
    model = pii.Tagger().train(x, y, rounds=6)
    hit = total = 0
    for t in (text() for _ in range(100)):
        starts = pii.windows(t)
        base = pii.base_spans(t)[0]
        if starts:
            alone = set(pii._runs(pii._stitched(len(t), starts, model.decode(pii._windowed(t, starts)))))
            hit, total = hit + sum(s in alone for s in base), total + len(base)
        assert set(base) <= set(pii.all_spans([t], model)[0][1])
    assert hit / total > 0.8


@pytest.mark.parametrize("text, kind, want", [
    ("call (030) 555-0199 now", "phone", "(030) 555-0199"), ("ring 0171 2345678.", "phone", "0171 2345678"), ("tel 555.123.4567", "phone", "555.123.4567"), ("pay 4111.1111.1111.1111 by", "card", "4111.1111.1111.1111"), ("to john2024@host, and", "email", "john2024@host"),
    ("card 4111 1111 1111 1112 is", "card", ""), ("host 10.0.0.256 is", "ip", ""), ("key 12ab34cd567890ef1 is", "phone", ""),
])
def test_network_spans_over_short_refused_digits_are_added(text, kind, want):
    found = want or text.split(" ", 1)[1].rsplit(" ", 1)[0]
    start, n = text.index(found), pii.KINDS.index(kind)
    tags = {start + i: 1 + 2 * n + (i > 0) for i in range(len(found))}
    base, refused = pii.base_spans(text)
    assert base == [] and pii.added_spans(text, tags, base, refused) == ([(start, n, start + len(want))] if want else [])


def test_trained_network_adds_spans_in_other_spellings():
    rng = random.Random(7)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    fill = lambda: " ".join([*(rng.choice(["the", "of", "und", "Year", "lamp,", "it.", d(2)]) for _ in range(8)), "at"])
    texts = [f"{fill()} +1 ({d(3)}) 555-{d(4)} by {fill()} a{d(2)}@m{d(1)}.example.org or {fill()} 4111111111111111 by {fill()}" for _ in range(300)]
    pairs = sorted({p for t in texts for p in pii.sample_windows(t)})[: pii.TRAIN_WINDOWS]
    x, y = (np.array([np.frombuffer(p[i], np.int8) for p in pairs]) for i in (0, 1))
    model = pii.Tagger().train(x.astype(np.int64), y)
    want = [f"({d(3)}) 555-{d(4)}" for _ in range(50)] + [f"{d(3)}.555.{d(4)}" for _ in range(50)]
    new = [f"{fill()} {w} by {fill()}" for w in want]
    found = [[t[a:b] for a, k, b in spans if pii.KINDS[k] == "phone"] for t, (_, spans) in zip(new, pii.all_spans(new, model), strict=True)]
    assert sum(w in f for w, f in zip(want, found, strict=True)) > 80


def test_training_windows_come_from_the_whole_text():
    text = "12 " + "x" * 80 + " "
    long = text * 200 + "ring +1 (415) 555-0199 " * 80
    assert sum(np.frombuffer(y, np.int8).any() for _, y in pii.sample_windows(long)) > 5


# 10: archive


def test_archive_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1200
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "v", other), (9, "v", other), (7, "w\r\nX: y", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = str(tmp_path / "warc")
    warc_store.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc_store.read_records(spark, path)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc_store.parsed(records).collect())
    assert got == Counter([(1, "revisit", 2, 1200), (2, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "revisit", 2, 1200), (9, "response", None, 1200), (9, "revisit", 9, 1200), (7, "revisit", 9, 1200)])
    for r in warc_store.record_bytes(records).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert len(rest) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4 and rest.endswith(b"\r\n\r\n")


def test_damaged_payload_is_refused(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").select("digest", F.lit(b"abd").alias("payload")).write.parquet(str(tmp_path / "bad"))
    (tmp_path / "warc/payloads").rename(tmp_path / "old")
    (tmp_path / "bad").rename(tmp_path / "warc/payloads")
    with pytest.raises(Exception, match="no sound payload"):
        warc_store.read_records(spark, path).collect()


def test_empty_archive(spark):
    assert warc_store.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
