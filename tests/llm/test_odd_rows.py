"""Rows without an id, with the id of another row, and repeated ones: what the operators return for them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import impact_index, line_hash_dedup, mixing, order_minhash, spaced_seed, warc_store

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("ids", ["null", "equal", "own"])
@pytest.mark.parametrize("texts", ["equal", "own"])
def test_mix_takes_part_of_a_tie(spark, ids, texts):
    a = [({"null": None, "equal": 7, "own": i}[ids], " ".join(["word"] * 9 + [f"w{i}" if texts == "own" else "w"]), "a") for i in range(1000)]
    b = [(5000 + i, "one two three four five", "b") for i in range(400)]
    mixed = mixing.pareto_mix(spark.createDataFrame(a + b, DOCS).repartition(5))
    by = {r.source: r for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w"), F.max("copies").alias("c"), F.count("*").alias("n"), F.max("size").alias("m")).collect()}
    assert all(abs(r.w - r.t) <= r.m / 2 for r in by.values()) and {k: r.n for k, r in by.items()} == {"a": 1000, "b": 400}
    assert mixing.mixed_documents(spark.createDataFrame(a + b, DOCS)).count() == mixed.agg(F.sum("copies")).first()[0]


def test_repeats_between_rows_without_an_id_or_with_one_id(spark):
    shared = "This whole sentence of ten words stands in several texts."
    rows = [(None, f"{shared} Alpha."), (None, f"{shared} Beta."), (5, "Gamma one. These eight words are in both of them."), (5, "Delta one. These eight words are in both of them."), (9, "Only here is this sentence found once."), (9, "Only here is this sentence found once.")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], DOCS)
    got = line_hash_dedup.repeated_units(docs).collect()
    assert Counter((r.doc_id, r.kept_doc_id, r.words) for r in got) == {(None, None, 10): 1, (5, 5, 8): 1}
    left = sorted(r.text for r in line_hash_dedup.deduplicated(docs).collect())
    assert sum(shared in t for t in left) == 1 and sum("These eight words" in t for t in left) == 1 and left.count("Only here is this sentence found once.") == 2
    docs = spark.createDataFrame([(3, shared, "a"), (None, shared, "a"), (None, shared, "a")], DOCS)
    assert Counter((r.doc_id, r.kept_doc_id) for r in line_hash_dedup.repeated_units(docs).collect()) == {(None, 3): 2}


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(50, [1.0] * 8), (50, [1.0] * 8), (50, [-1.0] * 8), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = lambda e: np.floor(256 * np.array(e, np.float32).astype(np.float64)).astype(np.int64)
    want = Counter()
    for q in ([1.0] * 8, [-1.0] * 8):
        best = sorted((-int(whole(e) @ whole(q)), i) for i, e in rows if i != 50)[:5]
        want.update((50, k + 1, i, -s) for k, (s, i) in enumerate(best))
    got = impact_index.top_k(frame, frame.where("vec_id = 50"), 5)
    assert Counter(tuple(r) for r in got.collect()) == want and got.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("words", [12, 14, 20, 40, 62, 80, 200, 600])
@pytest.mark.parametrize("share", [0.02, 0.05, 0.08, 0.1, 0.11])
def test_similar_pairs_share_a_sketch(words, share):
    """Recall of the candidate search in each cell of length and changed words, over pairs that are similar."""
    rng = np.random.default_rng(words + int(1000 * share))
    met = []
    for _ in range(400):
        n = int(rng.integers(words * 9 // 10, words * 11 // 10 + 1))
        a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        b = np.where(rng.random(n) < share, rng.integers(1, 1 << 62, n, dtype=np.uint64), a)
        if (a != b).any() and order_minhash.similar(a, b):
            x, y = order_minhash.sketch(order_minhash.shingles(a)), order_minhash.sketch(order_minhash.shingles(b))
            met.append(bool(np.isin(x, y).any()))
        if len(met) == 150:
            break
    assert len(met) > 20 and np.mean(met) >= 0.9


def test_one_repeated_token_gives_one_row_of_diagonals(spark):
    """A word over and over meets an item along many diagonals, all of them in one row, and the result is a plain loop's."""
    texts = {1: "a " * 800, 2: "b " * 30 + "a " * 11 + "b " * 30, 3: "c d e " * 40, 4: "a " * 5 + "b " + "a " * 6, 5: "a " * 10 + "x y " + "a " * 3}
    tests = {1: "a " * 100, 2: "c d e " * 6, 3: "a " * 12}
    got = spaced_seed.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(tests.items()), "item_id long, text string"))
    want = {}
    for d, text in texts.items():
        for i, item in tests.items():
            a, b = text.split(), item.split()
            for shift in range(-len(b), len(a)):
                same = [int(b[j] == a[j + shift]) for j in range(max(0, -shift), min(len(b), len(a) - shift))]
                best = max((sum(same[k : k + 12]) for k in range(len(same) - 11)), default=0)
                if best >= 10:
                    old = want.get((d, i), (0, 0))
                    want[d, i] = (max(old[0], best), max(old[1], sum(same)))
    assert {(r.doc_id, r.item_id): (r.best, r.equal) for r in got.collect()} == want and (1, 1) in want and len(want) >= 6


def test_repeated_rows_of_the_largest_page(spark, monkeypatch):
    """One row of the largest id is the response, by url, however many there are; ids may be missing throughout."""
    monkeypatch.setattr(warc_store, "CHUNK", 7)
    one, two, three = "a" * 1000, "b" * 1000, "c" * 999
    rows = [(None, None, one)] * 50 + [(None, "u", one)] * 3 + [(8, "x", two)] * 21 + [(8, "w", two)] * 15 + [(2, "w", two)] * 4 + [(8, "x", three)] * 3
    got = warc_store.record_types(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    told = Counter((r.page_id, r.url, r.bytes, r.record_type, r.refers_to) for r in got.collect())
    assert told == {
        (None, None, 1000, "response", None): 1, (None, None, 1000, "revisit", None): 49, (None, "u", 1000, "revisit", None): 3,
        (8, "w", 1000, "response", None): 1, (8, "w", 1000, "revisit", 8): 14, (8, "x", 1000, "revisit", 8): 21, (2, "w", 1000, "revisit", 8): 4, (8, "x", 999, "response", None): 3,
    }
    heads = warc_store.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter(r.record_type for r in heads.collect()) == {"response": 5, "revisit": 91}
