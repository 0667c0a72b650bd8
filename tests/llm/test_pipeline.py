"""The pipeline's stages against plain loops that share no code with them, each on its own input."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
#: Extra columns whose names the operators use themselves.
CLASH = ("size", "copies", "line", "digest", "class", "n", "pool", "words", "tokens", "_doc", "_key", "_slot")


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def classes_of(n: int, linked) -> list[int]:
    """Smallest member of each one's class, where linked(i, j) tells whether i < j belong together."""
    label = list(range(n))
    for j in range(n):
        for i in range(j):
            if label[i] != label[j] and linked(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def place(r) -> tuple:
    return (r.doc_id is None, r.doc_id or 0)


def without_lines(rows) -> Counter:
    """What is left of (doc_id, text) when of near lines the earliest stays; rows of equal id and text are one document."""
    lines = [(place(r), n, x.strip()) for r in {(place(r), r.text): r for r in rows}.values() for n, x in enumerate((r.text or "").split("\n")) if x.strip()]
    texts = sorted({x for *_, x in lines})
    counts = [Counter(x) for x in texts]

    def near(i, j):
        most = min(2, min(len(texts[i]), len(texts[j])) // 16)
        return most and abs(len(texts[i]) - len(texts[j])) <= most and sum(((counts[i] - counts[j]) + (counts[j] - counts[i])).values()) <= 2 * most and edits(texts[i], texts[j]) <= most

    named = dict(zip(texts, classes_of(len(texts), near), strict=True))
    first: dict = {}
    for at, n, x in lines:
        first[named[x]] = min(first.get(named[x], (at, n)), (at, n))
    kept = {(at, n) for at, n, x in lines if first[named[x]] == (at, n)}
    out = Counter()
    for r in rows:
        old = (r.text or "").split("\n")
        new = [x for n, x in enumerate(old) if not x.strip() or (place(r), n) in kept]
        if new == old or any(x.strip() for x in new):
            out[r.doc_id, r.text if new == old else "\n".join(new)] += 1
    return out


def common_order(a: list, b: list) -> int:
    row = np.zeros(len(b) + 1, int)
    same = {x: np.array([x == y for y in b]) for x in set(a)}
    for x in a:
        step = np.r_[0, np.where(same[x], row[:-1] + 1, row[1:])]
        row = np.maximum.accumulate(step)
    return int(row[-1])


def passages(text: str, items: list[str]) -> bool:
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    doc = words(text)
    for item in map(words, items):
        n, wrong = (12, 2) if len(item) >= 12 else (len(item), 0)
        if sum((Counter(doc) & Counter(item)).values()) < n - wrong:
            continue
        for at in range(len(doc) - n + 1) if n else ():
            if any(sum(x != y for x, y in zip(doc[at : at + n], item[i : i + n], strict=True)) <= wrong for i in range(len(item) - n + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def docs(spark, small):
    some = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40 or doc_id between 150 and 170")
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(10_001, None, "en", "src1", 0), (10_002, "12 34 ½", "en", "src1", 5), (None, "A line of its own without an id.\nAnd a second one of them.", None, None, None), (None, None, None, None, None), (10_003, "", "en", "a", 0),
            (10_004, "Two rows with the same id, this is one of them.", "en", "a", 1), (10_004, "Quite another text that has the same number as the one above.", "en", "a", 1), (10_005, "Twice the same row.", "en", "a", 1), (10_005, "Twice the same row.", "en", "a", 1),
            (10_006, f"before it {item} behind it", "en", "a", 1), (None, f"without an id {item}", "en", "a", 1)]
    both = some.unionByName(spark.createDataFrame(rows, some.schema))
    return both.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def stages(spark, small, docs):
    from lumenlake.llm.common import write_table

    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = write_table(stage(spark, at, small), "test")
        assert name == "mixture" or after.columns == docs.columns
        seen[name] = (at.collect(), after.collect())
        at = after
    return seen


def test_language(stages):
    before, after = stages["language"]
    letters = lambda r: any(unicodedata.category(x)[0] == "L" for x in r.text or "")
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before if letters(r))


def test_lines(stages):
    before, after = stages["lines"]
    assert Counter((r.doc_id, r.text) for r in after) == without_lines(before)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    words = [re.findall(r"[^\W_]+", (r.text or "").lower()) for r in before]
    bags = [Counter(w) for w in words]

    def similar(i, j, least=0.8):
        m = sum((bags[i] & bags[j]).values())
        total = len(words[i]) + len(words[j])
        return total and m >= least * (total - m) and (m := common_order(words[i], words[j])) >= least * (total - m)

    label = classes_of(len(before), similar)
    kept = Counter((r.doc_id, r.text) for r in after)
    by = defaultdict(list)
    for r, c, w in zip(before, label, words, strict=True):
        by[c if w else (r.doc_id, "no words")].append(r)
    for rows in by.values():
        held = {(r.doc_id, r.text) for r in rows} & set(kept)
        assert held and (min(map(place, rows)) in {(d is None, d or 0) for d, _ in held})
        assert all(kept[h] == 1 or h[0] is None for h in held)
    # copies of the same words never stay together
    seen = Counter(tuple(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in after)
    assert all(n == 1 for w, n in seen.items() if w)


def test_decontamination(stages, spark, small):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before if not passages(r.text, items))


def test_mixture(stages):
    before, after = stages["mixture"]
    words = lambda rows: sum(len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in rows)
    longest = max(len((r.text or "").split()) for r in before)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert abs(words(after) - words(before)) <= longest * len({r.source for r in before})
    rows = Counter((r.doc_id, r.text) for r in before)
    assert all(n <= 3 * rows[k] for k, n in Counter((r.doc_id, r.text) for r in after).items())


def test_empty_documents(spark, small, docs):
    at = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, small)
    assert at.count() == 0


def test_run_is_the_stages_in_turn(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns[-1] == "copy" and out.where(F.col("copy") > 3).count() == 0
