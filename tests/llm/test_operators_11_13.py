"""Whitening, grammar runs and the backoff automaton against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import backoff_automaton, grammar_runs, whitening
from lumenlake.llm.queries import QUERIES

CLASH = ("key", "n", "component", "deviation", "whitened", "start", "length", "period", "block", "shard", "score", "held", "held_out", "docs", "tokens")
VECTORS = "vec_id long, embedding array<float>, label int"


# 11: whitening


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def test_whitening_against_plain_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64) for r in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(np.float64), bias=True))
    got = QUERIES["op11_whitening"](spark, small).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-12
    signs = {}
    for r in got:
        e, u = values[-r.component], vectors[:, -r.component]
        assert r.deviation == int(((n * x[r.vec_id] - total) ** 2).sum()) and r.explained == pytest.approx(e / values.sum(), rel=1e-9)
        want = (x[r.vec_id] - total / n) @ u / math.sqrt(e)
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(round(r.whitened / want, 9))
    assert {c: len(s) for c, s in signs.items()} == dict.fromkeys(range(1, 5), 1) and all(s <= {1.0, -1.0} for s in signs.values())


def test_covariance_is_the_exact_fraction(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-50, 50) / 256 + 1000, rng.random(), rng.randrange(3) / 256]) for i in range(300)]
    frame, dims = whitening.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fit = whitening.distinct_vectors(frame.repartition(5), dims)
    n, sums, matrix = whitening.covariance(fit, dims)
    x = sorted({tuple(math.floor(256 * c) for c in e) for _, e in rows})
    assert n == len(x) and sums == [sum(c) for c in zip(*x, strict=True)]
    assert np.array_equal(matrix.astype(np.float64), exact_covariance(x))


@pytest.mark.parametrize("size", [1.0, 1e-40, 1e30])
@pytest.mark.parametrize("spectrum", ["spread", "clusters", "equal", "deficient"])
def test_refined_eigenvectors(spectrum, size):
    rng = np.random.default_rng(5)
    d = 24
    values = {"spread": np.arange(1, d + 1.0), "clusters": np.r_[1 + 1e-9 * np.arange(8), 2 + 1e-11 * np.arange(8), 3.0 + np.arange(8)], "equal": np.r_[np.ones(12), np.full(12, 2.0)], "deficient": np.r_[np.zeros(10), np.arange(1, 15.0)]}[spectrum]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    a = q @ np.diag(values.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2 * np.longdouble(size)
    value, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 and np.abs(a @ x - x * value).max() < 1e-17 * d * size
    assert np.abs(value / size - np.sort(values)[::-1]).max() < 1e-16 and (np.diff(value) <= 1e-17 * size).all()
    if spectrum in ("spread", "clusters"):
        # each vector is the one that the matrix was made of, to double precision, though float32 cannot tell clusters apart
        meant = q[:, np.argsort(-values)]
        near = np.abs((x * meant).sum(axis=0))
        assert np.abs(near - 1).max() < (1e-15 if spectrum == "spread" else 1e-12)


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2], 1), (1, [0.1, 0.2], 1), (None, [0.5, -0.2], None), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0], 1), (9, [-0.0, 0.7], 2)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in CLASH})
    got = whitening.whitened(frame).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter({(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (9, 1): 1, (9, 2): 1}) and {r.n for r in got} == {3}
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1) and max(r.identity_error for r in got) < 1e-12
    assert whitening.whitened(frame.limit(0)).collect() == []
    same = whitening.whitened(spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(4)], VECTORS)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)} and len(same) == 8
    flat = whitening.whitened(spark.createDataFrame([(i, [i / 4, 0.5, -i / 2], 0) for i in range(4)], VECTORS)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True}
    large = whitening.whitened(spark.createDataFrame([(i, [float(2**i), 1.0]) for i in range(40, 60)], "vec_id long, embedding array<double>")).collect()
    assert {r.n for r in large} == {16} or len(large) == 40


# 12: runs


def plain_runs(words):
    """Every maximal stretch of each period, by its definition; a stretch counts for its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts():
    rng = random.Random(11)
    yield from ("", "a", "aaaaa", "aaaaaa", "ababababab", "abcabcabcabc", "abcabcabcab", "aabaabaabaabaab" * 3, fibonacci(300), "a" * 500, "ab" * 200 + "b" + "ab" * 200, ("a" * 7 + "b") * 9)
    for k in (1, 2, 3, 6):
        for n in (7, 12, 30, 64, 129, 400):
            yield "".join(rng.choice("abcdef"[:k]) for _ in range(n))
    for _ in range(150):
        out = ""
        for _ in range(rng.randrange(1, 7)):
            part = "".join(rng.choice("abcdefghij"[: rng.randrange(1, 11)]) for _ in range(rng.randrange(1, 14)))
            out += part * rng.randrange(1, 9) + part[: rng.randrange(len(part))]
        yield out


def test_runs_against_their_definition():
    for text in texts():
        assert grammar_runs.runs(np.array([ord(c) for c in text], np.int64)) == plain_runs(text), text


def test_windows_lose_no_run_and_compress_what_repeats():
    rng = random.Random(2)
    words = [rng.randrange(5000) for _ in range(3000)]
    words[700:1900] = (words[700:760] * 20)[:1200]
    found = grammar_runs.windows(np.array(words))
    assert len(found) >= 1 and any(a <= 700 and b >= 1900 for a, b in found) and sum(b - a for a, b in found) < 2000
    grammar = grammar_runs.Grammar(np.array([1, 2, 3, 4] * 64))
    assert grammar.top == 2 and [len(s) for *_, s in grammar.symbols] == [64, 64, 64, 32, 16, 8, 4, 2, 1]


def test_symbols_stand_where_they_say():
    for text in texts():
        ids = np.array([ord(c) for c in text], np.int64)
        for length, middle, starts in grammar_runs.Grammar(ids).symbols:
            assert 0 < middle < length and len({ids[s : s + length].tobytes() for s in starts}) == 1 and starts.max() + length <= len(ids)


def test_long_texts_stay_cheap():
    rng = random.Random(4)
    # a Fibonacci word has no run of four periods
    for text, most in (("a" * 200_000, 1), (fibonacci(60_000), 0), ("".join(rng.choice("ab") for _ in range(4000)), 4000)):
        assert min(most, 1) <= len(grammar_runs.runs(np.frombuffer(text.encode(), np.uint8).astype(np.int64))) <= most


def test_document_rows_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 160)))) for i in range(60)]
    rows += [(None, "x " * 40), (7, "x y " * 20), (7, "x y " * 20), (90, None), (91, ""), (92, " \n\t "), (93, "A a " * 30 + " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    want = Counter()
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(((-m, s, q) for s, m, q in found), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc_id, len(found), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert Counter(tuple(r) for r in grammar_runs.document_runs(frame, plant=True).collect()) == want
    assert grammar_runs.document_runs(frame.limit(0)).collect() == []


# 13: language model


def plain_scores(rows, order, mu):
    tokens = {i: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for i, (_, t) in enumerate(rows)}
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(tuple(t[k - n + 1 : k + 1]) for i, t in tokens.items() if not held[i] for n in range(1, order + 1) for k in range(n - 1, len(t)))
    ones = {k: c for k, c in counts.items() if len(k) == 1 and k != ("<s>",)}
    total = sum(ones.values())

    def p(gram):
        if len(gram) == 1:
            return (ones.get(gram, 0) + 0.1) / (total + 0.1 * (len(ones) + 1))
        return (counts[gram] + mu * p(gram[1:])) / (counts[gram[:-1]] + mu)

    for i, t in tokens.items():
        score = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k + 1]))) for k in range(1, len(t)))
        yield rows[i][0], held[i], len(t) - 1, sum((w,) in ones for w in t[1:]), total, sum(math.log10(p((w,))) for w in t[1:]), score


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_plain_counts(spark, order, monkeypatch):
    rng = random.Random(order)
    vocabulary = ["Ab", "aB", "c", "É", "é", "d.", "e", "x1"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    rows += [(None, "ab c"), (5, None), (5, ""), (6, " \t\x0b"), (6, " \t\x0b"), (11, "never seen words"), (20, "long " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    monkeypatch.setattr(backoff_automaton, "BLOCK", 900)
    monkeypatch.setattr(backoff_automaton, "SHARD", 500)
    got = backoff_automaton.scored(frame, order=order, mu=7.0).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain_scores(rows, order, 7.0), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_of_a_state_sum_to_one():
    words = np.array([3, 9, 27, 81], np.uint64)
    row = {"docs": [1], "held": [False], "lengths": [9], "words": words.tobytes(), "tokens": backoff_automaton.zstandard.ZstdCompressor().compress(np.array([2, 3, 2, 2, 3, 3, 2, 3, 0], "<u4").tobytes())}
    block = backoff_automaton.Block(row, 3)
    for g in block.grams.values():
        g["total"] = g["count"]
    automaton = backoff_automaton.Automaton(block.grams, 9, 3, 5.0)
    unknown = 0.1 / (9 + 0.1 * 4)
    # all states but those whose history ends the text, which nothing follows
    ended = [1 + int(e) if n == 1 else 1 + automaton.codes + int(e) for n in (1, 2) for e in np.flatnonzero(block.grams[n]["last"] == 0)]
    for state in (s for s in range(len(automaton.fails)) if s not in ended):
        total, share, at = 0.0, 1.0, state
        seen = set()
        while True:
            total += sum(share * 10 ** w for k, (w, _) in automaton.arcs.items() if k // automaton.codes == at and k % automaton.codes not in seen | {1})
            seen |= {k % automaton.codes for k in automaton.arcs if k // automaton.codes == at}
            if at == 0:
                break
            share *= 10 ** automaton.penalties[at]
            at = automaton.fails[at]
        assert total + share * unknown == pytest.approx(1)


def test_empty_and_untrained_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert backoff_automaton.scored(empty).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = backoff_automaton.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_the_model_is_better_than_single_words(spark, small):
    got = backoff_automaton.scored(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(got) == 2 and all(r.s > r.b for r in got)
