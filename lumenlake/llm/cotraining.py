"""Quality classification by co-training a text view and a page-metadata view.

The text view is a logistic regression over hashed words and the shape of the text (line lengths and character
shares); the metadata view is one over what the table says of the page without its text: source, language and
recorded length.  Both start from the labelled
documents.  In each round either view labels the documents of an unlabelled pool of which it is surest, in the
labels' proportion, for the other view to learn from.  Each view is then calibrated on labelled documents
that neither learned from, the calibrated log-odds are combined by a logistic regression on them, and all documents are scored.

The models are fitted on bounded samples (LABELLED and POOL ids, chosen by hash, of each its smallest text); every
document is scored over its whole text.

Defined cases: a null text is empty, and null metadata is a value of its own; labels other than 0 and 1 and
labels without a document are ignored; the smallest of several labels of a document counts; with no labels or only one kind of them,
the score is the share of quality documents among the labels, 0.5 if there are none; repeated rows are scored alike;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, POOL, ROUNDS, ADDED = 3000, 3000, 4, 0.1
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 1 << 14, 64, 16
_WORD = re.compile(r"\S+")
SHAPES, LENGTH_BUCKETS = 8, 16
TEXT, META = WORD_BUCKETS + SHAPES, SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BUCKETS


def word_features(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's words and the square roots of their counts, of unit length; behind them its shape."""
    shape, places = shape_features(text), np.arange(WORD_BUCKETS, TEXT, dtype=np.int32)
    words = _WORD.findall(text.lower())
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    if not words:
        return places, shape
    at, n = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
    x = np.sqrt(n)
    return np.r_[at.astype(np.int32), places], np.r_[(x / np.linalg.norm(x)).astype(np.float32), shape]


def shape_features(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = max(len(c), 1)
    blanks, lines = int(np.isin(c, (9, 10, 32)).sum()), int((c == 10).sum()) + 1
    digits, upper = ((c >= 48) & (c <= 57)).sum() / n, ((c >= 65) & (c <= 90)).sum() / n
    signs = ((c > 32) & (c < 127) & ~((c >= 48) & (c <= 57)) & ~((c >= 65) & (c <= 90)) & ~((c >= 97) & (c <= 122))).sum() / n
    shape = np.log1p(lines) / 5, np.log1p(n / lines) / 8, np.log1p(n / (blanks + 1)) / 3, min(10 * digits, 3), min(10 * upper, 3), min(10 * signs, 5), blanks / n, (c[1:] == c[:-1]).mean() if len(c) > 1 else 0
    return np.array(shape, dtype=np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One place each for source, language and the binary order of the recorded length; the first place of each is null's."""
    out = np.zeros(META, dtype=np.float32)
    out[zlib.crc32(source.encode()) % (SOURCE_BUCKETS - 1) + 1 if source is not None else 0] = 1
    out[SOURCE_BUCKETS + (zlib.crc32(lang.encode()) % (LANG_BUCKETS - 1) + 1 if lang is not None else 0)] = 1
    out[SOURCE_BUCKETS + LANG_BUCKETS + (min(1 + int(max(n_chars, 0)).bit_length(), LENGTH_BUCKETS - 1) if n_chars is not None else 0)] = 1
    return out


class Rows:
    """Sparse rows: for each its columns and values."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int) -> None:
        self.width, self.n = width, len(columns)
        self.columns, self.values = columns, values

    def take(self, which: np.ndarray) -> Rows:
        return Rows([self.columns[i] for i in which], [self.values[i] for i in which], self.width)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, self.columns), np.int64, self.n)
        empty = np.zeros(0)
        return np.repeat(np.arange(self.n), size), np.concatenate([empty.astype(np.int64), *self.columns]).astype(np.int64), np.concatenate([empty, *self.values])

    def dot(self, w: np.ndarray) -> np.ndarray:
        row, column, value = self.flat()
        return np.bincount(row, value * w[column], self.n)


def logistic(x: Rows, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression, by Adam on all rows."""
    row, column, value = x.flat()
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], x.n) + w[-1], -30, 30)))
        r = (p - y) / max(x.n, 1)
        g = np.r_[np.bincount(column, value * r[row], x.width) + penalty * w[:-1], r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds; targets are drawn in from 0 and 1 as is usual for few rows."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    (a,), b = logistic(Rows([np.zeros(1, np.int64)] * len(y), [np.array([m]) for m in margin], 1), np.where(y > 0, high, low), 1e-4, 300)
    return float(a), b


@dataclass
class Model:
    prior: float = 0.5
    views: list[tuple[np.ndarray, float]] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def score(self, rows: list[Rows], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of quality by text, by metadata and by both."""
        if not self.views:
            return (np.full(n, self.prior),) * 3
        odds = [a * (x.dot(w) + b0) + b for x, (w, b0), (a, b) in zip(rows, self.views, self.scale, strict=True)]
        both = self.weights[0] * odds[0] + self.weights[1] * odds[1] + self.weights[2]
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, both))


def cotrain(rows: list[Rows], y: np.ndarray, held: np.ndarray) -> Model:
    """y: 1, 0, or -1 for the pool; held: labelled rows kept for calibration."""
    known = np.flatnonzero((y >= 0) & ~held)
    if not len(known) or len(set(y[known])) < 2:
        seen = y[y >= 0]
        return Model(float(seen.mean()) if len(seen) else 0.5)
    prior = float(y[known].mean())
    learned = [dict(zip(known.tolist(), y[known].tolist(), strict=True)) for _ in rows]
    pool = np.flatnonzero(y < 0)
    fit = lambda v: logistic(rows[v].take(np.array(list(learned[v]))), np.array(list(learned[v].values()), dtype=np.float64))
    for _ in range(ROUNDS):
        views = [fit(v) for v in (0, 1)]
        n = int(ADDED * len(pool))
        high, low = round(n * prior), n - round(n * prior)
        gone: set[int] = set()
        for v, (w, b) in enumerate(views):
            order = pool[np.argsort(rows[v].take(pool).dot(w) + b, kind="stable")]
            sure = {int(i): 0 for i in order[:low]} | {int(i): 1 for i in order[len(order) - high :]}
            for i, label in sure.items():
                learned[1 - v].setdefault(i, label)
            gone |= set(sure)
        pool = np.array([i for i in pool.tolist() if i not in gone], dtype=np.int64)
    views = [fit(v) for v in (0, 1)]
    check = np.flatnonzero((y >= 0) & held)
    if len(check) < 20 or len(set(y[check])) < 2:
        check = known
    margins = [rows[v].take(check).dot(w) + b for v, (w, b) in enumerate(views)]
    truth = y[check].astype(np.float64)
    scale = [platt(m, truth) for m in margins]
    odds = [a * m + b for m, (a, b) in zip(margins, scale, strict=True)]
    w, b = logistic(Rows([np.arange(2)] * len(truth), list(np.stack(odds, axis=1)), 2), truth, 1e-3, 300)
    return Model(prior, views, scale, (float(w[0]), float(w[1]), b))


def _featured(batch: pa.RecordBatch, known: dict[str, int]) -> list[Rows]:
    texts = [t or "" for t in batch["text"].to_pylist()]
    words = [word_features(t, known) for t in texts]
    meta = [meta_features(*r) for r in zip(*(batch[c].to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
    return [Rows([a for a, _ in words], [b for _, b in words], TEXT), Rows([np.arange(META)] * len(meta), meta, META)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        words, meta = _featured(batch, known)
        pack = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pack(words.columns), pack(words.values), pack(meta.values)], names=["doc_id", "y", "at", "x", "meta"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on bounded samples of the labelled and of the other documents."""
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    said = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    rest = docs.where("doc_id is not null").select("doc_id").join(said.select("doc_id"), "doc_id", "left_anti").distinct()
    chosen = by_hash(said, labelled).unionByName(by_hash(rest, pool).withColumn("y", F.lit(-1)))
    # at most labelled + pool ids
    wanted = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(chosen), "doc_id")
    one = wanted.groupBy("doc_id", "y").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row")).select("doc_id", "y", "row.*")
    got = one.mapInArrow(_sampled, "doc_id long, y int, at binary, x binary, meta binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["meta"])))
    rows = [Rows([np.frombuffer(r["at"], np.int32) for r in got], [np.frombuffer(r["x"], np.float32) for r in got], TEXT), Rows([np.arange(META)] * len(got), [np.frombuffer(r["meta"], np.float32) for r in got], META)]
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got], dtype=bool)
    return cotrain(rows, np.array([r["y"] for r in got], dtype=np.int64), held)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_score, meta_score, score and whether the document is of quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = model.score(_featured(part, known), part.num_rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, scores), pa.array(scores[2] >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "good"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, good boolean")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
