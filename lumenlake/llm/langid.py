"""Language identification in two steps: family first, then one language of it.

A text becomes the square roots of its hashed character bigram and trigram counts, of unit length.
One-versus-one linear support vector machines (squared hinge, dual coordinate descent) choose the
family, and others, trained within each family, choose the language.  Votes of the pairs, as
logistic functions of their margins, give the choice and its score.

The machines are fitted on a sample of about PER_LANGUAGE documents of each label, SAMPLE at most in
all on average, and of more than SAMPLE labels the most frequent are learned; every document is scored, over its whole text.

Defined cases: a null text and one without a letter are `und` with score 0; without any label every text is `und`; with
one label it is that, with score 1; rows with a null doc_id are never learned from and not held out;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The family of each language; a label that is missing here is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}
PER_LANGUAGE, SAMPLE, BUCKETS = 600, 4800, 4096
#: Letters and some numerals, which `has_letter` leaves out.
_LETTER = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 20


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category, as \\p{L} has it."""
    return any(any(map(str.isalpha, m.group())) for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Of unit length; long texts are counted a piece at a time."""
    counts = np.zeros(BUCKETS)
    for at in range(0, max(len(text), 1), _CHUNK):
        c = np.frombuffer(f" {text[max(0, at - 2) : at + _CHUNK].lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        two = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
        three = two[:-1] * np.uint64(0xC2B2AE3D) + c[2:] * np.uint64(0x27D4EB2F)
        for h in (two, three):
            counts += np.bincount(((h >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of the L2-regularised squared-hinge machine, the last one the bias."""
    w, bias, alpha, soft = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), 1 / (2 * cost)
    diagonal, random = np.einsum("ij,ij->i", x, x) + 1 + soft, np.random.default_rng(7)
    for _ in range(rounds):
        for i in random.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (w @ x[i] + bias) - 1 + soft * alpha[i]) / diagonal[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                bias += step * y[i]
    return np.r_[w, bias]


class Pairs:
    """One-versus-one machines over some classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.w = np.array([linear_svm(x[m], np.where(labels[m] == self.classes[a], 1.0, -1.0)) for a, b in self.pairs for m in [np.isin(labels, [self.classes[a], self.classes[b]])]])

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each class in the votes of its pairs."""
        if not self.pairs:
            return np.ones((len(x), len(self.classes)))
        out = np.zeros((len(x), len(self.classes)))
        for (a, b), w in zip(self.pairs, self.w, strict=True):
            vote = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -60, 60)))
            out[:, a] += vote
            out[:, b] += 1 - vote
        return out / len(self.classes) * (2 / max(len(self.classes) - 1, 1))


class Hierarchy:
    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        families = np.array([family_of(v) for v in labels], dtype=object)
        self.family = Pairs(x, families)
        self.within = {f: Pairs(x[families == f], labels[families == f]) for f in self.family.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.family.shares(x)
        best, out, score = first.argmax(axis=1), np.empty(len(x), dtype=object), np.zeros(len(x))
        for f, name in enumerate(self.family.classes):
            if (at := np.flatnonzero(best == f)).size:
                second = self.within[name].shares(x[at])
                k = second.argmax(axis=1)
                out[at] = np.array(self.within[name].classes, dtype=object)[k]
                score[at] = np.clip(first[at, f] * second[np.arange(len(at)), k], 0, 1)
        return out, score


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([features(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Hierarchy | None:
    """Fit on labelled documents (text, lang, doc_id), a bounded sample of them chosen by hash."""
    rows = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    each = min(per_language, -(-sample // len(sizes)))
    # at most `sample` rows
    shares = docs.sparkSession.createDataFrame([(v, min(1 << 20, int(each / n * (1 << 20)) + 1)) for v, n in sizes.items()], "lang string, _share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("_share")).select("text", "lang")
    got = chosen.mapInArrow(_embed, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Hierarchy(np.array([np.frombuffer(r["x"], np.float32) for r in got]), np.array([r["lang"] for r in got], dtype=object))


def _named(model: Hierarchy | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    named = np.array([model is not None and t is not None and has_letter(t) for t in texts], dtype=bool)
    lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if named.any():
        lang[named], score[named] = model.predict(np.array([features(texts[i]) for i in np.flatnonzero(named)]))
    return lang, score


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _score(model: Hierarchy | None, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            lang, score = _named(model, part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(lang, pa.string()), pa.array(score)], names=[*keys, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Hierarchy | None, keys: list[str]) -> DataFrame:
    """keys, lang_pred and score of every document."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys), "lang_pred string, score double"])
    return docs.select(*keys, "text").mapInArrow(_score(model, keys), schema)


def split_parts(docs: DataFrame) -> DataFrame:
    """docs with held_out and whether they may be learned from (may_learn)."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    return docs.withColumn("held_out", F.coalesce(part == 0, F.lit(False))).withColumn("may_learn", F.coalesce(part != 0, F.lit(False)))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    parts = split_parts(docs.select("doc_id", "text", "lang"))
    model = fit(parts.where("may_learn"))
    return identify(parts, model, ["doc_id", "held_out"])


def known_language(docs: DataFrame) -> DataFrame:
    """Documents whose language can be told; those that come out as `und` go."""
    model = fit(split_parts(docs).where("may_learn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield part.filter(pa.array(_named(model, part["text"].to_pylist())[0] != "und"))

    return docs.mapInArrow(run, docs.schema)
