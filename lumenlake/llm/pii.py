"""Personal data: pattern spans, and more from a character-level bidirectional LSTM with CRF transitions.

The base spans are fixed patterns with checks.  They also label windows of a bounded sample of the corpus, on
which a small network is trained in numpy: character classes, an LSTM each way, scores of nine
tags (outside; begin and inside of four kinds) and learned transitions, by the CRF's likelihood.

Every text is read whole.  A span of any kind holds a digit or an @, so windows cover all surroundings of
such characters and the rest is outside by rule.  Windows overlap by half and are decoded by
Viterbi; each character takes the tag of the window in which it lies most centrally, and spans are built from the
tags of the whole text.  A span of the network is added if it holds what its kind must hold, cuts no number in two, meets no
base span and no match of its own kind that had that kind's form and failed its check.

The patterns find one spelling of each kind, so the sample also holds its texts with the spans respelled:
phones without their prefix, phones and cards with other separators, addresses at a host without a dot.

Defined cases: a null text is empty; a text without digit and @ has no spans; where the sample has no labelled
window, the base spans are all; repeated rows are treated alike; other columns are ignored.
Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Windows that the network is trained on at most, characters of a window, and how far a trigger reaches.
TRAIN_WINDOWS, WINDOW, REACH = 1536, 64, 24
TAGS = 1 + 2 * len(KINDS)
#: Windows that one text offers the training sample at most, in each of its spellings.
TEXT_WINDOWS = 64

# Fixed patterns; digits and lengths are checked below.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: What may stand between the digits of a card or phone of the network.
_NUMBER = re.compile(r"[+(]*[0-9][\x20().0-9/_-]*[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Domains are found first and the local part is read backwards, so long words cost no retries."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _sound(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


Span = tuple[int, int, int]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(start, number of kind, end) of the sound matches in order, and of those a check refused."""
    kept, refused = [], []
    if not _TRIGGER.search(text):
        return kept, refused
    found = [(0, s) for s in (_emails(text) if "@" in text else ())]
    for number, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(number, m.span()) for m in pattern.finditer(text)]
    for number, (start, end) in found:
        (kept if _sound(KINDS[number], text[start:end]) else refused).append((start, number, end))
    return sorted(kept), refused


# Character classes: padding, other, digit, lower, upper, other letter, blank, line end, then each ASCII sign.
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.ones(128, dtype=np.int64)
for _c in range(128):
    _CLASS[_c] = 2 if chr(_c).isdigit() else 3 if chr(_c).islower() else 4 if chr(_c).isupper() else 7 if _c in (10, 13) else 6 if _c in (9, 32) else 1
for _n, _c in enumerate(_SIGNS):
    _CLASS[_c] = 8 + _n
CLASSES = 8 + len(_SIGNS)


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < 128, _CLASS[np.minimum(c, 127)], 5)


def windows(text: str) -> list[int]:
    """Starts of the windows: half a window apart over everything within REACH of a trigger."""
    out: list[int] = []
    begin = stop = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a > stop:
            out += _tiles(begin, stop)
            begin, stop = a, b
        else:
            stop = b
    return out + _tiles(begin, stop)


def _tiles(begin: int, stop: int) -> list[int]:
    return list(range(begin, max(begin + 1, stop - WINDOW // 2), WINDOW // 2)) if stop > 0 else []


def taught_spans(text: str) -> list[Span]:
    """What the network is to learn: base spans, and digits of a card's length whose check fails.

    No network of this size can tell the two kinds of digits apart; the check that follows it does.
    """
    kept, refused = base_spans(text)
    card = KINDS.index("card")
    return kept + [s for s in refused if s[1] == card and 12 <= len(_NOT_DIGIT.sub("", text[s[0] : s[2]])) <= 19]


def respelled(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans as the patterns do not find them, and where they then lie; by hash of what is found."""
    parts, out, at, size = [], [], 0, 0
    for start, kind, end in sorted(spans):
        if start < at:
            continue
        found = text[start:end]
        new = _respelling(KINDS[kind], found, xxhash.xxh3_64_intdigest(found.encode("utf-8", "surrogatepass")))
        size += start - at
        parts += [text[at:start], new]
        out.append((size, kind, size + len(new)))
        size, at = size + len(new), end
    return "".join([*parts, text[at:]]), out


def _respelling(kind: str, found: str, h: int) -> str:
    if kind == "email":
        return found[: found.index(".", found.index("@"))]
    if kind == "ip":
        return found
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return "./_-"[h % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = re.findall("[0-9]+", found)
    if len(groups) > 1 and len(digits) - len(groups[0]) >= 9 and h % 4:
        groups = groups[1:]
    elif len(groups) == 1:
        groups = [digits[:3], digits[3:6], digits[6:]]
    form = h // 4 % 6
    if form == 0:
        return f"({groups[0]}) {'-'.join(groups[1:])}"
    if form == 1:
        return f"{groups[0]} {''.join(groups[1:])}"
    return ".-/ "[form - 2].join(groups)


def labels(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int8)
    for start, kind, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if not out[start:end].any():
            out[start], out[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Character classes -> two LSTMs -> tag scores -> CRF."""

    def __init__(self, size: int = 24, width: int = 12, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        new = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.size = size
        self.p = {"e": r.normal(0, 0.3, (CLASSES, width)), "out": new(2 * size, TAGS), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"x{d}": new(width, 4 * size), f"h{d}": new(size, 4 * size), f"c{d}": np.r_[np.zeros(size), np.ones(size), np.zeros(2 * size)]}

    def _run(self, emb: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; emb and result are in text order."""
        n, t, _ = emb.shape
        s = self.size
        given = emb @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, s)), np.zeros((n, s))
        out = np.empty((n, t, s))
        for at in range(t) if d == "f" else range(t - 1, -1, -1):
            z = given[:, at] + h @ self.p[f"h{d}"]
            gate, g = _sigmoid(z[:, : 3 * s]), np.tanh(z[:, 3 * s :])
            before_h, before_c = h, c
            c = gate[:, s : 2 * s] * c + gate[:, :s] * g
            tanh_c = np.tanh(c)
            h = gate[:, 2 * s :] * tanh_c
            out[:, at] = h
            if keep is not None:
                keep.append((at, before_h, before_c, gate, g, tanh_c))
        return out

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        emb = self.p["e"][x]
        runs = {d: [] for d in "fb"} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(emb, d, runs[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"emb": emb, "states": states, "runs": runs}
        return states @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood and its gradients."""
        keep: dict = {}
        u, move = self.scores(x, keep), self.p["move"]
        n, t, k = u.shape
        alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = u[:, 0]
        for at in range(1, t):
            alpha[:, at] = u[:, at] + _logsum(alpha[:, at - 1, :, None] + move, 1)
        for at in range(t - 2, -1, -1):
            beta[:, at] = _logsum(move + (u[:, at + 1] + beta[:, at + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        rows = np.arange(n)
        gold = u[rows[:, None], np.arange(t), y].sum(axis=1) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        du = np.exp(alpha + beta - z[:, None, None])
        du[rows[:, None], np.arange(t), y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + move + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        du /= n
        g = {"move": pair / n, "bias": du.sum(axis=(0, 1)), "out": np.einsum("nts,ntk->sk", keep["states"], du)}
        ds, demb, s = du @ self.p["out"].T, np.zeros_like(keep["emb"]), self.size
        for i, d in enumerate("fb"):
            dz_all = np.empty((n, t, 4 * s))
            dh, dc = np.zeros((n, s)), np.zeros((n, s))
            g[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
            for at, h0, c0, gate, cand, tanh_c in reversed(keep["runs"][d]):
                dh = dh + ds[:, at, i * s : (i + 1) * s]
                gi, gf, go = gate[:, :s], gate[:, s : 2 * s], gate[:, 2 * s :]
                dc = dc + dh * go * (1 - tanh_c**2)
                dz = np.concatenate([dc * cand * gi * (1 - gi), dc * c0 * gf * (1 - gf), dh * tanh_c * go * (1 - go), dc * gi * (1 - cand**2)], axis=1)
                g[f"h{d}"] += h0.T @ dz
                dz_all[:, at] = dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * gf
            g[f"c{d}"] = dz_all.sum(axis=(0, 1))
            g[f"x{d}"] = np.einsum("ntw,ntz->wz", keep["emb"], dz_all)
            demb += dz_all @ self.p[f"x{d}"].T
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.ravel(), demb.reshape(-1, demb.shape[2]))
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 14, batch: int = 64, rate: float = 0.02) -> Tagger:
        random, step = np.random.default_rng(11), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for turn in range(rounds):
            order = random.permutation(len(x))
            for at in range(0, len(x), batch):
                _, g = self.gradients(x[order[at : at + batch]], y[order[at : at + batch]].astype(np.int64))
                step += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a = a * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] -= rate * (1 - turn / rounds) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely tags of each window."""
        u, move = self.scores(x), self.p["move"]
        n, t, k = u.shape
        best, came = u[:, 0], np.empty((n, t, k), dtype=np.int8)
        for at in range(1, t):
            options = best[:, :, None] + move
            came[:, at] = options.argmax(axis=1)
            best = u[:, at] + options.max(axis=1)
        out = np.empty((n, t), dtype=np.int8)
        out[:, -1] = best.argmax(axis=1)
        for at in range(t - 1, 0, -1):
            out[:, at - 1] = came[np.arange(n), at, out[:, at]]
        return out


def _windowed(text: str, starts: list[int]) -> np.ndarray:
    known = classes(text)
    out = np.zeros((len(starts), WINDOW), dtype=np.int64)
    for row, a in enumerate(starts):
        part = known[a : a + WINDOW]
        out[row, : len(part)] = part
    return out


def _stitched(length: int, starts: list[int], tags: np.ndarray) -> dict[int, int]:
    """Tag of each covered place: that of the window in which it is most central."""
    best: dict[int, tuple[int, int]] = {}
    for a, row in zip(starts, tags.tolist(), strict=True):
        for i in range(min(WINDOW, length - a)):
            edge = min(i if a else WINDOW, WINDOW - 1 - i if a + WINDOW < length else WINDOW)
            if a + i not in best or best[a + i][0] < edge:
                best[a + i] = (edge, row[i])
    return {p: t for p, (_, t) in best.items() if t}


def _runs(tags: dict[int, int]) -> Iterator[Span]:
    """Spans of one kind: begin or inside, followed by insides."""
    start = kind = end = None
    for p in sorted(tags):
        k, begins = (tags[p] - 1) // 2, tags[p] % 2 == 1
        if start is not None and p == end and k == kind and not begins:
            end = p + 1
            continue
        if start is not None:
            yield start, kind, end
        start, kind, end = p, k, p + 1
    if start is not None:
        yield start, kind, end


def _plausible(kind: int, found: str) -> bool:
    digits = sum(c in "0123456789" for c in found)
    if KINDS[kind] == "email":
        return 0 < found.find("@") < len(found) - 3
    if KINDS[kind] == "ip":
        return digits >= 4 and found.count(".") == 3 and _sound("ip", found) if re.fullmatch(r"[0-9.]+", found) and ".." not in found.strip(".") and found.strip(".") == found else False
    return _NUMBER.fullmatch(found) is not None and _sound(KINDS[kind], found)


def _settled(kind: int, found: str) -> bool:
    """Whether a refused match had the form of its kind, so that the network may not overrule the check."""
    digits = len(_NOT_DIGIT.sub("", found))
    return 12 <= digits <= 19 if KINDS[kind] == "card" else 9 <= digits <= 15 if KINDS[kind] == "phone" else True


def _cuts_number(text: str, start: int, end: int) -> bool:
    return text[start - 1 : start].isdigit() or text[end : end + 1].isdigit()


def added_spans(text: str, tags: dict[int, int], base: list[Span], refused: list[Span]) -> list[Span]:
    taken, out = [(a, b) for a, _, b in base], []
    settled = [s for s in refused if _settled(s[1], text[s[0] : s[2]])]
    for start, kind, end in _runs(tags):
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())
        if start >= end or not _plausible(kind, text[start:end]) or KINDS[kind] != "email" and _cuts_number(text, start, end):
            continue
        if not any(start < b and a < end for a, b in taken) and not any(k == kind and start < b and a < end for a, k, b in settled):
            taken.append((start, end))
            out.append((start, kind, end))
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    found = [base_spans(t) for t in texts]
    if model is None:
        return [(base, base) for base, _ in found]
    starts = [windows(t) for t in texts]
    some = [i for i, s in enumerate(starts) if s]
    tags: list[dict[int, int]] = [{} for _ in texts]
    at = 0
    while at < len(some):
        n, rows = at, 0
        while n < len(some) and (n == at or rows + len(starts[some[n]]) <= 2048):
            rows += len(starts[some[n]])
            n += 1
        for i in some[at:n] if n - at == 1 else ():
            tags[i] = _stitched(len(texts[i]), starts[i], np.concatenate([model.decode(_windowed(texts[i], starts[i][a : a + 2048])) for a in range(0, len(starts[i]), 2048)]))
        if n - at > 1:
            decoded = model.decode(np.concatenate([_windowed(texts[i], starts[i]) for i in some[at:n]]))
            first = 0
            for i in some[at:n]:
                tags[i] = _stitched(len(texts[i]), starts[i], decoded[first : first + len(starts[i])])
                first += len(starts[i])
        at = n
    return [(base, sorted(base + added_spans(t, g, base, refused))) for t, g, (base, refused) in zip(texts, tags, found, strict=True)]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sample_windows(text: str) -> Iterator[tuple[bytes, bytes]]:
    """Classes and labels of windows about triggers, chosen by hash over the whole text; then of the text respelled."""
    spans = taught_spans(text)
    for version, known in [(text, spans), respelled(text, spans)][: 1 + bool(spans)]:
        codes, tags = classes(version).astype(np.int8), labels(len(version), known)
        picked = heapq.nsmallest(TEXT_WINDOWS, windows(version), key=lambda a: (xxhash.xxh3_64_intdigest(codes[a : a + WINDOW].tobytes()), a))  # noqa: B023
        for a in picked:
            yield tuple(np.pad(t := c[a : a + WINDOW], (0, WINDOW - len(t))).tobytes() for c in (codes, tags))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = [], []
        for text in batch["text"].to_pylist():
            for classes_, tags in sample_windows(text):
                x.append(classes_)
                y.append(tags)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])


def fit(docs: DataFrame, most: int = TRAIN_WINDOWS) -> Tagger | None:
    """Train on at most `most` windows, chosen by hash; null if none of them is labelled."""
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_samples, "x binary, y binary").distinct()
    got = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(most).collect()
    if not got:
        return None
    x, y = (np.array([np.frombuffer(r[c], np.int8) for r in got]) for c in "xy")
    return Tagger().train(x.astype(np.int64), y) if y.any() else None


def found(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256, spans, their number and that of those the network added, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = all_spans([t or "" for t in part["text"].to_pylist()], model)
                counts = [pa.array([sum(k == kind for _, k, _ in spans) for _, spans in each], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in each])
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, digests, pa.array([spelled(spans) for _, spans in each]), pa.array([len(spans) for _, spans in each], pa.int64()), pa.array([len(spans) - len(base) for base, spans in each], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_spans long", "n_added long"])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """Train on docs and report the spans of all of them."""
    return found(docs, fit(docs))
