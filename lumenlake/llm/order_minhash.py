"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are runs of letters or digits in lower case; a document is its sequence of five-word shingles, equal
shingles told apart by their occurrence number.  A sketch keeps, for each of TABLES hash functions, the PICK
shingles of smallest hash in text order, so two documents share it only if the same shingles come in
the same order.  Documents that share a sketch are candidates.

Similarity is that of an alignment of the words: those that match in order, over all words of either text.  Matches lie
within a band about the diagonal, which is as wide as the similarity asked for allows.  Two texts that agree in a share j
of their shingles share one of TABLES sketches with a probability of about 1 - (1 - j ** PICK) ** TABLES.  Texts of fewer than SHORT_TO shingles are known by
SHORT_PICK of them instead, those of fewer than SINGLE_TO by single ones too: one change may leave them one shingle.
Similar texts without a shingle in common are not met: some of those under 16 words, most of those under 6 (README).

Copies of the same words are one node, found by digest.  Candidates that any sketches connect form a pool, which is
cut into chunks by size.  A task takes the pairs of a chunk that share a shingle, found through an inverted index, aligns
those whose words in common leave room for the similarity, and returns no more links than connect what it found.  Pools of
several chunks go on with one text for each class they hold, and those that still hold several classes are compared by pairs of
wider chunks, whose tasks know the classes and skip what is connected.  So a pool of any size is spread over tasks
of bounded memory, no such pair within a pool goes untested, and no list of all pairs is made.

Defined cases: a text of fewer than five words is one shingle of its words; a null text or one without words is in a class of
its own; class_id is the smallest doc_id of a class and null where the class has none; equal doc_id with different texts are
separate documents of that id; repeated rows are copies; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import components, prefilter, write_table
from lumenlake.llm.spans import text_key

WORDS, TABLES, PICK, SIMILARITY = 5, 48, 3, 0.8
#: Shingles from which texts have sketches of PICK shingles, and below which they have sketches of SHORT_PICK.  Texts of which one is at most
#: so much longer as the similarity allows have one of the two in common.
SHORT_PICK, PICK_FROM, SHORT_TO = 2, 60, 75
#: Shingles below which texts have sketches of a single one as well.
SINGLE_TO = 16
#: Shingles of a chunk on average, and of one of the two wider chunks of a task.
CHUNK_SHINGLES, WIDE_SHINGLES = 200_000, 600_000
_WORD = re.compile(r"[^\W_]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEEDS = np.random.default_rng(41).integers(1 << 62, 1 << 63, TABLES, dtype=np.uint64) | np.uint64(1)
_ROWS, _HALF, _TOP = np.arange(TABLES), np.uint64(32), np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words; those of a bounded number of words are remembered."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order, with the occurrence number mixed in."""
    width = min(WORDS, len(words))
    if not width:
        return np.zeros(0, dtype=np.uint64)
    h = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        h *= _ODD[0]
        h += words[i : i + len(h)]
    return numbered(mix(h))


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes with the occurrence number of each mixed in from the second on."""
    ordered = np.sort(h)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(h, kind="stable")
        start = np.r_[True, ordered[1:] != ordered[:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
        number = np.empty(len(h), dtype=np.uint64)
        number[order] = (np.arange(len(h)) - first).astype(np.uint64)
        h = np.where(number > 0, mix(h + number * _ODD[0]), h)
    return h


def _lowest(h: np.ndarray, pick: int) -> np.ndarray:
    """For each table the places of the `pick` smallest hashes; long texts are searched a piece at a time."""
    places = []
    for at in range(0, len(h), 1 << 15):
        x = h[None, at : at + (1 << 15)] * _SEEDS[:, None]
        x ^= x >> _HALF
        x *= _ODD[2]
        for _ in range(min(pick, x.shape[1])):
            low = x.argmin(axis=1)
            places.append(low + at)
            x[_ROWS, low] = _TOP
    out = np.array(places).T
    if out.shape[1] > pick:
        x = h[out] * _SEEDS[:, None]
        x ^= x >> _HALF
        out = np.take_along_axis(out, np.argsort(x * _ODD[2], axis=1, kind="stable")[:, :pick], axis=1)
    return out


def _sketch(h: np.ndarray, pick: int) -> np.ndarray:
    """For each table the hash of the `pick` smallest shingles in text order."""
    out = _SEEDS + np.uint64(pick)
    for place in np.sort(_lowest(h, min(pick, len(h))), axis=1).T:
        out = mix(out * _ODD[0] + h[place])
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """The sketches of a text, TABLES of each kind that it has; few of a short text's shingles outlive a change, so it is known by fewer of them."""
    picks = [PICK] * (len(h) >= PICK_FROM) + [SHORT_PICK] * (len(h) < SHORT_TO) + [1] * (len(h) < SINGLE_TO)
    return np.concatenate([_sketch(h, pick) for pick in picks])


def banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most shingles matched in order, at places that differ by band at most; bit-parallel over a."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if differ.size else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if differ.size else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        m = places.get(x, 0)
        if m and len(a) > band:
            m &= window << j - band if j >= band else window >> band - j
        if u := v & m:
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether aligned words over all words reach `least`."""
    total = len(a) + len(b)
    # matched m with m / (total - m) >= least leaves total - 2 m unmatched, which bounds the band
    band = int(total - 2 * least * total / (1 + least)) + 1
    m = banded_matches(a, b, band)
    return m >= least * (total - m) - 1e-9


def links(docs: list[np.ndarray], split: int = 0, classes: list | None = None, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what is similar among texts of hashed words and shares a shingle, as few as do.

    With split, those before it are compared with those behind it alone.  Texts of one class are known to be connected.
    """
    cut = [shingles(x) for x in docs]
    sizes = np.array([len(x) for x in docs])
    _, code = np.unique(np.concatenate(cut), return_inverse=True)
    begin = np.r_[0, np.cumsum([len(x) for x in cut])]
    owner = np.repeat(np.arange(len(docs)), np.diff(begin))
    n_left = split or len(docs)
    inside = owner < n_left
    order = np.argsort(code[inside], kind="stable")
    posting_doc = owner[inside][order]
    bounds = np.searchsorted(code[inside][order], np.arange(code.max() + 2))
    first = {c: i for i, c in reversed(list(enumerate(classes or [])))}
    parent = [first[c] for c in classes] if classes else list(range(len(docs)))
    words: dict[int, np.ndarray] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def counted(x: int) -> np.ndarray:
        if x not in words:
            words[x] = numbered(docs[x])
        return words[x]

    found = []
    for x in range(split or 1, len(docs)):
        codes = code[begin[x] : begin[x + 1]]
        a, n = bounds[codes], bounds[codes + 1] - bounds[codes]
        total = int(n.sum())
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(total)
        shared = np.bincount(posting_doc[at], minlength=n_left)[: split or x]
        needed = np.ceil(least * (sizes[x] + sizes[: len(shared)]) / (1 + least) - 1e-9)
        for y in np.flatnonzero((shared > 0) & (np.minimum(sizes[x], sizes[: len(shared)]) >= needed)).tolist():
            if root(x) != root(y) and len(np.intersect1d(counted(x), counted(y), assume_unique=True)) >= needed[y] and similar(docs[x], docs[y], least):
                parent[root(x)] = root(y)
                found.append((x, y))
    return found


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            digests, sizes, sketches = [], [], []
            for text in part["text"].to_pylist():
                words = hashes(_WORD.findall((text or "").lower()))
                digests.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
                h = shingles(words)
                sizes.append(len(h))
                sketches.append(sketch(h).astype(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "text_key", "digest", "n", "sketch"])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed words of the texts that have the wanted digest."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keep, packed = [], []
            for text, digest in zip(part["text"].to_pylist(), part["digest"].to_pylist(), strict=True):
                words = hashes(_WORD.findall((text or "").lower()))
                keep.append(len(words) > 0 and xxhash.xxh3_128_digest(words.tobytes()) == digest)
                packed.append(words.tobytes() if keep[-1] else None)
            out = pa.RecordBatch.from_arrays([part["digest"], part["pool"], part["chunks"], pa.array(packed, pa.binary())], names=["digest", "pool", "chunks", "words"])
            yield out.filter(pa.array(keep))


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a chunk."""
    rows = rows.drop_duplicates("digest").sort_values("digest", kind="stable")
    found = links([np.frombuffer(x, np.uint64) for x in rows["words"]])
    names = rows["digest"].tolist()
    return pd.DataFrame({"a": [names[x] for x, _ in found], "b": [names[y] for _, y in found]}, dtype=object)


def _crossed(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the classes of two wider chunks, or within one of them."""
    rows = rows.drop_duplicates("digest").sort_values(["side", "digest"], kind="stable")
    split = int((rows["side"] == 0).sum())
    if not split or split == len(rows) and not rows["alone"].iloc[0]:
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    found = links([np.frombuffer(x, np.uint64) for x in rows["words"]], split % len(rows), rows["class"].tolist())
    names = rows["digest"].tolist()
    return pd.DataFrame({"a": [names[x] for x, _ in found], "b": [names[y] for _, y in found]}, dtype=object)


def _in_chunks(members: DataFrame) -> DataFrame:
    """Links within the chunks of members (pool, chunks, digest, words)."""
    chunk = F.pmod(F.xxhash64("digest"), F.col("chunks")).alias("chunk")
    return members.select("pool", chunk, "digest", "words").groupBy("pool", "chunk").applyInPandas(_within, "a binary, b binary")


def _several(members: DataFrame, links: DataFrame) -> DataFrame:
    """members of the pools that hold several classes under these links, with their class."""
    classes = write_table(components(links, "a", "b").select(F.col("node").alias("digest"), F.col("label").alias("class")), "pool-classes")
    named = write_table(members.join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest")), "pool-members")
    several = named.groupBy("pool").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("pool")
    return named.join(write_table(several, "open-pools"), "pool")


def _links(members: DataFrame) -> DataFrame:
    """Links (a, b) between the digests of members (digest, pool, chunks, words)."""
    found = write_table(_in_chunks(members), "links")
    hot = members.where("chunks > 1")
    if hot.isEmpty():
        return found
    # one text of each class in a pool
    left = write_table(_several(hot, found), "open")
    firsts = left.groupBy("pool", "class").agg(F.min(F.struct("digest", "words")).alias("first")).select("pool", "first.*")
    sizes = firsts.groupBy("pool").agg(F.ceil(F.sum(F.length("words") / 8) / CHUNK_SHINGLES).cast("int").alias("chunks"))
    found = write_table(found.unionByName(_in_chunks(write_table(firsts, "pool-firsts").join(write_table(sizes, "first-sizes"), "pool"))), "links")
    # and what is in several classes still
    wide = F.ceil(F.col("chunks") * F.lit(CHUNK_SHINGLES / WIDE_SHINGLES)).cast("int")
    left = _several(left.drop("class"), found).withColumn("wide", wide).withColumn("own", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("wide")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    side, alone = (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("alone")
    left = left.select("pool", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "digest", "words", "class", side, alone)
    return write_table(found.unionByName(left.groupBy("pool", "i", "j").applyInPandas(_crossed, "a binary, b binary")), "links")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, digest, first) of every row; first is the (none, doc_id, text_key) of the row that stands for its class."""
    known = write_table(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_sketches, "doc_id long, text_key long, digest binary, n int, sketch array<long>"), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    texts = known.where("digest is not null").groupBy("digest").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    texts = write_table(texts, "texts")
    keys = texts.select("digest", F.posexplode("sketch").alias("at", "value")).select("digest", (F.col("at") % TABLES).alias("table"), "value")
    shared = keys.groupBy("table", "value").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    # tables of their own, here and below, so that joins can be split at a hot sketch or class
    shared = write_table(shared, "shared-sketches")
    met = keys.join(shared, ["table", "value"]).select("digest", "first").where("digest <> first").distinct()
    pools = components(met, "digest", "first").select(F.col("node").alias("digest"), F.col("label").alias("pool"))
    pools = pools.join(texts.select("digest", "first.doc_id", "first.text_key", "n"), "digest")
    sizes = pools.groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    pools = write_table(pools.join(sizes, "pool").select("doc_id", "text_key", "digest", "pool", "chunks"), "pools")
    # texts of the pools alone are read once more
    wanted = prefilter(docs.select("doc_id", "text"), "doc_id", pools, "doc_id")
    wanted = wanted.join(pools.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), wanted["doc_id"].eqNullSafe(F.col("_id")) & (text_key(wanted["text"]) == F.col("_key")))
    members = wanted.select("text", "digest", "pool", "chunks").mapInArrow(_payload, "digest binary, pool binary, chunks int, words binary")
    found = _links(write_table(members, "members"))
    classes = components(found, "a", "b").select(F.col("node").alias("digest"), F.col("label").alias("class"))
    named = texts.select("digest", "first").join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    named = write_table(named, "named")
    lowest = write_table(named.groupBy("class").agg(F.min("first").alias("first")), "class-firsts")
    named = named.drop("first").join(lowest, "class").select("digest", "first")
    plain = known.where("digest is null").withColumn("first", place)
    cols = ["doc_id", "text_key", "digest", "first"]
    return known.where("digest is not null").join(named, "digest").select(cols).unionByName(plain.select(cols))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row: rows of a class are copies or connected by similar pairs."""
    return _classes(docs).select("doc_id", F.col("first.doc_id").alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id, in it of the smallest text_key, in it the smallest row.

    Rows without an id rank last in their class; those without an id and without words all stay.
    """
    rows = write_table(_classes(docs), "class-rows")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    pair = [F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")]
    key = lambda df, by: df["doc_id"].eqNullSafe(by["_doc"]) & (text_key(df["text"]) == by["_key"])
    gone = rows.where(~same).select(*pair).distinct()
    left = docs.join(gone, key(docs, gone), "left_anti")
    alone = rows.where("doc_id is null and digest is null").select(*pair).distinct()
    # a row that holds a value without an order is told apart by what it reads as
    one = left.join(alone, key(left, alone), "left_anti").groupBy("doc_id", text_key().alias("_key")).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))).alias("_row"))
    return one.select("_row.*").unionByName(left.join(alone, key(left, alone), "left_semi"))
