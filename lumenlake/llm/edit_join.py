"""Line deduplication by a segment-partition edit join.

Lines are within the threshold if an edit distance of one edit per CHARS_PER_EDIT characters of the shorter line, MOST
at the most, turns one into the other; so shorter lines than CHARS_PER_EDIT are only compared for equality.  Two lines within k
edits share, unchanged, one of the k + 1 segments into which the shorter is cut; where that segment can lie
in the longer one follows from the two lengths and its number.  So each line is indexed by its segments, keyed
with its length, and probes the indexes of its own length and of up to k less with the few substrings
that can match.  Lines with an equal key form a group of candidates.  A parity sketch of the characters, in which an edit
changes at most two bits, and a finer partition, of whose FINE segments all but k are unchanged, drop most wrong pairs
of a group; a banded bit-parallel edit distance decides the rest.

A group is cut into chunks by size.  A task compares the lines of a chunk and returns no more links than connect what
it found.  Groups of several chunks go on with one line for each class they hold, and those that still hold
several classes are compared by pairs of wider chunks, whose tasks know the classes and skip what is connected.  So no list
of all pairs of a group is made, and no pair goes untested.

Lines are compared without outer blanks.  Equal lines are one node from the start; linked ones form
classes, and of each class the earliest line (smallest doc_id, then line number) stays.  Every line with a character is
compared unless the caller asks for a floor.  Seeds of a line are sent once per task and made distinct by key
before they meet, so a line in every document costs no more than a rare one.

Defined cases: a null or empty text has no lines; a null doc_id ranks last; rows with equal doc_id and text
are one document; very long lines are compared whole; a text that loses its last line becomes empty, and
`deduplicated` drops such documents; empty tables give empty results; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import components, prefilter, write_table
from lumenlake.llm.spans import text_key

#: Most edits, and characters of a line for each edit.
MOST, CHARS_PER_EDIT = 2, 16
#: Segments of the finer partition.
FINE = 8
#: Lines of a chunk of a group, and of one of the two wider chunks of a task.
CHUNK, WIDE = 128, 2048
#: Lines that a task compares at a time.
STEP_LINES = 4096
#: Candidates that wait for each other, since a column of the band costs as much for one pair as for many.
TOGETHER = 1024
#: Line numbers a task remembers as sent; beyond it some are sent again and made distinct later.
REMEMBERED = 300_000
#: Characters of a step of a task.
STEP_CHARS = 1 << 19
_BASE, _U = np.uint64(0x9E3779B97F4A7C15), np.uint64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Lines laid end to end, with hashes of any substring by prefix sums."""

    def __init__(self, lines: list[str]) -> None:
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.r_[0, np.cumsum(self.length)[:-1]] if len(lines) else np.zeros(0, np.int64)
        power = np.full(len(codes) + 1, _BASE, dtype=np.uint64)
        inverse = np.full(len(codes) + 1, _INVERSE, dtype=np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.r_[_U(0), np.cumsum(_mix(codes.astype(np.uint64) + _U(1)) * power[:-1])]
        self.codes = codes
        self.ids = _mix(self.hashes(self.start, self.length)).view(np.int64)

    def parity(self) -> np.ndarray:
        """64 parity bits of the character counts of each line."""
        bits = _U(1) << ((self.codes.astype(np.uint64) * _U(0x9E3779B1) >> _U(7)) % _U(64))
        return np.bitwise_xor.reduceat(bits, self.start) if len(bits) else np.zeros(0, np.uint64)

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def edits_of(length: np.ndarray) -> np.ndarray:
    """Edits allowed between a line of this length and a longer one."""
    return np.minimum(MOST, length // CHARS_PER_EDIT)


def segment(length: np.ndarray, number: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the segment of this number (from 0) of lines of these lengths cut into parts."""
    short = length // parts
    first_longer = parts - (length - short * parts)
    return number * short + np.maximum(0, number - first_longer), short + (number >= first_longer)


def _key(h: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
    return _mix(h ^ _mix(length.astype(np.uint64) * _U(8) + _U(number + 1))).view(np.int64)


def seeds(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, ids, own): the substrings with which lines probe the indexes; own are those that index the line itself."""
    for most in range(1, MOST + 1):
        for less in range(most + 1):
            length = block.length - less
            mine = edits_of(length) == most
            for number in range(most + 1):
                at, size = segment(length, number, most + 1)
                for shift in range(max(-number, less - (most - number)), min(number, less + (most - number)) + 1):
                    inside = np.flatnonzero(mine & (at + shift >= 0) & (at + shift + size <= block.length))
                    if inside.size:
                        begin = block.start[inside] + at[inside] + shift
                        yield _key(block.hashes(begin, size[inside]), length[inside], number), block.ids[inside], less == shift == 0


def within(left: list[str], right: list[str], allowed: np.ndarray | int = MOST) -> np.ndarray:
    """Which pairs of lines are within the allowed edits, MOST at most: bit-parallel over the band, all pairs column by column."""
    allowed = np.broadcast_to(allowed, len(left))
    out = np.zeros(len(left), dtype=bool)
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    at = 0
    while at < len(order):
        n = at + 1
        while n < len(order) and n - at < 4096 and len(left[order[n]]) * (n - at) < 1 << 21:
            n += 1
        rows = order[at:n]
        out[rows] = _band([left[i] for i in rows], [right[i] for i in rows], MOST) <= allowed[rows]
        at = n
    return out


def _columns(lines: list[str], pad: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.full((len(lines), int(length.max(initial=0)) + 2 * pad), fill, dtype=np.uint32)
    for i, line in enumerate(lines):
        out[i, pad : pad + len(line)] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.ascontiguousarray(out.T), length


def _band(left: list[str], right: list[str], most: int) -> np.ndarray:
    """Edit distances, right up to `most` and above it where they are more."""
    width = 2 * most + 1
    all_bits, top = _U((1 << width) - 1), _U(width - 1)
    a, m = _columns(left, most, 0xFFFFFFFF)
    b, n = _columns(right, 0, 0xFFFFFFFE)
    # bit t of a word is row j - most + t of column j; rows below the first line start flat
    vp = np.full(len(left), ((1 << width) - 1) ^ ((1 << most) - 1), dtype=np.uint64)
    vn = np.zeros(len(left), dtype=np.uint64)
    score = np.full(len(left), most, dtype=np.int64)
    for j in range(1, len(b) + 1):
        eq = np.zeros(len(left), dtype=np.uint64)
        for t in range(width):
            if j - 1 + t < len(a):
                eq |= (a[j - 1 + t] == b[j - 1]).astype(np.uint64) << _U(t)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & all_bits
        hp = (vn | ~(d0 | vp)) & all_bits
        hn = d0 & vp
        down = j + most <= m
        row = np.minimum(np.maximum(m - j + most, 0), width - 1).astype(np.uint64)
        step = np.where(down, 1 - (d0 >> top).astype(np.int64), ((hp >> row) & _U(1)).astype(np.int64) - ((hn >> row) & _U(1)).astype(np.int64))
        score += np.where(j <= n, step, 0)
        vp = (hn | ~((d0 >> _U(1)) | hp)) & all_bits
        vn = (d0 >> _U(1)) & hp
    return np.where(np.abs(m - n) <= most, score, most + 1)


def _lines(text: str | None, least: int = 1) -> Iterator[tuple[int, str]]:
    """Number and trimmed text of the lines of `least` characters or more."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= least:
            yield number, line


def _occurrences(least: int):
    """A row per compared line, and one with number -1 for each text, which has the number of its lines."""
    names, types = ["doc_id", "text_key", "line", "digest", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, key, text in zip(*(batch.slice(at, 256)[c].to_pylist() for c in names[:2] + ["text"]), strict=True):
                    own = [(doc_id, key, number, _digest(line), None) for number, line in _lines(text, least)]
                    rows += [(doc_id, key, -1, None, len(own)), *own]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Block]]:
    """Lines that can have near ones, each once as far as the task remembers."""
    seen: set[int] = set()
    lines: list[str] = []
    size = 0
    for batch in batches:
        for text in batch["text"]:
            for _, line in _lines(text.as_py()):
                if len(line) >= CHARS_PER_EDIT and (h := hash(line)) not in seen:
                    seen.add(h)
                    lines.append(line)
                    size += len(line)
            if size > STEP_CHARS:
                yield lines, Block(lines)
                lines, size = [], 0
                if len(seen) > REMEMBERED:
                    seen.clear()
    if lines:
        yield lines, Block(lines)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, block in _blocks(batches):
        for keys, ids, own in seeds(block):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(np.full(len(ids), own))], names=["key", "id", "own"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lines, block in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(lines, pa.string())], names=["id", "line"])


class _Classes:
    """Lines that are known to be connected."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[x] = y
        return x != y


class _Lines:
    """Some lines and what tells whether two of them can be near."""

    def __init__(self, ids: list[int], lines: list[str], own: np.ndarray) -> None:
        self.block = Block(lines)
        self.ids, self.lines, self.own, self.length, self.parity = ids, lines, own, self.block.length, self.block.parity()
        self.hash = np.array(ids, dtype=np.int64)

    def candidates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs that the sketch and the finer partition leave."""
        most = edits_of(np.minimum(self.length[i], self.length[j]))
        alike = np.bitwise_count(self.parity[i] ^ self.parity[j]) <= 2 * most
        left = np.flatnonzero(alike & (self.own[i] | self.own[j]) & (np.abs(self.length[i] - self.length[j]) <= most) & (self.hash[i] != self.hash[j]))
        i, j, most = i[left], j[left], most[left]
        short, long = np.where(self.length[i] <= self.length[j], [i, j], [j, i])
        length, room, start = self.length[short], self.length[long], self.block.start
        same = np.zeros(len(left), dtype=np.int64)
        for number in range(FINE):
            at, size = segment(length, number, FINE)
            want, met = self.block.hashes(start[short] + at, size), np.zeros(len(left), dtype=bool)
            for shift in range(-MOST, MOST + 1):
                begin = np.clip(at + shift, 0, room - size)
                met |= (begin == at + shift) & (self.block.hashes(start[long] + begin, size) == want)
            same += met
        return left[same >= FINE - most]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, right = ([self.lines[x] for x in side.tolist()] for side in (i, j))
        return within(left, right, edits_of(np.minimum(self.length[i], self.length[j])))

    def links(self, found: list[tuple[int, int]]) -> dict[str, list]:
        return {"a": [self.ids[i] for i, _ in found], "b": [self.ids[j] for _, j in found], "da": [_digest(self.lines[i]) for i, _ in found], "db": [_digest(self.lines[j]) for _, j in found]}


def spanning(group: np.ndarray, lines: _Lines) -> list[tuple[int, int]]:
    """Links that connect the near lines of each group, as few as do; rows of a group are neighbours.

    In each step some lines of each group are compared with those behind them: its first, the next two, the next four and so on;
    steps of few candidates go together.
    """
    start = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
    pairs = []
    for d in range(1, int(rank.max(initial=0)) + 1):
        i = np.flatnonzero(group[:-d] == group[d:])
        i = i[lines.candidates(i, i + d)]
        pairs.append(np.stack([np.frexp(rank[i] + 1.0)[1], i, i + d]))
    known, found = _Classes(), []
    if pairs:
        order, left, right = np.concatenate(pairs, axis=1)
        order = np.cumsum(np.bincount(order))[order] // TOGETHER
        for step in np.unique(order):
            mine = np.flatnonzero(order == step)
            mine = mine[[known.root(lines.ids[i]) != known.root(lines.ids[j]) for i, j in zip(left[mine].tolist(), right[mine].tolist(), strict=True)]]
            near = mine[lines.near(left[mine], right[mine])]
            found += [(i, j) for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True) if known.join(lines.ids[i], lines.ids[j])]
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within chunks; the rows of a chunk come one after the other."""
    names = ["key", "chunk", "id", "own", "line"]

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key, chunk, own = (rows[c].to_numpy() for c in ("key", "chunk", "own"))
        lines = _Lines(rows["id"].to_pylist(), rows["line"].to_pylist(), own.astype(bool))
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
        return pa.RecordBatch.from_pydict(lines.links(spanning(group, lines)), schema=_LINK)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch.select(names))
        n += batch.num_rows
        if n >= STEP_LINES:
            rows = pa.Table.from_batches(held)
            key, chunk = rows["key"].to_numpy(), rows["chunk"].to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            at = 0
            while (more := ends[ends >= at + STEP_LINES]).size:
                yield compared(rows.slice(at, int(more[0]) - at))
                at = int(more[0])
            held = rows.slice(at).to_batches()
            n -= at
    if n:
        yield compared(pa.Table.from_batches(held))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("da", pa.binary()), ("db", pa.binary())])
_LINK_SQL = "a long, b long, da binary, db binary"


def _crossed(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the lines of two wider chunks that are in different classes."""
    rows = rows.sort_values("id", kind="stable")
    lines = _Lines(rows["id"].tolist(), rows["line"].tolist(), rows["own"].to_numpy(bool))
    known, found, waiting = _Classes(), [], []
    names = [("class", c) for c in rows["class"]]
    for i in range(1, len(names)):
        j = lines.candidates(np.full(i, i), np.arange(i))
        waiting += [(x, i) for x in j.tolist() if known.root(names[x]) != known.root(names[i])]
        if waiting and (len(waiting) >= TOGETHER or i == len(names) - 1):
            near = lines.near(*np.array(waiting).T)
            found += [(x, y) for x, y in np.array(waiting)[near].tolist() if known.join(names[x], names[y])]
            waiting = []
    return pd.DataFrame(lines.links(found), dtype=object)


def _in_chunks(members: DataFrame) -> DataFrame:
    """Links within the chunks of members (key, chunk, id, own, line)."""
    return members.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "id").mapInArrow(_linked, _LINK_SQL)


def _several(members: DataFrame, links: DataFrame) -> DataFrame:
    """members of the keys that hold several classes under these links, with their class."""
    classes = write_table(components(links, "a", "b").select(F.col("node").alias("id"), F.col("label").alias("class")), "hot-classes")
    named = write_table(members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")), "hot-members")
    several = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    return named.join(write_table(several, "hot-keys"), "key")


def near_lines(docs: DataFrame) -> DataFrame:
    """Links (a, b) between the digests of different lines within the threshold, as many as connect them."""
    texts = docs.where(F.length("text") >= CHARS_PER_EDIT).select("text")
    known = write_table(texts.mapInArrow(_seeds, "key long, id long, own boolean"), "seeds")
    # keys of more than one line, one of which is indexed by it
    keys = known.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("own")).where("own and low < high").select("key")
    keys = write_table(keys, "seed-keys")
    members = prefilter(known, "key", keys, "key").join(keys, "key").groupBy("key", "id").agg(F.max("own").alias("own"))
    members = write_table(members, "seed-members")
    lines = prefilter(texts.mapInArrow(_texts, "id long, line string"), "id", members, "id").dropDuplicates(["id"])
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    members = members.join(write_table(sizes, "hot-sizes"), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    members = write_table(members.join(lines, "id"), "seed-lines")
    links = write_table(_in_chunks(members), "links")
    hot = members.where("chunks > 1")
    if not hot.isEmpty():
        # one line of each class in a key
        open_ = write_table(_several(hot.drop("chunk"), links), "open")
        firsts = open_.groupBy("key", "class").agg(F.min(F.struct("id", "line")).alias("first")).select("key", "first.*", F.lit(True).alias("own"))
        sizes = firsts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        firsts = write_table(firsts, "firsts").join(write_table(sizes, "first-sizes"), "key").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int"))
        links = write_table(links.unionByName(_in_chunks(firsts)), "links")
        # and what is in several classes still
        wide = F.ceil(F.col("chunks") * F.lit(CHUNK / WIDE)).cast("int")
        open_ = _several(open_.drop("class"), links).withColumn("wide", wide).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(2)), F.col("wide")).cast("int"))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
        open_ = open_.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "own", "line", "class")
        links = write_table(links.unionByName(open_.groupBy("key", "i", "j").applyInPandas(_crossed, _LINK_SQL)), "links")
    return links.select(F.col("da").alias("a"), F.col("db").alias("b"))


def line_classes(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, text_key, line, n, class, again): a row per compared line and one with line -1 per text, which has its number of lines as n.

    again: the line repeats, exactly or nearly, an earlier one of its class.
    """
    found = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_occurrences(least), "doc_id long, text_key long, line int, digest binary, n long")
    found = write_table(found, "lines")
    near = components(near_lines(docs), "a", "b").select(F.col("node").alias("digest"), F.col("label").alias("class"))
    lines = found.join(near, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    lines = write_table(lines.drop("digest"), "line-classes")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "text_key", "line")
    first = lines.where("line >= 0").groupBy("class").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
    # a table of its own, so that the join reads both sides from exchanges that Spark can split at a hot class
    first = write_table(first, "line-firsts")
    return lines.join(first, "class", "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


def removed_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, text_key, n_lines, removed): compared lines of each text and the numbers of those that go, in order."""
    by = line_classes(docs, least).groupBy("doc_id", "text_key")
    return by.agg(F.max("n").alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("again"), F.col("line")))).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without their repeated lines, n_chars set anew; documents of which nothing is left go."""
    gone = removed_lines(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("removed").alias("_gone"))
    numbers = gone["_gone"]
    met = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]) & (text_key(docs["text"]) == gone["_key"]), "left")
    rest = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(numbers, i)), "\n")
    new = {"text": F.when(numbers.isNull(), docs["text"]).otherwise(rest)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(numbers.isNull(), docs["n_chars"]).otherwise(F.length(rest).cast(docs.schema["n_chars"].dataType))
    return met.where(numbers.isNull() | rest.rlike(r"\S")).select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
