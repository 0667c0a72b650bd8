"""Substring deduplication by line or paragraph hashing.

A text is cut into units: paragraphs (at empty lines), lines, or sentence lines, which end at a line
end or after a full stop, exclamation or question mark that a blank follows.  Sentence lines are the default because a
passage copied into the middle of a long line shares no whole line with its source, but does share
its inner sentences.  Units are normalised (lower case, single blanks), digested to 128 bits and grouped
over the whole corpus; of each digest the occurrence in the smallest doc_id, and in it the first, stays,
all others are removed and reported with their offsets in the original text.

A unit of fewer than min_words words repeats by chance.  Neighbouring units of that kind are taken together as one run,
which ends at a longer unit and, for sentences, at a line's end; so passages of short sentences are
matched by their runs.  A run of fewer than min_words words is left alone.

Digests, not texts, are shuffled; counts are combined before the shuffle, and the join of occurrences
to repeated digests is an inner join, which Spark splits where one digest holds many rows.

Defined cases: runs of fewer than min_words words are neither matched nor removed, with min_words 1 every unit is matched; a null or empty text
has no units; a null doc_id ranks last; rows with equal doc_id, or without one, rank by a hash of their texts, and only rows
that are equal in both are one document and keep what it keeps; repeats inside a document are removed after the first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import write_table
from lumenlake.llm.spans import text_key, without_spans

#: Units with fewer words are matched in runs.
MIN_WORDS = 6
BREAKS = {"paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "line": re.compile(r"\n"), "sentence": re.compile(r"[.!?]+(?=\s)|\n")}
#: Texts that one step of a task holds digests for.
_STEP = 256


def units(text: str, unit: str, min_words: int = 1) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(number, start, end, digest, words) of each unit or run of short units, outer blanks left out; the number is that of the first unit."""
    at = number = 0
    run: list[tuple[int, int, int, list[str]]] = []

    def ended() -> Iterator[tuple[int, int, int, bytes, int]]:
        if run:
            words = [w for *_, own in run for w in own]
            yield run[0][0], run[0][1], run[-1][2], hashlib.blake2b(" ".join(words).lower().encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(words)
            run.clear()

    for end in [*(m.end() for m in BREAKS[unit].finditer(text)), len(text)]:
        piece = text[at:end]
        if words := piece.split():
            start = at + len(piece) - len(piece.lstrip())
            if run and (len(words) >= min_words or len(run[-1][3]) >= min_words):
                yield from ended()
            run.append((number, start, start + len(piece.strip()), words))
            number += 1
        if unit == "sentence" and piece.endswith("\n"):
            yield from ended()
        at = end
    yield from ended()


def _cut(unit: str, min_words: int):
    names = ["doc_id", "text_key", "unit", "start", "end", "words", "digest", "again"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = []
                part = batch.slice(at, _STEP)
                for doc_id, key, text in zip(*(part[c].to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
                    seen: set[bytes] = set()
                    for n, start, end, digest, words in units(text, unit, min_words):
                        if words >= min_words:
                            rows.append((doc_id, key, n, start, end, words, digest, digest in seen))
                            seen.add(digest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    return run


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit or run: doc_id, text_key, unit (the first's number), start, end, words, kept_doc_id."""
    rows = docs.where("text is not null").select("doc_id", text_key().alias("text_key"), "text")
    schema = "doc_id long, text_key long, unit int, start int, end int, words int, digest binary, again boolean"
    cut = write_table(rows.mapInArrow(_cut(unit, min_words), schema), "units")
    rank = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("doc"), "text_key")
    known = cut.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a table of its own, so that the join reads both sides from exchanges that Spark can split at a hot digest
    known = write_table(known, "repeated")
    gone = cut.join(known, "digest").where((rank > F.col("first")) | F.col("again"))
    return gone.select("doc_id", "text_key", "unit", "start", "end", "words", F.when(F.col("first.doc") < 2**63 - 1, F.col("first.doc")).alias("kept_doc_id"))


def deduplicated(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated units cut out of their texts."""
    return without_spans(docs, repeated_units(docs, unit, min_words))
