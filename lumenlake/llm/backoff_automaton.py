"""Language-model scores by a weighted backoff automaton over n-grams of the whole corpus.

The model is a hierarchical Dirichlet one: with c the counts in the training documents, h a history and h' the history
without its first token,

    p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu),    p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),

V the distinct tokens and one more for all that are unknown; so every history's probabilities sum to one.  As an
automaton, every history that was seen is a state.  An n-gram that was seen is an arc with the weight log10 p and leads to the
longest history that its end makes.  Where a state has no arc for a token, its failure arc leads to the state of the shorter
history and weighs log10(mu / (c(h) + mu)).  A text is read once from left to right, from the state of its
beginning: the state is carried from token to token and the weights are added up.

Nothing of the model's size reaches the driver, a broadcast or one task:

1. Documents are cut into blocks of about BLOCK characters; texts are tokenised once and kept as numbers.
2. A block sends each of its different n-grams once, with its count in the block's training documents, to a shard chosen
   by the n-gram's hash.  Shards, of about SHARD n-grams, add up.  As a block names an n-gram once, no n-gram, however frequent, can
   make a shard large before it stands in millions of blocks.
3. A shard answers each block with the sums in the order of the block's own list.
4. A block builds the part of the automaton that its documents can reach, with the weights of the whole, and reads them.

Tokens are bytes between the six ASCII blanks, A-Z as a-z, then one end per text.  They are told apart by 64-bit hashes: among ten million
different words the chance that any two agree is below one in 300,000; n-grams have 64 bits too.

Defined cases: a null text is empty and has its end as only token; a null doc_id is not held out; rows with the same doc_id are
documents of their own; without training documents N is 0 and every token unknown; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import write_table

#: Characters of a block, n-grams of a shard.
BLOCK, SHARD = 3_000_000, 2_000_000
#: Longest n-gram, and the weight of the shorter history in tokens.
ORDER, MU = 2, 200.0
#: Added to each count of single tokens.
ADDED = 0.1
#: Tokens that no text can hold: a blank ends texts, another begins them.
END, BEGIN = b"\n", b" "
BLOCKS = "block long, docs array<long>, held array<boolean>, lengths array<int>, trained long, words binary, tokens binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes as hold the largest; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


# 1: blocks


def _cut(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        code: dict[bytes, int] = {END: 0, BEGIN: 1}
        docs, held, tokens, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code), np.uint64, len(code))
            lengths = [len(t) for t in tokens]
            trained = sum(n for n, h in zip(lengths, held, strict=True) if not h)
            packed = zstandard.ZstdCompressor(level=1).compress(np.concatenate(tokens).astype("<u4").tobytes())
            row = [[number], [docs], [held], [lengths], [trained], [words.astype("<u8").tobytes()], [packed]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or b"").lower().split()
                words.append(END)
                tokens.append(np.fromiter((code.setdefault(w, len(code)) for w in words), np.uint32, len(words)))
                docs.append(doc_id)
                held.append(out)
                size += len(text.as_py() or b"") + 1
                if size >= chars:
                    yield block()
                    number += 1
                    code = {END: 0, BEGIN: 1}
                    docs, held, tokens, size = [], [], [], 0
        if docs:
            yield block()

    return run


# 2-4: n-grams of a block


class Block:
    """N-grams of a block's texts.  `grams[n]` holds the different n-grams: key, last token, the numbers of the (n-1)-grams that begin and end it, count here."""

    def __init__(self, row, order: int) -> None:
        self.docs, self.held, self.lengths = list(row["docs"]), np.array(row["held"], bool), np.array(row["lengths"], np.int64)
        words = np.frombuffer(row["words"], "<u8")
        self.tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<u4").astype(np.int64)
        ends = np.cumsum(self.lengths + 1)
        begins = ends - self.lengths - 1
        stream = np.ones(int(ends[-1]), np.int64)
        inner = np.ones(len(stream), bool)
        inner[begins] = False
        stream[inner] = self.tokens
        trains = np.repeat(~self.held, self.lengths + 1)
        since = np.arange(len(stream)) - np.repeat(begins, self.lengths + 1)
        self.grams = {1: {"key": words, "count": np.bincount(stream[trains], minlength=len(words)), "last": np.arange(len(words))}}
        key, number = words[stream], stream
        for n in range(2, order + 1):
            at = np.flatnonzero(since >= n - 1)
            key_now = np.zeros(len(stream), np.uint64)
            key_now[at] = _mixed(key[at - 1], words[stream[at]])
            keys, first, inverse = np.unique(key_now[at], return_index=True, return_inverse=True)
            place = at[first]
            self.grams[n] = {"key": keys, "count": np.bincount(inverse[trains[at]], minlength=len(keys)), "last": stream[place], "begin": number[place - 1], "end": number[place]}
            numbered = np.full(len(stream), -1)
            numbered[at] = inverse
            key, number = key_now, numbered

    def dealt(self, shards: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(shard, n, numbers of the n-grams that go there)."""
        for n, g in self.grams.items():
            shard = ((g["key"] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                yield int(shard[own[0]]), n, own


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two; the order counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sent(order: int, shards: int):
    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in blocks:
            for _, row in part.iterrows():
                block = Block(row, order)
                rows = [(shard, row["block"], n, block.grams[n]["key"][own].astype("<u8").tobytes(), _narrow(block.grams[n]["count"][own])) for shard, n, own in block.dealt(shards)]
                yield pd.DataFrame(rows, columns=["shard", "block", "n", "keys", "counts"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's sums, in the order of each block's list; known counts the shard's different tokens of training texts."""
    out = []
    for n, part in rows.groupby("n"):
        keys, inverse = np.unique(np.concatenate([np.frombuffer(k, "<u8") for k in part["keys"]]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_wide(c) for c in part["counts"]]), len(keys)).astype(np.int64)
        known = int((total[keys != xxhash.xxh3_64_intdigest(BEGIN)] > 0).sum()) if n == 1 else 0
        at = 0
        for i, (block, k) in enumerate(zip(part["block"], part["keys"], strict=True)):
            out.append((block, rows["shard"].iloc[0], n, _narrow(total[inverse[at : at + len(k) // 8]]), 0 if i else known))
            at += len(k) // 8
    return pd.DataFrame(out, columns=["block", "shard", "n", "totals", "known"])


# 4: the automaton


class Automaton:
    """States by number; arcs by state * codes + token.  State 0 has no history; those of n tokens follow those of fewer."""

    def __init__(self, grams: dict[int, dict[str, np.ndarray]], total: int, known: int, mu: float) -> None:
        order, self.codes = max(grams), len(grams[1]["key"])
        first = np.cumsum([0, 1, *[len(grams[n]["key"]) for n in range(1, order)]])
        self.base = np.log10((grams[1]["total"] + ADDED) / (total + ADDED * (known + 1)))
        p = 10**self.base
        seen = grams[1]["total"] > 0
        keys, weights = [np.arange(self.codes)], [self.base]
        leads = [np.where(seen, first[1] + np.arange(self.codes), 0) if order > 1 else np.zeros(self.codes, np.int64)]
        fails, penalties = [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(2, order + 1):
            g, shorter = grams[n], grams[n - 1]
            history = shorter["total"][g["begin"]]
            p = (g["total"] + mu * p[g["end"]]) / (history + mu)
            arc = np.flatnonzero(g["total"] > 0)
            keys.append((first[n - 1] + g["begin"][arc]) * self.codes + g["last"][arc])
            weights.append(np.log10(p[arc]))
            leads.append(first[n] + arc if n < order else first[n - 1] + g["end"][arc])
            fails.append(np.zeros(self.codes, np.int64) if n == 2 else first[n - 2] + shorter["end"])
            penalties.append(np.log10(mu / (shorter["total"] + mu)))
        self.arcs = dict(zip(np.concatenate(keys).tolist(), zip(np.concatenate(weights).tolist(), np.concatenate(leads).tolist(), strict=True), strict=True))
        self.fails, self.penalties = np.concatenate(fails).tolist(), np.concatenate(penalties).tolist()
        self.begin = int(first[1] + 1) if order > 1 and grams[1]["total"][1] > 0 else 0

    def score(self, tokens: list[int]) -> float:
        """log10 probability of a text, read once from left to right."""
        arcs, fails, penalties, codes = self.arcs, self.fails, self.penalties, self.codes
        state, score = self.begin, 0.0
        for token in tokens:
            while (arc := arcs.get(state * codes + token)) is None:
                score += penalties[state]
                state = fails[state]
            score += arc[0]
            state = arc[1]
        return score


def _read(order: int, shards: int, total: int, known: int, mu: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = {(s, n): t for s, n, t in zip(answers["shard"], answers["n"], answers["totals"], strict=True)}
        out = []
        for _, row in blocks.iterrows():
            block = Block(row, order)
            for g in block.grams.values():
                g["total"] = np.zeros(len(g["key"]), np.int64)
            for shard, n, own in block.dealt(shards):
                block.grams[n]["total"][own] = _wide(found[shard, n])
            automaton = Automaton(block.grams, total, known, mu)
            ends = np.cumsum(block.lengths)
            base = np.add.reduceat(automaton.base[block.tokens], ends - block.lengths)
            seen = np.add.reduceat((block.grams[1]["total"][block.tokens] > 0).astype(np.int64), ends - block.lengths)
            scores = [automaton.score(block.tokens[end - n : end].tolist()) for end, n in zip(ends.tolist(), block.lengths.tolist(), strict=True)]
            docs = pd.array([None if d is None or d != d else int(d) for d in block.docs], "Int64")
            out.append(pd.DataFrame({"doc_id": docs, "held_out": block.held, "n_tokens": block.lengths, "n_known": seen, "train_tokens": total, "base_score": base, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def scored(docs: DataFrame, held_out: str = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false)", order: int = ORDER, mu: float = MU) -> DataFrame:
    """A row per document, see OUT; the model learns from documents for which the SQL condition held_out fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(held_out).alias("held"), F.col("text").cast("binary").alias("text"))
    blocks = write_table(rows.mapInArrow(_cut(BLOCK), BLOCKS), "lm-blocks")
    sizes = blocks.agg(F.sum("trained").alias("trained"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    if sizes["tokens"] is None:
        return docs.sparkSession.createDataFrame([], OUT)
    shards = max(1, -(-sizes["tokens"] * order // SHARD))
    sent = blocks.mapInPandas(_sent(order, shards), "shard long, block long, n int, keys binary, counts binary")
    answers = write_table(sent.groupBy("shard").applyInPandas(_added, "block long, shard long, n int, totals binary, known long"), "lm-sums")
    known = answers.agg(F.sum("known")).first()[0]
    read = _read(order, shards, sizes["trained"], known, mu)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(read, OUT)
