"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers floor(256 * x).  The index is cut into shards of about SHARD vectors.  A shard
keeps its postings in segments of one dimension and one impact, the component quantised to a multiple of STEP, as a list
of vectors each; zeros have no posting.  Segments are ordered by falling |impact|.  With each level of impact goes the length of
what it and those before it leave of every vector.

A block of queries takes the segments in order and adds their impacts to the scores of their vectors.  By the
Cauchy-Schwarz inequality a score is off by at most |query| * |rest of the vector|, so a vector whose upper bound is below
the k-th lower bound cannot be in the result.  The proof is tried where the impact has halved; a query stops only when it leaves few
vectors, or no segment is left; these are rescored from the exact integers, so the answer does not depend on
STEP or on when it stopped.

Every query meets every shard: queries go out in blocks of about QUERIES to each shard, where up to TOGETHER blocks meet
one copy of it; k rows per query and shard come back.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do
rows with a null vec_id; vectors of other lengths than the query's have no inner product with it; all rows that share the
query's vec_id are its own; query rows equal in vec_id and integers are one query, those of one vec_id that differ are queries
of their own; repeated candidates count as often as they occur; ties go to the
smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import write_table

#: Vectors of a shard, queries of a block, blocks that meet a copy of a shard, width of an impact step.
SHARD, QUERIES, TOGETHER, STEP = 8192, 512, 64, 16


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): v the integers floor(256 * x) of each sound vector."""
    sound = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.where(sound).select("vec_id", F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"))


class ShardIndex:
    """Posting segments of one shard by falling quantised impact, and what each level leaves of the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int = STEP) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], np.ascontiguousarray(vectors[order])
        level = np.abs(self.exact) // step
        impact = np.sign(self.exact) * (level * step + step // 2)
        vector, dim = np.nonzero(self.exact)
        value, height = impact[vector, dim], level[vector, dim]
        order = np.lexsort((vector, value, dim, -height))
        vector, dim, value, height = vector[order], dim[order], value[order], height[order]
        changes = np.flatnonzero((dim[1:] != dim[:-1]) | (value[1:] != value[:-1])) + 1
        starts = np.r_[0, changes] if len(vector) else np.zeros(0, np.int64)
        self.levels: list[tuple[list[tuple[int, int, np.ndarray]], np.ndarray]] = []
        rest, ends = self.exact.astype(np.float64), np.r_[starts[1:], len(vector)]
        heights = np.unique(height)[::-1]
        limit = heights[0] / 2 if len(heights) else 0
        for h, after in zip(heights, [*heights[1:], -1], strict=True):
            mine = np.flatnonzero(height[starts] == h)
            segments = [(int(dim[starts[s]]), int(value[starts[s]]), vector[starts[s] : ends[s]]) for s in mine]
            for d, v, at in segments:
                rest[at, d] -= v
            # lengths are kept only where the proof is to be tried
            self.levels.append((segments, np.linalg.norm(rest, axis=1) if after < limit or after < 0 else None))
            while limit > max(after, 0.5):
                limit /= 2
        self.postings = len(vector)
        #: Postings that `top` added up, over all queries.
        self.touched = 0

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the positions and exact scores of the k best."""
        n = len(self.ids)
        out: list = [None] * len(queries)
        left, score, q = np.arange(len(queries)), np.zeros((n, len(queries))), np.ascontiguousarray(queries.T.astype(np.float64))
        length = np.linalg.norm(queries.astype(np.float64), axis=1)
        for number, (segments, rest) in enumerate(self.levels or [([], np.zeros(n))]):
            for dim, impact, at in segments:
                score[at] += impact * q[dim]
                self.touched += len(at) * len(left)
            if rest is None:
                continue
            gap = rest[:, None] * length[None, left] * (1 + 1e-9) + 1e-6
            low = score - gap
            low[self.ids[:, None] == own[None, left]] = -np.inf
            floor = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(left), -np.inf)
            possible = score + gap >= floor[None, :]
            done = (possible.sum(axis=0) * 32 <= n) | (number + 1 >= len(self.levels))
            for row in np.flatnonzero(done):
                at = np.flatnonzero(possible[:, row])
                at = at[self.ids[at] != own[left[row]]]
                exact = self.exact[at] @ queries[left[row]]
                keep = np.lexsort((self.ids[at], -exact))[:k]
                out[left[row]] = (at[keep], exact[keep])
            left, score, q = left[~done], np.ascontiguousarray(score[:, ~done]), np.ascontiguousarray(q[:, ~done])
            if not left.size:
                break
        return out


def _probe(k: int):
    """Blocks of queries against the shard of their group."""

    def run(shards: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for dims, ids, packed in zip(shards["dims"], shards["ids"], shards["packed"], strict=True) if len(blocks) else ():
            index = ShardIndex(np.frombuffer(ids, np.int64), np.frombuffer(packed, np.int64).reshape(-1, dims))
            for q_ids, q_keys, q_packed in zip(blocks["q_ids"], blocks["q_keys"], blocks["q_packed"], strict=True):
                own, keys = np.frombuffer(q_ids, np.int64), np.frombuffer(q_keys, np.int64)
                best = index.top(np.frombuffer(q_packed, np.int64).reshape(-1, dims), own, k)
                found.append(pd.DataFrame({"query_id": np.repeat(own, n := [len(at) for at, _ in best]), "query": np.repeat(keys, n), "vec_id": index.ids[np.concatenate([at for at, _ in best])], "score": np.concatenate([x for _, x in best])}))
        return pd.concat(found)

    return run


def _pack(keys: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = {c: [rows[c].iloc[0]] for c in keys}
        return pd.DataFrame(head | {"ids": [rows["vec_id"].to_numpy(np.int64).tobytes()]} | ({"keys": [rows["key"].to_numpy(np.int64).tobytes()]} if "key" in rows else {}) | {"packed": [np.stack(rows["v"].to_numpy()).astype(np.int64).tobytes()]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with every vector but its own."""
    found = write_table(whole_numbers(vectors).withColumn("dims", F.size("v")), "vectors")
    n = max(1, -(-found.count() // SHARD))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    shards = found.withColumn("shard", shard).groupBy("shard", "dims").applyInPandas(_pack(["shard", "dims"]), "shard int, dims int, ids binary, packed binary")
    asked = whole_numbers(queries).distinct().withColumns({"dims": F.size("v"), "key": F.xxhash64("v")})
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block", "dims").applyInPandas(_pack(["block", "dims"]), "block int, dims int, ids binary, keys binary, packed binary")
    together = F.floor(F.col("block") / TOGETHER).cast("int").alias("batch")
    asked = asked.select("dims", together, F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("packed").alias("q_packed"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"))
    batches = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // TOGETHER))).alias("batch")
    keys = ["shard", "dims", "batch"]
    part = shards.select("*", batches).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_probe(k), "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
