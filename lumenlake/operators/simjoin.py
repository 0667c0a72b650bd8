"""Pairs of 64-bit hashes within a Hamming distance, and the groups they form.

Of the t + 1 blocks into which a hash is cut, two hashes within t bits agree on one at least, so a row for each block goes to the
other hashes that share it.  What is left of the hash is cut the same way there, in memory, so that only t + 1 rows a hash are
shuffled while two blocks select what is compared; a pair is kept in its first agreeing blocks only.

A block that very many hashes share would be a group without bound.  Its hashes meet by an equi-join: of t + k blocks two hashes agree
on k at least, so every choice of k blocks is a key.  k grows as t shrinks, so that the keys stay selective.  A block takes every (t + k)-th
bit, so that runs of bits in which hashes vary little spread over all blocks.  Equal hashes, of a scope or over all of them, are one vertex from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.tables import components, drop_table, exchanged, write_table

#: Bits that set too few or too many bits to tell images apart.
FLAT_BITS = 2
#: Hashes of a chunk; two chunks are compared at once, in a table of CHUNK * CHUNK distances.
CHUNK = 1024
#: Hashes that share a block and are compared in one task; where more share it, they meet by a join.
MOST_SHARED = 1 << 16
#: Rows taken together, and pairs sent together.
STEP = 1 << 17


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def degenerate(name: str) -> Column:
    ones = F.bit_count(name)
    return (ones <= FLAT_BITS) | (ones >= 64 - FLAT_BITS)


def label(name: str) -> Column:
    """Sixteen hexadecimal digits of the unsigned hash."""
    return F.lpad(F.lower(F.hex(name)), 16, "0")


def masks(most: int) -> list[int]:
    """Masks, as signed numbers, of which two hashes within `most` bits agree on one at least."""
    together = 3 if most <= 4 else 2 if most <= 6 else 1
    n = most + together
    blocks = [sum(1 << bit for bit in range(i, 64, n)) for i in range(n)]
    whole = [sum(c) for c in combinations(blocks, together)]
    return [_signed(m) for m in whole]


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of these bits."""
    return [sum(1 << bit for bit in bits[i::n]) for i in range(n)]


def blocks(most: int) -> list[tuple[int, list[int]]]:
    """Masks, as unsigned numbers, of the blocks of a hash, each with those of the rest: two hashes within `most` bits agree on a block, and on one of its rest."""
    outer = _cut(list(range(64)), most + 1)
    return [(m, _cut([bit for bit in range(64) if not m >> bit & 1], most + 1)) for m in outer]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _close(h: np.ndarray, group: np.ndarray, block: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of hashes of a group within `most` bits that agree on no block before the group's."""
    known = blocks(most)
    for c in np.unique(block).tolist():
        at = np.flatnonzero(block == c)
        own, number = h[at], group[at].astype(np.uint64)
        for i, mask in enumerate(known[c][1]):
            # equal keys stand together; the few that are equal by chance are told apart below
            key = (own & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) ^ number * np.uint64(0xC2B2AE3D27D4EB4F)
            order = np.argsort(key)
            key = key[order]
            left, step = np.flatnonzero(key[1:] == key[:-1]), 1
            while left.size:
                x, y = order[left], order[left + step]
                differ = own[x] ^ own[y]
                ok = (np.bitwise_count(differ) <= most) & (number[x] == number[y]) & (differ & np.uint64(mask) == 0)
                for before in [m for m, _ in known[:c]] + known[c][1][:i]:
                    ok &= differ & np.uint64(before) != 0
                if ok.any():
                    yield at[x[ok]], at[y[ok]]
                step += 1
                left = left[left + step < len(key)]
                left = left[key[left + step] == key[left]]


def _shared(most: int, keys: list[str]):
    """Function of rows (..., block) in order of keys, block and the block's bits: pairs of rows, and with their block the rows of a block that too many share."""
    outer = np.array([m for m, _ in blocks(most)], np.uint64)

    def starts(rows: pa.Table) -> np.ndarray:
        block = rows["block"].to_numpy()
        parts = [rows[k].to_numpy() for k in keys] + [block, rows["hash"].to_numpy().view(np.uint64) & outer[block]]
        return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([p[1:] != p[:-1] for p in parts])]))

    def paired(rows: pa.Table, x: np.ndarray, y: np.ndarray | None) -> pa.RecordBatch:
        one, other = rows.take(x), None if y is None else rows.take(y)
        found = {"block": one["block"] if y is None else pa.nulls(len(x), rows["block"].type)}
        for c in rows.column_names[:-1]:
            found |= {f"{c}_a": one[c], f"{c}_b": pa.nulls(len(x), rows[c].type) if y is None else other[c]}
        return pa.table(found).combine_chunks().to_batches()[0]

    def pairs_of(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        vertex, held, n = rows["vertex"].to_numpy(), [], 0
        for x, y in _close(rows["hash"].to_numpy().view(np.uint64), group, rows["block"].to_numpy(), most):
            x, y = np.where(vertex[x] < vertex[y], x, y), np.where(vertex[x] < vertex[y], y, x)
            apart = vertex[x] != vertex[y]
            held.append((x[apart], y[apart]))
            n += len(held[-1][0])
            if n >= STEP:
                yield paired(rows, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield paired(rows, *map(np.concatenate, zip(*held, strict=True)))

    def place(rows: pa.Table, i: int) -> list:
        block = rows["block"][i].as_py()
        return [*(rows[k][i].as_py() for k in keys), block, rows["hash"][i].as_py() & int(outer[block])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sent: the place of a group of which rows came back, as others share its block
        held, n, sent = [], 0, None
        for batch in chain(batches, [None]):
            last = batch is None
            if not last:
                held.append(batch)
                n += batch.num_rows
            if not n or n < STEP and not last:
                continue
            rows = pa.Table.from_batches(held)
            first = starts(rows)
            size = np.diff(np.append(first, n))
            many = size > MOST_SHARED
            many[0] |= sent == place(rows, 0)
            sent = place(rows, n - 1) if many[-1] else None
            # the last group may go on in the next batch
            ended = n if last or many[-1] else int(first[-1])
            group = np.repeat(np.arange(len(size)), size)[:ended]
            hot = np.flatnonzero(many[group])
            if hot.size:
                yield paired(rows, hot, None)
            few = np.flatnonzero((~many & (size > 1))[group])
            if few.size:
                yield from pairs_of(rows.take(few), group[few])
            held, n = rows.slice(ended).to_batches(), n - ended

    return run


def near(rows: DataFrame, most: int, keys: list[str], apart: Column | None = None) -> DataFrame:
    """All pairs of rows (vertex, hash, ...) within `most` bits that agree in keys, as columns _a and _b, vertex_a below vertex_b."""
    known = [_signed(m) for m, _ in blocks(most)]
    cut = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(known))])).alias("block"))
    value = F.col("hash").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in known]), F.col("block") + 1))
    there = cut.repartition(*keys, "block", value).withColumn("value", value).sortWithinPartitions(*keys, "block", "value").drop("value")
    schema = "block int, " + ", ".join(f"{c}_a {t}, {c}_b {t}" for c, t in rows.dtypes)
    found = there.mapInArrow(_shared(most, keys), schema)
    found = write_table(found if apart is None else found.where(F.col("block").isNotNull() | apart), "near")
    many = found.where("block is not null").select("block", *[F.col(f"{c}_a").alias(c) for c in rows.columns])
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(known)])
    met = _near_by_keys(many, most, [*keys, "block"], apart).where(first == F.col("block_a")).drop("block_a", "block_b")
    return found.where("block is null").drop("block").unionByName(met)


def _near_by_keys(rows: DataFrame, most: int, keys: list[str], apart: Column | None) -> DataFrame:
    """What `near` returns, by an equi-join on each choice of several blocks."""
    known = masks(most)
    cut = rows.select("*", F.posexplode(F.array(*[F.col("hash").bitwiseAND(F.lit(m)) for m in known])).alias("choice", "value"))
    side = lambda s: cut.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns], "choice", "value")
    x, y = side("a"), side("b")
    on = [x["choice"] == y["choice"], x["value"] == y["value"], F.col("vertex_a") < F.col("vertex_b")]
    on += [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys] + ([] if apart is None else [apart])
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(known)])
    # Spark takes exploded rows for as few as there were before
    return x.join(exchanged(y), [*on, F.when(distance("hash_a", "hash_b") <= most, first) == x["choice"]]).drop("choice", "value")


def pairs(rows: DataFrame, most: int, across: bool = False) -> DataFrame:
    """(a, b, scope_a, scope_b, distance) of rows (vertex, scope, hash) within `most` bits, a below b.

    Within a scope, or with across between different scopes; null scopes link to nothing.
    """
    known = rows.where("scope is not null and hash is not null")
    met = near(known, most, [], F.col("scope_a") != F.col("scope_b")) if across else near(known, most, ["scope"])
    return met.select(F.col("vertex_a").alias("a"), F.col("vertex_b").alias("b"), "scope_a", "scope_b", distance("hash_a", "hash_b").alias("distance"))


def groups_within(photos: DataFrame, most: int = 6) -> DataFrame:
    """(group_id, session_id, id): connected photos of a session, two at least; group_id is the lowest id."""
    some = photos.where("session_id is not null and phash is not null").select("id", "session_id", "phash")
    vertex = write_table(some.groupBy(F.col("session_id").alias("scope"), F.col("phash").alias("hash")).agg(F.min("id").alias("vertex")), "vertices")
    linked = _components_of(pairs(vertex, most), "a", "b")
    named = vertex.join(exchanged(linked), F.col("vertex") == F.col("node"), "left").select("scope", "hash", F.coalesce("label", "vertex").alias("group_id"))
    members = some.join(exchanged(named), (F.col("session_id") == F.col("scope")) & (F.col("phash") == F.col("hash"))).select("group_id", "session_id", "id")
    return _sized(members, ["group_id"])


def groups_across(photos: DataFrame, most: int = 4) -> DataFrame:
    """(group_id, session_id, id): photos that links between different sessions connect, flat hashes left out.

    A hash is one vertex over all sessions: where several sessions have it, its photos are connected, and two hashes are
    linked unless the same single session has both.
    """
    some = photos.where("session_id is not null and phash is not null").where(~degenerate("phash")).select("id", "session_id", "phash")
    vertex = some.groupBy(F.col("phash").alias("hash")).agg(F.min("id").alias("vertex"), F.min("session_id").alias("low"), F.max("session_id").alias("high"))
    vertex = write_table(vertex, "vertices")
    # null: several sessions have it
    one = vertex.select("hash", "vertex", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    linked = _components_of(near(one, most, [], F.coalesce(F.col("only_a") != F.col("only_b"), F.lit(True))), "vertex_a", "vertex_b")
    named = vertex.join(exchanged(linked), F.col("vertex") == F.col("node"), "left").where("label is not null or low < high")
    named = named.select("hash", F.coalesce("label", "vertex").alias("group_id"))
    return some.join(exchanged(named), F.col("phash") == F.col("hash")).select("group_id", "session_id", "id")


def _components_of(met: DataFrame, a: str, b: str) -> DataFrame:
    """Components of pairs that `near` found, whose table goes then."""
    linked = components(met, a, b)
    drop_table(met)
    return linked


def _sized(members: DataFrame, keys: list[str]) -> DataFrame:
    large = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return members.join(exchanged(large), keys, "left_semi")


def _linked(most: int):
    """Column function of two chunks of hashes with their vertices, and whether they are one chunk: links that connect all vertices within `most` bits.

    Of the pairs within `most` bits only as many come back as connect the same vertices: one fewer than there are at most.
    """

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def run(hash_a: pd.Series, vertex_a: pd.Series, hash_b: pd.Series, vertex_b: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for ha, va, hb, vb, one in zip(hash_a, vertex_a, hash_b, vertex_b, same, strict=True):
            ha, hb = np.asarray(ha, np.int64), np.asarray(hb, np.int64)
            near = np.bitwise_count((ha[:, None] ^ hb[None, :]).view(np.uint64)) <= most
            group_a, before = np.arange(len(ha)), None
            # each round takes the smallest group of all that are near over one hash of the other chunk
            while before is None or (group_a != before).any():
                before = group_a
                group_b = np.where(near, group_a[:, None], len(ha)).min(axis=0, initial=len(ha))
                if one:
                    group_b = np.minimum(group_b, group_a)
                group_a = np.minimum(group_a, np.where(near, group_b[None, :], len(ha)).min(axis=1, initial=len(ha)))
            links = [(va[i], va[g]) for i, g in enumerate(group_a.tolist()) if g != i]
            if not one:
                links += [(vb[j], va[g]) for j, g in enumerate(group_b.tolist()) if g < len(ha)]
            out.append([{"a": int(x), "b": int(y)} for x, y in links])
        return pd.Series(out)

    return run


def connecting_links(rows: DataFrame, most: int) -> DataFrame:
    """(a, b): links that connect the vertices of rows (scope, hash, vertex) whose hashes lie within `most` bits in one scope.

    Hashes of a scope must be distinct.  A scope of up to CHUNK of them is one cell; larger ones have a cell for each value of
    each of most + 1 blocks of bits, of which two hashes within `most` bits share one.  Cells are cut into chunks of about CHUNK
    hashes, and every two chunks of a cell are compared in one row; a row returns fewer links than it holds vertices.
    """
    n = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("_n"))
    met = rows.join(exchanged(n), "scope")
    edges = [64 * i // (most + 1) for i in range(most + 2)]
    cut = lambda i: F.concat_ws(":", F.lit(str(i)), F.substring(F.lpad(F.bin("hash"), 64, "0"), edges[i] + 1, edges[i + 1] - edges[i]))
    cells = F.when(F.col("_n") <= CHUNK, F.array(F.lit(""))).otherwise(F.array(*[cut(i) for i in range(most + 1)]))
    celled = write_table(met.select("scope", "hash", "vertex", F.explode(cells).alias("cell")), "cells")
    sizes = celled.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("chunks", F.ceil(F.col("_n") / CHUNK).cast("int")).drop("_n")
    chunk = F.pmod(F.xxhash64("hash"), F.col("chunks")).cast("int").alias("chunk")
    packed = celled.join(exchanged(sizes), ["scope", "cell"]).groupBy("scope", "cell", "chunks", chunk).agg(F.collect_list(F.struct("hash", "vertex")).alias("h"))
    packed = write_table(packed, "chunks")
    left = packed.select("scope", "cell", F.col("chunk").alias("i"), F.col("h").alias("x"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"))
    right = packed.select("scope", "cell", F.col("chunk").alias("j"), F.col("h").alias("y"))
    both = left.join(exchanged(right), ["scope", "cell", "j"])
    return both.select(F.inline(_linked(most)("x.hash", "x.vertex", "y.hash", "y.vertex", F.col("i") == F.col("j")))).select("a", "b")


def face_links(faces: DataFrame, photos: DataFrame, most: int = 10) -> DataFrame:
    """(a, b): links between photos of a session that connect all those that share a face's appearance within `most` bits.

    A hash of a session is one vertex, its smallest photo, to which its other photos are linked.  Hashes within `most` bits link
    their smallest photos: that loses nothing, since where these are the same photo, it alone joins the two.
    """
    rows = faces.join(exchanged(photos.select("id", "session_id")), F.col("photo_id") == F.col("id")).where("session_id is not null and appearance_hash is not null")
    held = write_table(rows.select(F.col("session_id").alias("scope"), F.col("appearance_hash").alias("hash"), "id").distinct(), "faces")
    vertex = held.groupBy("scope", "hash").agg(F.min("id").alias("vertex"))
    same = held.join(exchanged(vertex), ["scope", "hash"]).select(F.col("id").alias("a"), F.col("vertex").alias("b"))
    return same.unionByName(connecting_links(vertex, most)).where("a <> b")


def face_groups(faces: DataFrame, photos: DataFrame, most: int = 10) -> DataFrame:
    """(group_id, session_id, id): photos of a session that share a face's appearance within `most` bits."""
    linked = components(face_links(faces, photos, most))
    return photos.select("id", "session_id").join(exchanged(linked), F.col("id") == F.col("node")).select(F.col("label").alias("group_id"), "session_id", "id")
