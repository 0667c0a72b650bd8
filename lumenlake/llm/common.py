"""What the training-data operators share besides the library's own tables and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import tables
from lumenlake.operators.tables import drop_table, shared_dir, write_table

__all__ = ["PREFILTER_SLOTS", "SENT_EDGES", "components", "drop_table", "prefilter", "shared_dir", "write_table"]

#: Most rows that `prefilter` broadcasts: 2^20 of two longs, about 32 MB, at any input size.
PREFILTER_SLOTS = 1 << 20
#: Most edges of a round of `components` that broadcasts its pointers, about 2 MB at any input size: the shuffles of so few rows
#: take a task for each partition of the session and move next to nothing.
SENT_EDGES = 1 << 14


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, label); the last rounds, and all of a small table, without the exchanges of large ones."""
    return tables.components(edges, a, b, SENT_EDGES)


def prefilter(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be in wanted: all that are, and a few more.

    Keys are hashed to PREFILTER_SLOTS slots of 64 bits, of which each key sets two, so the broadcast side has a fixed
    bound.  It only spares the exact join behind it the shuffle of rows that cannot match.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(PREFILTER_SLOTS))
    bit = lambda c, n: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c, F.lit(n)), F.lit(64)).cast("int"))
    bits = lambda c: bit(c, 1).bitwiseOR(bit(c, 2))
    slots = wanted.select(slot(wanted_key).alias("_wanted"), bits(wanted_key).alias("_mask")).groupBy("_wanted").agg(F.bit_or("_mask").alias("_mask"))
    asked = rows.withColumns({"_slot": slot(key), "_bits": bits(key)})
    return asked.join(F.broadcast(slots), (F.col("_slot") == F.col("_wanted")) & (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_bits")), "left_semi").drop("_slot", "_bits")
