"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 1, 2, 3 and so on in turn and share the
whole of all sizes; a target stops at `most` times its source's size and the excess is reshared by weight.

Copies: within a source, document i is expected min(most, k * size) times, with k such that the
expected words are the target.  The whole part is certain.  For the fraction p the documents are
ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of the id, and the sample is the first part of that order
that comes nearest the words left over: its size is fixed in words, not in documents.

A source can hold a third of all rows, so no window runs over a source's rows.  The order is cut
into BINS bins, sums by bin find the bin of the cut, and only its rows are ordered.

Defined cases: a null text or one without a word has size 0 and is never taken; a null source is a
source of its own, last in order; rows with the same doc_id share their u and are ordered by a hash of their texts, and of rows
equal in both as many are taken as the target leaves room for; a null doc_id counts as the text 'null'; an empty table gives an empty result.  Columns of the input named
like a computed one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import write_table
from lumenlake.llm.spans import text_key

#: Words, as the contract has them.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the Pareto order in a source; rows of one of them are ordered.
BINS = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(4503599627370496.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of a table with source and size; one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", turn.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # taking too few or too many sources for full gives a lower level, so the highest one is right
    by = by.withColumn("share", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    return by.select("source", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def _source_rates(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """targets with k, the expected copies per word of size; null where all documents stop at `most`."""
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    words, squares = F.col("n") * F.col("size"), (F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")).cast("decimal(38,0)")
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    at = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(sizes["source"], "size", "n", "target")
    at = at.withColumn("full", F.coalesce(F.sum(words).over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    before = F.coalesce(F.sum(squares).over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,0)"))
    at = at.withColumn("rest", (F.sum(squares).over(Window.partitionBy("source")) - before).cast("double"))
    at = at.withColumn("k", (F.col("target") - F.lit(float(most)) * F.col("full")) / F.col("rest"))
    rates = at.where(F.col("k") * F.col("size") <= most).groupBy("source").agg(F.max_by("k", "size").alias("k"))
    return targets.join(rates, targets["source"].eqNullSafe(rates["source"]), "left").select(targets["*"], "k")


def _ranked(sized: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """sized with source_size, target, copies (whole) and z, the place in Pareto order in (0, 1); z null if no fraction is left."""
    out = sized.join(rates.withColumnRenamed("source", "_source"), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("k") * F.col("size"), F.when(F.col("size") > 0, float(most)).otherwise(0.0)))
    out = out.withColumn("_e", expected).withColumn("copies", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("copies"))
    u = uniform(F.col("doc_id"))
    odds = (u / (1.0 - u)) / (F.col("_p") / (1.0 - F.col("_p")))
    return out.withColumn("z", F.when(F.col("_p") > 0, odds / (1.0 + odds))).drop("k", "_e", "_p")


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source, cut): the last step of each source's order that is taken once more, and how many of its n equal rows."""
    place = F.least(F.floor(F.col("z") * BINS), F.lit(BINS - 1))
    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    bins = ranked.where("z is not null").groupBy("source", place.alias("bin")).agg(F.sum("size").alias("words"))
    bins = bins.join(left.withColumnRenamed("source", "_source"), bins["source"].eqNullSafe(F.col("_source"))).drop("_source")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # the bin in which the words run out; where they last for all bins, the last one
    at = bins.where("before < left").groupBy("source").agg(F.max_by(F.struct("bin", "before", "left"), "bin").alias("at")).select(F.col("source").alias("_source"), "at.*")
    rows = ranked.where("z is not null").join(at, F.col("source").eqNullSafe(F.col("_source")) & (place == at["bin"]))
    # equal rows are one step, of which a part may be taken
    steps = rows.groupBy("source", "z", _doc().alias("d"), "key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("left").alias("left"))
    inner = Window.partitionBy("source").orderBy("z", "d", "key").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(inner), F.lit(0))
    steps = steps.withColumn("take", F.least(F.col("n"), F.floor(room / F.col("size") + 0.5))).where("take > 0")
    cut = steps.groupBy("source").agg(F.max(F.struct("z", "d", "key", "take", "n")).alias("cut"))
    # no row of the bin fits: all before the bin are taken
    return at.join(cut.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_source").alias("source"), F.coalesce(F.col("cut"), F.struct((F.col("bin") / BINS).alias("z"), F.lit(-(2**63)).alias("d"), F.lit(-(2**63)).alias("key"), F.lit(0).cast("long").alias("take"), F.lit(0).cast("long").alias("n"))).alias("cut"))


def _doc() -> Column:
    """doc_id for ordering: null last."""
    return F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))


def _decided(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (doc_id, source, size, key, perhaps row) with source_size, target and copies, as the rows of sized decide."""
    rates = write_table(_source_rates(sized, source_targets(sized, weights, most), most), "mix-rates")
    cuts = write_table(_cuts(_ranked(sized, rates, most)), "mix-cuts")
    rows = _ranked(rows, rates, most)
    rows = rows.join(cuts.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")), "left")
    place, end = F.struct("z", _doc().alias("d"), "key"), F.struct("cut.z", "cut.d", "cut.key")
    torn = (place == end) & (F.col("cut.take") < F.col("cut.n"))
    out = rows.withColumn("copies", F.col("copies") + F.coalesce((F.col("z").isNotNull() & (place <= end)).cast("long"), F.lit(0)))
    if not cuts.where("cut.take < cut.n").isEmpty():
        # rows that nothing tells apart are numbered, each part of the table by itself
        equal = write_table(rows.where(torn).withColumn("_part", F.spark_partition_id()), "mix-ties")
        counts = equal.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_rows"))
        ahead = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
        own = F.row_number().over(Window.partitionBy("_source", "_part").orderBy(F.lit(0)))
        equal = equal.withColumn("_row", own).join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        more = (F.col("_row") + F.col("_ahead") <= F.col("cut.take")).cast("long")
        out = out.where(~F.coalesce(torn, F.lit(False))).unionByName(equal.withColumn("copies", F.col("copies") + more).select(*out.columns))
    return out.drop("z", "cut", "key", "_source")


def _sizes(docs: DataFrame) -> DataFrame:
    return write_table(docs.select("doc_id", "source", word_count("text").alias("size"), text_key().alias("key")), "mix-sizes")


def _with_rows(docs: DataFrame) -> DataFrame:
    """Each document with its whole row set aside, so that no column of it can clash."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), text_key().alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, narrow: bool = False) -> DataFrame:
    """docs with size, source_size, target and copies (0 to most); copies is how often the mix takes the row.

    narrow: return doc_id, source and the computed columns alone, without a second pass over the texts.
    """
    sized = _sizes(docs)
    if narrow:
        return _decided(sized, sized, weights, most)
    out = _decided(_with_rows(docs), sized, weights, most)
    made = ["size", "source_size", "target", "copies"]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *made)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its columns and `copy`, from 1."""
    out = _decided(_with_rows(docs), _sizes(docs), weights, most).where("copies > 0")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
