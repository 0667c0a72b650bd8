"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A document is contaminated by a test item if WINDOW consecutive tokens of the two, laid side by side,
differ in at most MOST places.  MASKS are three fixed seeds of six token positions each; between
them any WINDOW tokens with MOST substitutions hold one seed without a substitution, so equal seed hashes
find every such passage.  The hits of a document and an item give one row with the shifts between them, each a diagonal
along which the tokens are compared and the best window counted; of the document, the row holds what the diagonals reach.

Test hashes are broadcast only while their count is at most BROADCAST_ROWS; beyond it the training hashes
are first cut down by a slot table of fixed size and then joined by a shuffle.

An item of fewer than WINDOW tokens has no window of its own: it is looked for whole, without a substitution, by one
hash of all its tokens.

Tokens are runs of letters or digits in lower case.  Defined cases: null and empty texts have no tokens and match nothing; a
document of fewer tokens than the item's window holds no passage of it; rows with a null doc_id cannot be named
in a result but are compared by `decontaminated`; equal doc_id with different texts are compared apart and reported once;
repeated items count once per item_id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import prefilter, write_table

WINDOW, MOST = 12, 2
#: Found by enumeration: lossless for 12 tokens with 2 substitutions (tests/llm checks it).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 8, 9))
#: Rows of test hashes that may be broadcast, about 32 MB.
BROADCAST_ROWS = 500_000
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, row_key, at, h): the seeds of each row, with the token at which each begins.

    A seed that reaches over the end leaves the missing tokens out of its hash, on both sides alike.
    """
    hashed = rows.select(*keys, "row_key", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")).where(F.size("hashes") >= WINDOW)
    seeds = lambda i: F.array(*[F.xxhash64(F.lit(n), *[F.get("hashes", i + p) for p in mask]) for n, mask in enumerate(MASKS)])
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hashes") - (min(m[-1] for m in MASKS) + 1)), seeds))
    place = hashed.select(*keys, "row_key", F.posexplode(each).alias("at", "h"))
    return place.withColumn("at", F.floor(F.col("at") / len(MASKS)).cast("int"))


def _passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, best, equal) of each diagonal with a passage; row_key is the hash of the document's text."""
    words = tokens("text").alias("tokens")
    test = items.where("item_id is not null").select("item_id", F.xxhash64("text").alias("row_key"), words).distinct()
    test = write_table(test, "items")
    train = docs.select("doc_id", F.xxhash64("text").alias("row_key"), words)
    found = _near(train, test.where(F.size("tokens") >= WINDOW))
    # one number for each length below WINDOW that occurs
    lengths = sorted(r["n"] for r in test.select(F.size("tokens").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    return found.unionByName(_whole(train, test.where(F.size("tokens") < WINDOW), lengths)) if lengths else found


def _whole(train: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """Documents that hold all tokens of a short item, one after the other."""
    probes = short.select("item_id", F.col("tokens").alias("item_tokens"), F.xxhash64("tokens").alias("h"))
    n = F.size("tokens")
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.slice("tokens", i + 1, k)))
    each = F.array_distinct(F.flatten(F.array(*[F.coalesce(runs(k), F.array().cast("array<array<string>>")) for k in lengths])))
    held = train.select("doc_id", "row_key", F.explode(each).alias("run")).withColumn("h", F.xxhash64("run"))
    if short.count() <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    else:
        held = prefilter(held, "h", probes, "h")
    met = held.join(probes, "h").where(F.col("run") == F.col("item_tokens"))
    return met.select("doc_id", "row_key", "item_id", F.size("run").cast("long").alias("best"), F.size("run").cast("long").alias("equal"))


def _near(train: DataFrame, test: DataFrame) -> DataFrame:
    """The same for items of WINDOW tokens or more."""
    probes = _windows(test.withColumn("item_n", F.size("tokens")), "item_id", "item_n")
    probes = probes.select("item_id", F.col("row_key").alias("item_key"), "item_n", F.col("at").alias("item_at"), "h").distinct()
    probes = write_table(probes, "item-seeds")
    seeds = _windows(train, "doc_id")
    if probes.count() <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    else:
        seeds = prefilter(seeds, "h", probes, "h")
    hits = seeds.join(probes, "h").withColumn("shift", F.col("at") - F.col("item_at"))
    # a document and an item have fewer diagonals than tokens, so a set of them is no longer than the text
    hits = hits.groupBy("doc_id", "row_key", "item_id", "item_key", "item_n").agg(F.collect_set("shift").alias("shifts"))
    hits = write_table(hits, "hits")
    # only documents with a hit are compared, and only from the first token that a diagonal meets to the last
    near = prefilter(train.withColumnRenamed("tokens", "doc_tokens"), "doc_id", hits, "doc_id")
    hits = hits.withColumnsRenamed({"doc_id": "_doc", "row_key": "_key"})
    hits = hits.withColumns({"from": F.greatest(F.lit(0), F.array_min("shifts")), "upto": F.array_max("shifts") + F.col("item_n")})
    near = near.join(hits, near["doc_id"].eqNullSafe(hits["_doc"]) & (near["row_key"] == hits["_key"]))
    reach = F.slice("doc_tokens", F.col("from") + 1, F.greatest(F.lit(0), F.col("upto") - F.col("from")))
    shifts = F.transform("shifts", lambda s: s - F.col("from"))
    near = near.select("doc_id", "row_key", "item_id", "item_key", reach.alias("doc_tokens"), shifts.alias("shifts"))
    near = near.join(test.select("item_id", F.col("row_key").alias("item_key"), "tokens"), ["item_id", "item_key"])
    near = near.select("doc_id", "row_key", "item_id", _judged().alias("passages")).where(F.size("passages") > 0)
    most = lambda name: F.array_max(F.transform("passages", lambda v: v[name])).cast("long").alias(name)
    return near.select("doc_id", "row_key", "item_id", most("best"), most("equal"))


def _judged() -> Column:
    """(best, equal) of each of `shifts` along which tokens and doc_tokens hold a passage, one diagonal at a time."""
    first = lambda s: F.greatest(F.lit(0), -s)
    end = lambda s: F.least(F.size("tokens"), F.size("doc_tokens") - s)
    count = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)
    same = lambda s: F.transform(F.sequence(first(s), end(s) - 1), lambda j: (F.get("tokens", j) == F.get("doc_tokens", j + s)).cast("int"))
    windows = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: count(F.slice(x, i, WINDOW)))
    # an array of one binds what is used twice
    judged = lambda s: F.transform(F.array(same(s)), lambda x: F.struct(F.array_max(windows(x)).alias("best"), count(x).alias("equal")))
    long = F.filter("shifts", lambda s: end(s) - first(s) >= WINDOW)
    return F.filter(F.flatten(F.transform(long, judged)), lambda v: v["best"] >= WINDOW - MOST)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, best, equal): equal tokens in the best window of WINDOW, and along its whole diagonal at most."""
    return _passages(docs.where("doc_id is not null"), items).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.max("equal").alias("equal"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a passage of a test item."""
    found = _passages(docs, items).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")
