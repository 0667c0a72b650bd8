"""Evaluation of classifiers: accuracy, confusion, calibration, over tables of logits and true labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.tables import write_table

#: The merged group of each raw scene group; a label that is missing here is other.
MERGED_GROUPS = {
    "nature": "nature",
    "nature_water": "nature",
    "urban": "urban",
    "indoor_home": "home_stay",
    "residential": "home_stay",
    "hotel": "home_stay",
    "indoor": "public_indoor",
    "indoor_cultural": "public_indoor",
    "indoor_retail": "public_indoor",
    "workplace": "public_indoor",
    "education": "public_indoor",
    "healthcare": "public_indoor",
    "religious": "faith_history",
    "historic": "faith_history",
    "sports": "sports_leisure",
    "sports_stadium": "sports_leisure",
    "food_dining": "food_night",
    "public_transport": "transport",
    "transport_vehicle": "transport",
    "industrial": "industry",
    "other": "other",
}


def merged_group(label: Column) -> Column:
    """Merged group of a raw scene group; other where the label is unknown or null."""
    known = F.create_map(*[F.lit(x) for pair in MERGED_GROUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(label, F.lit("other"))), F.lit("other"))


def marked_confusion(leaks: DataFrame, truth: str = "truth", top: str = "top") -> DataFrame:
    """Confusion leaks with same_merged: whether both labels fall into one merged group, so that merging hides the leak."""
    return leaks.withColumn("same_merged", merged_group(F.col(truth)) == merged_group(F.col(top)))


def softmax_top(logits: str) -> list[Column]:
    """Index of the first largest logit and its softmax probability."""
    top = F.array_max(logits)
    return [(F.array_position(logits, top) - 1).cast("int").alias("top"), (1 / F.aggregate(F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double"))), F.lit(0.0), lambda a, x: a + x)).alias("confidence")]


def ranked(logits: str) -> Column:
    """Classes by falling logit, ties to the smaller class."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def accuracy(rows: DataFrame, group: int = 1) -> DataFrame:
    """Top-1, top-5 and coarse accuracy in percent of rows (logits, truth: array of classes); coarse classes hold `group` fine ones."""
    order = rows.select(ranked("logits").alias("order"), "truth")
    first, five = F.element_at("order", 1), F.slice("order", 1, 5)
    coarse = lambda c: F.floor(c / group)
    hit = lambda c: 100.0 * F.avg(c.cast("double"))
    return order.agg(F.count(F.lit(1)).alias("n"), hit(F.array_contains("truth", first)).alias("top1"), hit(F.arrays_overlap("truth", five)).alias("top5"), hit(F.exists("truth", lambda t: coarse(t) == coarse(first))).alias("coarse"))


def confusion(rows: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent wrong pairs of (truth, top)."""
    wrong = rows.where("truth <> top").groupBy("truth", "top").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "top").limit(most)


def recalls(rows: DataFrame, support: int = 10, most: int = 15) -> DataFrame:
    """The classes of least recall among those with enough rows."""
    by = rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("top")).cast("double")).alias("recall"))
    return by.where(F.col("n") >= support).orderBy("recall", "truth").limit(most)


def region_audit(rows: DataFrame) -> DataFrame:
    """Accuracy of each region, and its distance to the best one."""
    by = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("top")).cast("double")).alias("accuracy"))
    return by.crossJoin(by.agg(F.max("accuracy").alias("_best"))).withColumn("gap", F.col("_best") - F.col("accuracy")).drop("_best")


#: First words of a query that name its region; any other query is global.
REGIONS = [
    "indian", "nigerian", "ethiopian", "kenyan", "egyptian", "moroccan", "chinese", "japanese", "korean", "vietnamese", "thai", "indonesian",
    "filipino", "turkish", "iranian", "arab", "israeli", "russian", "polish", "greek", "spanish", "portuguese", "italian", "mexican", "brazilian",
    "peruvian", "colombian", "argentinian", "cuban", "nepalese",
]


def region_of(query: str) -> Column:
    """The region that the first word of a query names, else global."""
    first = F.element_at(F.split(F.coalesce(F.col(query), F.lit("")), " "), 1)
    return F.when(first.isin(REGIONS), first).otherwise("global")


def region_delta(audited: DataFrame) -> DataFrame:
    """(regions, delta): how far the best region of a region audit is from the worst; null below two regions."""
    many, spread = F.count(F.lit(1)), F.max("accuracy") - F.min("accuracy")
    return audited.agg(many.alias("regions"), F.when(many > 1, spread).alias("delta"))


def merged_accuracy(rows: DataFrame) -> DataFrame:
    """(n, accuracy): rows (truth: array of labels, top: label) whose top falls into the merged group of a true label, in percent."""
    hit = F.array_contains(F.transform("truth", merged_group), merged_group(F.col("top")))
    return rows.agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.coalesce(hit, F.lit(False)).cast("double"))).alias("accuracy"))


def any_true(rows: DataFrame, truth: str, guess: str, key: str = "image_id") -> DataFrame:
    """Percent of keys whose guess is among the labels of any of their rows."""
    by = rows.groupBy(key).agg(F.max(F.coalesce(F.col(truth) == F.col(guess), F.lit(False)).cast("double")).alias("_hit"))
    return by.agg((100.0 * F.avg("_hit")).alias("accuracy"))


def temperature(rows: DataFrame, low: float = 0.5, step: float = 0.05, n: int = 51) -> DataFrame:
    """(temperature, nll) over a grid, from one aggregate over (x, y): a logit and whether its label is true."""
    grid = [round(low + step * i, 10) for i in range(n)]
    p = lambda t: 1 / (1 + F.exp(-F.col("x") / t))
    loss = lambda t: -F.sum(F.when(F.col("y"), F.log(F.greatest(p(t), F.lit(1e-6)))).otherwise(F.log(F.greatest(1 - p(t), F.lit(1e-6)))))
    one = rows.agg(F.greatest(F.count_if("y"), F.lit(1)).alias("positives"), *[loss(t).alias(f"t{i}") for i, t in enumerate(grid)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("temperature"), (F.col(f"t{i}") / F.col("positives")).alias("nll")) for i, t in enumerate(grid)])))


def threshold(rows: DataFrame, precision: float) -> DataFrame:
    """(tau, precision, coverage): the lowest probability such that all rows (p, y) from it on are right often enough.

    Equal probabilities are one step.  Running sums need no single task: values are counted first, then
    ranges of them, written so that sums and rows see the same ranges; a range starts from the sum of those above it.
    """
    by = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("t"))
    ranged = write_table(by.repartitionByRange(F.desc("p")).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum("n").alias("_n"), F.sum("t").alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t"))
    inner = Window.partitionBy("_part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(F.broadcast(sums), "_part").select("p", (F.sum("n").over(inner) + F.col("_n")).alias("shown"), (F.sum("t").over(inner) + F.col("_t")).alias("right"))
    run = run.withColumn("precision", F.col("right") / F.col("shown"))
    whole = by.agg(F.sum("n").alias("_all"))
    good = run.where(F.col("precision") >= precision).agg(F.min_by(F.struct("p", "precision", "shown"), "p").alias("g"))
    top = run.agg(F.max_by(F.struct("p", "precision", "shown"), "p").alias("f"))
    best = good.crossJoin(top).crossJoin(whole).select(F.coalesce("g", "f").alias("b"), "_all")
    return best.select(F.col("b.p").alias("tau"), F.col("b.precision").alias("precision"), (F.col("b.shown") / F.col("_all")).alias("coverage"))


def gates(measured: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(gate, value, limit, passed) of one row of measures."""
    row = lambda k, v: F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), F.coalesce(F.col(k) >= v, F.lit(False)).alias("passed"))
    return measured.select(F.inline(F.array(*[row(k, v) for k, v in limits.items()])))


