"""Curation of labelled image corpora: mapping classes, selecting labels, removing copies."""

from __future__ import annotations

import difflib
import html as html_entities

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.operators.curation import numbered
from lumenlake.operators.tables import write_table

#: Sources from the most to the least trusted.
TRUST = ["human", "machine", "openverse", "commons"]


def normalized(name: str) -> Column:
    return F.regexp_replace(F.lower(F.replace(F.regexp_replace(F.trim(name), r"^/+", ""), F.lit("_"), F.lit(" "))), r"[^a-z0-9 ]+", " ")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


#: Names a word may stand in, on the right, before names that share it have to share more than the word.
COMMON = 64


def _letters(names: DataFrame) -> DataFrame:
    """norm and its letters, the k-th of a kind apart from the others, as an array `bag`."""
    seen = F.transform(F.split("norm", ""), lambda c, i: F.concat(c, F.size(F.filter(F.split(F.substring("norm", F.lit(1), i + 1), ""), lambda d: d == c)).cast("string")))
    return names.withColumn("bag", seen)


def _alike(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Pairs of names (x, y) that share a word which stands in many names and enough letters for a ratio of `least`.

    The ratio is at most twice the common letters over all letters, so a pair needs least * (a + b) / 2 of them.  Letters are put in
    one order, rarest first; names of lengths a and b that share c letters share one among the first a - c + 1 of the one and the
    first b - c + 1 of the other, and at places i and j no more than the letters that are left from there.  The key
    holds the word and both lengths, so that only names of fitting lengths meet.
    """
    bags = _letters(x.select("norm").unionByName(y.select("norm")).distinct())
    often = bags.select(F.explode("bag").alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    # letters are 36 and the space, each numbered up to the longest name: a small table, but no hint where names are long
    order = bags.select("norm", F.explode("bag").alias("letter")).join(often, "letter").groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("often", "letter"))).alias("bag"))
    ranked = lambda df, name: df.join(order, "norm").select(F.col("norm").alias(name), "word", F.size("bag").alias(f"{name}_n"), F.transform("bag", lambda v: v["letter"]).alias(f"{name}_bag"))
    x, y = ranked(x, "x"), ranked(y, "y")
    lengths = y.groupBy("word").agg(F.collect_set("y_n").alias("others"))
    need = lambda n, m: F.ceil((n + m) * (least / 2) - 1e-9).cast("int")
    head = lambda bag, n, m: F.posexplode(F.slice(bag, F.lit(1), F.greatest(F.lit(0), n - need(n, m) + 1)))
    own = lambda df, name, sizes: df.select("*", F.explode(sizes).alias("m")).where(need(F.col(f"{name}_n"), F.col("m")) <= F.least(F.col(f"{name}_n"), F.col("m")))
    left = own(x.join(lengths, "word"), "x", F.col("others")).select("x", "x_n", "x_bag", "word", "m", head("x_bag", F.col("x_n"), F.col("m")).alias("i", "letter"))
    shorter = x.groupBy("word").agg(F.collect_set("x_n").alias("others"))
    right = own(y.join(shorter, "word"), "y", F.col("others")).select("y", "y_n", "y_bag", "word", F.col("m").alias("k"), head("y_bag", F.col("y_n"), F.col("m")).alias("j", "letter"))
    met = left.join(right.withColumnsRenamed({"word": "_word", "letter": "_letter"}), (F.col("word") == F.col("_word")) & (F.col("letter") == F.col("_letter")) & (F.col("m") == F.col("y_n")) & (F.col("k") == F.col("x_n")))
    # the first letter that both have in common is the one that counts the pair
    enough = need(F.col("x_n"), F.col("y_n"))
    met = met.where(F.least(F.col("x_n") - F.col("i"), F.col("y_n") - F.col("j")) >= enough)
    met = met.where(F.size(F.array_intersect(F.slice("x_bag", F.lit(1), F.col("i")), F.slice("y_bag", F.lit(1), F.col("j")))) == 0)
    return met.where(F.size(F.array_intersect("x_bag", "y_bag")) >= enough).select("x", "y").distinct()


def fuzzy_matches(left: DataFrame, right: DataFrame, least: float = 0.8, common: int = COMMON) -> DataFrame:
    """(left_id, right_id, score): for each left name the most similar right name that shares a word of three letters with it or holds it or is held by it.

    Different names are compared, however many ids bear one.  They meet through words that stand in at most `common` right names; through
    words of more names by `_alike`, which loses no pair of at least `least`; and whole names through the substrings of the others: the ratio of
    a name and one that it holds is 2 a / (a + b), so only substrings long enough for `least` are made.  A left name without
    a word of three letters matches nothing, nor does a null name or id.  Ties go to the smaller right_id.
    """
    a, b = (df.select(F.col("id").alias(key), normalized("name").alias("norm")).where(F.col("norm").isNotNull() & F.col(key).isNotNull()) for df, key in ((left, "left_id"), (right, "right_id")))
    # of the ids of one right name, the smallest is the one that can be returned; written, as all that follows reads the different names many times
    b = write_table(b.groupBy("norm").agg(F.min("right_id").alias("right_id")), "right-names")
    names = write_table(a.select("norm").distinct(), "left-names")
    words = lambda df: df.select("norm", F.explode(F.array_distinct(F.split("norm", " +"))).alias("word")).where(F.length("word") > 2)
    x, y = words(names), words(b)
    many = y.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > common).select("word")
    few = lambda df: df.join(many, "word", "left_anti")
    shared = few(x).withColumnRenamed("norm", "x").join(few(y).withColumnRenamed("norm", "y"), "word").select("x", "y")
    alike = _alike(x.join(many, "word", "left_semi"), y.join(many, "word", "left_semi"), least)
    long = F.greatest(F.lit(1), F.ceil(F.length("norm") * (least / (2 - least)) - 1e-9).cast("int"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("norm") - n + 1), lambda i: F.substring(F.col("norm"), i, n))
    parts = lambda df: df.where(F.length("norm") > 0).select("norm", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(long, F.length("norm")), pieces)))).alias("part"))
    named = names.where(F.col("norm").rlike("[^ ]{3}"))
    inside = parts(b.select("norm")).join(named, F.col("part") == named["norm"]).select(named["norm"].alias("x"), b["norm"].alias("y"))
    around = parts(named).join(b.select(F.col("norm").alias("y")), F.col("part") == F.col("y")).select(F.col("norm").alias("x"), "y")
    met = shared.unionByName(alike).unionByName(inside).unionByName(around).distinct()
    met = met.withColumn("score", _ratio("x", "y")).where(F.col("score") >= least)
    best = met.join(b.withColumnRenamed("norm", "y"), "y").groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("right_id").alias("id"))).alias("best"))
    return a.join(best, a["norm"] == best["x"]).select("left_id", F.col("best.id").alias("right_id"), (-F.col("best.s")).alias("score"))


def selected_labels(rows: DataFrame, least: float = 0.7, cap: int = 100) -> DataFrame:
    """The `cap` surest rows of each class; the limit is the operator's purpose, ties go to the smaller image_id."""
    order = Window.partitionBy("mid").orderBy(F.desc("confidence"), "image_id")
    return rows.where(F.col("confidence") >= least).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def single_label(rows: DataFrame) -> DataFrame:
    """The surest class of each image, ties to the smaller class."""
    best = rows.groupBy("image_id").agg(F.max("confidence").alias("confidence"))
    return rows.join(best, ["image_id", "confidence"]).groupBy("image_id", "confidence").agg(F.min(F.struct("mid", "fine", "coarse")).alias("b")).select("image_id", "b.*", "confidence")


def canonical_labels(rows: DataFrame) -> DataFrame:
    """(mid, fine, coarse, merged): per class the surest name, the first coarse group that is not 'other', and the other names."""
    by = rows.groupBy("mid", "fine", "coarse").agg(F.max("confidence").alias("score"))
    place = F.struct((-F.col("score")).alias("s"), F.col("fine").alias("f"))
    out = by.groupBy("mid").agg(F.min(place).alias("best"), F.min_by(F.when(F.col("coarse") != "other", F.col("coarse")), F.when(F.col("coarse") != "other", place)).alias("coarse"), F.sort_array(F.collect_set("fine")).alias("names"))
    return out.select("mid", F.col("best.f").alias("fine"), F.coalesce("coarse", F.lit("other")).alias("coarse"), F.array_join(F.array_except("names", F.array("best.f")), "|").alias("merged"))


def selection_stats(rows: DataFrame, few: int = 100) -> DataFrame:
    by = rows.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    small = by.orderBy("n", "mid").limit(8).agg(F.array_join(F.sort_array(F.collect_list("mid")), "|").alias("smallest"))
    return rows.agg(F.countDistinct("image_id").alias("images")).crossJoin(by.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") < few).alias("few"))).crossJoin(small)


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows of the most trusted path of each content, all labels of the kept path included."""
    trust = F.array_position(F.array(*map(F.lit, TRUST)), F.col("source"))
    digest = rows.withColumn("digest", F.sha1("content"))
    first = digest.groupBy("digest").agg(F.min(F.struct(trust.alias("t"), F.col("seq").alias("s"), F.col("path").alias("p"))).alias("best"))
    return digest.join(first.select("digest", F.col("best.p").alias("_kept")), "digest").where("path = _kept").drop("_kept", "content")


def audit(id_: str) -> Column:
    """Whether the whole 160-bit SHA-1 of an id is a multiple of ten: its last decimal digit, folded from the hex digits."""
    digits = F.split(F.sha1(F.col(id_).cast("string")), "")
    value = lambda d: F.conv(d, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 16 + value(d)) % 10) == 0


def region_queries(classes: DataFrame, regions: list[str], each: int = 8) -> DataFrame:
    """(fine, region, query, turn): each class alone (region null) and with `each` regions.

    In order of the classes the first region moves on by seven, and regions of a class lie evenly apart; turn is the place of
    a query in the crawl, from 0.
    """
    rows = numbered(classes.select("fine"), ["fine"]).select("fine", (F.col("place") - 1).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(each))).alias("_j"))
    step = max(1, len(regions) // each)
    names = F.array(*map(F.lit, regions))
    region = F.when(F.col("_j") > 0, F.element_at(names, ((F.col("_i") * 7 + (F.col("_j") - 1) * step) % len(regions) + 1).cast("int")))
    return rows.select("fine", region.alias("region"), F.concat_ws(" ", region, "fine").alias("query"), (F.col("_i") * (each + 1) + F.col("_j")).alias("turn"))


@F.pandas_udf(T.StringType())
def _entities(text: pd.Series) -> pd.Series:
    return text.map(html_entities.unescape, na_action="ignore")


def _unescaped(text: Column) -> Column:
    """All named and numbered entities read; texts without an ampersand never reach Python."""
    return F.when(F.contains(text, F.lit("&")), _entities(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def plain_text(html: str) -> Column:
    """Text of a markup: tags gone, entities read, blanks single."""
    return F.trim(F.regexp_replace(_unescaped(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def stripped_markup(html: str) -> Column:
    """A short markup without its tags, entities read; empty for null."""
    return F.trim(_unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", "")))


def within_quota(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key: a quota is the purpose here."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def crawled_within_quotas(results: DataFrame, seen: DataFrame, per_query: int | None = None, per_class: int | None = None, page: int = 50) -> DataFrame:
    """(fine, turn, place, id): what a crawl keeps of its results (fine, turn, place, id) when its queries run in order of turn.

    A query skips ids that seen (id) holds or that an earlier query kept, free of charge.  It keeps per_query others at
    most.  With per_class it reads pages of `page` results, the first in any case, and further ones while its class has kept fewer.
    Which ids a query keeps depends on all before it.  Each round lets every query keep what the last round's earlier
    queries left it; the first query is right after one round and each later one a round after those before it, so the rounds end
    when nothing changes, after as many as the longest chain of queries that take ids from each other.
    """
    keys = ["fine", "turn", "place", "id"]
    # joins of every round go through exchanges: what is broadcast passes through the driver once a round
    offered = write_table(results.join(seen.select("id").hint("merge"), "id", "left_anti").groupBy("fine", "turn", "id").agg(F.min("place").alias("place")).select(*keys), "offered")
    turns = offered.select("fine", "turn").distinct()
    kept = offered.limit(0)
    while True:
        first = kept.groupBy("id").agg(F.min("turn").alias("_first"))
        now = offered.join(first.hint("merge"), "id", "left").where("_first is null or _first >= turn").select(*keys)
        if per_class is not None:
            before = Window.partitionBy("fine").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
            counts = kept.groupBy("turn").agg(F.count(F.lit(1)).alias("_n"))
            start = turns.join(counts.hint("merge"), "turn", "left").select("turn", F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(before), F.lit(0)).alias("_start"))
            paged = now.withColumn("_page", F.floor(F.col("place") / page))
            pages = paged.groupBy("turn", "_page").agg(F.count(F.lit(1)).alias("_n"))
            inner = Window.partitionBy("turn").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
            read = pages.join(start.hint("merge"), "turn").withColumn("_so_far", F.col("_start") + F.coalesce(F.sum("_n").over(inner), F.lit(0)))
            now = paged.join(read.where(f"_page = 0 or _so_far < {per_class}").select("turn", "_page").hint("merge"), ["turn", "_page"]).select(*keys)
        if per_query is not None:
            now = within_quota(now, ["turn"], [F.col("place"), F.col("id")], per_query)
        now = write_table(now, "kept")
        if kept.exceptAll(now).isEmpty() and now.exceptAll(kept).isEmpty():
            return now
        kept = now


def manifest_progress(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the ids done and settled for good, and how many its target still lacks."""
    done = rows.groupBy("source").agg(F.countDistinct(F.when(F.col("status") == "completed", F.col("id"))).alias("completed"), F.countDistinct(F.when(F.col("status").isin("completed", "rejected"), F.col("id"))).alias("processed"))
    met = targets.join(done, "source", "left").fillna(0, ["completed", "processed"])
    return met.withColumn("remaining", F.greatest(F.col("target") - F.col("completed"), F.lit(0)))


def pruned(rows: DataFrame, least: int = 25) -> DataFrame:
    """Rows of classes with enough different images."""
    large = rows.groupBy("fine").agg(F.countDistinct("image_id").alias("n")).where(F.col("n") >= least).select("fine")
    return rows.join(large, "fine", "left_semi")


def sampling_weights(rows: DataFrame, power: float = 0.5) -> DataFrame:
    """(image_id, fine, weight): one over a power of the frequency of the image's first label."""
    first = rows.groupBy("image_id").agg(F.min("fine").alias("fine"))
    n = first.groupBy("fine").agg(F.count(F.lit(1)).alias("n"))
    return first.join(n, "fine").select("image_id", "fine", (1 / F.pow("n", F.lit(power))).alias("weight"))


def multi_hot(rows: DataFrame, classes: list[str], column: str) -> DataFrame:
    """(image_id, target): zeros and ones over the classes."""
    by = rows.groupBy("image_id").agg(F.collect_set(column).alias("_set"))
    return by.select("image_id", F.transform(F.array(*map(F.lit, classes)), lambda c: F.array_contains("_set", c).cast("int")).alias("target"))


def mapped(places: DataFrame, classes: DataFrame, overrides: DataFrame, drops: DataFrame) -> DataFrame:
    """(place, class_id, how): places (place, norm) whose name is a class's (class_id, norm); overrides win over names, and dropped classes go unless overridden to."""
    exact = places.join(classes, "norm").select("place", "class_id").join(drops, "class_id", "left_anti").join(overrides.select("place"), "place", "left_anti")
    return exact.withColumn("how", F.lit("exact")).unionByName(overrides.withColumn("how", F.lit("override"))).select("place", "class_id", "how")


def class_map(
    places: DataFrame, classes: DataFrame, additions: DataFrame, drops: DataFrame, overrides: DataFrame, groups: DataFrame, least: float = 0.8
) -> DataFrame:
    """(name, mid, class_name, score, coarse, how) of each place name that finds a class.

    places (name) meet classes (mid, name) by equal normalised names (the smallest mid of several), the others by
    `fuzzy_matches`.  additions (name, class_name) come before both if there is such a class, whatever the case; drops
    (name) take names out; overrides (name, mid, class_name) come before all.  groups (class_name, coarse) is looked up by
    the class's name in lower case with underscores, else other.  Scores are rounded to three places.
    """
    named = places.select("name").where("name is not null").distinct().withColumn("norm", normalized("name"))
    known = classes.select("mid", F.col("name").alias("class_name"))
    by_norm = known.groupBy(normalized("class_name").alias("norm")).agg(F.min(F.struct("mid", "class_name")).alias("k")).select("norm", "k.*")
    exact = named.join(by_norm, "norm").select("name", "mid", "class_name", F.lit(1.0).alias("score"), F.lit("1 exact").alias("how"))
    rest = named.join(by_norm, "norm", "left_anti").select(F.col("name").alias("id"), "name")
    near = fuzzy_matches(rest, classes.select(F.col("mid").alias("id"), "name"), least).withColumnsRenamed({"left_id": "name", "right_id": "mid"})
    fuzzy = near.join(known, "mid").select("name", "mid", "class_name", "score", F.lit("2 fuzzy").alias("how"))
    by_name = known.groupBy(F.lower("class_name").alias("_key")).agg(F.min(F.struct("mid", "class_name")).alias("k")).select("_key", "k.*")
    added = additions.select("name", F.lower("class_name").alias("_key")).join(by_name, "_key")
    added = added.withColumns({"_x": normalized("name"), "_y": normalized("class_name")}).withColumn("score", _ratio("_x", "_y"))
    added = added.select("name", "mid", "class_name", "score", F.lit("3 added").alias("how"))
    kept = exact.unionByName(fuzzy).unionByName(added).join(drops.select("name"), "name", "left_anti")
    every = kept.unionByName(overrides.select("name", "mid", "class_name", F.lit(1.0).alias("score"), F.lit("4 override").alias("how")))
    best = every.groupBy("name").agg(F.max(F.struct("how", "mid", "class_name", "score")).alias("b"))
    best = best.select("name", "b.mid", "b.class_name", F.round("b.score", 3).alias("score"), F.substring("b.how", 3, 8).alias("how"))
    key = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    coarse = groups.groupBy(key("class_name").alias("_key")).agg(F.min("coarse").alias("coarse"))
    out = best.withColumn("_key", key("class_name")).join(coarse, "_key", "left")
    return out.select("name", "mid", "class_name", "score", F.coalesce("coarse", F.lit("other")).alias("coarse"), "how")


#: Parts of a short licence name that refuse it, and names that are taken as they stand.
REFUSED_LICENCES = ["by-sa", "by-nc", "by-nd", "nc-sa", "sharealike", "non-free"]
TAKEN_LICENCES = ["cc by", "cc by 1.0", "cc by 2.0", "cc by 2.5", "cc by 3.0", "cc by 4.0", "cc0", "cc0 1.0", "cc-zero"]


def free_licence(name: str) -> Column:
    """Whether a short licence name asks for attribution at most: share-alike, non-commercial and unknown ones do not pass."""
    n = F.lower(F.trim(_unescaped(F.col(name))))
    refused = n.rlike("|".join(REFUSED_LICENCES))
    public = F.contains(n, F.lit("public domain")) | n.rlike("^(pd[- ]|no restrictions)")
    return F.coalesce(~refused & (n.isin(TAKEN_LICENCES) | public), F.lit(False))


def free_address(address: str) -> Column:
    """Whether a licence's address is that of attribution 2.0 or of the public domain."""
    return F.coalesce(F.lower(F.col(address)).rlike(r"creativecommons\.org/licenses/by/2\.0|publicdomain"), F.lit(False))


def image_manifest(images: DataFrame, ids: DataFrame) -> DataFrame:
    """(image_id, url, author, licence, title) of the wanted image_ids whose licence address is free.

    images (image_id, url, author, licence, title, and thumbnail if the source has small copies, whose address is then given).
    """
    url = "thumbnail" if "thumbnail" in images.columns else "url"
    free = images.where(free_address("licence")).join(ids.select("image_id"), "image_id", "left_semi")
    return free.select("image_id", F.col(url).alias("url"), "author", "licence", "title")


def _first_unseen(rows: DataFrame, key: str, seen: DataFrame) -> DataFrame:
    """Rows whose key was not seen, the first by place of each key."""
    new = rows.join(seen.select(key), key, "left_anti")
    rest = [c for c in rows.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct("place", *[c for c in rest if c != "place"])).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def crawled_images(results: DataFrame, seen: DataFrame, least: int) -> DataFrame:
    """(page_id, place, fine, query, title, licence, thumb, artist) of search results that can be used.

    results (page_id, place, fine, query, title, mime, width, height, thumb, licence, artist): JPEG of `least` pixels both ways
    with a small copy's address and a free licence; a page that seen (page_id) holds, or an earlier place, is left out.
    """
    fit = (F.col("mime") == "image/jpeg") & (F.col("width") >= least) & (F.col("height") >= least) & (F.col("thumb") != "")
    good = results.where(fit & free_licence("licence")).withColumns({"licence": F.trim("licence"), "artist": stripped_markup("artist")})
    return _first_unseen(good.select("page_id", "place", "fine", "query", "title", "licence", "thumb", "artist"), "page_id", seen)


def searched_images(results: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, place, fine, query, url, licence) of results with an id that is new and an address; the licence as `CC BY 2.0`."""
    licence = F.trim(F.concat(F.lit("CC "), F.upper(F.coalesce("licence", F.lit(""))), F.lit(" "), F.coalesce("version", F.lit(""))))
    url = F.coalesce(F.when(F.col("thumbnail") != "", F.col("thumbnail")), F.when(F.col("url") != "", F.col("url")))
    good = results.withColumns({"licence": licence, "url": url}).where("id is not null and url is not null")
    return _first_unseen(good.select("id", "place", "fine", "query", "url", "licence"), "id", seen)


def first_copies(rows: DataFrame, within: list[str]) -> DataFrame:
    """(digest, *within, seq): the first row of each content within each split."""
    return rows.groupBy(F.sha1("content").alias("digest"), *within).agg(F.min("seq").alias("seq"))


def clean_subset(rows: DataFrame) -> DataFrame:
    """Rows whose label a human gave."""
    return rows.where(F.col("source") == TRUST[0])


def validation_rows(rows: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    """(path, fine, confidence, source): labelled images (image_id, fine, confidence) of known classes (fine) whose file is held (path)."""
    path = F.concat(F.lit("img/"), "image_id", F.lit(".jpg"))
    rows = rows.select(path.alias("path"), "fine", "confidence", F.lit(TRUST[0]).alias("source"))
    return rows.join(classes.select("fine"), "fine", "left_semi").join(held.select("path"), "path", "left_semi").select("path", "fine", "confidence", "source")


def write_corpus(folder: str, kept: DataFrame, validation: DataFrame, audited: DataFrame) -> None:
    """Sorted CSV with headers: train, train_clean (human labels), val and audit, each a folder of its own.

    kept and validation have path, fine, confidence and source, audited has path, fine and region_query.
    """
    shown = lambda df: df.select("path", "fine", F.format_string("%.3f", F.col("confidence").cast("double")).alias("confidence"), "source")
    splits = {"train": shown(kept), "train_clean": shown(clean_subset(kept)), "val": shown(validation), "audit": audited.select("path", "fine", "region_query")}
    for name, rows in splits.items():
        rows.orderBy(*rows.columns).write.option("header", True).csv(f"{folder}/{name}")


def cooldowns(rows: DataFrame, pause: int = 300) -> DataFrame:
    """(source, until): per source the end of the pause after its last refusal (source, ts, detail) that names code 429."""
    last = rows.where(F.contains("detail", F.lit("429"))).groupBy("source").agg(F.max("ts").alias("last"))
    return last.select("source", (F.col("last") + F.make_dt_interval(secs=F.lit(pause))).alias("until"))
