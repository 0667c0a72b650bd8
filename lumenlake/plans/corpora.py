"""Queries over labelled corpora and classifier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import corpus, evaluate
from lumenlake.plans.registry import DERIVED, query
from lumenlake.sources.catalog import Catalog


@query("G01_normalized_names", "SELECT p_partkey, regexp_replace(lower(replace(regexp_replace(trim(p_name || '_' || p_type), '^/+', ''), '_', ' ')), '[^a-z0-9 ]+', ' ', 'g') AS norm FROM part")
def normalized_names(c: Catalog) -> DataFrame:
    return c.table("part").withColumn("n", F.concat_ws("_", "p_name", "p_type")).select("p_partkey", corpus.normalized("n").alias("norm"))


@query("D13_fuzzy_names")
def fuzzy_names(c: Catalog) -> DataFrame:
    """Supplier names matched to customer names by shared words."""
    left = c.table("nation").select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", F.lit("the"), F.lower("n_name")).alias("name"))
    right = c.table("customer").join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lower("n_name"), F.lit("the"), "c_mktsegment").alias("name"))
    return corpus.fuzzy_matches(left, right, 0.5)


@query("G03_canonical_labels", """
WITH b AS (SELECT mid, fine, coarse, max(confidence) AS score FROM label_rows GROUP BY 1, 2, 3)
SELECT mid, min_by(fine, (-score, fine)) AS fine, coalesce(min_by(coarse, (-score, fine)) FILTER (coarse <> 'other'), 'other') AS coarse, '' AS merged FROM b GROUP BY 1""", "label_rows")
def canonical_labels(c: Catalog) -> DataFrame:
    return corpus.canonical_labels(c.view("label_rows"))


DERIVED["chosen"] = "SELECT image_id, mid, fine, coarse, confidence FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY confidence DESC, image_id) AS n FROM label_rows WHERE confidence >= 0.7) WHERE n <= 100"


def chosen(c: Catalog) -> DataFrame:
    return corpus.selected_labels(c.view("label_rows"))


@query("G04_selected_labels", "SELECT * FROM chosen", "label_rows chosen")
def selected_labels(c: Catalog) -> DataFrame:
    return chosen(c)


@query("G05_single_label", "SELECT image_id, mid, fine, coarse, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, mid) AS n FROM chosen) WHERE n = 1", "label_rows chosen")
def single_label(c: Catalog) -> DataFrame:
    return corpus.single_label(chosen(c))


@query("G07_selection_stats", """
SELECT (SELECT count(DISTINCT image_id) FROM chosen) AS images, count(*) AS classes, count(*) FILTER (n < 100) AS few,
  (SELECT string_agg(mid, '|' ORDER BY mid) FROM (SELECT mid FROM chosen GROUP BY mid ORDER BY count(*), mid LIMIT 8)) AS smallest FROM (SELECT mid, count(*) AS n FROM chosen GROUP BY 1)""", "label_rows chosen")
def selection_stats(c: Catalog) -> DataFrame:
    return corpus.selection_stats(chosen(c))


@query("G08_machine_labels", """
SELECT image_id, mid, fine, coarse, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, mid) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY mid ORDER BY confidence DESC, image_id) AS n FROM label_rows WHERE confidence >= 0.9 AND image_id NOT IN (SELECT doc_id::VARCHAR FROM labels)) WHERE n <= 50) WHERE k = 1""", "label_rows")
def machine_labels(c: Catalog) -> DataFrame:
    """Sure labels of images that are not held yet, the best class of each."""
    held = c.table("labels").select(F.col("doc_id").cast("string").alias("image_id")).distinct()
    return corpus.single_label(corpus.selected_labels(c.view("label_rows").join(held, "image_id", "left_anti"), 0.9, 50))


@query("G12_cross_source_dedup", """
SELECT sha1(content) AS digest, seq, path, fine, source FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY list_position(['human', 'machine', 'openverse', 'commons'], source), seq) AS n FROM corpus) WHERE n = 1""", "corpus")
def cross_source_dedup(c: Catalog) -> DataFrame:
    return corpus.without_copies(c.view("corpus"))


@query("G13_audit_split", """
SELECT seq, list_reduce(list_prepend(0, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(sha1(seq::VARCHAR), i::INTEGER, 1)) - 1)), lambda a, d: (a * 16 + d) % 10) = 0 AS audit FROM corpus""", "corpus")
def audit_split(c: Catalog) -> DataFrame:
    return c.view("corpus").select("seq", corpus.audit("seq").alias("audit"))


@query("G15_region_queries", f"""
WITH f AS (SELECT fine, row_number() OVER (ORDER BY fine) - 1 AS i FROM (SELECT DISTINCT fine FROM label_rows)),
x AS (SELECT fine, i, j, CASE WHEN j > 0 THEN list_extract({evaluate.REGIONS}, ((i * 7 + (j - 1) * ({len(evaluate.REGIONS)} // 8)) % {len(evaluate.REGIONS)} + 1)::INTEGER) END AS region FROM f, range(0, 9) r(j))
SELECT fine, region, coalesce(region || ' ', '') || fine AS query, i * 9 + j AS turn FROM x""", "label_rows")
def region_queries(c: Catalog) -> DataFrame:
    return corpus.region_queries(c.view("label_rows").select("fine").distinct(), evaluate.REGIONS)


@query("G17_crawl_quotas", """
WITH RECURSIVE e AS (SELECT user_id AS turn, event_id - event_id % 3 AS id, min(event_id) AS place FROM events WHERE event_id % 40 > 0 GROUP BY 1, 2),
q AS (SELECT turn, array_agg(id ORDER BY place, id) AS ids, row_number() OVER (ORDER BY turn) AS n FROM e WHERE id NOT IN (SELECT event_id FROM events WHERE event_id % 30 = 0) GROUP BY turn),
r AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS turn, []::BIGINT[] AS got, []::BIGINT[] AS used
  UNION ALL
  SELECT n, turn, got, list_concat(used, got) FROM (SELECT q.n, q.turn, r.used, list_filter(q.ids, lambda x: NOT list_contains(r.used, x))[1:20] AS got FROM r JOIN q ON q.n = r.n + 1)
)
SELECT turn, unnest(got) AS id FROM r""")
def crawl_quotas(c: Catalog) -> DataFrame:
    """Queries that find some of the same ids keep 20 new ones each, in their order."""
    rows = c.table("events")
    results = rows.where("event_id % 40 > 0").selectExpr("'class' as fine", "user_id as turn", "event_id as place", "event_id - event_id % 3 as id")
    return corpus.crawled_within_quotas(results, rows.where("event_id % 30 = 0").selectExpr("event_id as id"), per_query=20).select("turn", "id")


@query("G16_clean_results", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&(middot|copy|lt|gt|#39);', '.', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS text_length FROM pages WHERE url IS NOT NULL""")
def clean_results(c: Catalog) -> DataFrame:
    return c.table("pages").where("url is not null").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.length(corpus.plain_text("html")).cast("long").alias("text_length"))


@query("G17_host_quota", "SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n <= 2")
def host_quota(c: Catalog) -> DataFrame:
    rows = c.table("pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return corpus.within_quota(rows, ["host"], [F.col("page_id")], 2).select("page_id", "url")


@query("G18_manifest_progress", """
WITH t AS (SELECT event_type AS source, 500 * length(event_type) AS target FROM (SELECT DISTINCT event_type FROM events)),
d AS (SELECT event_type AS source, count(DISTINCT user_id) FILTER (event_id % 3 = 0) AS completed, count(DISTINCT user_id) FILTER (event_id % 3 < 2) AS processed FROM events GROUP BY 1)
SELECT source, target, completed, processed, greatest(target - completed, 0) AS remaining FROM t JOIN d USING (source)""")
def manifest_progress(c: Catalog) -> DataFrame:
    e = c.table("events")
    rows = e.select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "rejected").otherwise("failed").alias("status"))
    return corpus.manifest_progress(rows, e.select(F.col("event_type").alias("source")).distinct().withColumn("target", 500 * F.length("source").cast("long")))


@query("G20_pruned_classes", "SELECT image_id, mid, fine, coarse, confidence FROM label_rows WHERE fine IN (SELECT fine FROM label_rows GROUP BY 1 HAVING count(DISTINCT image_id) >= 40)", "label_rows")
def pruned_classes(c: Catalog) -> DataFrame:
    return corpus.pruned(c.view("label_rows"), 40).select("image_id", "mid", "fine", "coarse", "confidence")


@query("G21_sampling_weights", "WITH f AS (SELECT image_id, min(fine) AS fine FROM label_rows GROUP BY 1) SELECT image_id, fine, 1 / pow(count(*) OVER (PARTITION BY fine), 0.5) AS weight FROM f", "label_rows", rounded="weight")
def sampling_weights(c: Catalog) -> DataFrame:
    return corpus.sampling_weights(c.view("label_rows"))


@query("G22_multi_hot", "SELECT image_id, string_agg(CASE WHEN k THEN '1' ELSE '0' END, '' ORDER BY l) AS target FROM (SELECT image_id, l, bool_or(coarse = l) AS k FROM label_rows, (SELECT unnest(['de', 'en', 'es', 'fr', 'quality']) AS l) GROUP BY 1, 2) GROUP BY 1", "label_rows")
def multi_hot(c: Catalog) -> DataFrame:
    return corpus.multi_hot(c.view("label_rows"), ["de", "en", "es", "fr", "quality"], "coarse").select("image_id", F.array_join(F.col("target").cast("array<string>"), "").alias("target"))


def scored(c: Catalog) -> DataFrame:
    """Vectors as logits of 64 classes, their label as the true class."""
    return c.table("embeddings").select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("truth"))


DERIVED["ranks"] = "SELECT vec_id, label AS truth, i - 1 AS class, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS place FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings)"
DERIVED["tops"] = "SELECT vec_id, truth::INTEGER AS truth, class::INTEGER AS top FROM ranks WHERE place = 1"


def tops(c: Catalog) -> DataFrame:
    return scored(c).select("vec_id", "truth", *evaluate.softmax_top("logits"))


@query("B20_softmax_top", "SELECT t.vec_id, t.truth, t.top, 1 / (SELECT sum(exp(x::DOUBLE - list_max(e.embedding)::DOUBLE)) FROM (SELECT unnest(e.embedding) AS x)) AS confidence FROM tops t JOIN embeddings e ON e.vec_id = t.vec_id", "ranks tops", rounded="confidence")
def softmax_top(c: Catalog) -> DataFrame:
    return tops(c)


@query("G23_accuracy", "SELECT count(DISTINCT vec_id) AS n, 100.0 * avg((place = 1)::INTEGER) AS top1, 100.0 * avg((place <= 5)::INTEGER) AS top5, 100.0 * avg((SELECT (class // 8 = r.truth // 8)::INTEGER FROM ranks q WHERE q.vec_id = r.vec_id AND place = 1)) AS coarse FROM ranks r WHERE class = truth", "ranks", rounded="top1 top5 coarse")
def accuracy(c: Catalog) -> DataFrame:
    return evaluate.accuracy(scored(c).withColumn("truth", F.array("truth")), 8)


@query("G25_confusion", "SELECT truth, top, count(*) AS n FROM tops WHERE truth <> top GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", "ranks tops")
def confusion(c: Catalog) -> DataFrame:
    return evaluate.confusion(tops(c))


_RAW = f"({list(evaluate.MERGED_GROUPS)})[{{0}} % 21 + 1]"
_GROUP = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evaluate.MERGED_GROUPS.items()) + " END"


@query("G25_marked_confusion", f"""
SELECT truth, top, n, {_GROUP.format("truth")} = {_GROUP.format("top")} AS same_merged FROM (
  SELECT {_RAW.format("truth")} AS truth, {_RAW.format("top")} AS top, count(*) AS n FROM tops WHERE {_RAW.format("truth")} <> {_RAW.format("top")} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10)""", "ranks tops")
def marked_confusion(c: Catalog) -> DataFrame:
    """Leaks between scene groups, marked where merging hides them."""
    raw = lambda n: F.get(F.array(*map(F.lit, evaluate.MERGED_GROUPS)), (F.col(n) % 21).cast("int"))
    return evaluate.marked_confusion(evaluate.confusion(tops(c).withColumns({"truth": raw("truth"), "top": raw("top")})))


@query("G26_weak_recalls", "SELECT truth, count(*) AS n, avg((truth = top)::INTEGER) AS recall FROM tops GROUP BY 1 HAVING count(*) >= 10 ORDER BY 3, 1 LIMIT 15", "ranks tops", rounded="recall")
def weak_recalls(c: Catalog) -> DataFrame:
    return evaluate.recalls(tops(c))


@query("G27_region_audit", "WITH b AS (SELECT vec_id % 5 AS region, count(*) AS n, avg((truth = top)::INTEGER) AS accuracy FROM tops GROUP BY 1) SELECT *, (SELECT max(accuracy) FROM b) - accuracy AS gap FROM b", "ranks tops", rounded="accuracy gap")
def region_audit(c: Catalog) -> DataFrame:
    return evaluate.region_audit(tops(c).withColumn("region", F.col("vec_id") % 5))


def slots(c: Catalog) -> DataFrame:
    """Every logit with whether its class is true, scaled so that probabilities spread."""
    return scored(c).select(F.posexplode("logits").alias("class", "x"), "truth").select((10 * F.col("x").cast("double")).alias("x"), (F.col("class") == F.col("truth")).alias("y"))


DERIVED["slots"] = "SELECT 10 * x::DOUBLE AS x, (i = label) AS y FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)"


@query("G28_temperature_grid", """
SELECT t / 20.0::DOUBLE AS temperature, -sum(ln(greatest(CASE WHEN y THEN 1 / (1 + exp(-x / (t / 20.0::DOUBLE))) ELSE 1 - 1 / (1 + exp(-x / (t / 20.0::DOUBLE))) END, 1e-6))) / greatest(count(*) FILTER (y), 1) AS nll FROM slots, range(10, 61) r(t) GROUP BY 1""", "slots", rounded="temperature nll")
def temperature_grid(c: Catalog) -> DataFrame:
    return evaluate.temperature(slots(c))


@query("G29_threshold", """
WITH b AS (SELECT round(1 / (1 + exp(-x)), 3) AS p, count(*) AS n, count(*) FILTER (y) AS t FROM slots GROUP BY 1), r AS (SELECT p, sum(n) OVER w AS shown, sum(t) OVER w / sum(n) OVER w AS precision FROM b WINDOW w AS (ORDER BY p DESC))
SELECT p AS tau, precision, shown / (SELECT sum(n) FROM b) AS coverage FROM r ORDER BY precision >= 0.0157 DESC, CASE WHEN precision >= 0.0157 THEN p ELSE -p END LIMIT 1""", "slots", rounded="tau precision coverage")
def threshold(c: Catalog) -> DataFrame:
    return evaluate.threshold(slots(c).select(F.round(1 / (1 + F.exp(-F.col("x"))), 3).alias("p"), "y"), 0.0157)


@query("G30_release_gates", "SELECT 'top1' AS gate, 100.0 * avg((truth = top)::INTEGER) AS value, 1.0::DOUBLE AS limit, 100.0 * avg((truth = top)::INTEGER) >= 1.0 AS passed FROM tops", "ranks tops", rounded="value")
def release_gates(c: Catalog) -> DataFrame:
    return evaluate.gates(accuracy(c), {"top1": 1.0})


@query("G31_any_true", "SELECT 100.0 * avg(k) AS accuracy FROM (SELECT l.image_id, max((l.coarse = b.coarse)::INTEGER) AS k FROM label_rows l JOIN (SELECT image_id, min_by(coarse, (-confidence, mid)) AS coarse FROM label_rows GROUP BY 1) b ON b.image_id = l.image_id GROUP BY 1)", "label_rows", rounded="accuracy")
def any_true(c: Catalog) -> DataFrame:
    """Images whose surest label is among their labels' groups."""
    rows = c.view("label_rows")
    guesses = corpus.single_label(rows).select("image_id", F.col("coarse").alias("guess"))
    return evaluate.any_true(rows.join(guesses, "image_id"), "coarse", "guess")


@query("G02_class_mapping", """
WITH n AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation), m AS (SELECT s_suppkey AS place, n.id AS class_id, 'exact' AS how FROM supplier JOIN n ON n.id = s_nationkey WHERE s_suppkey % 7 <> 0)
SELECT place, CASE WHEN place % 11 = 0 THEN 1 ELSE class_id END AS class_id, CASE WHEN place % 11 = 0 THEN 'override' ELSE how END AS how FROM m WHERE class_id <> 3 OR place % 11 = 0""")
def class_mapping(c: Catalog) -> DataFrame:
    """Exact names first, then overrides over them, then dropped classes out."""
    n = c.table("nation").select(F.col("n_nationkey").alias("class_id"), F.lower("n_name").alias("norm"))
    places = c.table("supplier").where("s_suppkey % 7 <> 0").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("place"), F.lower("n_name").alias("norm"))
    overrides = places.where("place % 11 = 0").select("place", F.lit(1).cast("long").alias("class_id"))
    drops = n.where("class_id = 3").select("class_id")
    return corpus.mapped(places, n, overrides, drops)


@query("G06_multi_label_rows", "SELECT image_id, mid, fine, coarse, printf('%.3f', confidence) AS confidence FROM chosen", "label_rows chosen")
def multi_label_rows(c: Catalog) -> DataFrame:
    return chosen(c).withColumn("confidence", F.format_string("%.3f", "confidence")).select("image_id", "mid", "fine", "coarse", "confidence").orderBy("image_id", "mid", "fine", "coarse", "confidence")


@query("G09_licence_gates", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'CC BY 2.0' WHEN 1 THEN 'cc-by-sa-4.0' WHEN 2 THEN 'CC BY-NC 4.0' WHEN 3 THEN 'Public domain' WHEN 4 THEN 'CC0' ELSE '' END AS licence, page_id % 6 IN (0, 3, 4) AS free FROM pages")
def licence_gates(c: Catalog) -> DataFrame:
    names = F.array(*map(F.lit, ["CC BY 2.0", "cc-by-sa-4.0", "CC BY-NC 4.0", "Public domain", "CC0", ""]))
    return c.table("pages").select("page_id", F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")).alias("licence")).withColumn("free", corpus.free_licence("licence"))


@query("G10_image_manifest", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '&size=small' END AS url, 'page ' || page_id::VARCHAR AS title FROM pages WHERE url IS NOT NULL AND page_id % 6 IN (0, 3, 4)")
def image_manifest(c: Catalog) -> DataFrame:
    """Free images with their small copy's address where there is one."""
    small = F.when(F.col("page_id") % 3 != 0, F.concat("url", F.lit("&size=small")))
    free = licence_gates(c).where("free").select("page_id")
    return c.table("pages").where("url is not null").join(free, "page_id", "left_semi").select("page_id", F.coalesce(small, "url").alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))


@query("G11_split_dedup", "SELECT sha1(content) AS digest, fine, min(seq) AS seq FROM corpus GROUP BY content, fine", "corpus")
def split_dedup(c: Catalog) -> DataFrame:
    """The first row of each content within a split."""
    return corpus.first_copies(c.view("corpus"), ["fine"])


@query("G14_clean_subset", "SELECT path, fine FROM corpus WHERE source = 'human'", "corpus")
def clean_subset(c: Catalog) -> DataFrame:
    return corpus.clean_subset(c.view("corpus")).select("path", "fine")


@query("G19_cooldowns", "SELECT event_type AS source, max(ts) + INTERVAL 300 SECOND AS until FROM events WHERE event_id % 13 = 0 GROUP BY 1")
def cooldowns(c: Catalog) -> DataFrame:
    """Per source the end of the pause after its last refusal with code 429."""
    rows = c.table("events").select(F.col("event_type").alias("source"), "ts", F.when(F.col("event_id") % 13 == 0, "HTTP 429: slow down").otherwise("ok").alias("detail"))
    return corpus.cooldowns(rows)


_MERGED = "CASE WHEN {0} < 4 THEN 'people' WHEN {0} < 16 THEN 'nature' WHEN {0} < 40 THEN 'city' ELSE 'other' END"


@query("G24_merged_accuracy", f"SELECT count(*) AS n, 100.0 * avg(({_MERGED.format('truth')} = {_MERGED.format('top')})::INTEGER) AS accuracy FROM tops", "ranks tops", rounded="accuracy")
def merged_accuracy(c: Catalog) -> DataFrame:
    return tops(c).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg((F.expr(_MERGED.format("truth")) == F.expr(_MERGED.format("top"))).cast("double"))).alias("accuracy"))
