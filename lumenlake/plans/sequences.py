"""Queries over similarity groups, bursts and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators import sequence, simjoin
from lumenlake.operators.tables import exchanged
from lumenlake.plans.registry import DERIVED, query
from lumenlake.sources.catalog import Catalog

#: Seconds of a burst in these tables, whose photos of a session lie at least eight seconds apart.
GAP = 7200

_COMPONENTS = """
WITH RECURSIVE v AS ({vertices}), e AS ({edges}), r AS (
  SELECT vertex AS node, vertex AS label FROM v
  UNION
  SELECT e.b, r.label FROM r JOIN e ON e.a = r.node
), c AS (SELECT node, min(label) AS label FROM r GROUP BY node)"""


@query("E05_hash_pairs", """
SELECT a.id AS a, b.id AS b, a.session_id AS session_id, bit_count(xor(a.phash, b.phash))::INTEGER AS distance
FROM photos a JOIN photos b ON a.session_id = b.session_id AND a.id < b.id AND bit_count(xor(a.phash, b.phash)) <= 6""", "photos")
def hash_pairs(c: Catalog) -> DataFrame:
    rows = c.photos.select(F.col("id").alias("vertex"), F.col("session_id").alias("scope"), F.col("phash").alias("hash"))
    return simjoin.pairs(rows, 6).select("a", "b", F.col("scope_a").alias("session_id"), "distance")


DERIVED["similar_rows"] = _COMPONENTS.format(
    vertices="SELECT id AS vertex FROM photos WHERE session_id IS NOT NULL AND phash IS NOT NULL",
    edges="SELECT a.id AS a, b.id AS b FROM photos a JOIN photos b ON a.session_id = b.session_id AND a.id <> b.id AND bit_count(xor(a.phash, b.phash)) <= 6") + """
SELECT label AS group_id, session_id, id FROM c JOIN photos ON id = node WHERE label IN (SELECT label FROM c GROUP BY label HAVING count(*) > 1)"""


@query("E01_similar_groups", "SELECT * FROM similar_rows", "photos similar_rows")
def similar_groups(c: Catalog) -> DataFrame:
    return simjoin.groups_within(c.photos)


DERIVED["cross_rows"] = _COMPONENTS.format(
    vertices="SELECT id AS vertex FROM photos WHERE session_id IS NOT NULL AND phash IS NOT NULL",
    edges="""SELECT a.id AS a, b.id AS b FROM photos a JOIN photos b ON a.session_id <> b.session_id AND bit_count(xor(a.phash, b.phash)) <= 4
      AND bit_count(a.phash) BETWEEN 3 AND 61 AND bit_count(b.phash) BETWEEN 3 AND 61""") + """
, l AS (SELECT DISTINCT a FROM e), same AS (
  SELECT p.id, min(c.label) OVER (PARTITION BY p.session_id, p.phash) AS label FROM c JOIN photos p ON p.id = c.node JOIN l ON l.a = p.id)
SELECT label AS group_id, session_id, photos.id FROM same JOIN photos USING (id)"""


@query("E02_cross_session_groups", "SELECT * FROM cross_rows", "photos cross_rows")
def cross_session_groups(c: Catalog) -> DataFrame:
    return simjoin.groups_across(c.photos)


@query("E03_hash_labels", "SELECT id, lpad(lower(hex(phash)), 16, '0') AS label, bit_count(phash) <= 2 OR bit_count(phash) >= 62 AS degenerate FROM photos", "photos")
def hash_labels(c: Catalog) -> DataFrame:
    return c.photos.select("id", simjoin.label("phash").alias("label"), simjoin.degenerate("phash").alias("degenerate"))


DERIVED["face_rows"] = _COMPONENTS.format(
    vertices="SELECT id AS vertex FROM photos WHERE session_id IS NOT NULL",
    edges="""SELECT DISTINCT x.photo_id AS a, y.photo_id AS b FROM face_observations x JOIN photos p ON p.id = x.photo_id JOIN photos q ON q.session_id = p.session_id AND q.id <> p.id
      JOIN face_observations y ON y.photo_id = q.id AND bit_count(xor(x.appearance_hash, y.appearance_hash)) <= 10""") + """
SELECT label AS group_id, session_id, id FROM c JOIN photos ON id = node WHERE label IN (SELECT label FROM c GROUP BY label HAVING count(*) > 1)"""


@query("E04_face_groups", "SELECT * FROM face_rows", "photos face_observations face_rows")
def face_groups(c: Catalog) -> DataFrame:
    return simjoin.face_groups(c.view("face_observations"), c.photos)


DERIVED["bursts"] = f"""
WITH RECURSIVE o AS (
  SELECT session_id, id, floor(epoch(capture_datetime::TIMESTAMP))::BIGINT AS t, row_number() OVER (PARTITION BY session_id ORDER BY capture_datetime, id) AS n
  FROM photos WHERE session_id IS NOT NULL AND capture_datetime IS NOT NULL
), r AS (
  SELECT session_id, id, t, n, t AS start FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.id, o.t, o.n, CASE WHEN o.t - r.start <= {GAP} THEN r.start ELSE o.t END FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1
)
SELECT session_id, start, id FROM (SELECT *, count(*) OVER (PARTITION BY session_id, start) AS k FROM r) WHERE k > 1"""


@query("E06_bursts", "SELECT * FROM bursts", "photos bursts")
def bursts(c: Catalog) -> DataFrame:
    return sequence.bursts(c.photos, GAP)


DERIVED["members"] = "SELECT 'burst' AS group_type, start + session_id * 10000000000 AS group_id, session_id, id FROM bursts"


def members(c: Catalog) -> DataFrame:
    return sequence.bursts(c.photos, GAP).select(F.lit("burst").alias("group_type"), (F.col("start") + F.col("session_id") * F.lit(10_000_000_000)).alias("group_id"), "session_id", "id")


@query("E07_burst_labels", "SELECT session_id, 'burst:' || start::VARCHAR AS label, count(*) AS photos, min(id) AS lowest FROM bursts GROUP BY 1, 2", "photos bursts")
def burst_labels(c: Catalog) -> DataFrame:
    return sequence.bursts(c.photos, GAP).groupBy("session_id", F.concat(F.lit("burst:"), F.col("start").cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("photos"), F.min("id").alias("lowest"))


@query("E10_group_list", """
SELECT group_type, group_id, count(*) AS photo_count, count(DISTINCT p.session_id) AS sessions, count(*) FILTER (possible_blink) AS blinks,
  count(*) FILTER (closed_eye_face_count > 0) AS closed_eyes, count(*) FILTER (closed_eye_face_count IS NULL) AS unevaluated
FROM members m JOIN photos p ON p.id = m.id LEFT JOIN analysis a ON a.photo_id = p.id GROUP BY 1, 2""", "photos analysis bursts members")
def group_list(c: Catalog) -> DataFrame:
    return sequence.group_list(members(c), c.joined)


@query("E11_covers", """
SELECT * FROM (SELECT group_type, group_id, row_number() OVER (PARTITION BY group_type, group_id ORDER BY capture_datetime NULLS LAST, m.id)::INTEGER AS place, m.id FROM members m JOIN photos p ON p.id = m.id) WHERE place <= 4""", "photos bursts members")
def covers(c: Catalog) -> DataFrame:
    return sequence.covers(members(c), c.photos)


_ORDER = {
    "chronology": "",
    "sharpness": "sharpness DESC NULLS LAST, ",
    "clipping": "highlight_clipping + shadow_clipping NULLS LAST, ",
    "eyes": "CASE WHEN closed_eye_face_count > 0 THEN 2 WHEN eye_evaluated_count > 0 THEN 0 ELSE 1 END, ",
}


def _page(name: str):
    def run(c: Catalog) -> DataFrame:
        rows = members(c).drop("session_id").join(c.joined, "id")
        place = F.row_number().over(Window.partitionBy("group_type", "group_id").orderBy(*sequence.page_order(name)))
        return rows.select("group_type", "group_id", "id", place.alias("place"))

    return run


for _n, _k in (("E12", "chronology"), ("E13", "sharpness"), ("E14", "clipping"), ("E15", "eyes")):
    query(f"{_n}_page_by_{_k}", f"""SELECT group_type, group_id, m.id, row_number() OVER (PARTITION BY group_type, group_id ORDER BY {_ORDER[_k]}capture_datetime NULLS LAST, m.id)::INTEGER AS place
FROM members m JOIN photos p ON p.id = m.id LEFT JOIN analysis a ON a.photo_id = p.id""", "photos analysis bursts members")(_page(_k))


DERIVED["states"] = """SELECT photo_id, face_index, appearance_hash AS hash, CASE WHEN left_eye_open_prob >= 0.8 AND right_eye_open_prob >= 0.8 THEN 'open'
  WHEN left_eye_open_prob <= 0.2 AND right_eye_open_prob <= 0.2 THEN 'closed' END AS state FROM face_observations"""
DERIVED["frames"] = """SELECT p.id, p.session_id, p.capture_datetime, coalesce(eye_algorithm_version = 2 AND face_count >= 0 AND eye_evaluated_count = 2 * face_count AND coalesce(n, 0) = face_count AND coalesce(known, 0) = coalesce(n, 0), false) AS evaluable
  FROM photos p LEFT JOIN analysis a ON a.photo_id = p.id LEFT JOIN (SELECT photo_id, count(*) AS n, count(state) AS known FROM states GROUP BY 1) s ON s.photo_id = p.id"""


@query("E16_eye_states", "SELECT photo_id, face_index, state FROM states", "face_observations states")
def eye_states(c: Catalog) -> DataFrame:
    return c.view("face_observations").select("photo_id", "face_index", sequence.eye_state("left_eye_open_prob", "right_eye_open_prob").alias("state"))


@query("E17_evaluable_frames", "SELECT id, evaluable FROM frames", "photos analysis face_observations states frames")
def evaluable_frames(c: Catalog) -> DataFrame:
    return sequence.frames(c.photos, c.analysis, c.view("face_observations")).select("id", "evaluable")


@query("E18_possible_blinks", """
WITH o AS (
  SELECT start, f.*, lag(f.id) OVER w AS before_id, lead(f.id) OVER w AS after_id, lag(evaluable) OVER w AS before_ok, lead(evaluable) OVER w AS after_ok
  FROM bursts b JOIN frames f ON f.id = b.id WINDOW w AS (PARTITION BY b.session_id, start ORDER BY f.capture_datetime NULLS LAST, f.id)
), k AS (SELECT * FROM o WHERE before_ok AND evaluable AND after_ok), hit AS (
  SELECT DISTINCT k.id FROM k JOIN states c ON c.photo_id = k.id AND c.state = 'closed'
  JOIN states x ON x.photo_id = before_id AND x.state = 'open' AND bit_count(xor(x.hash, c.hash)) <= 10
  JOIN states y ON y.photo_id = after_id AND y.state = 'open' AND bit_count(xor(y.hash, c.hash)) <= 10
)
SELECT k.id, hit.id IS NOT NULL AS possible_blink FROM k LEFT JOIN hit ON hit.id = k.id""", "photos analysis face_observations states frames bursts")
def possible_blinks(c: Catalog) -> DataFrame:
    return sequence.blinks(sequence.bursts(c.photos, GAP), sequence.frames(c.photos, c.analysis, c.view("face_observations")))


_KINDS = """
SELECT group_type, group_id, session_id, id FROM members UNION ALL SELECT 'similar', group_id, session_id, id FROM similar_rows
UNION ALL SELECT 'cross-session', group_id, session_id, id FROM cross_rows UNION ALL SELECT 'face', group_id, session_id, id FROM face_rows"""
DERIVED["kinds"] = _KINDS
_KIND_VIEWS = "photos face_observations bursts members similar_rows cross_rows face_rows kinds"


_GROUPS = {"burst": members, "similar": similar_groups, "cross-session": cross_session_groups, "face": face_groups}


def all_members(c: Catalog, kinds: list[str] | None = None, across: bool = True) -> DataFrame:
    """(group_type, group_id, session_id, id) of the groups of some kinds; of bursts, similar, face and, with across, cross-session groups if none is named."""
    named = kinds or [k for k in _GROUPS if across or k != "cross-session"]
    found = [_GROUPS[k](c).select(F.lit(k).alias("group_type"), "group_id", "session_id", "id") for k in named]
    return reduce(DataFrame.unionByName, found)


@query("E08_all_groups", "SELECT group_type, group_id, id FROM kinds", _KIND_VIEWS)
def all_groups(c: Catalog) -> DataFrame:
    return all_members(c).select("group_type", "group_id", "id")


@query("E24_groups_of_tab", """
SELECT group_type, group_id, count(*) AS photo_count, count(DISTINCT p.session_id) AS sessions FROM kinds k JOIN photos p ON p.id = k.id WHERE group_type IN ('face', 'cross-session') GROUP BY 1, 2""", _KIND_VIEWS)
def groups_of_tab(c: Catalog) -> DataFrame:
    """The group list of some kinds alone."""
    kinds = ["face", "cross-session"]
    rows = c.photos.join(exchanged(c.analysis), F.col("id") == F.col("photo_id"), "left")
    return sequence.group_list(sequence.of_kinds(all_members(c, kinds), kinds), rows).select("group_type", "group_id", "photo_count", "sessions")


@query("E26_similarity_summary", """
SELECT group_type, groups, photos, hashed, failed FROM (SELECT group_type, count(DISTINCT group_id) AS groups, count(*) AS photos FROM kinds GROUP BY 1)
CROSS JOIN (SELECT count(phash) AS hashed, count(*) FILTER (phash IS NULL) AS failed FROM photos)""", _KIND_VIEWS)
def similarity_summary(c: Catalog) -> DataFrame:
    """Groups and photos of each kind, beside the photos hashed and those that failed."""
    return sequence.similarity_summary(all_members(c), c.photos)


@query("E22_comparison_window", """
SELECT session_id, start, string_agg(id::VARCHAR, ',' ORDER BY k) AS ids FROM (
  SELECT *, max(CASE WHEN sharp = 1 THEN k END) OVER g AS f FROM (
    SELECT b.session_id, b.start, b.id, count(*) OVER (PARTITION BY b.session_id, b.start) AS n, row_number() OVER (PARTITION BY b.session_id, b.start ORDER BY capture_datetime NULLS LAST, b.id) - 1 AS k,
      row_number() OVER (PARTITION BY b.session_id, b.start ORDER BY sharpness DESC NULLS LAST, b.id) AS sharp
    FROM bursts b JOIN photos p ON p.id = b.id LEFT JOIN analysis a ON a.photo_id = b.id) WINDOW g AS (PARTITION BY session_id, start))
WHERE k >= greatest(0, least(f - 1, n - 4)) AND k < greatest(0, least(f - 1, n - 4)) + 4 GROUP BY 1, 2""", "photos analysis bursts")
def comparison_window(c: Catalog) -> DataFrame:
    """Up to four photos around the sharpest one of each burst, in order of capture, clamped to its ends."""
    rows = sequence.bursts(c.photos, GAP).drop("session_id").join(c.joined, "id").select("session_id", "start", "id", "capture_datetime", "sharpness")
    best = Window.partitionBy("session_id", "start").orderBy(F.col("sharpness").desc_nulls_last(), "id")
    shown = sequence.comparison_window(rows.withColumn("focus", F.row_number().over(best) == 1), ["session_id", "start"])
    return shown.groupBy("session_id", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


def review_queue(c: Catalog) -> DataFrame:
    """Photos of each session in order of capture with the bursts, similar and face groups they belong to."""
    named = all_members(c, ["burst", "similar", "face"]).select("id", F.struct(F.col("group_type").alias("kind"), "group_id").alias("s"))
    by = named.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("sequences"))
    rows = c.photos.where("session_id is not null").select("id", "session_id", "capture_datetime")
    return sequence.placed_within(rows, "session_id", [F.col("capture_datetime").asc_nulls_last(), F.col("id")], "index").drop("capture_datetime").join(exchanged(by), "id", "left")


@query("E19_review_queue", """
SELECT p.id, p.session_id, (row_number() OVER (PARTITION BY p.session_id ORDER BY capture_datetime NULLS LAST, p.id) - 1)::INTEGER AS index, coalesce(n, 0) AS sequences
FROM photos p LEFT JOIN (SELECT id, count(*) AS n FROM kinds WHERE group_type <> 'cross-session' GROUP BY id) s ON s.id = p.id WHERE p.session_id IS NOT NULL""", _KIND_VIEWS)
def review_queue_sizes(c: Catalog) -> DataFrame:
    return review_queue(c).select("id", "session_id", "index", F.coalesce(F.size("sequences").cast("long"), F.lit(0)).alias("sequences")).withColumn("sequences", F.greatest("sequences", F.lit(0)))


@query("E20_review_units", """
WITH RECURSIVE o AS (
  SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY capture_datetime NULLS LAST, id) - 1 AS i FROM photos WHERE session_id IS NOT NULL
), q AS (
  SELECT o.session_id, CASE WHEN group_type = 'burst' THEN 'burst' ELSE 'similar' END AS kind, group_type, group_id, array_agg(o.id ORDER BY i) AS ids, min(i) AS first
  FROM kinds JOIN o ON o.id = kinds.id WHERE group_type <> 'cross-session' GROUP BY ALL HAVING count(*) > 1
), s AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind <> 'burst', first, group_type <> 'similar', group_id) AS n FROM q
), r AS (
  SELECT DISTINCT session_id, 0::BIGINT AS n, '' AS kind, []::BIGINT[] AS got, []::BIGINT[] AS used FROM s
  UNION ALL
  SELECT session_id, n, kind, CASE WHEN len(f) > 1 THEN f ELSE [] END, CASE WHEN len(f) > 1 THEN list_concat(used, f) ELSE used END
  FROM (SELECT s.session_id, s.n, s.kind, r.used, list_filter(s.ids, lambda x: NOT list_contains(r.used, x)) AS f FROM r JOIN s ON s.session_id = r.session_id AND s.n = r.n + 1)
), c AS (
  SELECT session_id, kind, n, unnest(got) AS id FROM r WHERE len(got) > 0
), u AS (
  SELECT o.session_id, o.id, o.i, coalesce(c.kind, 'single') AS kind, min(o.i) OVER (PARTITION BY o.session_id, coalesce(c.n, -1 - o.i)) AS first FROM o LEFT JOIN c ON c.id = o.id
)
SELECT session_id, (dense_rank() OVER (PARTITION BY session_id ORDER BY first) - 1)::INTEGER AS unit, kind, (row_number() OVER (PARTITION BY session_id, first ORDER BY i) - 1)::INTEGER AS place, id FROM u""", _KIND_VIEWS)
def review_units(c: Catalog) -> DataFrame:
    return sequence.review_units(review_queue(c))


@query("E23_review_counts", "SELECT session_id, count(*) AS photos, count(state) AS reviewed, count(*) FILTER (state = 'selected') AS selected, count(*) FILTER (state = 'rejected') AS rejected FROM photos p LEFT JOIN selections s ON s.photo_id = p.id GROUP BY 1", "photos selections")
def review_counts(c: Catalog) -> DataFrame:
    met = c.photos.join(c.view("selections"), F.col("id") == F.col("photo_id"), "left")
    return met.groupBy("session_id").agg(F.count(F.lit(1)).alias("photos"), F.count("state").alias("reviewed"), F.count_if(F.col("state") == "selected").alias("selected"), F.count_if(F.col("state") == "rejected").alias("rejected"))


@query("E21_first_unreviewed", "SELECT session_id, coalesce(min_by(id, (capture_datetime IS NULL, capture_datetime, id)) FILTER (state IS NULL), min_by(id, (capture_datetime IS NULL, capture_datetime, id))) AS id FROM photos p LEFT JOIN selections s ON s.photo_id = p.id WHERE session_id IS NOT NULL GROUP BY 1", "photos selections")
def first_unreviewed(c: Catalog) -> DataFrame:
    met = c.photos.where("session_id is not null").join(c.view("selections"), F.col("id") == F.col("photo_id"), "left")
    place = F.struct(F.col("capture_datetime").isNull(), "capture_datetime", "id")
    return met.groupBy("session_id").agg(F.min(F.when(F.col("state").isNull(), place)).alias("a"), F.min(place).alias("b")).select("session_id", F.coalesce("a.id", "b.id").alias("id"))


@query("E25_capture_signals", """
SELECT group_type, group_id, concat_ws(', ', CASE WHEN b > 0 THEN b || CASE WHEN b = 1 THEN ' possible blink' ELSE ' possible blinks' END END,
  CASE WHEN k > 0 THEN k || CASE WHEN k = 1 THEN ' closed eye' ELSE ' closed eyes' END END) AS signals
FROM (SELECT group_type, group_id, count(*) FILTER (possible_blink) AS b, count(*) FILTER (closed_eye_face_count > 0) AS k
  FROM members m LEFT JOIN analysis a ON a.photo_id = m.id GROUP BY 1, 2)""", "photos analysis bursts members")
def capture_signals(c: Catalog) -> DataFrame:
    said = lambda n, word: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {word}"), F.when(F.col(n) == 1, "").otherwise("s")))
    return sequence.group_list(members(c), c.joined).select("group_type", "group_id", F.concat_ws(", ", said("blinks", "possible blink"), said("closed_eyes", "closed eye")).alias("signals"))
