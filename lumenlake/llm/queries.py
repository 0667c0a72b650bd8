"""Registered queries of the training-data operators and the SQL that DuckDB checks them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import backoff_automaton, cotraining, edit_join, grammar_runs, impact_index, langid, line_hash_dedup, mixing, order_minhash, pii, spaced_seed, warc_store, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(_table(spark, sf_dir, "documents"), narrow=True)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hash_dedup.repeated_units(_table(spark, sf_dir, "documents")).drop("text_key")


def op3_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines with a character, how many of them repeat an earlier one, and their numbers."""
    lines = edit_join.removed_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return impact_index.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op9_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archived_pages(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), 4)


def op12_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_runs.document_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_automaton.scored(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_line_hash_dedup": op2_line_hash_dedup,
    "op3_edit_join": op3_edit_join,
    "op4_order_minhash": op4_order_minhash,
    "op5_impact_topk": op5_impact_topk,
    "op6_cotraining": op6_cotraining,
    "op7_spaced_seeds": op7_spaced_seeds,
    "op8_language_hierarchy": op8_language_hierarchy,
    "op9_pii_bilstm_crf": op9_pii_bilstm_crf,
    "op10_warc_store": op10_warc_store,
    "op11_whitening": op11_whitening,
    "op12_grammar_runs": op12_grammar_runs,
    "op13_backoff_automaton": op13_backoff_automaton,
}

#: CRC-32 of the decimal doc_id, which DuckDB lacks: the digits' codes and eight shifts after each.
CRC = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ord(c)::UBIGINT] || list_transform(range(8), lambda i: 1000::UBIGINT)))),
  lambda a, x: CASE WHEN x = 1000 THEN xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) ELSE xor(a, x) END))::BIGINT"""

ORACLE_SQL = {
    "op1_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), s3 AS (
  SELECT *, max(level) FILTER (level * weight <= cap) OVER () AS share FROM s2
), t AS (
  SELECT source, source_size, CASE WHEN share IS NULL THEN cap ELSE least(cap, share * weight) END AS target FROM s3
), h0 AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size
), h1 AS (
  SELECT h0.source, size, target,
         coalesce(sum(n * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fully,
         (sum(n * size * size) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM h0 JOIN t ON h0.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY h0.source ORDER BY size DESC)
), h2 AS (
  SELECT *, (target - 3.0::DOUBLE * fully) / rest AS k FROM h1
), r AS (
  SELECT source, max_by(k, size) AS k FROM h2 WHERE k * size <= 3 GROUP BY source
), e AS (
  SELECT d.*, source_size, target, least(3.0::DOUBLE, coalesce(k * size, CASE WHEN size > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END)) AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source
), p AS (
  SELECT *, floor(e)::BIGINT AS copies, e - floor(e) AS p FROM e
), z AS (
  SELECT *, target - (sum(copies * size) OVER (PARTITION BY source))::DOUBLE AS remains,
         CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS z
  FROM p
), c AS (
  SELECT *, sum(CASE WHEN z IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY z NULLS LAST, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS upto
  FROM z
)
SELECT doc_id, source, size, source_size, target,
       (copies + CASE WHEN z IS NOT NULL AND upto <= remains THEN 1 ELSE 0 END) * size AS taken
FROM c""",
    "op2_line_hash_dedup": r"""
WITH p0 AS (
  SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?]+)(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS p FROM documents WHERE text IS NOT NULL
), p1 AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM p0
), p2 AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs,
         regexp_replace(piece, '^\s+|\s+$', '', 'g') AS body, length(piece) - length(regexp_replace(piece, '^\s+', '')) AS blank,
         coalesce(count(*) FILTER (ends_with(piece, chr(10))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lines FROM p1
), u0 AS (
  SELECT doc_id, i, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS unit, (offs + blank)::INTEGER AS start, (offs + blank + length(body))::INTEGER AS "end",
         lower(regexp_replace(body, '\s+', ' ', 'g')) AS norm, len(string_split(regexp_replace(body, '\s+', ' ', 'g'), ' ')) AS n, lines FROM p2 WHERE body <> ''
), u AS (
  SELECT *, sum(CASE WHEN n >= 6 OR prior IS NULL OR prior >= 6 OR lines > prior_lines THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(n) OVER o AS prior, lag(lines) OVER o AS prior_lines FROM u0 WINDOW o AS (PARTITION BY doc_id ORDER BY i))
), w AS (
  SELECT doc_id, min(unit) AS unit, min(start) AS start, max("end") AS "end", string_agg(norm, ' ' ORDER BY unit) AS norm, sum(n)::INTEGER AS words FROM u GROUP BY doc_id, run
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS kept_doc_id, row_number() OVER (PARTITION BY norm, doc_id ORDER BY unit) AS again FROM w WHERE words >= 6
)
SELECT doc_id, unit, start, "end", words, kept_doc_id FROM g WHERE doc_id > kept_doc_id OR again > 1""",
    "op3_edit_join": r"""
WITH RECURSIVE l0 AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), l1 AS (
  SELECT doc_id, unnest(range(len(x))) AS line, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS t FROM l0
), l AS (
  SELECT * FROM l1 WHERE t <> ''
), d AS (
  SELECT DISTINCT t, length(t) AS n FROM l WHERE length(t) >= 16
), e AS (
  SELECT a.t AS a, b.t AS b FROM d a JOIN d b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.t <> b.t
  AND (left(a.t, a.n // 3 - 2) = left(b.t, a.n // 3 - 2) OR right(a.t, a.n // 3 - 2) = right(b.t, a.n // 3 - 2) OR contains(b.t, substr(a.t, a.n // 3 + 3, a.n // 3 - 4)))
  AND levenshtein(a.t, b.t) <= least(2, least(a.n, b.n) // 16)
), r AS (
  SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node
), c AS (
  SELECT node, min(label) AS label FROM r GROUP BY node
), o AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY coalesce(label, t) ORDER BY doc_id, line) AS k FROM l LEFT JOIN c ON node = t
)
SELECT doc_id, count(line) AS n_lines, count(*) FILTER (k > 1) AS n_removed, coalesce(string_agg(CASE WHEN k > 1 THEN line::VARCHAR END, ',' ORDER BY line), '') AS removed
FROM (SELECT doc_id FROM documents) LEFT JOIN o USING (doc_id) GROUP BY doc_id""",
    "op5_impact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), e AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d, len(v) AS n FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_spaced_seeds": r"""
WITH dt AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE doc_id IS NOT NULL
), it AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE item_id IS NOT NULL
), d AS (
  SELECT doc_id, len(t) AS dn, unnest(t) AS w, unnest(range(len(t))) AS p FROM dt
), i AS (
  SELECT item_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS p FROM it
), e AS (
  SELECT doc_id, item_id, n, d.p - i.p AS shift, i.p AS p FROM d JOIN i ON d.w = i.w
  WHERE least(n, dn - (d.p - i.p)) - greatest(0, i.p - d.p) >= least(n, 12)
), w AS (
  SELECT doc_id, item_id, shift, n,
         count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS best,
         count(*) OVER (PARTITION BY doc_id, item_id, shift) AS equal
  FROM e
)
SELECT doc_id, item_id, max(best) AS best, max(equal) AS equal FROM w
WHERE (doc_id, item_id, shift) IN (SELECT (doc_id, item_id, shift) FROM w WHERE best >= CASE WHEN n >= 12 THEN 10 ELSE n END)
GROUP BY doc_id, item_id""",
    "op10_warc_store": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), m AS (
  SELECT *, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS last_id FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM m""",
    "op12_grammar_runs": rf"""
WITH d0 AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE {CRC} END AS h FROM documents
), d1 AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0
), d2 AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d1
), w AS (
  SELECT doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM d2)
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), g AS (
  SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM e
), r0 AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM r0 GROUP BY doc_id, start, length
), s AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * top.l // top.p)::BIGINT AS exponent_milli,
       sha256(coalesce(s.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op13_backoff_automaton": rf"""
WITH d AS (
  SELECT doc_id, {CRC} % 10 = 0 AS held_out, list_concat([' '], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)]) AS t FROM documents
), p AS (
  SELECT doc_id, held_out, unnest(t) AS w, unnest(range(len(t))) AS i FROM d
), g AS (
  SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM p
), one AS (
  SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w
), two AS (
  SELECT h, w, count(*) AS c FROM g WHERE NOT held_out AND i > 0 GROUP BY h, w
), a AS (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM one WHERE w <> ' '
), s AS (
  SELECT g.doc_id, g.held_out, coalesce(one.c, 0) AS c, coalesce(two.c, 0) AS c2, coalesce(before.c, 0) AS ch, n, (coalesce(one.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p
  FROM g CROSS JOIN a LEFT JOIN one ON one.w = g.w LEFT JOIN one before ON before.w = g.h LEFT JOIN two ON two.h = g.h AND two.w = g.w WHERE i > 0
)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, sum(log10(p)) AS base_score, sum(log10((c2 + {backoff_automaton.MU} * p) / (ch + {backoff_automaton.MU}))) AS score
FROM s GROUP BY doc_id""",
}
