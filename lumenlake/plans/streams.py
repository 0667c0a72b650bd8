"""Streaming queries, run over all that is there and returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.plans.registry import query
from lumenlake.sources.catalog import Catalog
from lumenlake.streaming import ingest


@query("E28_activity_windows", "SELECT date_trunc('hour', ts) AS start, user_id AS session_id, count(*) AS frames FROM events GROUP BY 1, 2")
def activity_windows(c: Catalog) -> DataFrame:
    out = ingest.settled(ingest.activity(ingest.frames(c.spark, c.sf_dir)), "update", ["start", "session_id"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("E28_shoots", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS session_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS frames FROM s GROUP BY user_id, k""")
def shoots(c: Catalog) -> DataFrame:
    """All shoots of the frames that are there, those that a frame could still lengthen as they stand."""
    out = ingest.settled(ingest.shoots(ingest.frames(c.spark, c.sf_dir), None), "complete", store=ingest.ROCKSDB)
    return out.withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("start", "end")})


@query("E29_imported_once", "SELECT '/shoot/' || user_id::VARCHAR || '/' || (event_id % 500)::VARCHAR AS path, ts AS t FROM events GROUP BY 1, 2")
def imported_once(c: Catalog) -> DataFrame:
    return ingest.settled(ingest.once(ingest.frames(c.spark, c.sf_dir))).select("path", F.col("t").cast("timestamp_ntz").alias("t"))


@query("E27_streaming_bursts", """
WITH RECURSIVE o AS (
  SELECT user_id AS session_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events
), r AS (
  SELECT session_id, t, n, t AS start FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.t, o.n, CASE WHEN o.t - r.start <= 7200 THEN r.start ELSE o.t END FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1
)
SELECT session_id, make_timestamp(start * 1000000) AS start, count(*) AS photos FROM r GROUP BY session_id, start HAVING count(*) > 1 AND start + 7200 < floor((SELECT max(epoch(ts)) FROM events) - 3600)""")
def streaming_bursts(c: Catalog) -> DataFrame:
    """Bursts that the watermark has closed."""
    out = ingest.settled(ingest.bursts(ingest.frames(c.spark, c.sf_dir), 7200), store=ingest.ROCKSDB)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("A29_continuous_ingest", "SELECT '/shoot/' || user_id::VARCHAR || '/' || (event_id % 500)::VARCHAR AS path, min(event_id) AS id, max(ts) AS t FROM events GROUP BY 1")
def continuous_ingest(c: Catalog) -> DataFrame:
    """New files become photo rows once: each micro-batch keeps its first id and last time of a path, which reading combines."""
    out = ingest.folded(ingest.frames(c.spark, c.sf_dir), "path", {"id": F.min("id"), "t": F.max("t")})
    return out.withColumn("t", F.col("t").cast("timestamp_ntz"))
