"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it names none, a temporary folder if all runs in one process.

    A cluster must name one, since executors share no other folder for sure.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumenlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """df for a join that grows with the input, by a sort-merge join.

    Spark knows a written table by the bytes of its files, which hold a long id in two or three bytes; as a broadcast table,
    which the driver builds, it takes 64.
    """
    return df.hint("merge")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that write_table made."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Parts of a table that is replaced by session: folders and files do not grow with the sessions.
SESSION_PARTS = 64


def replaced_by_session(rows: DataFrame, renew: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (session_id, ...) stored by parts of sessions, after `renew` of the stored table replaced the sessions that it returns.

    A part that a replaced session falls into is written anew, with the rows of its other sessions as they were; the other parts
    stay untouched.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/by-session-{uuid.uuid4().hex}"

    def save(df: DataFrame, mode: str) -> None:
        df.repartition(SESSION_PARTS, "part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    part = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_PARTS)).cast("int").alias("part")
    save(rows.select("*", part), "error")
    stored = spark.read.schema(f"{rows._jdf.schema().toDDL()}, part int").parquet(path)
    # on disk first, since a part cannot be overwritten while it is read
    new = write_table(renew(stored.drop("part")).select(*rows.columns, part), "renewed")
    sessions = new.select("session_id", "part").distinct()
    kept = stored.join(sessions.select("part").distinct(), "part", "left_semi").join(sessions.select("session_id"), "session_id", "left_anti")
    save(write_table(new.unionByName(kept), "parts"), "overwrite")
    return spark.read.schema(stored.schema).parquet(path).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b", sent: int = 0) -> DataFrame:
    """Connected components of an edge table, as (node, label) with the smallest node as label.

    Each round points every node at its smallest neighbour, follows that pointer once more and
    contracts the edges, so of each edge's two ends one at least goes; rounds end when no edge is left.
    A round of at most `sent` edges, either way counted, broadcasts its pointers, which are no more; in others, nothing but
    their number reaches the driver.  Loops and null ends are ignored.
    """
    once = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    live = write_table(once.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))), "edges")
    found, rounds = live.select(F.col("a").alias("node"), F.col("a").alias("cur")), 0
    while count := live.count():
        met = F.broadcast if count <= sent else exchanged
        # a table of its own, so that the join reads both sides from exchanges that Spark can split at a pointer that many nodes share
        near = write_table(live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "nearest")
        up = write_table(near.alias("x").join(met(near.alias("y")), F.col("x.p") == F.col("y.a"), "left").select("x.a", F.coalesce("y.p", "x.p").alias("p")), "parents")
        left, right = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        after = write_table(live.join(met(left), "a").join(met(right), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        # in the first round each node is its own label, so its pointer is the next one
        moved = found.join(met(up.withColumnRenamed("a", "cur")), "cur", "left").select("node", F.coalesce("p", "cur").alias("cur")) if rounds else up.toDF("node", "cur")
        before, found = (live, found), write_table(moved, "labels")
        for old in (near, up, *before):
            drop_table(old) if old.inputFiles() else None
        live, rounds = after, rounds + 1
    return found.select("node", F.col("cur").alias("label"))
