"""Content-addressed web archive: payload bytes once by strong digest, exact record headers apart.

`write_archive` puts two tables into a folder: payloads (digest, payload), one row per distinct
payload, and headers (seq-less rows of page_id, digest, header), one row per record with the exact bytes that
stand before the payload.  `read_records` joins them back to whole records and refuses a payload
whose SHA-256 is not its key.

Records with equal payloads of at least `revisit_from` bytes: the one with the largest page_id is the
response, the others are revisits of it.

Defined cases: a null html has an empty payload; a null url gives the target URI `urn:none`; a null page_id is
smaller than any other and stands as `null` in the header; of repeated rows of the largest page_id one with the
smallest url, null first, stays the response and the rest are revisits of it; repeated rows of one payload share their
record id; empty tables give empty archives; other columns of pages are not archived.  A payload, with or without
ids, may recur in any share of the rows: payloads are reduced before they are shuffled, the response of a payload is
found from ids and digests alone, and repeated rows of the largest id are counted, not ordered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import shared_dir, write_table

#: The smallest payload that is stored as a revisit when it recurs.
REVISIT_FROM = 1000
EOL = "\r\n"
#: Fixed value: what the standard calls a record that repeats a payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal rows that are written again at a time from their count.
CHUNK = 4096


def record_types(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, digest, sha1, bytes, record_type, refers_to: one row per page, without payloads."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    last = rows.where(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own, so that the join can be split at a payload that recurs very often
    rows = rows.join(write_table(last, "repeated-payloads"), "digest", "left")
    heads = F.col("n").isNotNull() & F.col("page_id").eqNullSafe(F.col("last_id"))
    rest = rows.where(~heads).withColumn("first", F.col("n").isNull())
    # equal rows of the largest id are one row with a count, so no task holds or orders a group of them
    equal = write_table(rows.where(heads).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "largest-ids")
    lead = equal.groupBy("digest").agg(F.min(F.struct("url")).alias("lead"))
    from_ = F.col("chunk") * CHUNK
    each = equal.join(lead, "digest").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK)))).repartition("digest", "chunk")
    each = each.withColumn("k", F.explode(F.sequence(from_, F.least(from_ + CHUNK, "times") - 1)))
    again = each.withColumn("first", (F.col("k") == 0) & F.col("url").eqNullSafe(F.col("lead.url"))).select(rest.columns)
    kept = rest.unionByName(again)
    return kept.select("page_id", "url", "digest", "sha1", "bytes", F.when(F.col("first"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("first"), F.col("last_id")).alias("refers_to"))


def _header(date: str) -> F.Column:
    """The exact text before the payload of one record."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    name = F.md5(F.concat_ws("|", page, F.col("digest")))
    uid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(EOL))
    stored = F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.lit(0)).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Page-ID", page), line("X-Payload-Bytes", F.col("bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("X-Refers-To-Page-ID", F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))).otherwise(F.lit("")),
        line("Content-Length", stored), F.lit(EOL))


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the payloads and headers tables below path."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    blobs = pages.select(payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    blobs.dropDuplicates(["digest"]).select("digest", "payload").write.parquet(f"{path}/payloads")
    record_types(pages, revisit_from).select("page_id", "digest", _header(date).alias("header")).write.parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record of an archive; payload is the full one, of revisits too.

    A header without its payload, or a payload that does not have its digest, raises.
    """
    heads = spark.read.schema("page_id long, digest string, header string").parquet(f"{path}/headers")
    blobs = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    refuse = F.raise_error(F.concat(F.lit("archive: no sound payload for "), F.col("digest"))).cast("binary")
    # once for each payload, before the join repeats it for each of its records
    sound = blobs.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(refuse))
    rows = heads.join(sound, "digest", "left")
    return rows.select("header", F.coalesce("payload", refuse).alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The whole records as they stand in a WARC file: header, stored payload, two line ends."""
    stored = F.when(F.col("header").contains(f"{EOL}WARC-Type: response{EOL}"), F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return records.select(F.concat(F.encode("header", "UTF-8"), stored, F.encode(F.lit(EOL * 2), "UTF-8")).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """What the records say: page_id, payload_bytes, payload_digest, record_type, refers_to; sizes and digests are those of the bytes read."""
    said = lambda key: F.regexp_extract("header", rf"\r\n{key}: ([^\r\n]*)", 1)
    long = lambda key: F.expr(f"try_cast(regexp_extract(header, '\\\\r\\\\n{key}: ([0-9-]+)', 1) as bigint)")
    return records.select(long("X-Page-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), said("WARC-Type").alias("record_type"), long("X-Refers-To-Page-ID").alias("refers_to"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages to a new archive in the shared folder and return what reading it back gives."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return parsed(read_records(spark, path))
