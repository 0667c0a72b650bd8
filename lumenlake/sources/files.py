"""Folder scans: files to photo rows, without reading their contents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by class.
CLASSES = {
    "decodable": ["jpg", "jpeg", "png", "webp", "tif", "tiff"],
    "raw": ["cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2"],
    "heic": ["heic", "heif"],
}


def extension_class(extension: str) -> Column:
    """decodable, raw, heic or ignored, whatever the case."""
    e = F.lower(extension)
    out = F.when(e.isin(CLASSES["decodable"]), "decodable")
    for name in ("raw", "heic"):
        out = out.when(e.isin(CLASSES[name]), name)
    return out.otherwise("ignored")


def orientation_of(width: str, height: str) -> Column:
    w, h = F.col(width), F.col(height)
    return F.when(w > h, "landscape").when(w < h, "portrait").when(w == h, "square")


def with_names(files: DataFrame) -> DataFrame:
    """files (path, ...) with filename, extension and class; files below a dot folder or with a dot name are left out."""
    named = files.where(~F.col("path").rlike(r"/\.[^/]")).withColumn("filename", F.regexp_extract("path", r"[^/]*$", 0))
    named = named.withColumn("extension", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))
    return named.withColumn("class", extension_class("extension"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Photo files of a folder tree in path order: path, filename, extension, class, size_bytes, file_mtime.

    The content column is never selected, so Spark lists files and reads none of them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("t"))
    rows = with_names(found).where("class <> 'ignored'")
    return rows.select("path", "filename", "extension", "class", "size_bytes", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("file_mtime")).orderBy("path")


def scan_summary(files: DataFrame) -> DataFrame:
    """Visible files, indexed ones and ignored ones; also errors, where files say by `failed` which could not be read."""
    used = F.col("class") != "ignored"
    counts = [F.count(F.lit(1)).alias("total_files"), F.count_if(used).alias("indexed"), F.count_if(~used).alias("ignored")]
    errors = [F.count_if(used & F.col("failed")).alias("errors")] if "failed" in files.columns else []
    return with_names(files).agg(*counts, *errors)


def _header_size(head: bytes | None) -> tuple[int, int] | None:
    """Width and height that the head of a PNG or JPEG file states."""
    head = bytes(head or b"")
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    at = 2 if head[:2] == b"\xff\xd8" else len(head)
    while at + 9 <= len(head) and head[at] == 0xFF:
        kind, length = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        else:
            at += 2 + max(length, 2)
    return None


def header_dimensions(files: DataFrame) -> DataFrame:
    """files (content, ...) with width and height read from PNG and JPEG heads in place of content; null if they state none, or a zero."""

    @F.pandas_udf("width long, height long")
    def read(content: pd.Series) -> pd.DataFrame:
        sizes = [_header_size(c) or (0, 0) for c in content]
        known = lambda i: pd.array([s[i] if min(s) > 0 else None for s in sizes], dtype="Int64")
        return pd.DataFrame({"width": known(0), "height": known(1)})

    return files.withColumn("_size", read("content")).select(*[c for c in files.columns if c != "content"], "_size.*")


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height of images that the JVM can decode; null where a header cannot be read."""
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    size = lambda c: F.when(F.col(f"image.{c}") > 0, F.col(f"image.{c}"))
    return image.select(F.col("image.origin").alias("path"), size("width").alias("width"), size("height").alias("height"))


def manifest(spark: SparkSession, path: str, schema: str = "id long, status string") -> DataFrame:
    """Rows of a JSON-lines manifest; a line that is none has only its text, in _corrupt."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows
