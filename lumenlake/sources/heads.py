"""A data source that reads the dimensions of image files from their first bytes.

Spark's own image source decodes every pixel, and its binary source reads whole files.  This one lists a folder once, deals the
files out to partitions, and opens each to read a few kilobytes; more only while the header goes on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlake.sources.exif import _entries

SCHEMA = "path string, size_bytes long, width long, height long, read_bytes long"
#: Bytes that are read of a file at first and at most, and files of a partition.
FIRST, MOST, FILES = 4096, 1 << 20, 512


def png_size(head: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", head[16:24]) if head[12:16] == b"IHDR" and len(head) >= 24 else None


def jpeg_size(head: bytes) -> tuple[int, int] | None:
    """Size from the frame header, which may stand behind long segments of metadata."""
    at = 2
    while at + 9 <= len(head) and head[at] == 0xFF:
        kind, length = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + max(length, 2)
    return None


def webp_size(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8X" and len(head) >= 30:
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a" and len(head) >= 30:
        return tuple(n & 0x3FFF for n in struct.unpack("<HH", head[26:30]))
    if kind == b"VP8L" and head[20:21] == b"\x2f" and len(head) >= 25:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def tiff_size(head: bytes) -> tuple[int, int] | None:
    order = "<" if head[:2] == b"II" else ">"
    tags = dict(_entries(head, order, struct.unpack(order + "I", head[4:8])[0]))
    return (tags[0x0100], tags[0x0101]) if {0x0100, 0x0101} <= tags.keys() else None


def size_of(head: bytes) -> tuple[int, int] | None:
    """Width and height that a PNG, JPEG, WebP or TIFF file states; null for others, where the head ends too soon, and for a zero."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            found = png_size(head)
        elif head[:2] == b"\xff\xd8":
            found = jpeg_size(head)
        elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            found = webp_size(head)
        else:
            found = tiff_size(head) if head[:4] in (b"II*\0", b"MM\0*") else None
    except struct.error:
        return None
    return found if found and min(found) > 0 else None


class HeadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.files = options["path"], int(options.get("filesPerPartition", FILES))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = self._store()
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File)
        return [InputPartition(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._store()
        for path, size in partition.value:
            found, n = None, 0
            try:
                with store.open_input_file(path) as file:
                    head = b""
                    while found is None and n < min(size, MOST):
                        n = min(size, MOST, max(FIRST, 4 * n))
                        head += file.read(n - len(head))
                        found = size_of(head)
                        if head[:2] not in (b"\xff\xd8", b"II", b"MM"):
                            break
            except OSError:
                found = None
            yield path, size, *(found or (None, None)), n


class HeadSource(DataSource):
    """Format `image_heads`; options: path (a folder or its address), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "image_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def image_heads(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """(path, size_bytes, width, height, read_bytes) of all files below a folder; dimensions are null where the head states none or cannot be read."""
    spark.dataSource.register(HeadSource)
    return spark.read.format("image_heads").option("filesPerPartition", files).load(folder)
