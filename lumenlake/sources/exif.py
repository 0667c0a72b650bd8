"""Camera metadata: reads the tag directories of JPEG, TIFF, PNG, WebP and HEIC bytes, and writes small ones."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag numbers.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso_photographic", 0x8833: "iso_speed", 0x8832: "iso_index", 0x9003: "taken", 0x920A: "focal", 0xA405: "focal_35mm", 0xA433: "lens_make", 0xA434: "lens", 0xA002: "width", 0xA003: "height"}
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Files beyond this size are not read.
MOST_BYTES = 256 << 20
RAW = "make string, model string, software string, lens_make string, lens string, taken string, exposure double, aperture double, focal double, focal_35mm double, iso_speed long, iso_index long, iso_photographic long, width long, height long, gps boolean"


def _jpeg(data: bytes) -> bytes | None:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + max(size, 2)
    return None


def _png(data: bytes) -> bytes | None:
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"eXIf":
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return None


def _webp(data: bytes) -> bytes | None:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        if kind == b"EXIF":
            found = data[at + 8 : at + 8 + size]
            return found.removeprefix(b"Exif\0\0")
        at += 8 + size + size % 2
    return None


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes between two places of an ISO media file; one that reaches beyond them ends the walk."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        start = at + 8
        if size == 1 and at + 16 <= end:
            size, start = struct.unpack(">Q", data[at + 8 : at + 16])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            return
        yield kind, start, stop
        at = stop


def _number(data: bytes, at: int, size: int) -> int:
    if at + size > len(data):
        raise ValueError("beyond the end")
    return int.from_bytes(data[at : at + size], "big")


def _exif_item(data: bytes, start: int, end: int) -> int | None:
    """Number of the item of kind Exif in an item table."""
    version = data[start]
    at = start + 4 + (2 if version == 0 else 4)
    for kind, a, b in _boxes(data, at, end):
        wide = 4 if data[a] >= 3 else 2
        if kind == b"infe" and data[a] >= 2 and data[a + 4 + wide + 2 : a + 4 + wide + 6] == b"Exif" and a + 4 + wide + 6 <= b:
            return _number(data, a + 4, wide)
    return None


def _extents(data: bytes, start: int, wanted: int) -> list[tuple[int, int, int]]:
    """(how, offset, size) of the parts of an item by the location table; how is 0 for places in the file, 1 for places in the item data."""
    version = data[start]
    sizes = _number(data, start + 4, 2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    count, at = _number(data, start + 6, wide), start + 6 + wide
    for _ in range(count):
        item, at = _number(data, at, wide), at + wide
        how = 0
        if version:
            how, at = _number(data, at, 2) & 15, at + 2
        at += 2
        base, at = _number(data, at, base_size), at + base_size
        n, at = _number(data, at, 2), at + 2
        parts = []
        for _ in range(n):
            at += index_size
            parts.append((how, base + _number(data, at, offset_size), _number(data, at + offset_size, length_size)))
            at += offset_size + length_size
        if item == wanted:
            return parts
    return []


def _heic(data: bytes) -> bytes | None:
    """The Exif item of an ISO media file, found through its item and location tables."""
    for kind, start, end in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        inner = {k: (a, b) for k, a, b in _boxes(data, start + 4, end)}
        if b"iinf" not in inner or b"iloc" not in inner:
            return None
        item = _exif_item(data, *inner[b"iinf"])
        found = b""
        for how, offset, size in _extents(data, inner[b"iloc"][0], item) if item is not None else []:
            if how > 1 or (how == 1 and b"idat" not in inner):
                return None
            offset += inner[b"idat"][0] if how else 0
            found += data[offset : offset + size]
        # the item begins with the distance of the TIFF part from the end of these four bytes
        return found[4 + struct.unpack(">I", found[:4])[0] :] if len(found) > 8 else None
    return None


def _tiff(data: bytes) -> bytes | None:
    """The TIFF part of a TIFF, JPEG, PNG, WebP or HEIC file; null where there is none or the file is damaged."""
    try:
        if data[:2] in (b"II", b"MM"):
            return data
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        return _heic(data) if data[4:8] == b"ftyp" else None
    except (ValueError, IndexError, struct.error):
        return None


def _entries(t: bytes, order: str, at: int) -> Iterator[tuple[int, object]]:
    """(tag, value) of one directory; what reaches beyond the bytes is left out."""
    if not 0 < at <= len(t) - 2:
        return
    (n,) = struct.unpack(order + "H", t[at : at + 2])
    for i in range(n):
        entry = t[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            return
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        size = _SIZES.get(kind, 0) * count
        start = struct.unpack(order + "I", entry[8:])[0] if size > 4 else None
        raw = entry[8 : 8 + size] if start is None else t[start : start + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            yield tag, raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (3, 4, 9):
            yield tag, struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind], raw[: _SIZES[kind]])[0]
        elif kind in (5, 10):
            a, b = struct.unpack(order + ("II" if kind == 5 else "ii"), raw[:8])
            yield tag, a / b if b else None


def read_tags(data: bytes | None) -> dict:
    """Raw tag values by name; empty where there are none or the bytes are damaged."""
    t = _tiff(data) if data is not None and len(data) <= MOST_BYTES else None
    if t is None or len(t) < 8:
        return {}
    order = "<" if t[:2] == b"II" else ">"
    found = dict(_entries(t, order, struct.unpack(order + "I", t[4:8])[0]))
    out = dict(found)
    if isinstance(found.get(EXIF_DIRECTORY), int):
        out |= dict(_entries(t, order, found[EXIF_DIRECTORY]))
    named = {name: out[tag] for tag, name in TAGS.items() if out.get(tag) is not None}
    return named | {"gps": isinstance(found.get(GPS_DIRECTORY), int) and any(True for _ in _entries(t, order, found[GPS_DIRECTORY]))}


def raw_tags(files: DataFrame, key: str) -> DataFrame:
    """key and raw tags of files (key, content)."""
    kinds = dict(c.split() for c in RAW.split(", "))
    read = {"string": (str, pa.string()), "double": (float, pa.float64()), "long": (int, pa.int64()), "boolean": (bool, pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_tags(c) for c in batch["content"].to_pylist()]
            made = [pa.array([None if r.get(n) is None else read[k][0](r[n]) for r in rows], read[k][1]) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch[key], *made], names=[key, *kinds])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {RAW}")


def _text(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def stamp(name: str | Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS` as a UTC stamp; anything else is null."""
    clock = F.try_to_timestamp(F.get(F.split(name, ","), F.lit(0)), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fields(raw: DataFrame, focal_scale: float = 0.01) -> DataFrame:
    """Catalog fields of raw tags: first positive ISO, scaled focal length or the 35 mm one, blank texts as null."""
    iso = F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in ("iso_speed", "iso_index", "iso_photographic")])
    out = raw.withColumns({
        "camera_make": _text("make"), "camera_model": _text("model"), "lens": _text("lens"), "lens_make": _text("lens_make"), "software": _text("software"),
        "focal_length": F.coalesce(F.col("focal") * focal_scale, F.col("focal_35mm")), "iso": iso, "shutter_speed": F.col("exposure"),
        "capture_datetime": stamp(F.nullif(F.trim("taken"), F.lit("0000:00:00 00:00:00"))), "gps_present": F.coalesce("gps", F.lit(False)),
    })
    return out.drop("make", "model", "focal", "focal_35mm", "iso_speed", "iso_index", "iso_photographic", "exposure", "taken", "gps")


def has_metadata() -> Column:
    """Whether any camera, exposure, date or place value is known; dimensions do not count."""
    some = F.coalesce(*[F.col(c).cast("string") for c in ("camera_make", "camera_model", "lens", "lens_make", "software", "focal_length", "iso", "aperture", "shutter_speed", "capture_datetime")])
    return some.isNotNull() | F.col("gps_present")


def write_tags(values: dict, container: str = "jpeg") -> bytes:
    """The head of a file of a kind (jpeg, tiff, png, webp or heic) with the given raw tags; rationals keep four decimals."""
    numbers = {name: tag for tag, name in TAGS.items()}

    def directory(entries: list[tuple[int, int, bytes, int]], base: int) -> bytes:
        head, tail = struct.pack("<H", len(entries)), b""
        after = base + 2 + 12 * len(entries) + 4
        for tag, kind, raw, count in sorted(entries):
            head += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(tail)))
            tail += raw if len(raw) > 4 else b""
        return head + b"\0\0\0\0" + tail

    def entry(name: str, v) -> tuple[int, int, bytes, int]:
        if isinstance(v, str):
            raw = v.encode() + b"\0"
            return numbers[name], 2, raw, len(raw)
        if isinstance(v, float):
            return numbers[name], 5, struct.pack("<II", round(v * 10_000), 10_000), 1
        return numbers[name], 4, struct.pack("<I", v), 1

    version = (0x9000, 4, struct.pack("<I", 1), 1)
    inner = [version, *(entry(k, v) for k, v in values.items() if v is not None and k in numbers)]
    exif = directory(inner, 8 + 2 + 12 * 2 + 4)
    outer = [(EXIF_DIRECTORY, 4, struct.pack("<I", 8 + 2 + 12 * 2 + 4), 1), (GPS_DIRECTORY, 4, struct.pack("<I", 8 + 2 + 12 * 2 + 4 if values.get("gps") else 0), 1)]
    tiff = b"II*\0" + struct.pack("<I", 8) + directory(outer, 8) + exif
    return _contained(tiff, container)


def _contained(tiff: bytes, container: str) -> bytes:
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    if container == "tiff":
        return tiff
    if container == "png":
        chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    if container == "webp":
        chunk = lambda kind, body: struct.pack("<4sI", kind, len(body)) + body + b"\0" * (len(body) % 2)
        body = b"WEBP" + chunk(b"VP8X", b"\x08" + bytes(9)) + chunk(b"EXIF", tiff)
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if container == "heic":
        payload = struct.pack(">I", 6) + b"Exif\0\0" + tiff
        item = box(b"infe", struct.pack(">IHH4s", 2 << 24, 7, 0, b"Exif") + b"\0")
        names = box(b"iinf", struct.pack(">IH", 0, 1) + item)
        place = lambda at: box(b"iloc", struct.pack(">IHHHHHII", 0, 0x4400, 1, 7, 0, 1, at, len(payload)))
        head = box(b"ftyp", b"heic\0\0\0\0mif1heic")
        meta = lambda at: box(b"meta", bytes(4) + names + place(at))
        return head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", payload)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"
