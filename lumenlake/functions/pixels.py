"""Measures of decoded images: numpy over one image at a time, inside tasks that Spark deals out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the measures.
CLIP_HIGH, CLIP_LOW, DARK, BRIGHT = 250, 5, 35.0, 65.0
MONO_SATURATION, MONO_CHANNELS = 0.06, 8.0
SIGMA_FULL, SPREAD_FULL, SHARP_MIDDLE, SHARP_WIDTH = 70.0, 180.0, 3.5, 0.6
HUES, HUE_SATURATION, HUE_VALUE, HUE_CHROMATIC, HUE_IMAGE = 12, 0.20, 0.08, 0.04, 0.01
#: Long side that images are reduced to before they are measured, and pixels beyond which they are refused.
LONG_SIDE, MOST_PIXELS = 2048, 500_000_000

MEASURES = "sharpness double, brightness double, contrast double, saturation double, highlight_clipping double, shadow_clipping double, is_monochrome int, is_dark int, is_bright int, color_signature int, phash long"


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([0.2126, 0.7152, 0.0722]) + 0.5).astype(np.int64)


def percentile(histogram: np.ndarray, p: float) -> int:
    """First level whose cumulative count reaches p percent."""
    return int(np.searchsorted(np.cumsum(histogram), histogram.sum() * p / 100))


def sharpness(gray: np.ndarray) -> float:
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.float64)
    edge = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    spread = edge.var()
    return 0.0 if spread <= 0 else float(100 / (1 + np.exp(-(np.log10(spread) - SHARP_MIDDLE) / SHARP_WIDTH)))


def signature(rgb: np.ndarray) -> int:
    """Bits of the hues that make up enough of the chromatic pixels and of the image; else of the leading hue, if any counts."""
    x = rgb.reshape(-1, 3) / 255.0
    high, low = x.max(axis=1), x.min(axis=1)
    delta = high - low
    some = (high >= HUE_VALUE) & (delta > 0) & (delta >= HUE_SATURATION * high)
    r, g, b = x[some].T
    high, delta = high[some], delta[some]
    sector = np.where(high == r, np.mod((g - b) / delta, 6), np.where(high == g, (b - r) / delta + 2, (r - g) / delta + 4))
    counts = np.bincount(np.floor((sector * 60 + 15) / 30).astype(np.int64) % HUES, minlength=HUES)
    n = counts.sum()
    if not n:
        return 0
    bits = np.flatnonzero((counts / n >= HUE_CHROMATIC) & (counts / len(x) >= HUE_IMAGE))
    if not len(bits) and n / len(x) >= HUE_IMAGE:
        bits = [HUES - 1 - int(counts[::-1].argmax())]
    return int(sum(1 << int(i) for i in bits))


#: Weights made before, of so many sizes at most.
_MADE: dict[tuple, np.ndarray] = {}
MOST_MADE = 256


def _weights(size: int, to: int, reach: float = 3.0) -> np.ndarray:
    """Rows of windowed-sinc weights that resample `size` places to `to`, in whole 2^-14ths so that reruns agree."""
    if (size, to, reach) in _MADE:
        return _MADE[size, to, reach]
    scale = max(size / to, 1.0)
    at = (np.arange(to)[:, None] + 0.5) * size / to - (np.arange(size)[None, :] + 0.5)
    x = at / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    if len(_MADE) >= MOST_MADE:
        _MADE.clear()
    made = _MADE[size, to, reach] = np.round(w / w.sum(axis=1, keepdims=True) * 16384).astype(np.int64)
    return made


def difference_hash(gray: np.ndarray) -> int:
    """64 bits: whether each of 9 x 8 resampled gray levels is below the one to its right; as a signed long."""
    small = _weights(gray.shape[0], 8) @ gray @ _weights(gray.shape[1], 9).T
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    value = sum(1 << i for i, bit in enumerate(bits) if bit)
    return value - (1 << 64) if value >> 63 else value


def reduced(rgb: np.ndarray) -> np.ndarray:
    """The image with its long side at LONG_SIDE at most, by averaging blocks."""
    step = -(-max(rgb.shape[:2]) // LONG_SIDE)
    if step == 1:
        return rgb
    h, w = (n // step * step for n in rgb.shape[:2])
    return rgb[:h, :w].reshape(h // step, step, w // step, step, 3).mean(axis=(1, 3)).round().astype(np.uint8)


def measure(rgb: np.ndarray) -> dict:
    rgb = reduced(rgb)
    gray = luma(rgb)
    n = gray.size
    histogram = np.bincount(gray.ravel(), minlength=256)
    level = np.arange(256)
    mean = (level * histogram).sum() / n
    sigma = np.sqrt(max((level * level * histogram).sum() / n - mean * mean, 0.0))
    spread = percentile(histogram, 95) - percentile(histogram, 5)
    x = rgb.reshape(-1, 3).astype(np.float64)
    high, low = x.max(axis=1), x.min(axis=1)
    saturation = float(np.where(high > 0, (high - low) / np.maximum(high, 1), 0).mean())
    channels = x.mean(axis=0)
    brightness = float(100 * mean / 255)
    return {
        "sharpness": sharpness(gray), "brightness": brightness, "contrast": float(60 * min(sigma / SIGMA_FULL, 1) + 40 * min(spread / SPREAD_FULL, 1)), "saturation": min(255 * saturation, 100.0),
        "highlight_clipping": float(100 * histogram[CLIP_HIGH:].sum() / n), "shadow_clipping": float(100 * histogram[: CLIP_LOW + 1].sum() / n),
        "is_monochrome": int(saturation < MONO_SATURATION and np.ptp(channels) < MONO_CHANNELS), "is_dark": int(brightness < DARK), "is_bright": int(brightness > BRIGHT),
        "color_signature": signature(rgb), "phash": difference_hash(gray),
    }


def measurable(width: int, height: int, size: int | None) -> bool:
    """Whether an image of so many bytes has the pixels it states, and not too many of them."""
    return size is not None and width > 0 and height > 0 and width * height <= MOST_PIXELS and size == 3 * width * height


def measured(images: DataFrame, key: str) -> DataFrame:
    """key and measures of images (key, width, height, data: blue, green, red bytes by rows); null measures where there are no pixels or too many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = dict.fromkeys(c.split()[0] for c in MEASURES.split(", "))
        for batch in batches:
            rows = []
            for k, w, h, data in zip(batch[key], batch["width"], batch["height"], batch["data"], strict=True):
                rows.append({key: k} | (measure(np.frombuffer(data, np.uint8).reshape(h, w, 3)[:, :, ::-1]) if measurable(w, h, data and len(data)) else empty))
            whole = [c.split()[0] for c in MEASURES.split(", ") if not c.endswith("double")]
            yield pd.DataFrame(rows).astype(dict.fromkeys(whole, "Int64"))

    return images.select(key, "width", "height", "data").mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, {MEASURES}")


def iou(a: str, b: str) -> F.Column:
    """Overlap of two boxes (struct of x, y, w, h) over their union."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}")) - F.greatest(f"{a}.{at}", f"{b}.{at}"))
    both = side("x", "w") * side("y", "h")
    return F.try_divide(both, F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both)


def suppressed(boxes: DataFrame, least: float = 0.3, most: int = 100) -> DataFrame:
    """Boxes (photo_id, score, x, y, w, h) that overlap no better one of their photo by more than `least`; at most `most` a photo."""

    def chosen(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which boxes stay, of photos with the same number of them, a photo a row: each place is compared with the boxes kept before it."""
        photos, n = x.shape
        kept = np.full((4, photos, min(n, most)), np.nan)
        count, stays = np.zeros(photos, np.int64), np.zeros((photos, n), bool)
        for i in range(n):
            kx, ky, kw, kh = kept[:, :, : count.max()]
            a, b, u, v = x[:, i, None], y[:, i, None], w[:, i, None], h[:, i, None]
            both = np.clip(np.minimum(a + u, kx + kw) - np.maximum(a, kx), 0, None) * np.clip(np.minimum(b + v, ky + kh) - np.maximum(b, ky), 0, None)
            free = np.flatnonzero(~(both > least * (u * v + kw * kh - both)).any(axis=1) & (count < most))
            kept[:, free, count[free]] = x[free, i], y[free, i], w[free, i], h[free, i]
            count[free] += 1
            stays[free, i] = True
            if count.min() == most:
                break
        return stays

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def keep(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        sizes = np.array([len(r) for r in x])
        out = np.empty(len(sizes), object)
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            sides = (np.concatenate(s.to_numpy()[same]).astype(np.float64).reshape(len(same), n) for s in (x, y, w, h))
            for k, row in zip(same.tolist(), chosen(*sides), strict=True):
                out[k] = np.flatnonzero(row)
        return pd.Series(out)

    # a photo's candidates are few: what a detector returns for one image
    ranked = boxes.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "x", "y", "w", "h"))).alias("b"))
    best = ranked.withColumn("i", F.explode(keep("b.x", "b.y", "b.w", "b.h"))).select("photo_id", F.get("b", F.col("i")).alias("b"))
    return best.select("photo_id", (-F.col("b.s")).alias("score"), "b.x", "b.y", "b.w", "b.h")


def eye_summary(faces: DataFrame) -> DataFrame:
    """Per photo the eyes evaluated, faces with both eyes closed, and the surest closure from 0 to 100."""
    l, r = F.col("left_eye_open_prob"), F.col("right_eye_open_prob")
    eyes = l.isNotNull().cast("long") + r.isNotNull().cast("long")
    return faces.groupBy("photo_id").agg(F.sum(eyes).alias("eye_evaluated_count"), F.count_if((l <= 0.2) & (r <= 0.2)).alias("closed_eye_face_count"), F.max(F.when(l.isNotNull() & r.isNotNull(), 100 * (1 - F.greatest(l, r)))).alias("max_eye_closure_confidence"))


def level_percentile(levels: DataFrame, key: str, p: float) -> DataFrame:
    """(key, level): percentile of a histogram table (key, level, n)."""
    run = F.sum("n").over(Window.partitionBy(key).orderBy("level"))
    whole = F.sum("n").over(Window.partitionBy(key))
    return levels.withColumn("_run", run).withColumn("_all", whole).where(F.col("_run") >= F.col("_all") * p / 100).groupBy(key).agg(F.min("level").alias("level"))


def histogram_cells(images: DataFrame, key: str) -> DataFrame:
    """(key, channel, level, n) of the luma, red, green and blue histograms, cells without pixels left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, w, h, data in zip(batch[key], batch["width"], batch["height"], batch["data"], strict=True):
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)[:, :, ::-1]
                for name, levels in (("luma", luma(rgb)), *zip(("red", "green", "blue"), np.moveaxis(rgb, 2, 0), strict=True)):
                    n = np.bincount(levels.ravel(), minlength=256)
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({key: k, "channel": name, "level": some.astype(np.int32), "n": n[some]})

    return images.select(key, "width", "height", "data").mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, channel string, level int, n long")


def applicable(dx: F.Column, dy: F.Column, value: F.Column, least: float = 6.0) -> F.Column:
    """The value, where the eyes are far enough apart to be judged."""
    apart = F.hypot(dx, dy)
    return F.when(~F.isnan(apart) & (apart >= least), value)


def detections(heads: DataFrame, least: float = 0.7, side: int = 640) -> DataFrame:
    """Candidate boxes of detector heads (photo_id, stride, cell, obj, cls, box): score, x, y, w, h.

    A cell's box is an offset from its corner in strides, and a size as the exponent of one; the score is the
    geometric mean of the two heads.  Heads with `points`, the offsets of the eyes and of further landmarks, also
    give right_eye and left_eye as structs of x and y.
    """
    grid = F.lit(side) / F.col("stride")
    row, column = F.floor(F.col("cell") / grid), F.col("cell") % grid
    s = F.col("stride").cast("double")
    w, h = F.exp(F.get("box", F.lit(2))) * s, F.exp(F.get("box", F.lit(3))) * s
    x, y = (F.get("box", F.lit(0)) + column) * s - w / 2, (F.get("box", F.lit(1)) + row) * s - h / 2
    out = heads.withColumn("score", F.sqrt(F.col("obj") * F.col("cls"))).where(F.col("score") >= least)
    point = lambda i: F.struct(
        ((F.get("points", F.lit(2 * i)) + column) * s).alias("x"), ((F.get("points", F.lit(2 * i + 1)) + row) * s).alias("y")
    )
    eyes = [point(0).alias("right_eye"), point(1).alias("left_eye")] if "points" in heads.columns else []
    return out.select("photo_id", "score", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), *eyes)


#: Files of more bytes and images of more pixels are not searched for faces.
MOST_BYTES = 256 * 1024 * 1024
MOST_FACE_PIXELS = 250_000_000


def too_large(size: Column, width: Column, height: Column, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_FACE_PIXELS) -> Column:
    """Whether a photo is stamped as having no faces without being decoded; unknown dimensions are no reason."""
    return F.coalesce(size > most_bytes, F.lit(False)) | F.coalesce(width.cast("long") * height > most_pixels, F.lit(False))


def face_hash(rgb: np.ndarray, x: float, y: float, w: float, h: float, margin: float = 0.18, least: int = 12) -> int | None:
    """Difference hash of a face's surroundings, clamped to the image; null for faces that are too small to tell."""
    height, width = rgb.shape[:2]
    x0, y0 = max(0, int(np.floor(x - margin * w))), max(0, int(np.floor(y - margin * h)))
    x1, y1 = min(width, int(np.ceil(x + w + margin * w))), min(height, int(np.ceil(y + h + margin * h)))
    if x1 - x0 < least or y1 - y0 < least:
        return None
    return difference_hash(luma(rgb[y0:y1, x0:x1]))


def face_hashes(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, face, x, y, w, h, hash): the appearance of each box (key, score, x, y, w, h), numbered from 0 by falling score, x, y, w, h.

    An image is read once for all its boxes.  The hash is null for faces that are too small to tell and where the image
    holds no pixels, not those it states, or too many; boxes with a null or non-finite side have none either.  Boxes without an image
    and images without a box give no row; boxes without a key neither.
    """
    place = F.struct((-F.col("score")).alias("s"), "x", "y", "w", "h")
    # the boxes of a photo are few: what is left of a detector's candidates
    faces = boxes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_of")).agg(F.sort_array(F.collect_list(place)).alias("boxes"))
    held = images.select(key, "width", "height", "data").join(faces, F.col(key) == F.col("_of")).drop("_of")
    sides = [F.col(f"boxes.{k}").alias(k) for k in "xywh"]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(width: pd.Series, height: pd.Series, data: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for wide, high, pixels, *box in zip(width, height, data, x, y, w, h, strict=True):
            if pd.isna(wide) or pd.isna(high) or not measurable(int(wide), int(high), pixels and len(pixels)):
                out.append([None] * len(box[0]))
                continue
            rgb = np.frombuffer(pixels, np.uint8).reshape(int(high), int(wide), 3)[:, :, ::-1]
            sides = np.array([np.asarray(b, dtype=np.float64) for b in box]).T
            out.append([face_hash(rgb, *b) if np.isfinite(b).all() else None for b in sides])
        return pd.Series(out)

    read = held.select(key, "boxes", "width", "height", "data", *sides)
    told = read.select(key, "boxes", hashes("width", "height", "data", *"xywh").alias("hashes"))
    each = told.select(key, F.posexplode(F.arrays_zip("boxes", "hashes")).alias("face", "f"))
    return each.select(key, "face", *[F.col(f"f.boxes.{k}").alias(k) for k in "xywh"], F.col("f.hashes").alias("hash"))
