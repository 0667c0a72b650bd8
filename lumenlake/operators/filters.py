"""Structured filters: a JSON object of conditions, compiled to one column expression."""

from __future__ import annotations

import json
import math
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.sources.catalog import merge_rows

MAX_CONDITIONS, MAX_ITEMS = 50, 100
#: Hue names by bit of the color signature.
HUES = ["red", "orange", "yellow", "lime", "green", "teal", "cyan", "azure", "blue", "violet", "magenta", "rose"]
_COMPARE = {"=": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}
_ORDERED = [*_COMPARE, "between", "is-null", "not-null"]
#: Operators that each kind of field allows.
LEGAL = {
    "real": [*_ORDERED, "in"],
    "int": [*_ORDERED, "in"],
    "datetime": _ORDERED,
    "bool": ["=", "!="],
    "palette": ["in"],
    "text": ["=", "!=", "in", "is-null", "not-null"],
}


def _plain(name: str) -> Column:
    return F.col(name)


def _text(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.col(name) == 1


def _positive(name: str) -> Column:
    """Known and above zero: false, not null, where nothing was measured."""
    return F.coalesce(F.col(name) > 0, F.lit(False))


def fields() -> dict[str, tuple[str, Any]]:
    """The fields of a filter: kind and column over photos, analysis and review state."""
    reals = {n: n for n in ("sharpness", "brightness", "contrast", "saturation", "highlight_clipping", "shadow_clipping", "aperture", "shutter_speed", "focal_length")} | {"eye_closure_confidence": "max_eye_closure_confidence"}
    out = {k: ("real", _plain(v)) for k, v in reals.items()}
    out |= {n: ("int", _plain(n)) for n in ("iso", "session_id", "face_count", "smile_count", "rating")}
    out |= {k: ("text", _plain(v)) for k, v in {"orientation": "orientation", "color_label": "color_label", "scene_group": "scene_coarse", "scene_fine": "scene_fine", "review_state": "review_state"}.items()}
    out |= {n: ("text", _text(n)) for n in ("camera_make", "camera_model", "lens")}
    out |= {"monochrome": ("bool", _flag("is_monochrome")), "color": ("bool", F.col("is_monochrome") == 0), "dark": ("bool", _flag("is_dark")), "bright": ("bool", _flag("is_bright"))}
    out |= {"possible_blink": ("bool", _plain("possible_blink")), "flagged": ("bool", _flag("flag"))}
    out |= {k: ("bool", _positive(v)) for k, v in {"faces_present": "face_count", "closed_eye_candidate": "closed_eye_face_count", "smiling": "smile_count"}.items()}
    return out | {"capture_datetime": ("datetime", _plain("capture_datetime")), "palette_color": ("palette", _plain("color_signature"))}


class FilterError(ValueError):
    """A filter that breaks a rule; the text says which."""


def parse(text: str | None) -> list[dict]:
    """Conditions of a filter's JSON; blank text matches all."""
    if text is None or not text.strip():
        return []
    try:
        found = json.loads(text)
    except ValueError as e:
        raise FilterError(f"not a filter: {e}") from e
    if not isinstance(found, dict) or found.get("operator") != "AND" or not isinstance(found.get("conditions"), list):
        raise FilterError("a filter has the operator AND and a list of conditions")
    if len(found["conditions"]) > MAX_CONDITIONS:
        raise FilterError(f"a filter has at most {MAX_CONDITIONS} conditions")
    return found["conditions"]


def _value(field: str, kind: str, value: Any) -> Any:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "real" and number and math.isfinite(value):
        return float(value)
    if kind == "int" and isinstance(value, int) and not isinstance(value, bool):
        return value
    if kind == "text" and isinstance(value, str):
        return value.strip()
    if kind == "bool" and isinstance(value, bool):
        return value
    if kind == "datetime" and isinstance(value, str) and value.strip():
        return value.strip()
    raise FilterError(f"field {field}: {value!r} is not a value of kind {kind}")


def condition(one: dict) -> Column:
    """The column of one condition; values are literals, never part of a text."""
    known, field, op, value = fields(), one.get("field"), one.get("operator"), one.get("value")
    if field not in known:
        raise FilterError(f"unknown field {field!r}")
    kind, column = known[field]
    if op not in LEGAL[kind]:
        raise FilterError(f"field {field} has no operator {op!r}")
    if op in ("between", "in"):
        if not isinstance(value, list) or (len(value) != 2 if op == "between" else not 1 <= len(value) <= (len(HUES) if kind == "palette" else MAX_ITEMS)):
            raise FilterError(f"field {field}: {op} needs a list of the right length")
    if kind == "palette":
        if not all(v in HUES for v in value):
            raise FilterError(f"field {field}: unknown color")
        return column.bitwiseAND(F.lit(sum({1 << HUES.index(v) for v in value}))) != 0
    if op == "is-null":
        return column.isNull()
    if op == "not-null":
        return column.isNotNull()
    if op == "between":
        low, high = (_value(field, kind, v) for v in value)
        return (column >= F.lit(low)) & (column <= F.lit(high))
    if op == "in":
        return column.isin([_value(field, kind, v) for v in value])
    return _COMPARE[op](column, F.lit(_value(field, kind, value)))


def compile_filter(text: str | None) -> Column:
    """One predicate: all conditions, in order."""
    return reduce(and_, map(condition, parse(text)), F.lit(True))


def canonical(text: str | None) -> str:
    """A key that filters with the same conditions in any order share."""
    return json.dumps(sorted(json.dumps(c, sort_keys=True) for c in parse(text)))


def canonical_key(name: str) -> Column:
    """`canonical` of a column of filters; null for text that is no filter."""

    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return canonical(text)
            except FilterError:
                return None

        return texts.map(one)

    return key(name)


def saved(views: DataFrame, new: DataFrame) -> DataFrame:
    """Saved views after new ones by name; text that is no filter does not replace one."""
    sound = new.where(canonical_key("filter_json").isNotNull())
    return merge_rows(views, sound, "name", {c: "new" for c in views.columns if c != "name"})


def renamed(views: DataFrame, changes: DataFrame) -> DataFrame:
    """Saved views after changes (name, new_name); a blank new name or one that another view has is refused."""
    names = views.select(F.lower("name").alias("_taken"))
    sound = changes.withColumn("new_name", F.trim("new_name")).where("new_name <> ''")
    free = sound.join(names, (F.lower("new_name") == F.col("_taken")) & (F.lower("new_name") != F.lower("name")), "left_anti")
    once = free.groupBy(F.lower("new_name").alias("_key")).agg(F.min(F.struct("name", "new_name")).alias("r")).select("r.*")
    return views.join(once, "name", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def listed(views: DataFrame, gone: DataFrame) -> DataFrame:
    """Saved views without the deleted names, by name without regard to case."""
    return views.join(gone.select("name"), "name", "left_anti").orderBy(F.lower("name"), "name")


def matches(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """(name, n) of many filters in one pass over the rows."""
    counts = rows.agg(*[F.count_if(compile_filter(f)).alias(f"c{i}") for i, f in enumerate(filters.values())])
    return counts.select(F.explode(F.create_map(*[x for i, n in enumerate(filters) for x in (F.lit(n), F.col(f"c{i}"))])).alias("name", "n"))


GRID = ["id", "path", "filename", "extension", "width", "height", "orientation", "camera_make", "camera_model", "iso", "aperture", "shutter_speed", "capture_datetime", "session_id", "rating", "flag", "color_label", "sharpness", "review_state"]


def page(rows: DataFrame, text: str | None, limit: int, offset: int = 0) -> DataFrame:
    """One page of the grid in capture order, unknown times last."""
    chosen = rows.where(compile_filter(text)).select(*GRID)
    return chosen.orderBy(F.col("capture_datetime").asc_nulls_last(), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def total(rows: DataFrame, text: str | None) -> DataFrame:
    return rows.where(compile_filter(text)).agg(F.count(F.lit(1)).alias("total"))


#: Shortcut filters.
PRESETS = {
    "potentially-soft": ("sharpness", "<", 40),
    "highlight-clipping": ("highlight_clipping", ">=", 5),
    "shadow-clipping": ("shadow_clipping", ">=", 5),
    "closed-eye-candidate": ("closed_eye_candidate", "=", True),
    "possible-blink": ("possible_blink", "=", True),
    "monochrome": ("monochrome", "=", True),
    "color": ("monochrome", "=", False),
    "dark": ("dark", "=", True),
    "bright": ("bright", "=", True),
    "landscape": ("orientation", "=", "landscape"),
    "portrait": ("orientation", "=", "portrait"),
    "faces": ("faces_present", "=", True),
}


def as_json(*conditions: tuple) -> str:
    return json.dumps({"operator": "AND", "conditions": [{"field": c[0], "operator": c[1]} | ({"value": c[2]} if len(c) > 2 else {}) for c in conditions]})
