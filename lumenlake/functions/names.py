"""Names of files and groups, dates read from names, and texts shown for values."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a rename template.
TOKENS = ("sequence", "original", "camera", "lens", "focal", "name", "date", "time", "iso")


def sanitized(name: Column | str) -> Column:
    """A name that is safe in a path: runs of separators become one dash, outer dots, blanks, dashes and underscores go."""
    run = F.regexp_replace(name, r'[\p{Cntrl} /\\:*?"<>|{}]+', "-")
    out = F.regexp_replace(F.regexp_replace(run, r"^[. \-_]+", ""), r"[. \-_]+$", "")
    return F.when(out == "", "renamed").otherwise(F.substring(out, 1, 150))


def expanded(template: str, values: dict[str, Column]) -> Column:
    """The template with its tokens replaced once; what a value brings in is not read again.

    Cut on the driver into literal and token parts, so no replacement can meet another's text.
    """
    parts = re.split("(" + "|".join(rf"\{{{t}\}}" for t in TOKENS) + ")", template)
    columns = [F.coalesce(values[p[1:-1]], F.lit("")) if p[1:-1] in TOKENS and p.startswith("{") else F.lit(p) for p in parts if p]
    return F.concat(*columns) if columns else F.lit("")


def stem(filename: str, extension: str) -> Column:
    """The name without its own extension, if it has it."""
    ends = (F.col(extension) != "") & F.endswith(F.col(filename), F.concat(F.lit("."), F.col(extension)))
    return F.when(ends, F.substr(F.col(filename), F.lit(1), F.length(filename) - F.length(extension) - 1)).otherwise(F.col(filename))


def cleaned(name: str, most: int = 60) -> Column:
    """A trimmed name of 1 to `most` characters, else null."""
    out = F.trim(name)
    return F.when(F.length(out).between(1, most), out)


def _fixed(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(v, digits))


def metric(v: Column) -> Column:
    return F.when(v.isNull(), "unavailable").otherwise(_fixed(v, 1))


def percent(v: Column, of: int = 1) -> Column:
    return F.when(v.isNull(), "unavailable").otherwise(F.concat(F.round(v * of).cast("long").cast("string"), F.lit("%")))


def duration(days: Column) -> Column:
    hours = days * 24
    whole = lambda v, unit: F.concat(F.round(v).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(days.isNull(), "unknown").when(hours < 1, "< 1 hour").when(days < 1, whole(hours, "hours")).when(days < 10, F.concat(_fixed(days, 1), F.lit(" days"))).otherwise(whole(days, "days"))


def iso(v: Column) -> Column:
    return F.when(v.isNull(), "unavailable").otherwise(F.round(v).cast("long").cast("string"))


def group_label(kind: Column, count: Column) -> Column:
    """What a card of a group says: its kind and how many photos it holds."""
    n = count.cast("string")
    face = F.concat(n, F.lit(" matching face appearances"))
    near = F.when(count == 2, "2 similar").otherwise(F.concat(n, F.lit(" similar photographs")))
    return F.when(kind == "burst", F.concat(F.lit("burst \u00b7 "), n)).when(kind == "face", face).otherwise(near)


def aperture(v: Column) -> Column:
    return F.when(v.isNull(), "unavailable").otherwise(F.concat(F.lit("f/"), _fixed(v, 1)))


def shutter(v: Column) -> Column:
    part = F.round(1 / v).cast("long")
    near = F.abs(1 / part - v) / v < 0.05
    return F.when(v.isNull(), "unavailable").when(v == 1, "1s").when(v > 1, F.concat(_fixed(v, 1), F.lit("s"))).when(near, F.concat(F.lit("1/"), part.cast("string"))).otherwise(F.concat(_fixed(v, 3), F.lit("s")))


def month_label(month: Column) -> Column:
    names = F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]))
    number = F.substring(month, 6, 2).try_cast("int")
    year = F.substring(month, 1, 4).try_cast("int")
    return F.when((year > 0) & number.between(1, 12), F.concat(F.element_at(names, number), F.lit(" "), year.cast("string"))).otherwise(month)


_DATE = re.compile(r"(?=(\d{8}))|(?=(\d{4})[.\-_: ](\d\d)[.\-_: ](\d\d)(?!\d))")
_CLOCK = re.compile(r"(?=(\d{6}))|(?=(\d+)([.\-_: ])(\d\d+)\3(\d\d))")


def _at(day: str, clock: str) -> str | None:
    try:
        d = date(int(day[:4]), int(day[4:6]), int(day[6:8]))
        t = time(int(clock[:2]), int(clock[2:4]), int(clock[4:6]))
    except ValueError:
        return None
    return f"{d.isoformat()}T{t.isoformat()}Z"


def _clock_in(text: str) -> str | None:
    """The first clock in a stretch of text: six digits, or three parts of six digits with the same sign between them."""
    for m in _CLOCK.finditer(text):
        if m[1]:
            return m[1]
        if len(found := m[2] + m[4] + m[5]) == 6:
            return found
    return None


def date_from_name(name: str | None) -> str | None:
    """The stamp that a file name states, if it states one.

    A day may stand as eight digits or in three parts; a clock may follow within 16 or 24 characters.  Eight digits
    that are no day end the search, and a compact day that other digits follow is only taken with a clock.
    """
    if name is None or "." not in name.strip():
        return None
    text = name.strip().rsplit(".", 1)[0].upper()
    if m := re.match(r"(?:IMG|VID|PXL|MVIMG)_(.*)", text, re.S):
        digits = re.sub(r"[^0-9]", "", m[1])
        if len(digits) >= 14 and (found := _at(digits[:8], digits[8:14])):
            return found
    for m in _DATE.finditer(text):
        at = m.start()
        if m[1]:
            if _at(m[1], "000000") is None:
                return None
            after = text[at + 8 : at + 24]
            clock = _clock_in(after)
            if clock:
                return _at(m[1], clock)
            if not re.search(r"[0-9]", after):
                return _at(m[1], "000000")
        else:
            day = m[2] + m[3] + m[4]
            return _at(day, _clock_in(text[at + 10 : at + 34]) or "000000")
    return None


def name_dates() -> Callable[[str], Column]:
    """Dates of names as a column; names without four digits in a row never reach Python."""

    @F.pandas_udf("string")
    def read(names: pd.Series) -> pd.Series:
        return names.map(date_from_name)

    return lambda name: F.when(F.col(name).rlike(r"[0-9]{4}"), read(F.when(F.col(name).rlike(r"[0-9]{4}"), F.col(name))))
