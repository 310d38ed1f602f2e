"""Datetime detection on text columns and column classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import DATETIME, NUMERIC, q

# Shapes of date texts: what a value must look like before it is handed to a parser (a failed parse costs an exception inside
# Spark), and the patterns that such a value may mean, the usual one first. None = Spark's own cast rules (ISO 8601).
_TIME = "( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?"
_CLOCK = "( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})? ?[AaPp][Mm])"
_NAME = "[A-Za-z]{3,9}"
DATE_SHAPES: dict[str, tuple[str, tuple[str | None, ...]]] = {
    "iso": (r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([T ][0-9].*)?)?", (None,)),
    "digits": ("[0-9]{8}", ("yyyyMMdd",)),
    "digits and time": ("[0-9]{14}", ("yyyyMMddHHmmss",)),
    "year/": ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}" + _TIME, ("yyyy/M/d[ H:mm[:ss]]",)),
} | {f"a{c}b{c}year{' clock' * (end is _CLOCK)}": (f"[0-9]{{1,2}}[{c}][0-9]{{1,2}}[{c}][0-9]{{4}}" + end, (f"M{c}d{c}yyyy{rest}", f"d{c}M{c}yyyy{rest}"))
     for c in "/.-" for end, rest in ((_TIME, "[ H:mm[:ss]]"), (_CLOCK, " h:mm[:ss] a"))} | {
    "month day year": (f"{_NAME} [0-9]{{1,2}} [0-9]{{4}}" + _TIME, ("MMM d yyyy[ H:mm[:ss]]", "MMMM d yyyy[ H:mm[:ss]]")),
    "day month year": (f"[0-9]{{1,2}} {_NAME} [0-9]{{4}}" + _TIME, ("d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]")),
    "month year": (f"{_NAME} [0-9]{{4}}", ("MMM yyyy", "MMMM yyyy")),
}
_NAMED = {"month day year", "day month year", "month year"}
_WEEKDAY = "^(?i:(mon|tue|wed|thu|fri|sat|sun)[a-z]*)[, ]+"


def _normal(c: Column, shape: str) -> Column:
    """The text without outer blanks; with month names also without weekday, commas and hyphens, and "am" apart from the time."""
    t = F.trim(c)
    if shape in _NAMED:
        return F.trim(F.regexp_replace(F.regexp_replace(t, _WEEKDAY, ""), "[, -]+", " "))
    return F.regexp_replace(t, "(?<=[0-9]) ?([AaPp][Mm])$", " $1") if shape.endswith("clock") else t


def _parse(c: Column, shape: str, fmt: str | None) -> Column:
    t = _normal(c, shape)
    parsed = F.try_to_timestamp(t) if fmt is None else F.try_to_timestamp(t, F.lit(fmt))
    return F.when(t.rlike(f"^{DATE_SHAPES[shape][0]}$"), parsed.cast("timestamp_ntz"))


def _variants(shape: str) -> list[tuple[str | None, ...]]:
    """What a shape's values may mean: names of any length together, orders of day and month apart."""
    formats = DATE_SHAPES[shape][1]
    return [formats] if shape in _NAMED else [(f,) for f in formats]


def _parse_any(c: Column, shape: str, formats: Sequence[str | None]) -> Column:
    return F.coalesce(*[_parse(c, shape, f) for f in formats])


def date_parsers(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[float, list[tuple[str, tuple]]]]:
    """Per text column the share of all rows (nulls count) that parse as a time, and the parser of each shape that occurs.

    One aggregate over all columns counts what every reading of every shape parses. A shape is read in the way that parses
    most of its values, of equal ones month before day; values of different shapes may share a column."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return {}
    readings = [(shape, formats) for shape in DATE_SHAPES for formats in _variants(shape)]
    aggs = [F.count(_parse_any(q(c), *r)).alias(f"c{i}_{j}") for i, c in enumerate(cols) for j, r in enumerate(readings)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs).first()
    out = {}
    for i, c in enumerate(cols):
        best: dict[str, tuple[int, tuple]] = {}
        for j, (shape, formats) in enumerate(readings):
            if row[f"c{i}_{j}"] > best.get(shape, (0, ()))[0]:
                best[shape] = row[f"c{i}_{j}"], formats
        share = sum(n for n, _ in best.values()) / row["_n"] if row["_n"] else 0.0
        out[c] = share, [(shape, formats) for shape, (_, formats) in best.items()]
    return out


def _apply(c: Column, parsers: list[tuple[str, tuple]]) -> Column:
    return F.coalesce(*[_parse_any(c, *p) for p in parsers])


def convert_datetimes(df: DataFrame, threshold: float = 0.5, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: convert text columns where more than ``threshold`` of all rows parse as a date or time of any of ``DATE_SHAPES``
    (failures become null); others stay text."""
    found = date_parsers(df, cols)
    conv = {c: _apply(q(c), parsers) for c, (share, parsers) in found.items() if share > threshold}
    return df.withColumns(conv) if conv else df


def column_types(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Numeric / categorical / datetime / other per column (detection
    only, no conversion). An empty table's text columns are categorical."""
    shares = date_parsers(df)
    rows = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, NUMERIC):
            kind = "numeric"
        elif isinstance(f.dataType, DATETIME):
            kind = "datetime"
        elif isinstance(f.dataType, T.StringType):
            kind = "datetime" if shares.get(f.name, (0.0, []))[0] > threshold else "categorical"
        else:
            kind = "other"
        rows.append((i, f.name, f.dataType.simpleString(), kind))
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, kind string")
