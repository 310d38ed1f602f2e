"""Row-level expressions: coercion, datetime parts, formatting, format rules, hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import DATETIME, NUMERIC, field_type, q

# Fixed values that must equal the reference's rules.
# E-mail rule: anchored at both ends.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# Password-strength rules, checked in this order; the first failing rule is reported.
MIN_LENGTH = 8
STRENGTH_RULES = (
    ("length", None),
    ("uppercase", r"[A-Z]"),
    ("lowercase", r"[a-z]"),
    ("number", r"[0-9]"),
    ("special", r"[!@#$%^&*(),.?\":{}|<>]"),
)


def numeric_expr(df: DataFrame, name: str) -> Column:
    """A column as a double; bad text -> null, timestamps -> epoch seconds."""
    dt = field_type(df, name)
    c = q(name)
    if isinstance(dt, NUMERIC):
        return c.cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, DATETIME):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return F.expr(f"try_cast({_sql_name(name)} AS DOUBLE)")


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce columns to double in place."""
    return df.withColumns({c: numeric_expr(df, c) for c in cols})


def datetime_expr(col: Column, fmt: str | None = None) -> Column:
    """Text -> timestamp_ntz, unparseable text -> null (ANSI-safe)."""
    if fmt is None:
        parsed = F.try_to_timestamp(col)
    else:
        parsed = F.try_to_timestamp(col, F.lit(fmt))
    return parsed.cast("timestamp_ntz")


def to_datetime(df: DataFrame, name: str, fmt: str | None = None) -> DataFrame:
    dt = field_type(df, name)
    if isinstance(dt, DATETIME):
        return df
    return df.withColumn(name, datetime_expr(q(name).cast("string"), fmt))


PARTS = {"Year": F.year, "Month": F.month, "Day": F.dayofmonth, "Hour": F.hour}


def datetime_features(df: DataFrame, name: str,
                      parts: Sequence[str] = ("Year", "Month", "Day", "Hour")) -> DataFrame:
    """Add ``{col}_Year`` / ``_Month`` / ``_Day`` / ``_Hour`` (bigint).

    The column is coerced to a timestamp first. If no value parses, nothing is
    added (the caller can test with :func:`has_any_datetime`)."""
    df = to_datetime(df, name)
    return df.withColumns({f"{name}_{p}": PARTS[p](q(name)).cast("long") for p in parts})


def datetime_features_checked(df: DataFrame, name: str,
                              parts: Sequence[str] = ("Year", "Month", "Day", "Hour")) -> DataFrame:
    """B6 with the reference's guard: an all-null column gets no new columns."""
    df = to_datetime(df, name)
    if df.where(q(name).isNotNull()).isEmpty():
        return df
    return datetime_features(df, name, parts)


def _fixed(x: Column, places: int, grouped: bool) -> Column:
    """A non-negative double with ``places`` (at most 2) decimals, rounded from its exact binary value, ties to even - the text
    that C's and Python's ``%.2f`` give. The fraction is taken as a whole number of 2^-52 and a rest below it, which matters
    for numbers below 1 only and is exact where it can decide."""
    whole, scale, unit = F.floor(x), 10 ** places, 1 << 52
    bits = (x - whole) * F.lit(float(unit))
    low = F.floor(bits)
    n = low * scale
    digits, rest = F.shiftright(n, 52), n.bitwiseAND(F.lit(unit - 1))
    below, need = (bits - low) * F.lit(float(scale)), (F.lit(unit // 2) - rest).cast("double")
    up = (below > need) | ((below == need) & (digits % 2 == 1))
    digits = digits + F.when(up, 1).otherwise(0)
    whole = whole + F.when(digits == scale, 1).otherwise(0)
    left = F.format_number(whole, 0) if grouped else whole.cast("string")
    # from 2^53 on a double is a whole number
    text = F.concat(left, F.lit("."), F.lpad((digits % scale).cast("string"), places, "0"))
    return F.when(x < F.lit(2.0 ** 53), text).otherwise(F.format_string(f"%{',' if grouped else ''}.{places}f", x))


def format_kpi(value: Column) -> Column:
    """1.23M / 4.5K / 1,234.56 style text. Negative values are never abbreviated. Ties go to the even digit (1250 is
    1.2K) and NaN and infinities are named, as Python's formatting does."""
    v = value.cast("double")
    a, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    plain = F.concat(sign, _fixed(a, 2, True))
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), "nan").when(v == F.lit(float("inf")), "infM")
            .when(v == F.lit(float("-inf")), "-inf")
            .when(v >= 1_000_000, F.concat(_fixed(a / 1_000_000, 2, False), F.lit("M")))
            .when(v >= 1_000, F.concat(_fixed(a / 1_000, 1, False), F.lit("K"))).otherwise(plain))


def email_valid(col: Column) -> Column:
    """E-mail format rule (null stays null)."""
    return col.rlike(EMAIL_PATTERN)


def strength_failure(col: Column) -> Column:
    """Name of the first strength rule the text fails, or null when all pass."""
    out = None
    for name, pattern in STRENGTH_RULES:
        cond = F.length(col) < MIN_LENGTH if pattern is None else ~col.rlike(pattern)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def valid_format(df: DataFrame, name: str, kind: str = "email") -> DataFrame:
    """Append ``{col}_valid`` (email) or ``{col}_failed_rule`` (strength)."""
    if kind == "email":
        return df.withColumn(f"{name}_valid", email_valid(q(name)))
    if kind == "strength":
        return df.withColumn(f"{name}_failed_rule", strength_failure(q(name)))
    raise ValueError(f"unknown format kind {kind!r}")


def format_report(df: DataFrame, name: str, kind: str = "email") -> DataFrame:
    """B9 report: rows, non-null, valid and the valid share of non-null values."""
    c = q(name)
    ok = email_valid(c) if kind == "email" else strength_failure(c).isNull() & c.isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"),
                  F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("valid"),
                  F.try_divide(F.sum(F.when(ok, 1).otherwise(0)).cast("double"),
                               F.count(c).cast("double")).alias("valid_share"))


def hash_column(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """SHA-256 hex of the UTF-8 text; null stays null."""
    return df.withColumn(out or name, F.sha2(q(name).cast("string"), 256))


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
