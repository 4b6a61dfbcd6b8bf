"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: ColumnLike) -> Column:
    return F.round(col(c), 6)


def safe_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """NULL when either side is missing or the denominator is zero (no ANSI error)."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def positive(c: ColumnLike) -> Column:
    return F.when(col(c) > 0, col(c))


def growth(cur: ColumnLike, prior: ColumnLike, use_abs: bool) -> Column:
    base = F.abs(col(prior)) if use_abs else col(prior)
    return (col(cur) - col(prior)) / F.nullif(base, F.lit(0.0))


def debt_sum(short: ColumnLike, long: ColumnLike, total: ColumnLike) -> Column:
    """Short plus long debt, missing as 0; total debt only when both are missing."""
    s, lg = col(short), col(long)
    return F.when(s.isNull() & lg.isNull(), F.coalesce(col(total), F.lit(0.0))).otherwise(
        F.coalesce(s, F.lit(0.0)) + F.coalesce(lg, F.lit(0.0))
    )


def clip(c: ColumnLike, lo: ColumnLike, hi: ColumnLike) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would return a bound)."""
    c, lo, hi = col(c), col(lo), col(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def flag(cond: Column) -> Column:
    """Boolean to a 0/1 integer, NULL counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def mean_present(cols: Sequence[ColumnLike]) -> Column:
    """Mean of the non-NULL columns; NULL when none is present."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((c.isNotNull().cast("double") for c in cs), F.lit(0.0))
    return total / F.nullif(n, F.lit(0.0))


def nan_to_null(c: ColumnLike) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def fiscal_year(date: ColumnLike, fye_month: ColumnLike) -> Column:
    d, m = col(date), col(fye_month)
    return F.year(d) + F.when(F.month(d) > m, 1).otherwise(0)


def period_label(frequency: ColumnLike, date: ColumnLike) -> Column:
    d = col(date)
    y = F.year(d).cast("string")
    return F.when(col(frequency) == "annual", y).otherwise(
        F.concat(y, F.lit("Q"), F.quarter(d).cast("string"))
    )


def pad_id(c: ColumnLike, width: int = 10) -> Column:
    return F.lpad(F.trim(col(c).cast("string")), width, "0")


def parse_number(text: ColumnLike, scale: ColumnLike | None = None, sign: ColumnLike | None = None) -> Column:
    """Reported number text to double; NULL when it holds no number."""
    t = F.trim(F.regexp_replace(col(text), " ", " "))
    in_parens = t.contains("(") & t.contains(")")
    digits = F.regexp_replace(F.regexp_replace(t, "−", "-"), r"[^0-9.\-]", "")
    value = digits.try_cast("double")
    if scale is not None:
        power = col(scale).try_cast("int")
        value = F.when(power.isNotNull(), value * F.pow(F.lit(10.0), power)).otherwise(value)
    negative = in_parens
    if sign is not None:
        negative = negative | F.coalesce(col(sign) == "-", F.lit(False))
    return F.when(negative, -F.abs(value)).otherwise(value)


def parse_score(raw: ColumnLike) -> Column:
    """Integer 1..5 from a free-text reply, or NULL."""
    text = F.trim(F.regexp_replace(col(raw), r"(?is)<think>.*?</think>", ""))
    lines = F.filter(
        F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike("^[1-5]$")
    )
    last_line = F.try_element_at(lines, F.lit(-1))
    anywhere = F.nullif(F.regexp_extract(text, r"(?U)\b([1-5])\b", 1), F.lit(""))
    return F.coalesce(last_line, anywhere).cast("int")
