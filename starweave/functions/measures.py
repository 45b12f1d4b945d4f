"""Column expressions and row-wise mappings of fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apply_mapping(df: DataFrame, spec: list[tuple[str, str, str]]) -> DataFrame:
    """Rename and cast by (source, target, type); text that does not parse becomes null instead of failing the job."""
    return df.select(*(F.col(s).try_cast(t).alias(d) for s, d, t in spec))


def date_key(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyyMMdd").cast("int")


def add_date_keys(df: DataFrame, roles: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({key: date_key(ts) for key, ts in roles})


def year_month(key: str | Column) -> Column:
    return (col(key) / 100).cast("int")


def add_audit(df: DataFrame, actor: str) -> DataFrame:
    now = F.current_timestamp()
    return df.withColumns({"created_ts": now, "updated_ts": now, "created_by": F.lit(actor), "updated_by": F.lit(actor)})


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def duration(start: str | Column, end: str | Column, unit: str) -> Column:
    """Whole seconds between, in the unit; null if either side is, negative if end comes first."""
    return F.timestamp_diff("SECOND", col(start), col(end)).cast("double") / _SECONDS[unit]


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Complete 24-hour periods."""
    return F.timestamp_diff("DAY", col(start), col(end))


def abnormal(value: str | Column, low: str | Column, high: str | Column) -> Column:
    """Outside the bounds (themselves normal); null unless value and both bounds are there."""
    v, lo, hi = col(value), col(low), col(high)
    return F.when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), (v < lo) | (v > hi))


def present(c: str | Column) -> Column:
    return col(c).isNotNull() & (F.trim(col(c)) != "")


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(present(n), F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes))


def band(c: str | Column, edges: list[tuple[float, str]], default: str | None = None) -> Column:
    """The label of the first upper edge that the value is below; null stays null."""
    out = F.when(col(c).isNull(), F.lit(None))
    for upper, label in edges:
        out = out.when(col(c) < upper, label)
    return out.otherwise(default)


def first_match(c: str | Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that is found."""
    out = None
    for label, pattern in rules:
        hit = col(c).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def flag_any(condition: Column) -> Column:
    """1 if the condition holds in any row of the group, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


def sum_flag(c: str | Column) -> Column:
    """Rows whose boolean is true; nulls count nothing, a group of nulls gives 0."""
    return F.coalesce(F.sum(col(c).cast("int")), F.lit(0))


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole as a double, null where whole is 0."""
    out = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def percent(condition: Column, digits: int = 2) -> Column:
    return F.round(100.0 * F.count_if(condition).cast("double") / F.count("*"), digits)


def age_at(anchor_age: str, anchor_year: str, event: str | Column) -> Column:
    return F.col(anchor_age) + (F.year(col(event)) - F.col(anchor_year))


def all_equal_own_names(df: DataFrame) -> Column:
    """True where every string column holds its own name: a header line read as data."""
    names = [n for n, t in df.dtypes if t == "string"]
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.lit(n)) for n in names)) if names else F.lit(False)
