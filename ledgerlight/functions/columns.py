"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
MONEY = "decimal(18,4)"

# The text patterns a billing export may use for its dates.
DATE_PATTERNS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
    "dd-MMM-yyyy",
    "MMM d, yyyy",
)

# Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def flag(condition: Column) -> Column:
    """0/1 from a condition; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def parse_date(col: str, patterns: Iterable[str] = DATE_PATTERNS) -> Column:
    """Day from text in any of the patterns, NULL when none fits."""
    text = F.trim(F.col(col))
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in patterns]
    return F.to_date(F.coalesce(*tries))


def clean_money(col: str) -> Column:
    """Money as an exact decimal: missing, NaN and negative become 0."""
    zero = F.lit(0).cast(MONEY)
    return F.greatest(F.coalesce(F.col(col).try_cast(MONEY), zero), zero)


def out_of_range(col: str) -> Column:
    """A number that money cannot hold: too large, or infinite."""
    number = F.col(col).try_cast("double")
    return flag(number.isNotNull() & ~F.isnan(number) & F.col(col).try_cast(MONEY).isNull()) == 1


def calendar_columns(col: str = "date") -> dict[str, Column]:
    day = F.col(col)
    monday_zero = F.weekday(day)
    return {
        "day_of_week": monday_zero,
        "day_of_month": F.dayofmonth(day),
        "month": F.month(day),
        "week_of_year": F.weekofyear(day),
        "is_weekend": flag(monday_zero >= 5),
        "is_month_end": flag(day == F.last_day(day)),
    }


def ratio_change(now: Column, before: Column) -> Column:
    """Relative change; NULL when the earlier value is 0 or missing."""
    return F.try_divide(now, before) - F.lit(1.0)


def safe_ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(default))


def key_hash(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose bound is exceeded: ``[(4000, "a"), (2000, "b")]``."""
    expr = F.lit(otherwise)
    for bound, label in reversed(steps):
        expr = F.when(value > bound, label).otherwise(expr)
    return expr


def segment_id(*cols: str) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("_", *[F.col(c) for c in cols]), " ", "_"))


def attach(df: DataFrame, stats: DataFrame, keys: Iterable[str], closed: bool = False, how: str = "left") -> DataFrame:
    """Join per-group values back to the rows.

    ``closed=True`` says the key comes from a fixed list (the service taxonomy),
    so ``stats`` has a handful of rows and is broadcast. Otherwise there is no
    hint: the optimizer broadcasts by measured size or splits skewed keys.
    """
    side = F.broadcast(stats) if closed else stats
    return df.join(side, list(keys), how)
