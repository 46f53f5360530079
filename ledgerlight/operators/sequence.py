"""One ordered sequence per service, without putting a service into one task.

The reference treats all rows of a service as a single sequence ordered by
date, with the rows of one date side by side. A hot service would then be one
huge window. Two steps avoid that: positions come from per-day counts plus a
rank inside each (service, day), and neighbourhoods come from fixed-size blocks
of positions that overlap by as many rows as the frame needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

BLOCK_ROWS = 10_000


def with_positions(
    df: DataFrame,
    key: str = "service_category",
    ties: Sequence[str] = ("provider", "team", "environment"),
) -> DataFrame:
    """Add ``seq`` (0-based position inside the service) and ``seq_len``."""
    days = df.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_c"))
    by_day = W.partitionBy(key).orderBy("date")
    days = days.select(
        key,
        "date",
        F.coalesce(F.sum("_c").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(W.partitionBy(key)).alias("seq_len"),
    )
    in_day = F.row_number().over(W.partitionBy(key, "date").orderBy(*ties))
    return (
        df.join(days, [key, "date"])
        .withColumn("seq", F.col("_before") + in_day - F.lit(1))
        .drop("_before")
    )


def in_blocks(
    df: DataFrame, before: int, after: int, key: str = "service_category", size: int = BLOCK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Rows cut into blocks of ``size`` positions, edges copied to neighbours.

    Returns the frame and the window to use; ``home_rows`` drops the copies.
    Needs ``before``/``after`` no larger than ``size``.
    """
    if max(before, after) > size:
        raise ValueError("frame is longer than a block")
    home = F.floor(F.col("seq") / F.lit(size))
    place = F.col("seq") % F.lit(size)
    wanted = F.array_compact(F.array(
        home,
        F.when((place < after) & (home > 0), home - 1),
        F.when(place >= size - before, home + 1),
    ))
    cut = df.withColumn("_home", home).withColumn("_block", F.explode(wanted))
    return cut, W.partitionBy(key, "_block").orderBy("seq")


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_block") == F.col("_home")).drop("_block", "_home")
