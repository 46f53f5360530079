"""Generalised extreme studentised deviate test per series (Rosner 1983).

The points the test removes are always among the largest and smallest of the
series, so a series shrinks to its count, mean, scatter and a few extremes
before any round is run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.student import t_quantile
from ..schemas import SERIES_KEYS

ROUNDS = 10


@lru_cache(maxsize=100_000)
def critical_value(n: int, alpha: float) -> float:
    """Bound for the largest deviate among ``n`` points."""
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return t * (n - 1) / math.sqrt((n - 2 + t * t) * n)


@lru_cache(maxsize=100_000)
def compat_critical_value(n: int, i: int, alpha: float) -> float:
    """The reference's bound: its count shrinks and ``i`` is taken off as well."""
    m = n - i
    if m <= 2:
        return math.inf
    t = t_quantile(1 - alpha / (2 * m), m - 2)
    return t * m / math.sqrt((m - 2 + t * t) * (m - 1))


def _rounds(n: int, mean: float, m2: float, values: np.ndarray, rounds: int, alpha: float, compat: bool) -> list[int]:
    """Positions in ``values`` of the outliers, in the order of removal."""
    alive = list(range(len(values)))
    removed, accepted = [], 0
    for i in range(rounds):
        if n < 3 or not alive:
            break
        sd = math.sqrt(max(m2, 0.0) / (n - 1))
        if sd <= 1e-12 * max(1.0, abs(mean)):
            break
        pick = max(alive, key=lambda k: abs(values[k] - mean))
        deviate = abs(values[pick] - mean) / sd
        bound = compat_critical_value(n, i, alpha) if compat else critical_value(n, alpha)
        exceeds = deviate > bound
        if compat and not exceeds:
            break
        removed.append(pick)
        alive.remove(pick)
        if exceeds:
            accepted = len(removed)
        x = values[pick]
        rest = (n * mean - x) / (n - 1)
        m2 -= (x - mean) * (x - rest)
        n, mean = n - 1, rest
    return removed[:accepted]


def gesd_outliers(
    df: DataFrame,
    keys: Sequence[str] = SERIES_KEYS,
    order: Sequence[str] = ("date",),
    value: str = "total_cost",
    rounds: int = ROUNDS,
    alpha: float = 0.05,
    compat: bool = False,
) -> DataFrame:
    """The outlying rows: keys, order columns, value and removal order.

    ``compat`` stops at the first round that does not exceed its bound and uses
    the reference's bound; the default keeps every round up to the last that
    does. The two ranking filters keep ``rounds`` rows per series on the map side.
    """
    keys, order = list(keys), list(order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean"), (F.var_pop("_v") * F.count(F.lit(1))).alias("_m2")
    )

    def ends(direction):
        w = W.partitionBy(*keys).orderBy(direction, *order)
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rounds).drop("_rn")

    extremes = ends(F.col("_v").desc()).union(ends(F.col("_v").asc())).distinct()
    packed = extremes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "_v"))).alias("_points"))
    schema = T.StructType([
        *[f for f in base.schema.fields if f.name in keys],
        T.StructField("_points", packed.schema["_points"].dataType),
        T.StructField("_hits", T.ArrayType(T.IntegerType())),
    ])

    def judge(batches):
        for pdf in batches:
            hits = [
                _rounds(int(n), mean, m2, np.array([p["_v"] for p in points]), rounds, alpha, compat)
                for n, mean, m2, points in zip(pdf["_n"], pdf["_mean"], pdf["_m2"], pdf["_points"])
            ]
            yield pdf[[*keys, "_points"]].assign(_hits=hits)

    judged = base.join(packed, keys).mapInPandas(judge, schema)
    hit = judged.select(*keys, "_points", F.posexplode("_hits").alias("_i", "_at"))
    point = F.col("_points")[F.col("_at")]
    return hit.select(
        *keys, *[point[c].alias(c) for c in order], point["_v"].alias(value), (F.col("_i") + 1).alias("removal_rank")
    )
