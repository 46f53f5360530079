"""Cost drivers of anomalies: a random forest and its Shapley contributions.

Path-dependent Shapley values (Lundberg et al. 2020) are additive over leaves.
A leaf is an interval per feature on its path plus the share of training rows
that would pass each interval, so contributions are vector operations over
(anomaly, leaf) and only the few anomalies asked for are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schemas import ROW_KEY
from ..session import stage_path

# Input columns of the model, in the given order.
ATTRIBUTION_FEATURES = (
    "cost_lag_1", "cost_lag_7", "rolling_mean_7", "rolling_std_7", "cost_change_1d", "cost_change_7d",
    "day_of_week", "month", "is_weekend", "is_month_end",
)


def fit_cost_model(
    df: DataFrame,
    path: str,
    features: Sequence[str] = ATTRIBUTION_FEATURES,
    label: str = "total_cost",
    trees: int = 100,
    depth: int = 5,
) -> str:
    """Fit the forest that explains cost and save it; returns ``path``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.select(label, *features).na.fill(0)
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    forest = RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=42
    )
    forest.fit(rows).write().overwrite().save(path)
    return path


def read_leaves(spark: SparkSession, path: str) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves of a saved forest: (value, [(feature, low, high, share)]).

    The node table is bounded by trees times 2^depth, whatever the data size.
    """
    stored = spark.read.parquet(f"{path}/data").selectExpr("treeID", "nodeData.*").selectExpr(
        "treeID", "id", "prediction", "double(rawCount) AS cover", "leftChild", "rightChild",
        "split.featureIndex AS feature", "try_element_at(split.leftCategoriesOrThreshold, 1) AS threshold",
    ).toPandas()
    leaves = []
    trees = stored["treeID"].nunique()
    for _, tree in stored.groupby("treeID"):
        node = {int(r.id): r for r in tree.itertuples()}
        pending = [(0, {})]
        while pending:
            at, walls = pending.pop()
            here = node[at]
            if here.leftChild < 0:
                leaves.append((here.prediction / trees, [(f, *w) for f, w in walls.items()]))
                continue
            f, cut = int(here.feature), float(here.threshold)
            low, high, share = walls.get(f, (-np.inf, np.inf, 1.0))
            for child, wall in (
                (int(here.leftChild), (low, min(high, cut))), (int(here.rightChild), (max(low, cut), high))
            ):
                passed = node[child].cover / here.cover
                pending.append((child, {**walls, f: (*wall, share * passed)}))
    return leaves


def contributions(leaves: list, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows, features) and the expected prediction.

    For one leaf with features U, feature j gets the leaf value times
    (inside_j - share_j) times the weighted sum over subsets of U without j of
    the products of ``inside`` (in the subset) and ``share`` (out of it). That
    sum depends on subset sizes only, so it is read off a polynomial.
    """
    phi = np.zeros(x.shape)
    base = 0.0
    for value, walls in leaves:
        size = len(walls)
        shares = np.array([w[3] for w in walls])
        base += value * float(np.prod(shares)) if size else value
        if not size:
            continue
        inside = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in walls], axis=1).astype(float)
        weights = np.array([factorial(k) * factorial(size - 1 - k) / factorial(size) for k in range(size)])
        for j, (f, *_rest) in enumerate(walls):
            poly = np.zeros((len(x), size))
            poly[:, 0] = 1.0
            for k in range(size):
                if k != j:
                    grown = poly * shares[k]
                    grown[:, 1:] += poly[:, :-1] * inside[:, [k]]
                    poly = grown
            phi[:, f] += value * (inside[:, j] - shares[j]) * (poly @ weights)
    return phi, base


def first_anomalies(df: DataFrame, top: int = 10, row_key: Sequence[str] = ROW_KEY, anomaly: str = "final_anomaly") -> DataFrame:
    """The ``top`` anomalies of each service with most at risk."""
    by_impact = W.partitionBy("service_category").orderBy(F.col("impact_score").desc(), *row_key)
    flagged = df.where(F.col(anomaly) == 1)
    return flagged.withColumn("_rn", F.row_number().over(by_impact)).where(F.col("_rn") <= top).drop("_rn")


def keep_known(anomalies: DataFrame, features: DataFrame, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Anomalies whose key exists in the feature rows."""
    return anomalies.join(features.select(*row_key), list(row_key), "left_semi")


def shapley_rows(
    anomalies: DataFrame,
    leaves: list,
    features: Sequence[str] = ATTRIBUTION_FEATURES,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """One row per anomaly and feature: ``feature, shap_value, base_value``."""
    features = list(features)
    keep = [f for f in anomalies.schema.fields if f.name in row_key]
    schema = T.StructType([
        *keep, T.StructField("feature", T.StringType()), T.StructField("shap_value", T.DoubleType()),
        T.StructField("base_value", T.DoubleType()),
    ])
    names = [f.name for f in keep]
    shared = anomalies.sparkSession.sparkContext.broadcast(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi, base = contributions(shared.value, pdf[features].to_numpy(float))
            wide = pdf[names].assign(**{f: phi[:, i] for i, f in enumerate(features)})
            yield wide.melt(id_vars=names, value_vars=features, var_name="feature", value_name="shap_value").assign(base_value=base)

    inputs = anomalies.select(*names, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features if f not in names])
    return inputs.mapInPandas(explain, schema)


def explain_services(
    scored: DataFrame,
    services: Sequence[str] | None = None,
    top: int | None = None,
    trees: int = 100,
    depth: int = 5,
    save_under: str | None = None,
) -> DataFrame:
    """Contributions for the anomalies of each service: all, or the ``top`` with most at risk.

    ``services`` may narrow the categories; by default they are those of the
    rows. A category without rows has no model and no contributions. Each model
    is a distributed fit over that service's rows; the loop is over the billing
    categories, a catalogue of a few names, not over rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    spark = scored.sparkSession
    present = {r[0] for r in scored.select("service_category").where("service_category IS NOT NULL").distinct().collect()}
    services = sorted(present if services is None else present.intersection(services))
    root = save_under or stage_path(spark, "cost-models")

    @inheritable_thread_target(spark)
    def one(service: str) -> list:
        rows = scored.where(F.col("service_category") == service)
        return read_leaves(spark, fit_cost_model(rows, f"{root}/{service}", trees=trees, depth=depth))

    with ThreadPoolExecutor(max_workers=4) as pool:
        models = dict(zip(services, pool.map(one, services)))
    leading = scored.where(F.col("final_anomaly") == 1) if top is None else first_anomalies(scored, top)
    out = None if services else shapley_rows(leading.limit(0), [])
    for service in services:
        part = shapley_rows(leading.where(F.col("service_category") == service), models[service])
        out = part if out is None else out.unionByName(part)
    return out
