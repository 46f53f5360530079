"""Isolation forest: distributed sampling, bounded trees, distributed scoring.

Liu, Ting and Zhou (2008). A tree needs only ~256 rows, so the whole training
work of one (group, tree) pair fits one small task however large the group is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attach, flag
from ..functions.quantiles import exact_quantiles
from ..schemas import ROW_KEY
from ..session import stage

# Input columns of the model, in the given order.
FOREST_FEATURES = (
    "cost_lag_1", "cost_lag_7", "rolling_mean_7", "rolling_std_7", "cost_change_1d", "cost_change_7d",
    "deviation_from_mean", "day_of_week", "is_weekend",
)
TREES = 100
SAMPLE = 256
SEED = 42
# Above this many nodes the forest is shipped by shuffle instead of broadcast.
BROADCAST_NODES = 2_000_000
# Rows of one scoring task on the shuffle path.
SCORE_ROWS = 100_000
_BUCKETS = 1 << 30


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    harmonic = np.log(safe - 1) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes (id, feature, threshold, left, right, path); feature -1 is a leaf."""
    nodes, pending, used = [], [(0, np.arange(len(x)), 0)], 1
    while pending:
        node, rows, depth = pending.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(mean_path(len(rows)))))
            continue
        f = int(open_features[rng.integers(len(open_features))])
        cut = float(low[f] + rng.random() * (high[f] - low[f]))
        cut = cut if cut < high[f] else float(low[f])  # neighbouring floats: both sides stay non-empty
        below = x[rows, f] <= cut
        nodes.append((node, f, cut, used, used + 1, 0.0))
        pending += [(used, rows[below], depth + 1), (used + 1, rows[~below], depth + 1)]
        used += 2
    return nodes


def row_hash(row_key: Sequence[str], seed: int = SEED) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in row_key], F.lit(seed))


def _group_key(group: str) -> Column:
    """The group as text that is never NULL, so rows without a group meet in joins too."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def fit_forest(
    df: DataFrame,
    group: str = "service_category",
    features: Sequence[str] = FOREST_FEATURES,
    row_key: Sequence[str] = ROW_KEY,
    trees: int = TREES,
    sample: int = SAMPLE,
    closed: bool = False,
) -> DataFrame:
    """Node table of the forest of every group.

    Which rows train which tree follows from a hash of the row key, so the
    forest does not depend on the partitioning. Splits ignore scale, so no
    standardisation is needed.
    """
    sizes = df.groupBy(_group_key(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(sample)) / F.greatest(F.col("_n"), F.lit(sample)) * F.lit(_BUCKETS)
    picks = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col("_h"), t), F.lit(_BUCKETS)) < share
    )
    drawn = (
        attach(df.select(group, _group_key(group).alias("_group"), row_hash(row_key).alias("_h"), _vector(features).alias("_x")), sizes, ["_group"], closed)
        .withColumn("tree", F.explode(picks))
        .select(group, "tree", "_h", "_x", "_n")
    )
    kind = dict((f.name, f.dataType) for f in df.schema.fields)[group]
    schema = T.StructType([T.StructField(group, kind), T.StructField("tree", T.IntegerType())] + [
        T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()), T.StructField("path", T.DoubleType()), T.StructField("sample", T.IntegerType()),
    ])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h")
        psi = int(min(sample, pdf["_n"].iloc[0]))
        x = np.stack(pdf["_x"].to_numpy())
        rng = np.random.default_rng([SEED, int(key[1])])
        limit = int(np.ceil(np.log2(max(psi, 2))))
        out = pd.DataFrame(_grow(x, rng, limit), columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, group, key[0])
        out.insert(1, "tree", key[1])
        out["sample"] = psi
        return out

    return drawn.groupBy(group, "tree").applyInPandas(build, schema)


def _pack(nodes: pd.DataFrame) -> tuple:
    """Node arrays of one group as (tree, node) matrices."""
    trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    out = []
    for col, dtype in (("feature", np.int16), ("threshold", float), ("left", np.int32), ("right", np.int32), ("path", float)):
        m = np.full((trees, width), -1, dtype=dtype)
        m[at] = nodes[col].to_numpy()
        out.append(m)
    present = np.unique(at[0])
    return (*out, present, int(nodes["sample"].iloc[0]))


def _score(packed: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, path, present, psi = packed
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in present:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[t, at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] <= threshold[t, at]
            at = np.where(inner, np.where(go_left, left[t, at], right[t, at]), at)
        total += path[t, at]
    return 2.0 ** (-(total / len(present)) / max(float(mean_path(psi)), 1e-9))


def score_forest(
    df: DataFrame,
    nodes: DataFrame,
    group: str = "service_category",
    features: Sequence[str] = FOREST_FEATURES,
    row_key: Sequence[str] = ROW_KEY,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """Add ``if_score`` in (0, 1]; larger is more anomalous.

    The node table is broadcast only while it is below ``broadcast_nodes``;
    beyond that rows and nodes meet in salted co-groups. Both ways give the
    same scores: rows without a group are a group of their own, and a group
    without nodes has the score NULL.
    """
    if nodes.count() > broadcast_nodes:
        return _score_by_shuffle(df, nodes, group, features, row_key)
    keyed = nodes.withColumn("_group", _group_key(group)).drop(group)
    packed = {key: _pack(part) for key, part in keyed.toPandas().groupby("_group")}
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def path_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        forest = shared.value
        for keys, vectors in batches:
            out = pd.Series(np.nan, index=keys.index)
            for key, at in keys.groupby(keys).groups.items():
                if key in forest:
                    out[at] = _score(forest[key], np.stack(vectors[at].to_numpy()))
            yield out

    return df.withColumn("if_score", F.nanvl(path_score(_group_key(group), _vector(features)), F.lit(None).cast("double")))


def _score_by_shuffle(
    df: DataFrame, nodes: DataFrame, group: str, features: Sequence[str], row_key: Sequence[str]
) -> DataFrame:
    key = _group_key(group)
    sizes = df.groupBy(key.alias("_group")).agg(F.ceil(F.count(F.lit(1)) / SCORE_ROWS).cast("int").alias("_salts"))
    rows = df.withColumn("_group", key).join(sizes, "_group").withColumn("_salt", F.pmod(row_hash(row_key), F.col("_salts")).cast("int")).drop("_salts")
    rows = rows.withColumn("_x", _vector(features))
    copies = nodes.withColumn("_group", key).drop(group).join(sizes, "_group")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    schema = T.StructType([*df.schema.fields, T.StructField("if_score", T.DoubleType())])
    names, width = df.columns, len(features)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # Arrow, so the rows' other columns come back as they went.
        if not left.num_rows or not right.num_rows:
            scores = pa.nulls(left.num_rows, pa.float64())
        else:
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in left.column("_x").chunks]).reshape(-1, width)
            scores = pa.array(_score(_pack(right.to_pandas()), x))
        return left.select(names).append_column("if_score", scores)

    return rows.groupBy("_group", "_salt").cogroup(copies.groupBy("_group", "_salt")).applyInArrow(score, schema)


def isolation_forest(
    df: DataFrame,
    group: str = "service_category",
    features: Sequence[str] = FOREST_FEATURES,
    row_key: Sequence[str] = ROW_KEY,
    contamination: float = 0.05,
    fit_rows: Column | None = None,
    closed: bool = False,
    trees: int = TREES,
) -> DataFrame:
    """Add ``if_score`` and ``if_flag``: the top ``contamination`` of each group.

    ``fit_rows`` limits training, and the cut-off, to those rows. ``df`` is
    read twice; stage it if it is not cheap.
    """
    train = df.where(fit_rows) if fit_rows is not None else df
    nodes = stage(fit_forest(train, group, features, row_key, trees=trees, closed=closed), "forest")
    scored = stage(score_forest(df, nodes, group, features, row_key), "forest-scores").withColumn("_group", _group_key(group))
    base = scored.where(fit_rows) if fit_rows is not None else scored
    cuts = exact_quantiles(base, ["_group"], "if_score", {"_cut": 1 - contamination}, closed)
    return (
        attach(scored, cuts, ["_group"], closed)
        .withColumn("if_flag", flag(F.col("if_score") > F.col("_cut")))
        .select(*df.columns, "if_score", "if_flag")
    )
