"""One-class machine: the nu hinge objective on random Fourier features, all groups solved together.

Minimises ``|w|^2 / 2 - rho + mean(hinge(rho - w.phi)) / nu`` (Schoelkopf et al.
2001) with the RBF kernel as an inner product of cosine features (Rahimi and
Recht 2007). The hinge is rounded on a width ``mu`` that shrinks to
``WIDTH``, which moves the optimum by half of that at most, and the rounded
objective is solved by Newton's method: its gradient and curvature are sums
over training rows, so a round is one grouped aggregate for all groups.

How it scales: distinct rows lie in staged blocks, so a group of any size is
many blocks; each task adds up its blocks of a group, salted partial sums meet
in two steps, and the state of a group is ``waves + 1`` numbers. Sums are added
as whole numbers, so any partitions give the same model.

Cases: rows with a missing feature teach nothing and have the score NULL; a
group without training rows has no model and NULL scores; repeated rows count
each; an empty frame gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import flag
from ..session import stage
from .autoencoder import packed_windows
from .reconstruct import standardize
from .segments import SEGMENT_FEATURES

WAVES = 64
SEED = 42
NU = 0.05
WIDTH = 1e-3
ROUNDS = 26
STEPS = (0.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
SALTS = 32
UNIT = 2.0**24  # sums are whole multiples of 1 / UNIT


def cosine_features(x: np.ndarray, waves: int, gamma: float) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    frequency = rng.normal(0.0, np.sqrt(2 * gamma), (x.shape[1], waves))
    phase = rng.uniform(0, 2 * np.pi, waves)
    return np.sqrt(2.0 / waves) * np.cos(x @ frequency + phase)


def width(turn: int) -> float:
    """Rounding of the hinge in a round: from 1 down to ``WIDTH``, which the last third of the rounds keeps."""
    return max(WIDTH, WIDTH ** (turn / (ROUNDS * 2 / 3)))


def loss_sums(theta: np.ndarray, direction: np.ndarray, phi: np.ndarray, n: np.ndarray, mu: float) -> np.ndarray:
    """Over rows: their number, the loss at each of ``STEPS`` along the direction, and slope and curvature at step 1."""
    lifted = np.hstack([-phi, np.ones((len(phi), 1))])
    gap, change = lifted @ theta, lifted @ direction
    losses = []
    for s in STEPS:
        z = np.maximum(gap + s * change, 0.0)
        losses.append(n @ np.where(z < mu, z * z / (2 * mu), z - mu / 2))
    z = gap + change
    slope = lifted.T @ (n * np.clip(z / mu, 0.0, 1.0))
    band = lifted[(z > 0) & (z < mu)]
    curve = band.T @ (band * n[(z > 0) & (z < mu), None])
    return np.rint(np.concatenate([[n.sum()], losses, slope, curve.ravel()]) * UNIT).astype(np.int64)


def newton(theta: np.ndarray, direction: np.ndarray, sums: np.ndarray, nu: float, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """The next point and direction. A full step has its slope at hand; after a shorter one the next round gets it."""
    m, at = len(theta), 1 + len(STEPS)
    total, losses = sums[0], sums[1:at] / (sums[0] * nu)
    points = [theta + s * direction for s in STEPS]
    values = [0.5 * p[:-1] @ p[:-1] - p[-1] + loss for p, loss in zip(points, losses, strict=True)]
    best = int(np.argmin(values))
    if direction.any() and STEPS[best] != 1.0 and values[1] > values[best] + 1e-12:
        return points[best], np.zeros(m)
    point, weight = points[1], np.append(np.ones(m - 1), 0.0)
    slope = weight * point + sums[at : at + m] / (total * nu)
    slope[-1] -= 1.0
    curve = np.diag(weight) + sums[at + m :].reshape(m, m) / (total * nu * mu)
    if curve[-1, -1] < 1.0:  # no row bends the loss: a plain step of the offset
        curve[-1, -1] += 1.0
    return point, -np.linalg.solve(curve + 1e-9 * np.eye(m), slope)


def fit(blocks: DataFrame, group: str, n_features: int, nu: float, gamma: float, waves: int = WAVES) -> DataFrame:
    """(group, theta): weights and offset of each group that has training rows."""
    kind, group_type = blocks.schema[group].dataType.simpleString(), to_arrow_type(blocks.schema[group].dataType)
    start = np.append(np.zeros(waves), 0.5)
    state = stage(blocks.select(group).distinct().select(group, F.lit(start.tobytes()).alias("theta"), F.lit(np.zeros(waves + 1).tobytes()).alias("direction")), "one-class")

    def summing(mu: float):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for batch in batches:
                for row in batch.to_pylist():
                    x, n = np.frombuffer(row["values"]).reshape(-1, n_features), np.frombuffer(row["counts"], np.int64)
                    part = loss_sums(np.frombuffer(row["theta"]), np.frombuffer(row["direction"]), cosine_features(x, waves, gamma), n.astype(float), mu)
                    found[row[group]] = found[row[group]] + part if row[group] in found else part
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(list(found), group_type), pa.array([salt] * len(found), pa.int32()), pa.array([p.tobytes() for p in found.values()], pa.binary())], [group, "salt", "sums"])

        return partial

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("sums").to_pylist():
                total = np.frombuffer(value, np.int64) if total is None else total + np.frombuffer(value, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], group_type), pa.array([total.tobytes()], pa.binary())], [group, "sums"])

    def stepping(mu: float):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                after = [newton(np.frombuffer(r["theta"]), np.frombuffer(r["direction"]), np.frombuffer(r["sums"], np.int64) / UNIT, nu, mu) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(group), *(pa.array([a[i].tobytes() for a in after], pa.binary()) for i in (0, 1))], [group, "theta", "direction"])

        return step

    summed = f"`{group}` {kind}, sums binary"
    for turn in range(1, ROUNDS + 1):
        mu = width(turn)
        parts = blocks.drop("hashes").join(state, group).mapInArrow(summing(mu), f"`{group}` {kind}, salt int, sums binary")
        sums = parts.groupBy(group, "salt").applyInArrow(added, summed).groupBy(group).applyInArrow(added, summed)
        state = stage(sums.join(state, group).mapInArrow(stepping(mu), f"`{group}` {kind}, theta binary, direction binary"), "one-class")
    return state.select(group, "theta")


def one_class_machine(
    df: DataFrame, key: str = "segment_id", features: Sequence[str] = SEGMENT_FEATURES, nu: float = NU, gamma: float | None = None, waves: int = WAVES,
) -> DataFrame:
    """Add ``svm_score`` (how far a row lies outside its group's machine) and ``svm_flag`` (it lies outside).

    Needs ``is_train``; features are scaled on a group's training rows. At most
    a share ``nu`` of a group's training rows lies outside. ``gamma`` defaults
    to one over the number of features.
    """
    gamma = gamma if gamma is not None else 1.0 / len(features)
    train = F.col("is_train") == 1
    scaled = standardize(df, features, [key], fit_rows=train)
    names = [f"{c}_scaled" for c in features]
    whole = F.lit(True)
    for name in (*features, *names):
        whole = whole & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    rows = stage(scaled.withColumn("_x", F.when(whole, F.array(*[F.col(n).cast("double") for n in names]))).drop(*names), "one-class-rows")
    models = fit(packed_windows(rows.where(train), key, "_x"), key, len(features), nu, gamma, waves)
    kind = rows.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, theta = np.frombuffer(row["values"]).reshape(-1, len(features)), np.frombuffer(row["theta"])
                outside = theta[-1] - WIDTH - cosine_features(x, waves, gamma) @ theta[:-1]
                again = pa.array([row[key]] * len(x), batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([again, pa.array(np.frombuffer(row["hashes"], np.int64)), pa.array(outside)], ["_group", "_hash", "svm_score"])

    scores = packed_windows(rows, key, "_x").join(models, key).mapInArrow(score, f"_group {kind}, _hash long, svm_score double")
    joined = rows.join(scores, (F.col(key) == F.col("_group")) & (F.xxhash64("_x") == F.col("_hash")), "left").drop("_group", "_hash", "_x")
    return joined.withColumn("svm_flag", flag(F.col("svm_score") > 0))
