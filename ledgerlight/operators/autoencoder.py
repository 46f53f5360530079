"""Recurrent window autoencoders, one per group, trained by data-parallel rounds.

An LSTM reads a window, its last hidden state is the code, a second LSTM
unrolls the code and a linear layer reads the window back out of it. All
groups train in the same jobs:

* Equal windows become one with a weight; windows are packed once into blocks
  of bounded size, however large a group is, and staged.
* A round joins the blocks with the groups' weights (a few thousand numbers a
  group; broadcast or shuffled by their measured size), each block gives the
  gradient of its windows, and Spark adds the parts, combined in each task
  before the shuffle. One Adam step a group makes the next weights, which are
  staged, so no round is computed twice and a lost executor costs its tasks.
* Gradients are added as whole numbers of 2**-32, so the sum, and with it the
  model, does not depend on partitions or their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import attach, flag
from ..functions.quantiles import exact_quantiles
from ..schemas import SERIES_KEYS
from ..session import stage
from .features import sliding_windows
from .reconstruct import LENGTH, MULTI_COLUMNS, standardize

HIDDEN = 16
ROUNDS = 30
RATE = 0.01
BLOCK = 4096
UNIT = 2.0**32
SEED = 42


def shapes(features: int, hidden: int) -> list[tuple[int, ...]]:
    """Encoder, decoder and read-out: input, recurrent and bias weights."""
    gates = 4 * hidden
    return [(gates, features), (gates, hidden), (gates,), (gates, hidden), (gates, hidden), (gates,), (features, hidden), (features,)]


def split(theta: np.ndarray, features: int, hidden: int) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(features, hidden):
        size = int(np.prod(shape))
        out.append(theta[at : at + size].reshape(shape))
        at += size
    return out


def first_weights(features: int, hidden: int, seed: int = SEED) -> np.ndarray:
    size = sum(int(np.prod(s)) for s in shapes(features, hidden))
    return np.random.default_rng(seed).uniform(-1, 1, size) / np.sqrt(hidden)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _unroll(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, window, hidden) of an LSTM over ``x`` (time, window, input)."""
    size = wh.shape[1]
    h, c = np.zeros((x.shape[1], size)), np.zeros((x.shape[1], size))
    states, tape = [], []
    for now in x:
        gates = now @ wx.T + h @ wh.T + b
        keep_in, keep, out = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in (0, 1, 3))
        new = np.tanh(gates[:, 2 * size : 3 * size])
        before, cell = h, c
        c = keep * c + keep_in * new
        squashed = np.tanh(c)
        h = out * squashed
        states.append(h)
        tape.append((now, before, cell, keep_in, keep, new, out, squashed))
    return np.array(states), tape


def _rewind(d_states: np.ndarray, tape: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of (input, wx, wh, b) from those of the hidden states."""
    d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(len(wx))
    d_x = np.zeros((len(tape), *tape[0][0].shape))
    d_h, d_c = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][2])
    for t in reversed(range(len(tape))):
        now, before, cell, keep_in, keep, new, out, squashed = tape[t]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * out * (1 - squashed**2)
        d_gates = np.concatenate([
            d_c * new * keep_in * (1 - keep_in), d_c * cell * keep * (1 - keep), d_c * keep_in * (1 - new**2), d_h * squashed * out * (1 - out),
        ], axis=1)
        d_wx += d_gates.T @ now
        d_wh += d_gates.T @ before
        d_b += d_gates.sum(0)
        d_x[t] = d_gates @ wx
        d_h, d_c = d_gates @ wh, d_c * keep
    return d_x, d_wx, d_wh, d_b


def errors(theta: np.ndarray, x: np.ndarray, hidden: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Mean squared error of each window of ``x`` (window, time, feature); with ``weight`` also the gradient of their weighted sum."""
    n, length, features = x.shape
    ex, eh, eb, dx, dh, db, ow, ob = split(theta, features, hidden)
    steps = x.transpose(1, 0, 2)
    read, read_tape = _unroll(steps, ex, eh, eb)
    code = np.broadcast_to(read[-1], (length, n, hidden))
    told, told_tape = _unroll(code, dx, dh, db)
    gap = told @ ow.T + ob - steps
    each = (gap**2).mean(axis=(0, 2))
    if weight is None:
        return each, None
    d_y = gap * weight[None, :, None] * (2.0 / (length * features))
    d_ow, d_ob = np.einsum("tnf,tnh->fh", d_y, told), d_y.sum((0, 1))
    d_code, d_dx, d_dh, d_db = _rewind(d_y @ ow, told_tape, dx, dh)
    d_read = np.zeros_like(read)
    d_read[-1] = d_code.sum(0)
    _, d_ex, d_eh, d_eb = _rewind(d_read, read_tape, ex, eh)
    return each, np.concatenate([g.ravel() for g in (d_ex, d_eh, d_eb, d_dx, d_dh, d_db, d_ow, d_ob)])


def adam(theta: np.ndarray, first: np.ndarray, second: np.ndarray, gradient: np.ndarray, turn: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = 0.9 * first + 0.1 * gradient
    second = 0.999 * second + 0.001 * gradient**2
    step = rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return theta - step, first, second


def packed_windows(windows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, values, counts, hashes): blocks of distinct windows with how often each occurs, in a fixed order."""
    kind = windows.schema[group].dataType.simpleString()
    distinct = windows.where(F.col(vector).isNotNull()).select(F.col(group), F.col(vector).alias("window"), F.xxhash64(vector).alias("hash"))
    distinct = stage(distinct.groupBy(group, "hash", "window").agg(F.count(F.lit(1)).alias("n")), "distinct-windows")
    sizes = distinct.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = distinct.join(sizes, group).withColumn("block", F.pmod("hash", "blocks")).drop("blocks")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending")])
        x = table.column("window").combine_chunks().flatten().to_numpy().astype(np.float64)
        row = [pa.array([part.tobytes()], pa.binary()) for part in (x, table.column("n").to_numpy(), table.column("hash").to_numpy())]
        return pa.Table.from_arrays([table.column(group).slice(0, 1).combine_chunks(), *row], names=[group, "values", "counts", "hashes"])

    blocks = dealt.groupBy(group, "block").applyInArrow(pack, f"`{group}` {kind}, values binary, counts binary, hashes binary")
    return stage(blocks, "window-blocks")


def _of(row: dict, length: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["values"]).reshape(-1, length, features), np.frombuffer(row["counts"], np.int64)


def fit(blocks: DataFrame, group: str, length: int, features: int = 1, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """(group, theta, loss): the weights after ``rounds`` full-batch Adam rounds, and the mean error before the last of them."""
    kind = blocks.schema[group].dataType.simpleString()
    start = first_weights(features, hidden)
    zeros = np.zeros(len(start)).tobytes()
    state = blocks.select(group).distinct().select(group, F.lit(start.tobytes()).alias("theta"), F.lit(zeros).alias("first"), F.lit(zeros).alias("second"), F.lit(0.0).alias("loss"))
    state = stage(state, "weights")

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            parts = []
            for row in rows:
                x, n = _of(row, length, features)
                each, gradient = errors(np.frombuffer(row["theta"]), x, hidden, n.astype(float))
                parts.append(np.rint(np.concatenate([[n.sum(), each @ n], gradient]) * UNIT).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(parts, pa.list_(pa.int64()))], [group, "part"])

    def stepper(turn: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    sums = np.array([s["total"] for s in sorted(row["sums"], key=lambda s: s["at"])], np.float64) / UNIT
                    after = adam(*(np.frombuffer(row[c]) for c in ("theta", "first", "second")), sums[2:] / sums[0], turn, rate)
                    out.append([*(a.tobytes() for a in after), sums[1] / sums[0]])
                columns = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(group), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [group, "theta", "first", "second", "loss"])

        return step

    for turn in range(1, rounds + 1):
        parts = blocks.drop("hashes").join(state.select(group, "theta"), group).mapInArrow(gradients, f"`{group}` {kind}, part array<long>")
        # Sums as decimals: whole numbers that no number of blocks overflows.
        sums = parts.select(group, F.posexplode("part").alias("at", "value")).groupBy(group, "at").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("double").alias("total"))
        sums = sums.groupBy(group).agg(F.collect_list(F.struct("at", "total")).alias("sums"))
        state = stage(sums.join(state.drop("loss"), group).mapInArrow(stepper(turn), f"`{group}` {kind}, theta binary, first binary, second binary, loss double"), "weights")
    return state.select(group, "theta", "loss")


def window_errors(blocks: DataFrame, weights: DataFrame, group: str, length: int, features: int, hidden: int) -> DataFrame:
    """(group, hash, error) of every distinct window."""
    kind = blocks.schema[group].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                x, _ = _of(row, length, features)
                each, _ = errors(np.frombuffer(row["theta"]), x, hidden)
                again = pa.array([row[group]] * len(each), batch.schema.field(group).type)
                yield pa.RecordBatch.from_arrays([again, pa.array(np.frombuffer(row["hashes"], np.int64)), pa.array(each)], [group, "hash", "error"])

    return blocks.join(weights.select(group, "theta"), group).mapInArrow(score, f"`{group}` {kind}, hash long, error double")


def with_errors(rows: DataFrame, group: str, vector: str, length: int, features: int, hidden: int, rounds: int, rate: float, fit_rows=None) -> DataFrame:
    """The rows with ``_error``, that of their window under their group's autoencoder; NULL without a window or a model."""
    blocks = packed_windows(rows, group, vector)
    trained = blocks if fit_rows is None else packed_windows(rows.where(fit_rows), group, vector)
    weights = fit(trained, group, length, features, hidden, rounds, rate)
    scores = stage(window_errors(blocks, weights, group, length, features, hidden), "window-errors")
    scores = scores.select(F.col(group).alias("_group"), F.col("hash").alias("_hash"), F.col("error").alias("_error"))
    return rows.join(scores, (F.col(group) == F.col("_group")) & (F.xxhash64(vector) == F.col("_hash")), "left").drop("_group", "_hash")


def sequence_autoencoder(
    df: DataFrame, group: str = "service_category", keys: Sequence[str] = SERIES_KEYS, order: Sequence[str] = ("date",), cost: str = "total_cost",
    length: int = LENGTH, quantile: float = 0.95, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, closed: bool = False,
) -> DataFrame:
    """Add ``lstm_error`` and ``lstm_flag`` (error above the group's quantile), as ``window_reconstruction`` does, from a recurrent model.

    The first ``length - 1`` rows of a series, and series of no more than
    ``length`` rows, have error 0 and no flag.
    """
    value = f"{cost}_scaled"
    series = W.partitionBy(*keys)
    rows = sliding_windows(standardize(df, [cost], [group], closed), series.orderBy(*order), [value], length)
    rows = rows.withColumn("_len", F.count(F.lit(1)).over(series))
    rows = stage(rows.withColumn("window", F.when(F.col("_len") > length, F.col("window"))).drop("_len", value), "windows")
    scored = stage(with_errors(rows, group, "window", length, 1, hidden, rounds, rate).drop("window"), "window-scores")
    cuts = exact_quantiles(scored, [group], "_error", {"_cut": quantile}, closed)
    return attach(scored, cuts, [group], closed).withColumns({
        "lstm_error": F.coalesce(F.col("_error"), F.lit(0.0)), "lstm_flag": flag(F.col("_error") > F.col("_cut")),
    }).drop("_error", "_cut")


def sequence_autoencoder_multi(
    df: DataFrame, key: str = "segment_id", columns: Sequence[str] = MULTI_COLUMNS, length: int = 14,
    hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE,
) -> DataFrame:
    """Error of rebuilding the ``length`` rows before each row, as ``lstm_score``, by one model trained on all training windows.

    Needs ``is_train``; columns are scaled per segment on its training rows,
    and windows do not cross from the training part into the held-out part.
    """
    names = [f"{c}_scaled" for c in columns]
    scaled = standardize(df, columns, [key], fit_rows=F.col("is_train") == 1)
    rows = sliding_windows(scaled, W.partitionBy(key, "is_train").orderBy("date"), names, length, preceding=True).drop(*names)
    rows = stage(rows.where(F.col("window").isNotNull()).withColumn("_model", F.lit("all")), "multi-windows")
    scored = with_errors(rows, "_model", "window", length, len(columns), hidden, rounds, rate, F.col("is_train") == 1)
    return scored.withColumnRenamed("_error", "lstm_score").drop("_model", "window")
