"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed word features are trained in numpy from
confirmed toxic documents and unlabelled text only: a document that is labelled
clean is treated as unlabelled. The risk estimator is corrected by the class
prior p: ``p R_p(+) + max(0, R_u(-) - p R_p(-))``; where the bracket turns
negative, the step goes against it, as the non-negative estimator asks. A few
classifiers with different seeds are averaged.

How it scales: the fit takes bounded samples (``MOST_POSITIVE`` and
``MOST_UNLABELLED`` documents, those of the least hash), whose ids are chosen
from narrow rows before any text is read; scoring is one pass without shuffle.

Cases: null and empty texts have no features and get the score of the bias;
null doc_ids and unlabelled documents are scored like others; repeated rows
are scored each; without a confirmed example every score is 0; an empty table
gives an empty result; extra columns are ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import wordbytes
from ledgerlight.llm.memory import give_back, lean

MOST_POSITIVE = 4_000
MOST_UNLABELLED = 8_000
LEAST_DOCUMENTS = 3  # a feature of fewer confirmed documents has no weight
LEAST_SHARE = 0.5
PREFIXES = (4, 5)
CLASSIFIERS = 3
STEPS = 400
PULL = 0.01
LEAST_BIAS = -2.0  # a text of no known feature is sure enough; lower would drown single words
BITS = 22


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): distinct hashed words and word beginnings of each row."""
    data = wordbytes.LOWER[data]
    start, end, row = wordbytes.words(data, offsets, LETTERS)
    found, rows = [wordbytes.hashes(data, start, end)], [row]
    for n in PREFIXES:
        long = end - start > n
        found.append(wordbytes.mix64(wordbytes.hashes(data, start[long], start[long] + n) + np.uint64(n)))
        rows.append(row[long])
    both = np.sort(np.concatenate(rows).astype(np.uint64) << np.uint64(BITS) | np.concatenate(found) >> np.uint64(64 - BITS))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


LETTERS = wordbytes.ALNUM.copy()
LETTERS[0x30:0x3A] = False


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0: such labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(text, positive) of the documents to learn from, and the share of confirmed ones among labelled rows.

    Rows that are held out are in neither sample. Both samples are bounded, so
    their ids may be broadcast: an id counts once however many rows it has, and
    of several texts of an id the one of the least hash is taken.
    """
    usable = ~held_out(F.col("doc_id"))
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    order = [F.xxhash64("doc_id", F.lit("pu")), F.col("doc_id")]
    positive = known.where("toxic = 1").select("doc_id").orderBy(*order).limit(MOST_POSITIVE)
    unlabelled = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(MOST_UNLABELLED)
    ids = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return rows.groupBy("doc_id", "positive").agg(one).select("text", "positive"), float(prior)


def sample_features(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """(features of each row, positive of each row) of the sampled documents, on the driver."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in wordbytes.parts(batch):
                row, feature = features(data, offsets)
                counts = np.bincount(row, minlength=z - a)
                packed = [f.astype("<u4").tobytes() for f in np.split(feature, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("positive").slice(a, z - a)], ["features", "positive"])

    table = rows.mapInArrow(scan, "features binary, positive boolean").toArrow()
    # An order of its own: rows arrive in any.
    packed, positive = table.column("features").to_pylist(), table.column("positive").to_pylist()
    order = sorted(range(len(packed)), key=lambda i: (positive[i], packed[i]))
    return [np.frombuffer(packed[i], "<u4") for i in order], np.array([positive[i] for i in order], bool)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Matrix:
    """A 0/1 matrix by rows, and its transpose, for numpy products."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int):
        self.row, self.column, self.n_rows, self.n_columns = row, column, n_rows, n_columns

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.n_rows)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.n_columns)


def fit(found: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the averaged classifiers."""
    n_positive, n_unlabelled = int(positive.sum()), int((~positive).sum())
    if not n_positive or not n_unlabelled or not prior:
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    # Row by row, as a row's features are distinct: all entries at once would take a few hundred MB of the driver.
    times, anywhere = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for feature, toxic in zip(found, positive.tolist(), strict=True):
        (times if toxic else anywhere)[feature] += 1
    used = np.flatnonzero(times >= LEAST_DOCUMENTS)
    # Of the unlabelled documents with the feature, the share that the prior says is toxic.
    share = prior * (times[used] / n_positive) / ((anywhere[used] + 1) / n_unlabelled)
    used = used[share >= LEAST_SHARE]
    del times, anywhere
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    columns = [at[at >= 0] for at in (place[feature] for feature in found)]
    row = np.repeat(np.arange(len(found)), [len(c) for c in columns])
    x = Matrix(row, np.concatenate(columns).astype(np.int64), len(positive), len(used))
    weights, bias = np.zeros(len(used)), 0.0
    for seed in range(CLASSIFIERS):
        w, b = train(x, positive, prior, seed)
        weights, bias = weights + w / CLASSIFIERS, bias + b / CLASSIFIERS
    some = np.abs(weights) > 1e-6
    return used[some], weights[some], bias


def train(x: Matrix, positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """One classifier: Adam on the non-negative risk with the (bounded) sigmoid loss, and an l1 pull on the weights."""
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 0.01, x.n_columns), -1.0
    first, second = np.zeros(x.n_columns + 1), np.zeros(x.n_columns + 1)
    in_p, in_u = positive / positive.sum(), ~positive / (~positive).sum()
    rate, pull = 0.05, PULL
    for step in range(1, STEPS + 1):
        # Each step sees each document with chance 0.8.
        seen = rng.random(x.n_rows) < 0.8
        p, u = in_p * seen / 0.8, in_u * seen / 0.8
        z = x.times(weights) + bias
        score = sigmoid(z)
        bracket = u @ score - prior * (p @ score)
        steep = score * (1 - score)
        toward_negative = (u - prior * p) * steep
        slope = toward_negative - prior * p * steep if bracket >= 0 else -toward_negative
        grad = np.append(x.back(slope), slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], max(bias - move[-1], LEAST_BIAS)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * pull, 0)
    return weights, bias


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    rows, prior = sample(docs, labels)
    try:
        return fit(*sample_features(rows), prior)
    finally:
        give_back()


def scores_of(batch: pa.RecordBatch, table: np.ndarray, bias: float) -> np.ndarray:
    out = [np.zeros(0)]
    for a, z, data, offsets in wordbytes.parts(batch):
        row, feature = features(data, offsets)
        out.append(sigmoid(np.bincount(row, table[feature], z - a) + bias))
    return np.concatenate(out)


def dense(used: np.ndarray, weights: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    table[used] = weights
    return table


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    used, weights, bias = model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((used, weights))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores_of(batch, table, bias))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they came."""
    used, weights, bias = model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((used, weights))

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch, table, bias) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
