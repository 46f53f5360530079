"""The recurrent autoencoder: gradients, partitions, plain loops, and what it sees that a linear one does not."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.operators import autoencoder as ae

RNG = np.random.default_rng(11)


def test_gradients_match_finite_differences():
    for length, features, hidden in ((4, 1, 3), (3, 2, 2)):
        x, weight = RNG.normal(size=(5, length, features)), RNG.uniform(0.5, 3, 5)
        theta = ae.first_weights(features, hidden) * 2
        _, gradient = ae.errors(theta, x, hidden, weight)
        loss = lambda t: float(ae.errors(t, x, hidden)[0] @ weight)
        for i in range(len(theta)):
            up, down = theta.copy(), theta.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - gradient[i]) < 1e-6


def plain_fit(x, hidden, rounds, rate=ae.RATE):
    theta = ae.first_weights(x.shape[2], hidden)
    first = second = np.zeros(len(theta))
    for turn in range(1, rounds + 1):
        _, gradient = ae.errors(theta, x, hidden, np.ones(len(x)))
        theta, first, second = ae.adam(theta, first, second, gradient / len(x), turn, rate)
    return theta


def test_fit_is_the_same_on_any_partitions(spark, monkeypatch):
    """Groups of very different sizes, a third of all windows equal; blocks of a few windows."""
    monkeypatch.setattr(ae, "BLOCK", 16)
    x = RNG.normal(size=(90, 4))
    x[:30] = x[0]
    rows = [("a" if i < 80 else "b", v.tolist()) for i, v in enumerate(x)]
    windows = spark.createDataFrame([*rows, ("a", None)], "g string, window array<double>")
    found = []
    for parts in (1, 8):
        blocks = ae.packed_windows(windows.repartition(parts), "g", "window")
        found.append({r.g: (bytes(r.theta), r.loss) for r in ae.fit(blocks.repartition(parts), "g", 4, 1, hidden=3, rounds=3).collect()})
    assert found[0] == found[1]
    for g, part in (("a", x[:80]), ("b", x[80:])):
        np.testing.assert_allclose(np.frombuffer(found[0][g][0]), plain_fit(part[:, :, None], 3, 3), atol=1e-5)


def test_recurrent_model_beats_directions_on_a_curve():
    """Windows on a circle of phases and steepnesses bend through many dimensions: two directions miss them, a code does not."""
    phase, steep = RNG.uniform(0, 2 * np.pi, 400), RNG.uniform(1.0, 4.0, 400)
    x = np.tanh(steep[:, None] * np.sin(phase[:, None] + np.linspace(0, 2 * np.pi, 7)))
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    linear = ((centred - centred @ axes[:2].T @ axes[:2]) ** 2).mean()
    theta = plain_fit(x[:, :, None], 16, 900, 0.01)
    assert ae.errors(theta, x[:, :, None], 16)[0].mean() < linear


def test_detector_flags_a_broken_week(spark, series, day):
    x = [100 + 30 * np.sin(i * 2 * np.pi / 7) + RNG.normal(0, 1) for i in range(80)]
    x[50] += 300
    rows = ae.sequence_autoencoder(series({"a": x, "b": [5.0] * 6}), hidden=4, rounds=4).collect()
    flagged = {(r.service_category, r.date) for r in rows if r.lstm_flag}
    assert flagged and flagged <= {("a", day(i)) for i in range(50, 57)}
    assert len(rows) == 86 and all(r.lstm_error == 0 and r.lstm_flag == 0 for r in rows if r.service_category == "b" or r.date < day(6))


def test_multi_column_scores(spark, day):
    schema = "segment_id string, date date, cost_usd double, rolling_mean_7 double, rolling_std_7 double, pct_change_1d double, is_train int"
    rows = [("s", day(i), *RNG.normal(size=4).tolist(), int(i < 40)) for i in range(60)]
    got = ae.sequence_autoencoder_multi(spark.createDataFrame(rows, schema), hidden=3, rounds=2)
    assert got.count() == 26 + 6 and got.where(F.col("lstm_score").isNull()).isEmpty()
