"""The one-class machine against a dense solve, finite differences and its own properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import one_class as oc

NAMES = ["a", "b"]


def exact_objective(w, rho, phi, nu):
    return 0.5 * w @ w - rho + np.maximum(rho - phi @ w, 0).mean() / nu


def dense_solve(phi, nu, rounds=60_000):
    """The dual by pairwise steps: least |sum a_i phi_i|^2 / 2 with sum a = 1, 0 <= a <= 1 / (nu n). Its value is minus the primal's."""
    n = len(phi)
    top = 1 / (nu * n)
    a = np.full(n, 1 / n)
    k = phi @ phi.T
    g = k @ a
    for _ in range(rounds):
        i = np.where(a < top - 1e-15, g, np.inf).argmin()
        j = np.where(a > 1e-15, g, -np.inf).argmax()
        if g[j] - g[i] < 1e-8:
            break
        step = min((g[j] - g[i]) / (k[i, i] + k[j, j] - 2 * k[i, j] + 1e-15), top - a[i], a[j])
        a[i], a[j] = a[i] + step, a[j] - step
        g += step * (k[:, i] - k[:, j])
    return -0.5 * a @ k @ a


def frame(spark, n=400):
    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.normal(size=2) * (1 + k) + (6 if i % 40 == 39 else 0)), int(i < n * 0.8)) for k, s in enumerate(("p", "q")) for i in range(n)]
    rows += [("no training", 0, 1.0, 1.0, 0), ("p", n, None, 1.0, 1), (None, 1, 0.5, 0.5, 0)]
    return spark.createDataFrame(rows, "segment_id string, i int, a double, b double, is_train int")


def test_slopes_match_finite_differences():
    rng = np.random.default_rng(1)
    phi, n, theta = rng.normal(size=(50, 4)), rng.integers(1, 4, 50).astype(float), rng.normal(size=5)
    at = 1 + len(oc.STEPS)
    of = lambda t: oc.loss_sums(t, np.zeros(5), phi, n, 0.3) / oc.UNIT
    got = of(theta)
    for i in range(5):
        e = np.zeros(5)
        e[i] = 1e-3
        up, down = of(theta + e), of(theta - e)
        assert (up[1] - down[1]) / 2e-3 == pytest.approx(got[at + i], abs=0.05)


def test_optimum_share_of_outliers_and_partitions(spark):
    rows = frame(spark)
    nu = 0.1
    out = oc.one_class_machine(rows, features=NAMES, nu=nu).cache()
    scaled = oc.standardize(rows, NAMES, ["segment_id"], fit_rows=F.col("is_train") == 1)
    packed = scaled.where("is_train = 1").withColumn("x", F.when(F.col("a").isNotNull(), F.array("a_scaled", "b_scaled"))).where("x IS NOT NULL")
    models = {r.segment_id: np.frombuffer(r.theta) for r in oc.fit(oc.packed_windows(packed, "segment_id", "x"), "segment_id", 2, nu, 0.5).collect()}
    assert set(models) == {"p", "q"}
    for s, theta in models.items():
        phi = oc.cosine_features(np.array([r.x for r in packed.where(F.col("segment_id") == s).collect()]), oc.WAVES, 0.5)
        assert exact_objective(theta[:-1], theta[-1], phi, nu) == pytest.approx(dense_solve(phi, nu), abs=1e-3)
    shares = {r.segment_id: r.share for r in out.where("is_train = 1 AND a IS NOT NULL").groupBy("segment_id").agg(F.avg("svm_flag").alias("share")).collect()}
    assert all(0.5 * nu < share <= nu for share in shares.values())
    far = out.where("is_train = 0 AND i % 40 = 39").agg(F.avg("svm_flag")).first()[0]
    assert far > 0.8
    assert out.count() == rows.count() and out.where("svm_score IS NULL").count() == 3
    again = oc.one_class_machine(rows.repartition(5), features=NAMES, nu=nu)
    key = lambda r: (str(r.segment_id), r.i, r.svm_score)
    assert [key(r)[2] for r in sorted(again.collect(), key=lambda r: key(r)[:2])] == pytest.approx([key(r)[2] for r in sorted(out.collect(), key=lambda r: key(r)[:2])], abs=1e-6)


def test_empty_frame(spark):
    assert oc.one_class_machine(frame(spark).limit(0), features=NAMES).count() == 0
