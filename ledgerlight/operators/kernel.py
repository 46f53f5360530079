"""One-class kernel score: distance from a segment's mean in feature space.

Random Fourier features (Rahimi and Recht 2007) turn the RBF kernel into an
inner product, so the score against all training rows is one product with
their mean: the limit of a one-class machine in which every row supports
(Schoelkopf et al. 2001). Fitting is one grouped mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach
from .reconstruct import _dot, standardize
from .segments import SEGMENT_FEATURES

WAVES = 128
SEED = 42


def kernel_one_class(
    df: DataFrame,
    key: str = "segment_id",
    features: Sequence[str] = SEGMENT_FEATURES,
    gamma: float | None = None,
    waves: int = WAVES,
) -> DataFrame:
    """Add ``svm_score``, larger for rows unlike the segment's training rows.

    Needs ``is_train``. ``gamma`` defaults to one over the number of features,
    which is the usual scale for standardised columns. ``df`` is read twice.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    width = gamma if gamma is not None else 1.0 / len(features)
    rng = np.random.default_rng(SEED)
    frequency = rng.normal(0.0, np.sqrt(2 * width), (len(features), waves))
    phase = rng.uniform(0, 2 * np.pi, waves)

    @F.pandas_udf("array<double>")
    def wave_features(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) @ frequency + phase
        return pd.Series(list(np.sqrt(2.0 / waves) * np.cos(m)))

    scaled = standardize(df, features, [key], fit_rows=F.col("is_train") == 1)
    names = [f"{c}_scaled" for c in features]
    mapped = scaled.withColumn("_phi", wave_features(F.array(*names))).drop(*names)
    train = mapped.where(F.col("is_train") == 1)
    centre = train.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector("_phi"))).alias("_centre"))
    return attach(mapped, centre, [key]).withColumn("svm_score", -_dot(F.col("_phi"), F.col("_centre"))).drop("_phi", "_centre")
