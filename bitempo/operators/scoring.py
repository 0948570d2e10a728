"""Batch scoring of current or as-of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import scaled_to_band, signal
from ..schema import FEATURE_NAMES
from .training import FixedScorer, Scorer

# Display range of each feature.
BANDS = {
    "rolling_5d_volatility": (0.0, 0.05),
    "rolling_20d_return": (-0.15, 0.15),
    "volume_zscore": (-3.0, 3.0),
    "price_momentum_10d": (-0.15, 0.15),
}
PROBABILITY_DIGITS = 4


def score(vectors: DataFrame, scorer: Scorer | FixedScorer, path: str) -> DataFrame:
    """Score wide vectors. Rows with an absent feature get no score and say so in ``status``."""
    scored = scorer.transform(vectors)
    p = F.bround("p_up", PROBABILITY_DIGITS)
    return scored.select(
        "entity_id",
        F.lit(path).alias("path"),
        F.when(F.col("p_up").isNotNull(), F.lit("ok"))
        .otherwise(F.lit(f"incomplete {path} features")).alias("status"),
        p.alias("p_up"),
        signal(F.col("p_up")).alias("signal"),
        *FEATURE_NAMES,
        *(scaled_to_band(F.col(f), *BANDS[f]).alias(f"{f}_band") for f in FEATURE_NAMES),
    )
