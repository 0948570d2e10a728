"""Labels, training matrices, time-ordered splits and the model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ratio_change
from ..plans.asof import own_states
from ..plans.hot import HotEntities, own_rows, resolve_hot, split_rows
from ..plans.ordered import time_quantile
from ..schema import FEATURE_NAMES, VARIANTS
from ..session import stage
from .features import feature_table
from .pit import pit_join

TRAIN_FRACTION = 0.7


def _next_close() -> Column:
    return F.lead("close", 1).over(Window.partitionBy("ticker", "_chunk").orderBy("date"))


def _label() -> Column:
    return (_next_close() > F.col("close")).cast("int")


def _next_return() -> Column:
    return ratio_change(_next_close(), F.col("close"))


def _by_day(bars: DataFrame, column: Column, name: str, hot) -> DataFrame:
    inputs = bars.select("ticker", "date", "close")
    hot = resolve_hot(hot, inputs, "ticker", "date")
    split = split_rows(inputs, "ticker", "date", hot, after=1)
    computed = split.select("ticker", "date", column.alias(name), "_own")
    return own_rows(computed).filter(F.col(name).isNotNull()).select(
        F.col("ticker").alias("entity_id"), F.col("date").alias("request_time"), name
    )


def build_labels(bars: DataFrame, hot: HotEntities | str | None = "auto") -> DataFrame:
    """1 if the next bar closes higher; the last bar of a ticker has no label."""
    return _by_day(bars, _label(), "label", hot)


def realized_returns(bars: DataFrame, hot: HotEntities | str | None = "auto") -> DataFrame:
    """Return from this close to the next, where there is a next."""
    return _by_day(bars, _next_return(), "ret", hot)


def training_matrix(
    labels: DataFrame,
    store: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    hot: HotEntities | str | None = "auto",
) -> DataFrame:
    """Labels with the features knowable at their time; only complete rows.

    The label travels through the point-in-time pass, so there is no join back to the labels.
    """
    matrix = pit_join(labels, store, features, keep=["label"], hot=hot)
    return matrix.dropna(subset=list(features))


def aligned_matrix(
    bars: DataFrame, hot: HotEntities | str | None = "auto"
) -> DataFrame:
    """Both variants' features on their common rows: ``feature__variant``, label and next return.

    Labels, returns and both feature sets come from one windowed pass over the bars, and both
    variants share one point-in-time pass. Rows complete in both variants are exactly the keys the
    two separate matrices have in common, so alignment needs no join.
    """
    names = [f"{f}__{v}" for v in VARIANTS for f in FEATURE_NAMES]
    hot = resolve_hot(hot, bars, "ticker", "date")
    table = feature_table(bars, VARIANTS, {"label": _label(), "ret": _next_return()}, hot)
    states = own_states(
        table, names, keep=["label", "ret"], where=F.col("label").isNotNull(), hot=hot
    )
    return states.select(
        "entity_id", "request_time", "label", "ret", *(F.col(c)["value"].alias(c) for c in names)
    ).dropna(subset=names)


def aligned_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (entity, time) keys that two separately built matrices share."""
    key = ["entity_id", "request_time"]
    return left.select(*key).join(right.select(*key), key, "left_semi").distinct()


def pick_variant(aligned: DataFrame, variant: str) -> DataFrame:
    """One variant of an aligned matrix under the plain feature names."""
    return aligned.select(
        "entity_id", "request_time", "label", "ret",
        *(F.col(f"{f}__{variant}").alias(f) for f in FEATURE_NAMES),
    )


def split_cut(matrix: DataFrame, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Exact time quantile of the rows: one row ``cut, n``."""
    return time_quantile(matrix, "request_time", fraction)


def time_split(
    matrix: DataFrame, fraction: float = TRAIN_FRACTION, cut: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Earliest rows (``<= cut``) to train on, latest to test.

    Without a given cut it is found now, once, and written as one row that both parts refer to.
    """
    at = stage(split_cut(matrix, fraction), "cut").select("cut").scalar() if cut is None else cut
    return (
        matrix.filter(F.col("request_time") <= at),
        matrix.filter(F.col("request_time") > at),
    )


def standardize_stats(
    train: DataFrame, features: Sequence[str] = FEATURE_NAMES
) -> DataFrame:
    """Mean and population standard deviation per feature, one row each."""
    stats = train.agg(
        *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)),
        *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)),
        F.count(F.lit(1)).alias("n"),
    )
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature_name"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("sd"),
                F.col("n"),
            )
            for i, f in enumerate(features)
        )
    )
    return stats.select(F.inline(each))


@dataclass(frozen=True)
class Scorer:
    """A fitted model with the scaling of its training rows."""

    model: LogisticRegressionModel
    scale: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``p_up``, NULL for rows with an absent feature."""
        complete = F.lit(True)
        for f in self.scale:
            complete = complete & F.col(f).isNotNull()
        # Incomplete rows pass through with zeros and lose their result again: one plan, no union.
        scaled = _assemble(df.withColumn("_complete", complete), self.scale)
        scored = self.model.transform(scaled)
        p = vector_to_array("_probability")[1]
        return scored.withColumn("p_up", F.when(F.col("_complete"), p)).select(*df.columns, "p_up")


@dataclass(frozen=True)
class FixedScorer:
    """Given coefficients on unscaled features, in plain column arithmetic."""

    weights: dict[str, float]
    intercept: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``p_up``, NULL for rows with an absent feature."""
        z = F.lit(self.intercept)
        for f, w in self.weights.items():
            z = z + F.lit(w) * F.col(f)
        return df.withColumn("p_up", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def penalised_gradient(train: DataFrame, scorer: Scorer, label: str = "label") -> DataFrame:
    """Slope of the penalised loss at the fitted weights, one row per weight: zeros at the optimum."""
    weights = dict(zip(scorer.scale, scorer.model.coefficients.toArray().tolist()))
    error = F.col("p_up") - F.col(label)
    scored = scorer.transform(train)
    slopes = {"intercept": F.avg(error)}
    for f, (mean, sd) in scorer.scale.items():
        z = (F.col(f) - F.lit(mean)) / F.lit(sd or 1.0)
        slopes[f] = F.avg(error * z) + F.lit(weights[f]) / F.count(F.lit(1))
    return scored.agg(*(c.alias(n) for n, c in slopes.items())).unpivot([], list(slopes), "weight", "slope")


def _assemble(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    z = [f"_z{i}" for i in range(len(scale))]
    scaled = df.select(
        "*",
        *(
            F.coalesce((F.col(f) - F.lit(mean)) / F.lit(sd or 1.0), F.lit(0.0)).alias(z[i])
            for i, (f, (mean, sd)) in enumerate(scale.items())
        ),
    )
    return VectorAssembler(inputCols=z, outputCol="_z").transform(scaled).drop(*z)


def fit_logistic(
    train: DataFrame, features: Sequence[str] = FEATURE_NAMES, label: str = "label"
) -> Scorer:
    """Standardise on the training rows, then L2-penalised logistic regression (C = 1).

    Spark averages the loss over rows, so the penalty weight is 1 / rows. Only the four means and
    deviations reach the driver.
    """
    stats = {r["feature_name"]: r for r in standardize_stats(train, features).collect()}
    rows = stats[features[0]]["n"]
    if not rows:
        raise ValueError("no training rows")
    scale = {f: (stats[f]["mean"], stats[f]["sd"]) for f in features}
    learner = LogisticRegression(
        featuresCol="_z", labelCol=label, probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction",
        regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
        maxIter=1000, tol=1e-8,
    )
    return Scorer(learner.fit(_assemble(train.select(*features, label), scale)), scale)
