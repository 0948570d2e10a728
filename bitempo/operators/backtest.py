"""Evaluation of scored rows and the two-variant backtest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import TRADING_DAYS, position, trading_cost
from ..plans.hot import HotEntities, own_rows, resolve_hot, split_rows
from ..plans.ordered import rank_area
from ..schema import VARIANTS
from ..session import stage
from .training import (
    TRAIN_FRACTION, FixedScorer, Scorer, aligned_matrix, fit_logistic, pick_variant, split_cut, time_split,
)

SCORED = ("entity_id", "request_time", "label", "ret", "p_up")  # what evaluation reads
BACKTEST = T.StructType(
    [
        T.StructField("variant", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("split_date", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("strategy_sharpe", T.DoubleType()),
    ]
)


def with_positions(scored: DataFrame, hot: HotEntities | str | None = "auto") -> DataFrame:
    """Add ``pos`` and ``turnover`` (change of position in time order, first one in full)."""
    sized = scored.withColumn("pos", position(F.col("p_up")))
    hot = resolve_hot(hot, sized, "entity_id", "request_time")
    split = split_rows(sized, "entity_id", "request_time", hot, before=1)
    w = Window.partitionBy("entity_id", "_chunk").orderBy("request_time")
    held = F.coalesce(F.lag("pos", 1).over(w), F.lit(0.0))
    moved = split.withColumn("turnover", F.abs(F.col("pos") - held))
    return own_rows(moved).select(*sized.columns, "turnover")


def attach_returns(scored: DataFrame, returns: DataFrame) -> DataFrame:
    """Look up the realised return of each row; absent counts as zero."""
    joined = scored.join(returns, ["entity_id", "request_time"], "left")
    return joined.withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def strategy_pnl(scored: DataFrame, hot: HotEntities | str | None = "auto") -> DataFrame:
    """Positions, turnover, cost and net result of rows with ``p_up`` and ``ret``."""
    placed = with_positions(scored, hot)
    gross = F.col("pos") * F.coalesce("ret", F.lit(0.0))
    return placed.withColumn("cost", trading_cost(F.col("turnover"), F.col("pos"))).withColumn(
        "net", gross - F.col("cost")
    )


def pooled_sharpe(pnl: DataFrame) -> DataFrame:
    """Annualised mean over deviation of all (entity, day) results; zero without any spread."""
    sd = F.stddev_pop("net")
    ratio = F.try_divide(F.avg("net"), sd) * F.sqrt(F.lit(TRADING_DAYS))
    return pnl.agg(
        F.count(F.lit(1)).alias("n"), F.when(sd == 0, F.lit(0.0)).otherwise(ratio).alias("sharpe")
    )


def accuracy(scored: DataFrame) -> DataFrame:
    predicted = (F.col("p_up") > 0.5).cast("int")
    hit = (predicted == F.col("label")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def roc_auc(scored: DataFrame) -> float:
    """Exact area under the ROC curve, ties averaged; NaN unless both labels occur."""
    area = rank_area(scored, "p_up", "label").first()["area"]
    return float("nan") if area is None else area


def backtest(
    bars: DataFrame,
    fraction: float = TRAIN_FRACTION,
    hot: HotEntities | str | None = "auto",
    fit: Callable[[DataFrame], Scorer | FixedScorer] = fit_logistic,
) -> DataFrame:
    """Both variants on identical rows and one split: two result rows.

    The aligned matrix is written to the shared folder once, because fitting and evaluating pass
    over it many times.
    """
    spark = bars.sparkSession
    aligned = stage(aligned_matrix(bars, hot), "aligned")
    cut_row = split_cut(aligned, fraction).first()
    if cut_row is None or cut_row["cut"] is None:
        raise ValueError("no complete rows to split")
    cut = F.lit(cut_row["cut"].isoformat(sep=" ")).cast("timestamp_ntz")
    results = []
    for variant in VARIANTS:
        train, test = time_split(pick_variant(aligned, variant), cut=cut)
        scored = fit(train).transform(test).select(*SCORED)
        scored = stage(scored, f"scored-{variant}")
        sharpe = pooled_sharpe(strategy_pnl(scored, hot)).first()
        quality = accuracy(scored).first()
        results.append(
            (
                variant, cut_row["n"] - quality["n"], quality["n"],
                cut_row["cut"].date().isoformat(),
                round(quality["accuracy"], 4), round(roc_auc(scored), 4),
                round(sharpe["sharpe"], 3),
            )
        )
    return spark.createDataFrame(results, BACKTEST)


def phantom_edge(result: DataFrame) -> DataFrame:
    """How much better the leaky variant looks: one row."""

    def of(variant: str, name: str):
        return F.max(F.when(F.col("variant") == variant, F.col(name)))

    return result.agg(
        *(
            F.bround(of("leaked", m) - of("correct", m), 4).alias(m)
            for m in ("accuracy", "roc_auc")
        ),
        of("correct", "strategy_sharpe").alias("sharpe_correct"),
        of("leaked", "strategy_sharpe").alias("sharpe_leaked"),
    )


def metrics_report(consistency: DataFrame, result: DataFrame) -> DataFrame:
    """Consistency, backtest and phantom edge as JSON documents, one row per section."""
    sections = {
        "consistency": consistency, "backtest": result, "phantom_edge": phantom_edge(result),
    }
    report = None
    for name, df in sections.items():
        row = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))
        report = row if report is None else report.unionByName(row)
    return report
