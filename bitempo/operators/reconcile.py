"""Offline reads against online reads at check points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import MATCH_TOLERANCE, values_match
from ..plans.asof import facts_in_orders, states_at
from ..plans.hot import HotEntities, resolve_hot, split_rows
from ..schema import FEATURE_NAMES


def check_points(
    bars: DataFrame,
    k: int,
    seed: int = 0,
    draw: Column | None = None,
    hot: HotEntities | str | None = "auto",
) -> DataFrame:
    """``k`` distinct dates per ticker from the later half of its history, drawn by a seeded hash.

    ``draw`` replaces the default hash as the drawing order (it must order dates totally).
    """
    hot = resolve_hot(hot, bars, "ticker", "date")
    split = split_rows(bars.select("ticker", "date"), "ticker", "date", hot)
    piece = Window.partitionBy("ticker", "_chunk")
    rank = F.coalesce("_rows_before", F.lit(0)) + F.row_number().over(piece.orderBy("date")) - 1
    placed = split.select(
        "ticker", "date", rank.alias("rank"),
        F.coalesce("_rows_total", F.count(F.lit(1)).over(piece)).alias("n"),
    )
    later = placed.filter(F.col("rank") >= F.floor(F.col("n") / 2))
    if draw is None:
        draw = F.xxhash64("ticker", "date", F.lit(seed))
    # The rank filter is applied per map task first, so at most k rows per ticker and task move.
    pick = F.row_number().over(Window.partitionBy("ticker").orderBy(draw, "date"))
    return (
        later.select("ticker", "date", pick.alias("pick"))
        .filter(F.col("pick") <= k)
        .select(F.col("ticker").alias("entity_id"), F.col("date").alias("request_time"))
    )


def reconcile(
    spine: DataFrame,
    correct: DataFrame,
    leaked: DataFrame,
    online_log: DataFrame,
    tol: float = MATCH_TOLERANCE,
    features: Sequence[str] = FEATURE_NAMES,
    hot: HotEntities | str | None = "auto",
    gather: bool = False,
) -> DataFrame:
    """Three reads per check point and feature, and whether they agree.

    All three stores go through one pass over the entity histories instead of three as-of joins
    and two equi joins. Check points with nothing knowable stay, with absent values. The stores may be
    long tables or wide ones.
    """
    sources = {
        "offline_correct": (correct, "event"),
        "offline_leaked": (leaked, "event"),
        "online": (online_log, "knowledge"),
    }
    # A store that serves several reads (the log, where it is the correct store itself) passes once.
    stores = {id(store): store for store, _ in sources.values()}
    parts = [
        facts_in_orders(store, features, {f"__{n}": o for n, (s, o) in sources.items() if s is store}, gather=gather)
        for store in stores.values()
    ]
    states = states_at(spine, parts, hot=hot, asked_only=True)
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature_name"),
                *(F.col(f"{f}__{name}")["value"].alias(name) for name in sources),
            )
            for f in features
        )
    )
    rows = states.select("entity_id", "request_time", F.inline(each))
    online = F.col("online")
    return rows.select(
        "*",
        values_match(F.col("offline_correct"), online, tol).alias("correct_matches_online"),
        values_match(F.col("offline_leaked"), online, tol).alias("leaked_matches_online"),
    )


def summarize(report: DataFrame) -> DataFrame:
    """One row: checks, comparable checks, match shares and the size of the leaked skew."""
    comparable = F.col("online").isNotNull()

    def share(flag: str) -> Column:
        return F.bround(F.avg(F.when(comparable, F.col(flag).cast("double"))), 6)

    skew = F.abs(F.col("offline_leaked") - F.col("online"))
    return report.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(comparable).alias("n_comparable"),
        share("correct_matches_online").alias("correct_matches_online_frac"),
        share("leaked_matches_online").alias("leaked_matches_online_frac"),
        F.bround(F.avg(skew), 6).alias("mean_abs_leaked_skew"),
        F.bround(F.max(skew), 6).alias("max_abs_leaked_skew"),
    )
