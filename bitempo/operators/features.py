"""Windowed features, in a causal and a deliberately leaky variant.

``correct`` uses first prints and trailing frames only. ``leaked`` has three leaks: the final close,
frames that reach one or two bars ahead, and whole-sample volume statistics. Both call the event day
the knowledge day. Frames are row frames: gaps between trading days do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import change, ratio_change
from ..plans.hot import HotEntities, is_split, own_rows, resolve_hot, running_moments, split_rows
from ..schema import FEATURE_COLUMNS, FEATURE_NAMES, VARIANTS

# Frame lengths of the four features and of the live buffer.
VOLATILITY_BARS = 5
RETURN_BARS = 20
MOMENTUM_BARS = 10
ZSCORE_MIN_BARS = 20
LIVE_BUFFER_BARS = 50
LIVE_MIN_BARS = 21
BLOCK_BARS = 10  # the buffer is a whole number of these
RETURN_LOOKAHEAD = 2
MOMENTUM_LOOKAHEAD = 1


def _volatility(log_return: str, frame) -> Column:
    enough = F.count(log_return).over(frame) >= VOLATILITY_BARS
    return F.when(enough, F.stddev_samp(log_return).over(frame))


def _zscore_running(w) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, mean, sd = running_moments("_volume", so_far)
    return F.when(n >= ZSCORE_MIN_BARS, F.try_divide(F.col("_volume") - mean, sd))


def _zscore_whole_sample() -> Column:
    whole = Window.partitionBy("ticker", "_chunk")
    v = F.col("_volume")
    mean = F.when(is_split(), F.col("_all_mean")).otherwise(F.avg(v).over(whole))
    sd = F.when(is_split(), F.col("_all_sd")).otherwise(F.stddev_samp(v).over(whole))
    return F.try_divide(v - mean, sd)


def _variant_columns(mode: str, w, close: str, log_return: str) -> dict[str, Column]:
    c = F.col(close)

    def back(n: int) -> Column:
        return F.lag(close, n).over(w)

    def ahead(n: int) -> Column:
        return F.lead(close, n).over(w)

    if mode == "correct":
        return {
            "rolling_5d_volatility": _volatility(
                log_return, w.rowsBetween(1 - VOLATILITY_BARS, Window.currentRow)
            ),
            "rolling_20d_return": ratio_change(c, back(RETURN_BARS)),
            "volume_zscore": _zscore_running(w),
            "price_momentum_10d": ratio_change(c, back(MOMENTUM_BARS)),
        }
    half = VOLATILITY_BARS // 2
    return {
        "rolling_5d_volatility": _volatility(log_return, w.rowsBetween(-half, half)),
        "rolling_20d_return": ratio_change(
            ahead(RETURN_LOOKAHEAD), back(RETURN_BARS - RETURN_LOOKAHEAD)
        ),
        "volume_zscore": _zscore_whole_sample(),
        "price_momentum_10d": ratio_change(
            ahead(MOMENTUM_LOOKAHEAD), back(MOMENTUM_BARS - MOMENTUM_LOOKAHEAD)
        ),
    }


def feature_table(
    bars: DataFrame,
    modes: Sequence[str] = VARIANTS,
    payload: dict[str, Column] | None = None,
    hot: HotEntities | str | None = "auto",
    knowledge: str = "date",
) -> DataFrame:
    """Features of one or both variants side by side, one row per bar.

    Columns: ``entity_id, event_timestamp, knowledge_timestamp`` and per mode ``feature__mode``.
    All windows share one partitioning, so the bars are shuffled and sorted once for everything.
    ``bars`` holds one row per (ticker, date). ``knowledge`` names the column that says when a row
    could be known; a value is never known before its event. ``payload`` adds columns computed over
    ``Window.partitionBy("ticker", "_chunk").orderBy("date")`` reaching at most two bars ahead.
    """
    unknown = set(modes) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown variants {sorted(unknown)}")
    closes = {"correct": "first_print_close", "leaked": "close"}
    inputs = bars.select(
        "ticker", "date", F.col(knowledge).alias("_known"),
        *(F.col(closes[m]).cast("double").alias(f"_close_{m}") for m in modes),
        F.col("volume").cast("double").alias("_volume"),
        *([F.col("close")] if payload else []),
    )
    hot = resolve_hot(hot, inputs, "ticker", "date")
    split = split_rows(
        inputs, "ticker", "date", hot,
        before=RETURN_BARS, after=RETURN_LOOKAHEAD, moments_of="_volume",
    )
    w = Window.partitionBy("ticker", "_chunk").orderBy("date")
    with_returns = split.select(
        "*",
        *(
            (F.ln(f"_close_{m}") - F.lag(F.ln(f"_close_{m}"), 1).over(w)).alias(f"_lr_{m}")
            for m in modes
        ),
    )
    computed = with_returns.select(
        F.col("ticker").alias("entity_id"),
        F.col("date").alias("event_timestamp"),
        F.greatest("date", "_known").alias("knowledge_timestamp"),
        *(
            column.alias(f"{name}__{m}")
            for m in modes
            for name, column in _variant_columns(m, w, f"_close_{m}", f"_lr_{m}").items()
        ),
        *(column.alias(name) for name, column in (payload or {}).items()),
        "_own",
    )
    return own_rows(computed).drop("_own")


def wide_features(
    bars: DataFrame, mode: str = "correct", hot: HotEntities | str | None = "auto"
) -> DataFrame:
    """One row per bar with the four features of one variant under their plain names."""
    table = feature_table(bars, (mode,), hot=hot)
    return table.select(
        "entity_id", "event_timestamp", "knowledge_timestamp",
        *(F.col(f"{f}__{mode}").alias(f) for f in FEATURE_NAMES),
    )


def to_long(wide: DataFrame, features: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Canonical long rows; absent values give no row.

    Each row emits its values as an array: unlike ``unpivot`` this keeps the rows' partitioning, so what is
    grouped by entity afterwards does not move again.
    """
    ids = ["entity_id", "event_timestamp", "knowledge_timestamp"]
    each = F.array(*(F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("value")) for f in features))
    melted = wide.select(*ids, F.inline(each))
    return melted.filter(F.col("value").isNotNull()).select(*FEATURE_COLUMNS)


def compute_features(
    bars: DataFrame, mode: str = "correct", hot: HotEntities | str | None = "auto"
) -> DataFrame:
    """Long feature table of one variant."""
    return to_long(wide_features(bars, mode, hot))


def to_wide(long: DataFrame, index: Sequence[str]) -> DataFrame:
    """Pivot long values to one column per feature, in one aggregate.

    The rows of one index meet before the shuffle; ``pivot`` would move every long row first.
    """
    def value(feature: str) -> Column:
        own = F.when(F.col("feature_name") == feature, F.col("value"))
        return F.first(own, ignorenulls=True).alias(feature)

    return long.groupBy(*index).agg(*(value(f) for f in FEATURE_NAMES))


def _block_moments(value: str, w) -> dict[str, Column]:
    """Sums of the last ``BLOCK_BARS`` rows, from which ``_with_buffer_moments`` adds up a buffer."""
    block = w.rowsBetween(1 - BLOCK_BARS, Window.currentRow)
    n = F.count(value).over(block)
    return {
        "_n": n, "_sum": F.sum(value).over(block), "_m2": F.var_pop(value).over(block) * n,
        "_low": F.min(value).over(block), "_high": F.max(value).over(block),
    }


def _with_buffer_moments(rows: DataFrame, w) -> DataFrame:
    """Add ``_mean`` and ``_spread`` (sample deviation) of the buffer, from one block in every ``BLOCK_BARS`` rows.

    A frame as long as the buffer would be summed again for every row. Equal values deviate by exactly zero.
    """
    names, places = ("_n", "_sum", "_m2", "_low", "_high"), range(LIVE_BUFFER_BARS // BLOCK_BARS)

    def block(name: str, k: int) -> str:
        return f"{name}{k}" if k else name

    def total(of: Callable[[int], Column]) -> Column:
        return reduce(add, (F.coalesce(of(k), F.lit(0.0)) for k in places))

    blocks = rows.select(
        "*", *(F.lag(c, k * BLOCK_BARS).over(w).alias(block(c, k)) for k in places if k for c in names))
    n = total(lambda k: F.col(block("_n", k)).cast("double")).alias("_all_n")
    low, high = F.least(*(block("_low", k) for k in places)), F.greatest(*(block("_high", k) for k in places))
    sums = blocks.select("*", n, total(lambda k: F.col(block("_sum", k))).alias("_all_sum"),
                         ((low == high) & ~F.isnan(low)).alias("_equal"))
    means = sums.withColumn("_mean", F.try_divide("_all_sum", "_all_n"))

    def around_mean(k: int) -> Column:
        away = F.try_divide(block("_sum", k), block("_n", k)) - F.col("_mean")
        return F.col(block("_m2", k)) + F.col(block("_n", k)) * away * away

    spread = F.when(F.col("_equal"), F.lit(0.0)).otherwise(F.sqrt(total(around_mean) / (F.col("_all_n") - 1)))
    return means.withColumn("_spread", F.when(F.col("_all_n") > 1, spread))


def live_features(
    bars: DataFrame,
    close: str = "close",
    time: str = "date",
    hot: HotEntities | str | None = "auto",
) -> DataFrame:
    """Features over a buffer of the last 50 bars, as a live process would hold them.

    A row appears from bar 21 on, and only if all four values exist. The z-score is over the
    buffer, unlike the expanding one of ``compute_features``.
    """
    inputs = bars.select(
        "ticker", F.col(time).alias("_time"), F.col(close).cast("double").alias("_close"),
        F.col("volume").cast("double").alias("_volume"),
    )
    hot = resolve_hot(hot, inputs, "ticker", "_time")
    split = split_rows(inputs, "ticker", "_time", hot, before=LIVE_BUFFER_BARS - 1)
    w = Window.partitionBy("ticker", "_chunk").orderBy("_time")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_returns = split.select(
        "*", (F.ln("_close") - F.lag(F.ln("_close"), 1).over(w)).alias("_lr"),
        *(c.alias(name) for name, c in _block_moments("_volume", w).items()),
    )
    computed = _with_buffer_moments(with_returns, w).select(
        F.col("ticker").alias("entity_id"),
        F.col("_time").alias("event_timestamp"),
        _volatility("_lr", w.rowsBetween(1 - VOLATILITY_BARS, 0)).alias("rolling_5d_volatility"),
        change(F.col("_close"), F.lag("_close", RETURN_BARS).over(w)).alias("rolling_20d_return"),
        F.when(F.col("_spread") > 0, (F.col("_volume") - F.col("_mean")) / F.col("_spread")).alias("volume_zscore"),
        change(F.col("_close"), F.lag("_close", MOMENTUM_BARS).over(w)).alias(
            "price_momentum_10d"
        ),
        F.count(F.lit(1)).over(so_far).alias("_bars"),
        "_own",
    )
    return (
        own_rows(computed)
        .filter(F.col("_bars") >= LIVE_MIN_BARS)
        .dropna(subset=list(FEATURE_NAMES))
        .drop("_own", "_bars")
    )


def seed_history(
    bars: DataFrame, close: str = "first_print_close", n: int = LIVE_BUFFER_BARS
) -> DataFrame:
    """The last ``n`` bars of each ticker, to fill the live buffers before the first tick.

    Spark cuts each group to ``n`` rows before the shuffle, so ticker size does not matter.
    """
    latest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    ranked = bars.select(
        "ticker", "date", F.col(close).cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
        F.row_number().over(latest).alias("bars_back"),
    )
    return ranked.filter(F.col("bars_back") <= n)
