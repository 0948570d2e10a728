"""Two providers in one stream: pushed trades and polled quotes, each with its own watermark.

A trade that is delivered again (same id) within its watermark is dropped; a polled quote repeats the running volume
of its minute, so only the last poll of each (ticker, minute) counts. Both are state bounded by their watermarks.
What is left is one tick stream; a further stateful step in the same query closes its bars.

The query goes by the slower of the two watermarks (Spark's default policy), so a provider that
lags holds bars open and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import order_key
from ..operators.bars import build_bars

POLL = "1 minute"
TICK_FIELDS = ("ticker", "price", "volume", "timestamp", "tie", "source")
ORDER = ("timestamp", "tie")


def unique_trades(trades: DataFrame, delay: str, tie: str, source: str = "trades") -> DataFrame:
    """Trades without those delivered again: same ticker, time and id (batch or stream)."""
    timed = trades.filter(F.col("timestamp").isNotNull()).withColumn("tie", F.col(tie).cast("long"))
    key = ["ticker", "timestamp", "tie"]
    if trades.isStreaming:
        kept = timed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(key)
    else:
        kept = timed.dropDuplicates(key)
    return kept.withColumn("source", F.lit(source)).select(*TICK_FIELDS)


def last_polls(quotes: DataFrame, delay: str, tie: str, source: str = "quotes") -> DataFrame:
    """The last poll of each (ticker, minute), dated at the minute's last microsecond (batch or stream).

    The date is the event time that later windows of the same query take; polls without a time are skipped.
    """
    timed = quotes.filter(F.col("timestamp").isNotNull()).withColumn("tie", F.col(tie).cast("long"))
    key = order_key(timed, ("timestamp", "tie"))
    if quotes.isStreaming:
        timed = timed.withWatermark("timestamp", delay)
    polls = timed.groupBy("ticker", F.window("timestamp", POLL).alias("w")).agg(
        *(F.max_by(c, key).alias(c) for c in ("price", "volume", "tie")))
    return polls.withColumn("timestamp", F.window_time("w")).withColumn("source", F.lit(source)).select(*TICK_FIELDS)


def provider_bars(
    trades: DataFrame, quotes: DataFrame, interval: str, trade_delay: str, quote_delay: str, tie: str
) -> DataFrame:
    """Bars over the ticks of both providers: the same plan for tables and for streams.

    ``tie`` is an integer column of both inputs that identifies a delivery and orders those of one time.
    """
    ticks = unique_trades(trades, trade_delay, tie).unionByName(last_polls(quotes, quote_delay, tie))
    return build_bars(ticks, interval, ORDER)
