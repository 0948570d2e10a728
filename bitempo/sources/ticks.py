"""Ticks: trade messages, polled quotes and the subscription filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_symbol, order_key
from ..schema import TRADE_MESSAGE


def parse_trades(messages: DataFrame, column: str = "value", source: str = "trades") -> DataFrame:
    """One tick per element of a trade message's ``data``; other message types are skipped."""
    parsed = messages.select(F.from_json(F.col(column), TRADE_MESSAGE).alias("m"))
    trades = parsed.filter(F.col("m.type") == "trade").select(F.explode("m.data").alias("d"))
    return trades.select(
        F.col("d.s").alias("ticker"),
        F.col("d.p").alias("price"),
        F.col("d.v").alias("volume"),
        F.timestamp_millis(F.col("d.t")).alias("timestamp"),
        F.lit(source).alias("source"),
    )


def subscriptions(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Distinct cleaned symbols of ``added`` without those of ``removed`` (column ``ticker``)."""

    def cleaned(df: DataFrame) -> DataFrame:
        symbols = df.select(clean_symbol(F.col("ticker")).alias("ticker"))
        return symbols.filter(F.col("ticker").isNotNull()).distinct()

    wanted = cleaned(added)
    return wanted if removed is None else wanted.join(cleaned(removed), "ticker", "left_anti")


def subscribed_ticks(
    ticks: DataFrame, added: DataFrame, removed: DataFrame | None = None
) -> DataFrame:
    """Ticks of subscribed symbols.

    No broadcast hint: the list may be any size, so Spark picks the join from its statistics and
    AQE splits a skewed ticker if the join is shuffled.
    """
    return ticks.join(subscriptions(added, removed), "ticker", "left_semi")


def latest_quote_per_ticker(quotes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Last quote of each ticker with the quote's own time, and how many there were."""
    key = order_key(quotes, order)
    return quotes.groupBy("ticker").agg(
        *(F.max_by(c, key).alias(c) for c in ("price", "volume", "timestamp")),
        F.count(F.lit(1)).alias("tick_count"),
    )


def one_quote_per_minute(quotes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Keep the last poll of each (ticker, minute).

    A polled quote repeats the running volume of its minute; summing every poll into a bar would
    count that volume several times.
    """
    key = order_key(quotes, order)
    minute = F.window("timestamp", "1 minute")["start"].alias("minute")
    return quotes.groupBy("ticker", minute).agg(
        *(F.max_by(c, key).alias(c) for c in ("price", "volume", "timestamp"))
    )
