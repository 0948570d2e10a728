"""Serving state derived from the versioned log.

The log is append-only and has the canonical feature columns. The current vector is the latest
entry by (knowledge, event), so rows that arrive late or twice never change it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import order_key
from ..plans.asof import facts_in_orders, states_at
from ..plans.hot import HotEntities
from ..schema import FEATURE_COLUMNS, FEATURE_NAMES
from .bars import build_bars
from .features import LIVE_BUFFER_BARS, LIVE_MIN_BARS
from .pit import pit_join

UPDATE_DIGITS = 6


def latest_values(log: DataFrame) -> DataFrame:
    """Current value of every (entity, feature), long form."""
    entry = F.struct("knowledge_timestamp", "event_timestamp", "value")
    latest = log.groupBy("entity_id", "feature_name").agg(F.max(entry).alias("e"))
    return latest.select(
        "entity_id", "feature_name", "e.value", "e.event_timestamp", "e.knowledge_timestamp"
    )


def latest_vectors(log: DataFrame, features: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Current vector of every entity in one aggregation; absent features are NULL."""
    entry = F.struct("knowledge_timestamp", "event_timestamp", "value")
    picks = [F.max(F.when(F.col("feature_name") == f, entry)).alias(f) for f in features]
    states = log.groupBy("entity_id").agg(*picks)
    return states.select("entity_id", *(F.col(f)["value"].alias(f) for f in features))


def online_asof(
    spine: DataFrame,
    log: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    hot: HotEntities | str | None = "auto",
    gather: bool = False,
) -> DataFrame:
    """What serving would have returned at each request: last known entry, not last event."""
    return pit_join(spine, log, features, order="knowledge", hot=hot, gather=gather)


def vector_to_log(vectors: DataFrame, knowledge: Column | None = None) -> DataFrame:
    """Wide vectors to log rows; absent values are not written."""
    ids = ["entity_id", "event_timestamp", "knowledge_timestamp"]
    known = F.col("knowledge_timestamp") if knowledge is None else knowledge
    stamped = vectors.withColumn("knowledge_timestamp", known)
    melted = stamped.select(*ids, *FEATURE_NAMES).unpivot(
        ids, list(FEATURE_NAMES), "feature_name", "value"
    )
    return melted.filter(F.col("value").isNotNull()).select(*FEATURE_COLUMNS)


def replay_counts(log: DataFrame) -> DataFrame:
    """Writes a replay performs, per feature."""
    return log.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("writes"),
        F.min("knowledge_timestamp").alias("first_knowledge"),
        F.max("knowledge_timestamp").alias("last_knowledge"),
    )


def order_divergence(
    spine: DataFrame,
    log: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    hot: HotEntities | str | None = "auto",
) -> DataFrame:
    """Per feature, how often "latest event" and "latest knowledge" reads differ.

    They differ when an old day is revised after a newer day became known. Both reads share one
    pass over the history.
    """
    facts = facts_in_orders(log, features, {f"__{o}": o for o in ("event", "knowledge")})
    states = states_at(spine, facts, hot=hot)
    pair = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature_name"),
                F.col(f"{f}__event")["value"].alias("by_event"),
                F.col(f"{f}__knowledge")["value"].alias("by_knowledge"),
            )
            for f in features
        )
    )
    rows = states.select(F.inline(pair)).filter(F.col("by_event").isNotNull())
    return rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("by_event") != F.col("by_knowledge")).alias("differing"),
    )


def ticker_status(
    ticks: DataFrame, interval: str, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Last tick, tick count, completed bars and readiness of each ticker.

    The bar of a ticker's last tick is still open: features see it once it is complete. Two nested aggregates (ticks to bars to tickers), both with map-side partials.
    """
    key = order_key(ticks, order)
    fields = ("price", "volume", "timestamp")
    bars = ticks.groupBy("ticker", F.window("timestamp", interval)).agg(
        *(F.max_by(c, key).alias(c) for c in fields),
        F.max(key).alias("key"), F.count(F.lit(1)).alias("ticks"),
    )
    bars_seen = F.least(F.lit(LIVE_BUFFER_BARS), F.count(F.lit(1)) - 1)
    return bars.groupBy("ticker").agg(
        F.max_by("price", "key").alias("last_price"),
        F.max_by("volume", "key").alias("last_volume"),
        F.max_by("timestamp", "key").alias("last_update"),
        F.sum("ticks").alias("tick_count"),
        bars_seen.alias("bars_accumulated"),
        (bars_seen >= LIVE_MIN_BARS).alias("features_ready"),
    )


def total_ticks(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("tickers"), F.sum("tick_count").alias("total_ticks")
    )


def update_events(vectors: DataFrame, time: str = "event_timestamp") -> DataFrame:
    """One JSON message per vector: ticker, rounded features, ISO time (of knowledge, where it has one)."""
    rounded = F.struct(*(F.bround(f, UPDATE_DIGITS).alias(f) for f in FEATURE_NAMES))
    message = F.struct(
        F.col("entity_id").alias("ticker"),
        rounded.alias("features"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    return vectors.select(F.col("entity_id").alias("ticker"), F.to_json(message).alias("value"))


def live_bars(
    ticks: DataFrame, interval: str, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Bars in the shape of the live bar table (nothing seeded)."""
    return build_bars(ticks, interval, order).withColumn("seed", F.lit(False))
