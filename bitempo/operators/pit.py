"""Point-in-time reads of a bitemporal feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.asof import any_known, facts_in_orders, guarded_value, states_at
from ..plans.hot import HotEntities
from ..schema import FEATURE_NAMES


def pit_join(
    spine: DataFrame,
    store: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    order: str = "event",
    keep: Sequence[str] = (),
    hot: HotEntities | str | None = "auto",
    entity: str = "entity_id",
    request: str = "request_time",
    asked_only: bool = False,
    gather: bool = False,
) -> DataFrame:
    """Feature vector of each request: per feature the latest fact knowable at that time.

    ``order="event"`` takes the greatest event time, then the greatest knowledge time (training
    reads); ``order="knowledge"`` the fact that became known last (what a serving log held).
    Requests with nothing knowable give no row; duplicate requests give one row unless ``keep``
    names spine columns to carry along. Values never expire. Facts without a knowledge time were never
    known; requests without entity or time give no row. ``store`` is the long table, or a wide one
    (recognised by its columns). Set ``asked_only`` where the spine names few of the store's entities, ``gather``
    where a long store is partitioned by entity or its rows move more than once.
    """
    states = _states(spine, store, features, order, keep, hot, entity, request, asked_only, gather)
    return _vectors(states, features, keep, entity, request)


def pit_join_long(
    spine: DataFrame,
    store: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    order: str = "event",
    hot: HotEntities | str | None = "auto",
    entity: str = "entity_id",
    request: str = "request_time",
    asked_only: bool = False,
    gather: bool = False,
) -> DataFrame:
    """As ``pit_join``, one row per (request, feature) with both timestamps of the fact."""
    states = _states(spine, store, features, order, (), hot, entity, request, asked_only, gather)
    times = ("event", "knowledge")
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature_name"),
                guarded_value(f, request).alias("value"),
                *(F.col(f)[k].alias(f"{k}_timestamp") for k in times),
            )
            for f in features
        )
    )
    rows = states.select(entity, request, F.inline(each))
    return rows.filter(F.col("knowledge_timestamp").isNotNull())


def _states(spine, store, features, order, keep, hot, entity, request, asked_only, gather) -> DataFrame:
    store = store if entity == "entity_id" else store.withColumnRenamed(entity, "entity_id")
    facts = facts_in_orders(store, features, {"": order}, gather=gather)
    return states_at(spine, facts, entity, request, keep, hot, asked_only)


def _vectors(states, features, keep, entity, request) -> DataFrame:
    return states.filter(any_known(features)).select(
        entity, request, *keep, *(guarded_value(f, request).alias(f) for f in features)
    )


def pit_single(store: DataFrame, entity_id: str, at: Column, order: str = "event") -> DataFrame:
    """One entity as of one time, long form. Both conditions reach the scan; no window needed."""
    first, second = (
        ("event_timestamp", "knowledge_timestamp")
        if order == "event"
        else ("knowledge_timestamp", "event_timestamp")
    )
    knowable = store.filter((F.col("entity_id") == entity_id) & (F.col("knowledge_timestamp") <= at))
    latest = F.max(F.struct(first, second, "value")).alias("s")
    return knowable.groupBy("entity_id", "feature_name").agg(latest).select(
        "entity_id", "feature_name", "s.value", "s.event_timestamp", "s.knowledge_timestamp"
    )


def leakage_audit(joined: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Rows checked and rows that use knowledge from after their request, per group.

    ``joined`` is any frame with ``request_time`` and ``knowledge_timestamp``: the point is to
    audit results that were not produced by ``pit_join``.
    """
    late = F.col("knowledge_timestamp") > F.col("request_time")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(late).alias("violations")
    )


def leaking_rows(joined: DataFrame) -> DataFrame:
    return joined.filter(F.col("knowledge_timestamp") > F.col("request_time"))


def assert_no_leak(joined: DataFrame) -> None:
    """Raise if any row of ``joined`` postdates its request (one aggregate job)."""
    total = leakage_audit(joined, by=()).first()
    if total["violations"]:
        raise AssertionError(f"{total['violations']} of {total['checked']} rows leak the future")

