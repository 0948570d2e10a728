"""Latest knowable state at a point in time, as one pass over an entity's history.

Stored facts and requests are put into one relation ordered by time, and each request reads a
running maximum. ``max`` of ``struct(event, knowledge, value)`` is the fact with the greatest event
time, then the greatest knowledge time; with the first two fields swapped it is the last one to
have become known. One shuffle by entity, no pair of (request, fact) is ever formed, so the cost is
linear in facts plus requests. (A join on ``knowledge <= request`` builds requests x history rows.)

Hot entities are cut into time buckets. Each bucket starts with a carry row that holds the maxima of
all earlier buckets, which is exact because ``max`` is associative.

Facts without a knowledge time were never known, requests without an entity or a time ask nothing:
both are left out before any plan, so every read agrees on them. Facts of entities nobody asks for, and
facts that became known after the last request, cannot answer anything and are left out as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import knowable_value
from ..session import stage
from .hot import HotEntities, hot_rows, in_tasks, resolve_hot, with_bucket

ORDERS = {"event": ("event", "knowledge"), "knowledge": ("knowledge", "event")}
_CARRY, _FACT, _REQUEST, _BOTH = 0, 1, 2, 3


def _fact(order: str, event: Column, knowledge: Column, value: Column) -> Column:
    times = {"event": event, "knowledge": knowledge}
    checked = knowable_value(value, event, knowledge)
    return F.struct(*(times[k].alias(k) for k in ORDERS[order]), checked.alias("value"))


def facts_in_orders(
    store: DataFrame, features: Sequence[str], orders: dict[str, str], entity: str = "entity_id",
    gather: bool = False,
) -> DataFrame:
    """Facts of a long or wide store with state columns for several orders (``suffix: order``).

    ``gather`` first brings the long rows of one (entity, event, knowledge) into one row: in place for a store
    partitioned by entity, else by a shuffle more. Of repeated facts the greatest value stays, as in the
    running maximum.
    """
    event, knowledge = F.col("event_timestamp"), F.col("knowledge_timestamp")
    rows = store.filter(knowledge.isNotNull() & F.col(entity).isNotNull())
    values = {f: F.col(f) for f in features}
    if "feature_name" in store.columns:
        present = {f: F.col("feature_name") == f for f in features}
        rows = rows.filter(F.col("feature_name").isin(list(features)))
        values = {f: F.col("value") for f in features}
        if gather:
            rows = rows.groupBy(entity, "event_timestamp", "knowledge_timestamp").agg(
                *(F.max(F.when(c, F.col("value"))).alias(f) for f, c in present.items()),
                # A stored NULL is a fact too.
                *(F.max(F.when(c, True)).alias(f"_has_{f}") for f, c in present.items()),
            )
            present = {f: F.col(f"_has_{f}") for f in features}
            values = {f: F.col(f) for f in features}
    else:
        present = {f: F.col(f).isNotNull() for f in features}
    return rows.select(
        F.col(entity).alias("_entity_key"),
        knowledge.alias("_t"),
        *(
            F.when(present[f], _fact(order, event, knowledge, values[f])).alias(f + suffix)
            for suffix, order in orders.items() for f in features
        ),
    )


def merge(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of relations with different columns; absent ones are NULL."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def _named(column: str, name: str) -> Column:
    """A column under a name; without an alias where it has that name (a union's rules trip over one)."""
    return F.col(column) if column == name else F.col(column).alias(name)


def state_columns(facts: DataFrame) -> list[str]:
    return [c for c in facts.columns if c not in ("_entity_key", "_t")]


def states_at(
    spine: DataFrame,
    facts: DataFrame | Sequence[DataFrame],
    entity: str = "entity_id",
    request: str = "request_time",
    keep: Sequence[str] = (),
    hot: HotEntities | str | None = "auto",
    asked_only: bool = False,
) -> DataFrame:
    """State of every fact column at each request: ``entity, request, *keep, *state columns``.

    ``facts`` may be several relations with different state columns; all are read in one pass. A
    state is NULL where nothing was knowable. Requests without ``keep`` columns are distinct
    in the result; with ``keep`` every spine row with an entity and a time stays. ``asked_only`` first
    drops what no request can see (worth its two joins where requests name few of the entities or end
    early); the result is the same.
    """
    parts = [facts] if isinstance(facts, DataFrame) else list(facts)
    states = [s for part in parts for s in state_columns(part)]
    spine = spine.filter(F.col(entity).isNotNull() & F.col(request).isNotNull())
    if asked_only:
        parts = [_asked(part, spine, entity, request) for part in parts]
    rows = merge(parts).select("*", F.lit(_FACT).alias("_kind")).unionByName(
        spine.select(
            _named(entity, "_entity_key"),
            F.col(request).alias("_t"),
            F.lit(_REQUEST).alias("_kind"),
            *keep,
        ),
        allowMissingColumns=True,
    )
    return _answer(rows, states, entity, request, keep, hot)


def _asked(facts: DataFrame, spine: DataFrame, entity: str, request: str) -> DataFrame:
    """The facts of entities in the spine that were known by its last request."""
    last = spine.agg(F.max(request).alias("last")).scalar()
    named = spine.select(F.col(entity).alias("_entity_key")).distinct()
    return facts.filter(F.col("_t") <= last).join(named, "_entity_key", "left_semi")


def own_states(
    table: DataFrame,
    features: Sequence[str],
    entity: str = "entity_id",
    request: str = "request_time",
    keep: Sequence[str] = (),
    where: Column | None = None,
    hot: HotEntities | str | None = "auto",
) -> DataFrame:
    """As ``states_at`` with a request at the event time of every row of a wide ``table``.

    Each row emits its fact and, if ``where`` holds, its request, so the table is evaluated once. Where both
    have one time they stay one row; every request sees all facts of its instant.
    """
    event, knowledge = F.col("event_timestamp"), F.col("knowledge_timestamp")
    facts = {f: F.when(F.col(f).isNotNull(), _fact("event", event, knowledge, F.col(f)))
             for f in features}
    fact = F.struct(
        knowledge.alias("_t"), F.lit(_FACT).alias("_kind"), *(c.alias(f) for f, c in facts.items())
    )
    ask = F.struct(
        event.alias("_t"), F.lit(_REQUEST).alias("_kind"),
        *(F.when(F.lit(False), c).alias(f) for f, c in facts.items()),
    )
    asked = F.lit(True) if where is None else where
    at_once = F.array(fact.withField("_kind", F.lit(_BOTH)))
    both = F.when(asked & (event == knowledge), at_once).when(asked, F.array(fact, ask)).otherwise(F.array(fact))
    rows = table.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("_entity_key"), *keep, F.inline(both))
    rows = rows.filter(F.col("_t").isNotNull())
    return _answer(rows, list(features), entity, request, keep, hot, by_time=True)


def _answer(rows, states, entity, request, keep, hot, by_time=False) -> DataFrame:
    """Running maxima over ``_entity_key, _t, _kind, *states, *keep``, read at the requests."""
    hot = resolve_hot(hot, rows, "_entity_key", "_t")
    key = ["_entity_key"]
    if hot is not None:
        key = ["_entity_key", "_bucket"]
        # Written once: the carry and the answer both pass over these rows.
        rows = stage(rows, "asof-rows")
        earlier = (
            Window.partitionBy("_entity_key")
            .orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            with_bucket(hot_rows(rows, "_entity_key", hot), "_entity_key", "_t", hot, "inner")
            .groupBy(*key)
            .agg(*(F.max(s).alias(s) for s in states))
            .select(*key, F.lit(_CARRY).alias("_kind"),
                    *(F.max(s).over(earlier).alias(s) for s in states))
        )
        rows = with_bucket(rows, "_entity_key", "_t", hot, "left").unionByName(
            carry, allowMissingColumns=True
        )
        rows = in_tasks(rows, hot, *key)
    # The carry row has no time and so sorts first; at one instant facts precede requests.
    ordered = Window.partitionBy(*key).orderBy("_t", "_kind")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by_time:
        # A row that is fact and request sees the other facts of its instant too.
        so_far = Window.partitionBy(*key).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    repeated = F.lit(False) if keep else F.coalesce(
        (F.lag("_kind").over(ordered) >= _REQUEST) & (F.lag("_t").over(ordered) == F.col("_t")),
        F.lit(False),
    )
    # The key keeps its one name up to here: two names of it would hide that both sides are partitioned alike.
    answered = rows.select(
        "_entity_key",
        F.col("_t").alias(request),
        *keep,
        "_kind",
        repeated.alias("_repeated"),
        *(F.max(s).over(so_far).alias(s) for s in states),
    )
    asked = answered.filter((F.col("_kind") >= _REQUEST) & ~F.col("_repeated"))
    return asked.drop("_kind", "_repeated").withColumnRenamed("_entity_key", entity)


def any_known(states: Sequence[str]) -> Column:
    return F.coalesce(*(F.col(s)["knowledge"] for s in states)).isNotNull()


def guarded_value(state: str, request: str = "request_time") -> Column:
    """The value of a state; fails the job if the state was not yet knowable at the request."""
    late = F.col(state)["knowledge"] > F.col(request)
    alarm = F.raise_error(F.lit(f"value of {state} was not knowable at the request")).cast("double")
    return F.when(late, alarm).otherwise(F.col(state)["value"])
