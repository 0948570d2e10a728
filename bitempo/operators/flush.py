"""Bars counted from the last flush.

A live buffer closes a ticker's bar with the first tick that comes an interval or more after the flush before
it; the first tick of all starts the clock. So each flush decides the next one: a chain, and where it
stands in the middle of a day depends on everything before.

A ticker of ordinary size is one group: successors of all ticks by one vectorised search, then the chain. A
large ticker is cut along time into chunks. A chain can only leave a chunk at one of the ticks in its last
interval; for each of those, the chunk that holds its successor says at which tick the chain leaves that one.
These pointers are followed by doubling, so a ticker of a million chunks takes twenty rounds. Then
every chunk knows its last flush before it and is segmented alone; a bar that spans chunks is put together
from one row a chunk. A chunk of ``rows_per_task`` rows is the most a task holds.

Defined results: ticks without ticker or time are left out; ticks of one time stand in the order given, and
only the first of them can flush; an empty table gives no bars.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import epoch_micros
from ..plans.hot import HotEntities, resolve_hot, split_rows
from ..session import stage

PARTS = (
    "ticker string, chunk long, since long, open double, high double, low double, close double, volume double,"
    " last long, ticks long, closed boolean"
)


def leaving(times: np.ndarray, step: int) -> np.ndarray:
    """For every tick, at which tick of the chunk a chain that flushes there leaves the chunk."""
    after = np.searchsorted(times, times + step).tolist()
    out = list(range(len(times)))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            out[i] = out[after[i]]
    return np.array(out, np.int64)


def flushes(times: np.ndarray, since: int, step: int) -> list[int]:
    """Positions of the ticks that flush, the last flush having been at ``since``."""
    after = np.searchsorted(times, times + step).tolist()
    out, i = [], int(np.searchsorted(times, since + step))
    while i < len(times):
        out.append(i)
        i = after[i]
    return out


def segments(chunk: Mapping[str, np.ndarray], step: int) -> dict[str, np.ndarray]:
    """One row per bar, or part of a bar, of a chunk in time order (``since``: last flush before it)."""
    times = np.asarray(chunk["at"], np.int64)
    since = int(chunk["since"][0])
    ends = flushes(times, since, step)
    starts = np.array([0, *(i + 1 for i in ends)])
    starts = starts[starts < len(times)]
    stops = np.append(starts[1:], len(times)) - 1
    price, volume = np.asarray(chunk["price"], float), np.asarray(chunk["volume"], float)
    return {
        "ticker": np.repeat(chunk["ticker"][:1], len(starts)), "chunk": np.repeat(chunk["chunk"][:1], len(starts)),
        "since": np.append(since, times[ends])[: len(starts)],
        "open": price[starts], "high": np.fmax.reduceat(price, starts), "low": np.fmin.reduceat(price, starts),
        "close": price[stops], "volume": np.add.reduceat(np.nan_to_num(volume), starts),
        "last": times[stops], "ticks": stops - starts + 1, "closed": np.isin(stops, ends),
    }


def whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict[str, np.ndarray]]]:
    """The chunks that end with each batch, of rows sorted by ticker and chunk; holds one open chunk."""
    begun: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([piece[c] for piece in begun]) for c in begun[0]} if len(begun) > 1 else begun[0]

    for batch in batches:
        if batch.empty:
            continue
        columns = {c: batch[c].to_numpy() for c in batch}
        ticker, chunk = columns["ticker"], columns["chunk"]
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (ticker[1:] != ticker[:-1])) + 1
        done = []
        for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if begun and (begun[0]["ticker"][0], begun[0]["chunk"][0]) != (ticker[start], chunk[start]):
                done.append(joined())
                begun = []
            begun.append({c: v[start:stop] for c, v in columns.items()})
        if done:
            yield done
    if begun:
        yield [joined()]


def per_chunk(rows: DataFrame, sort: Sequence[Column], work, schema: str) -> DataFrame:
    """``work`` on every chunk of ``rows`` (ticker, chunk, ...): many small chunks pass in one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunks in whole_chunks(batches):
            parts = [part for part in map(work, chunks) if part is not None]
            if parts:
                yield pd.DataFrame({c: np.concatenate([part[c] for part in parts]) for c in parts[0]})

    together = rows.repartition("ticker", "chunk").sortWithinPartitions("ticker", "chunk", *sort)
    return together.mapInPandas(run, schema)


def flush_bars(
    ticks: DataFrame, interval_seconds: int, order: Sequence[str] = ("timestamp",),
    hot: HotEntities | str | None = "auto", with_open: bool = False,
) -> DataFrame:
    """Bars of ``ticks`` (ticker, timestamp, price, volume): since, OHLCV, time of the last tick, ticks.

    ``with_open`` adds what a forced flush at the end would give.
    """
    step = interval_seconds * 1_000_000
    timed = ticks.filter(F.col("timestamp").isNotNull() & F.col("ticker").isNotNull())
    hot = resolve_hot(hot, timed, "ticker", "timestamp")
    ties = [F.col(c).alias(f"tie{i}") for i, c in enumerate(order[1:])]
    split = split_rows(timed, "ticker", "timestamp", hot)
    rows = split.select(
        "ticker", F.col("_chunk").cast("long").alias("chunk"), epoch_micros(split, "timestamp").alias("at"),
        F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"), *ties)
    sort = [F.col("at"), *(F.col(f"tie{i}").asc_nulls_last() for i in range(len(ties)))]
    carried = rows.groupBy("ticker", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    if hot is not None:
        rows = stage(rows, "flush-ticks")
        carried = stage(last_flush_before(rows, rows.groupBy("ticker", "chunk").agg(
            F.min("at").alias("first"), F.max("at").alias("last")), step), "flush-carried")
    else:
        carried = carried.select("ticker", "chunk", F.col("first").alias("since"))

    known = rows.join(carried, ["ticker", "chunk"])
    parts = per_chunk(known, sort, lambda chunk: segments(chunk, step), PARTS)
    whole = parts.groupBy("ticker", "since").agg(
        F.min_by("open", "chunk").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "chunk").alias("close"), F.sum("volume").alias("volume"), F.max("last").alias("last"),
        F.sum("ticks").alias("ticks"), F.max("closed").alias("closed"))
    kind = ticks.schema["timestamp"].dataType
    return whole.filter(F.col("closed") | F.lit(with_open)).select(
        "ticker", F.timestamp_micros("since").cast(kind).alias("since"), "open", "high", "low", "close", "volume",
        F.timestamp_micros("last").cast(kind).alias("timestamp"), "ticks")


def last_flush_before(rows: DataFrame, bounds: DataFrame, step: int) -> DataFrame:
    """ticker, chunk, since for every chunk (``bounds``: ticker, chunk, first, last)."""
    bounds = stage(bounds, "flush-chunks")
    # Where a chain can leave a chunk, and the chunk that holds its next flush.
    leave = rows.join(bounds, ["ticker", "chunk"]).filter(F.col("at") > F.col("last") - step).select("ticker", "at")
    begin = bounds.groupBy("ticker").agg(F.min("first").alias("at"))
    asking = leave.unionByName(begin).distinct()
    # Backwards: a frame that ends at its row is kept running, one that begins there is built anew for every row.
    ahead = Window.partitionBy("ticker").orderBy(F.desc("due"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asking.select("ticker", (F.col("at") + step).alias("due"), F.lit(0).alias("kind"), "at", F.lit(None).cast("long").alias("chunk")
                         ).unionByName(bounds.select("ticker", F.col("last").alias("due"), F.lit(1).alias("kind"),
                                                     F.lit(None).cast("long").alias("at"), "chunk"))
    routed = both.withColumn("chunk", F.last("chunk", ignorenulls=True).over(ahead)).filter("kind = 0 and chunk is not null")
    routed = stage(routed.select("ticker", "chunk", "at"), "flush-routed")

    def pointers(chunk: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        asks = chunk["asks"].astype(bool)
        times, at = chunk["at"][~asks], chunk["at"][asks]
        if not len(times) or not len(at):
            return None
        out = leaving(times, step)
        return {"ticker": chunk["ticker"][asks], "at": at, "next": times[out[np.searchsorted(times, at + step)]]}

    asked = rows.select("ticker", "chunk", "at", F.lit(False).alias("asks")).unionByName(
        routed.select("ticker", "chunk", "at", F.lit(True).alias("asks")))
    jump = per_chunk(asked, [F.col("at")], pointers, "ticker string, at long, next long")
    jump, reached = stage(jump, "flush-jumps"), stage(begin, "flush-reached")
    # A pointer leads into a later chunk and to a later flush: neither happens more often than that.
    spans = F.floor((F.max("last") - F.min("first")) / step) + 1
    most = bounds.groupBy("ticker").agg(F.least(F.count(F.lit(1)), spans).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(most.bit_length()):
        further = reached.join(jump, ["ticker", "at"]).select("ticker", F.col("next").alias("at"))
        reached = stage(reached.unionByName(further).distinct(), "flush-reached")
        second = jump.select("ticker", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = stage(jump.join(second, ["ticker", "next"]).select("ticker", "at", F.col("after").alias("next")), "flush-jumps")
    # Of all flushes at which chunks are left, the latest before a chunk; the first tick for the first chunk.
    so_far = Window.partitionBy("ticker").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = reached.select("ticker", F.col("at").alias("t"), F.lit(1).alias("kind"), F.col("at").alias("since"), F.lit(None).cast("long").alias("chunk"))
    own = bounds.select("ticker", F.col("first").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("since"), "chunk")
    found = marks.unionByName(own).withColumn("since", F.last("since", ignorenulls=True).over(so_far)).filter("kind = 0")
    return found.join(begin.select("ticker", F.col("at").alias("begin")), "ticker").select(
        "ticker", "chunk", F.coalesce("since", "begin").alias("since"))
