"""Small fixtures and brute-force forms of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from bitempo.schema import FEATURE_NAMES, FEATURES, RAW_BARS

REQUESTS = "entity_id string, request_time timestamp_ntz"


def t(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def features(spark, rows):
    return spark.createDataFrame([(e, f, v, t(a), t(b)) for e, f, v, a, b in rows], FEATURES)


def requests(spark, rows):
    return spark.createDataFrame([(e, t(a)) for e, a in rows], REQUESTS)


def random_facts(seed: int, n: int = 3000) -> pd.DataFrame:
    """Bitemporal facts: ties in time, late knowledge, one entity with most of the rows."""
    rng = np.random.default_rng(seed)
    event = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, n) * 6, "h")
    lag = pd.to_timedelta(rng.choice([0, 0, 1, 5, 30], n), "D")
    frame = pd.DataFrame(
        {
            "entity_id": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcde"), n)),
            "feature_name": rng.choice(FEATURE_NAMES, n),
            "value": rng.normal(size=n),
            "event_timestamp": event,
            "knowledge_timestamp": event + lag,
        }
    )
    keys = ["entity_id", "feature_name", "event_timestamp", "knowledge_timestamp"]
    return frame.drop_duplicates(keys)


def random_requests(seed: int, n: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    time = pd.Timestamp("2019-12-25") + pd.to_timedelta(rng.integers(0, 480, n) * 6, "h")
    frame = pd.DataFrame(
        {"entity_id": rng.choice(["hot", "a", "b", "c", "unknown"], n), "request_time": time}
    )
    return pd.concat([frame, frame.head(40)])


def brute_asof(facts: pd.DataFrame, spine: pd.DataFrame, order: str = "event") -> pd.DataFrame:
    """Textbook form: all pairs, then the best one."""
    first, second = (
        ("event_timestamp", "knowledge_timestamp")
        if order == "event"
        else ("knowledge_timestamp", "event_timestamp")
    )
    pairs = spine.drop_duplicates().merge(facts, on="entity_id")
    pairs = pairs[pairs["knowledge_timestamp"] <= pairs["request_time"]]
    keys = ["entity_id", "request_time", "feature_name"]
    return (
        pairs.sort_values([*keys, first, second]).groupby(keys).tail(1)
        .sort_values(keys).reset_index(drop=True)
    )


def random_bars(seed: int, sizes: dict[str, int]) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for ticker, n in sizes.items():
        gaps = rng.integers(1, 5, n).cumsum()
        first = np.exp(rng.normal(0, 0.05, n).cumsum()) * 50
        close = np.where(rng.random(n) < 0.2, first * 1.01, first)
        parts.append(
            pd.DataFrame(
                {
                    "ticker": ticker,
                    "date": pd.Timestamp("2015-01-01") + pd.to_timedelta(gaps, "D"),
                    "open": first, "high": first * 1.02, "low": first * 0.98, "close": close,
                    "volume": rng.integers(100, 10_000, n),
                    "first_print_close": first,
                    "revised": close != first,
                    "knowledge_date": pd.Timestamp("2015-01-01") + pd.to_timedelta(gaps, "D"),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def bars_frame(spark, bars: pd.DataFrame):
    return spark.createDataFrame(bars, RAW_BARS)


def per_row_features(bars: pd.DataFrame, mode: str) -> pd.DataFrame:
    """Every feature of every bar from the definition: one row, its own slice of the arrays."""
    rows = []
    for ticker in sorted(bars["ticker"].unique()):
        own = bars[bars["ticker"] == ticker].sort_values("date")
        price = own["first_print_close" if mode == "correct" else "close"].to_numpy(float)
        volume = own["volume"].to_numpy(float)
        n, ahead = len(own), (0, 0, 0) if mode == "correct" else (2, 2, 1)
        steps = np.log(price[1:] / price[:-1])
        for i, day in enumerate(own["date"]):
            # steps[j] leads from bar j to bar j + 1; the frame holds five of them.
            last = i + ahead[0]
            frame = steps[last - 5 : last] if last >= 5 and last < n else []
            month, fortnight = i + ahead[1], i + ahead[2]
            seen = volume[: i + 1] if mode == "correct" else volume
            spread = np.std(seen, ddof=1) if len(seen) >= (20 if mode == "correct" else 2) else np.nan
            rows.append((
                ticker, day,
                np.std(frame, ddof=1) if len(frame) else np.nan,
                price[month] / price[month - 20] - 1 if 20 <= month < n else np.nan,
                (volume[i] - seen.mean()) / spread,
                price[fortnight] / price[fortnight - 10] - 1 if 10 <= fortnight < n else np.nan,
            ))
    return pd.DataFrame(rows, columns=["entity_id", "event_timestamp", *FEATURE_NAMES])


def by_keys(df, *keys) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
