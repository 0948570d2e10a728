import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitempo.operators import features as fe
from bitempo.operators.bars import stamp_revisions
from bitempo.operators.reconcile import check_points
from bitempo.operators.training import build_labels, realized_returns
from bitempo.plans.hot import hot_entities, split_rows
from bitempo.schema import FEATURE_NAMES

from .helpers import bars_frame, by_keys, per_row_features, random_bars

SIZES = {"big": 700, "mid": 90, "small": 22, "tiny": 3}


@pytest.fixture(scope="module")
def bars():
    return random_bars(7, SIZES)


def splitter(spark, bars, rows_per_task):
    if rows_per_task is None:
        return None
    return hot_entities(bars_frame(spark, bars), "ticker", "date", rows_per_task)


@pytest.mark.parametrize("mode", ["correct", "leaked"])
@pytest.mark.parametrize("rows_per_task", [None, 200, 30, 5])
def test_against_pandas(spark, bars, mode, rows_per_task):
    hot = splitter(spark, bars, rows_per_task)
    got = by_keys(fe.wide_features(bars_frame(spark, bars), mode, hot), "entity_id", "event_timestamp")
    want = per_row_features(bars, mode)
    assert len(got) == len(want)
    for f in FEATURE_NAMES:
        assert (got[f].isna() == want[f].isna()).all(), f
        np.testing.assert_allclose(got[f], want[f], rtol=1e-9, atol=1e-12, err_msg=f)


def test_zscore_needs_twenty_bars(spark):
    wide = fe.wide_features(bars_frame(spark, random_bars(1, {"a": 25})), hot=None)
    z = by_keys(wide, "event_timestamp")["volume_zscore"]
    assert z.isna().tolist() == [True] * 19 + [False] * 6


def test_zero_price_and_constant_volume_give_null(spark):
    bars = random_bars(2, {"a": 30})
    bars.loc[3, "first_print_close"] = 0.0
    bars["volume"] = 5
    long = fe.compute_features(bars_frame(spark, bars), "correct", None).toPandas()
    assert "volume_zscore" not in set(long["feature_name"])
    assert np.isfinite(long["value"]).all()


def test_appending_the_future_changes_only_leaked(spark, bars):
    cut = bars[bars["date"] < bars["date"].quantile(0.6)]
    for mode, stable in (("correct", True), ("leaked", False)):
        for rows_per_task in (None, 40):
            early = fe.compute_features(bars_frame(spark, cut), mode, splitter(spark, cut, rows_per_task))
            late = fe.compute_features(bars_frame(spark, bars), mode, splitter(spark, bars, None))
            keys = ["entity_id", "feature_name", "event_timestamp"]
            both = early.toPandas().merge(late.toPandas(), on=keys, suffixes=("", "_later"))
            same = np.isclose(both["value"], both["value_later"], rtol=1e-9, atol=1e-12)
            assert same.all() == stable


@pytest.mark.parametrize("rows_per_task", [None, 60, 9])
def test_live_features(spark, bars, rows_per_task):
    hot = splitter(spark, bars, rows_per_task)
    got = by_keys(fe.live_features(bars_frame(spark, bars), hot=hot), "entity_id", "event_timestamp")
    want = []
    for ticker, b in bars.groupby("ticker"):
        c, v = b["close"].to_numpy(), b["volume"].to_numpy(float)
        for i in range(20, len(b)):
            buffer = v[max(0, i - 49) : i + 1]
            want.append(
                (
                    ticker, b["date"].iloc[i], np.std(np.diff(np.log(c[i - 5 : i + 1])), ddof=1),
                    c[i] / c[i - 20] - 1, (v[i] - buffer.mean()) / buffer.std(ddof=1),
                    c[i] / c[i - 10] - 1,
                )
            )
    want = pd.DataFrame(want, columns=["entity_id", "event_timestamp", *FEATURE_NAMES])
    want = want.sort_values(["entity_id", "event_timestamp"]).reset_index(drop=True)
    assert got["entity_id"].tolist() == want["entity_id"].tolist()
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(got[f], want[f], rtol=1e-8, atol=1e-12)


def test_live_needs_twenty_one_bars(spark):
    bars = random_bars(3, {"a": 20, "b": 21})
    rows = fe.live_features(bars_frame(spark, bars), hot=None).collect()
    assert [r["entity_id"] for r in rows] == ["b"]


@pytest.mark.parametrize("rows_per_task", [None, 30])
def test_neighbour_bars(spark, bars, rows_per_task):
    hot = splitter(spark, bars, rows_per_task)
    df = bars_frame(spark, bars)
    ordered = bars.sort_values(["ticker", "date"])
    groups = ordered.groupby("ticker")
    nxt = groups["close"].shift(-1)
    known = nxt.notna()

    got = by_keys(build_labels(df, hot), "entity_id", "request_time")["label"]
    assert got.tolist() == (nxt > ordered["close"])[known].astype(int).tolist()

    got = by_keys(realized_returns(df, hot), "entity_id", "request_time")["ret"]
    np.testing.assert_allclose(got, (nxt / ordered["close"] - 1)[known])

    third = groups["date"].shift(-3).fillna(ordered["date"])
    want = third.where(ordered["revised"], ordered["date"])
    got = by_keys(stamp_revisions(df.drop("knowledge_date"), hot=hot), "ticker", "date")
    assert got["knowledge_date"].tolist() == want.tolist()


@pytest.mark.parametrize("rows_per_task", [None, 25])
def test_check_points(spark, bars, rows_per_task):
    hot = splitter(spark, bars, rows_per_task)
    df = bars_frame(spark, bars)
    got = check_points(df, 5, seed=3, hot=hot).toPandas()
    again = check_points(df, 5, seed=3, hot=hot).toPandas()
    keys = ["entity_id", "request_time"]
    pd.testing.assert_frame_equal(
        got.sort_values(keys).reset_index(drop=True), again.sort_values(keys).reset_index(drop=True)
    )
    assert got.groupby("entity_id").size().to_dict() == {"big": 5, "mid": 5, "small": 5, "tiny": 2}
    assert not got.duplicated().any()
    for ticker, b in bars.groupby("ticker"):
        later = set(b["date"].sort_values().iloc[len(b) // 2 :])
        assert set(got[got["entity_id"] == ticker]["request_time"]) <= later


def test_seed_history(spark, bars):
    got = fe.seed_history(bars_frame(spark, bars)).toPandas()
    assert got.groupby("ticker").size().to_dict() == {"big": 50, "mid": 50, "small": 22, "tiny": 3}


def test_melt_and_pivot_are_inverse(spark, bars):
    wide = fe.wide_features(bars_frame(spark, bars), hot=None)
    back = fe.to_wide(fe.to_long(wide), ["entity_id", "event_timestamp"])
    any_value = F.coalesce(*FEATURE_NAMES).isNotNull()
    want = by_keys(wide.filter(any_value).drop("knowledge_timestamp"), "entity_id", "event_timestamp")
    pd.testing.assert_frame_equal(by_keys(back, "entity_id", "event_timestamp"), want)


def test_windows_share_one_shuffle(spark, bars):
    table = fe.feature_table(bars_frame(spark, bars), hot=None)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 1


def test_bursts_are_cut_further(spark):
    """An entity with most of its rows in one short time still splits into even chunks."""
    bars = random_bars(9, {"big": 900, "other": 40})
    burst = bars["ticker"].eq("big") & (bars.index < 800)
    start = pd.Timestamp("2010-01-01")
    bars.loc[burst, "date"] = start + pd.to_timedelta(np.arange(burst.sum()) * 60, "s")
    df = bars_frame(spark, bars)
    hot = hot_entities(df, "ticker", "date", 50)
    assert hot.dense is not None
    sizes = [
        r["count"] for r in split_rows(df, "ticker", "date", hot, 20, 2)
        .filter("ticker = 'big' and _own").groupBy("_chunk").count().collect()
    ]
    assert sum(sizes) == 900 and max(sizes) <= 100
    for mode in ("correct", "leaked"):
        got = by_keys(fe.wide_features(df, mode, hot), "entity_id", "event_timestamp")
        want = per_row_features(bars, mode)
        for f in FEATURE_NAMES:
            np.testing.assert_allclose(got[f], want[f], rtol=1e-8, atol=1e-12)
