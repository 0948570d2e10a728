import numpy as np
import pandas as pd
import pytest

from bitempo.operators import backtest as bt
from bitempo.operators import scoring, training
from bitempo.operators.features import feature_table, to_long, wide_features
from bitempo.operators.online import latest_vectors
from bitempo.operators.reconcile import check_points, reconcile, summarize
from bitempo.plans.hot import hot_entities
from bitempo.plans.ordered import time_quantile
from bitempo.schema import FEATURE_NAMES

from .helpers import bars_frame, brute_asof, by_keys, random_bars

SIZES = {"x": 300, "y": 150, "z": 60}


@pytest.fixture(scope="module")
def bars():
    return random_bars(11, SIZES)


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.7, 1.0])
@pytest.mark.parametrize("unit", ["us", "s", "D"])
def test_time_quantile(spark, fraction, unit):
    rng = np.random.default_rng(4)
    times = pd.Series(
        pd.Timestamp("1969-12-25")
        + pd.to_timedelta(rng.integers(0, 20, 501) if unit == "D" else rng.integers(0, 10**6, 501), unit)
    )
    df = spark.createDataFrame(pd.DataFrame({"ts": times}), "ts timestamp_ntz")
    row = time_quantile(df, "ts", fraction).first()
    want = times.astype("datetime64[us]").astype("int64").quantile(fraction, interpolation="linear")
    got = pd.Timestamp(row["cut"]).value // 1000
    assert abs(got - want) <= 1
    assert row["n"] == 501


def test_matrix_and_alignment(spark, bars):
    df = bars_frame(spark, bars)
    labels = training.build_labels(df, None)
    parts = {m: wide_features(df, m, None) for m in ("correct", "leaked")}
    separate = {m: training.training_matrix(labels, w, hot=None) for m, w in parts.items()}
    keys = by_keys(training.aligned_keys(*separate.values()), "entity_id", "request_time")

    correct = by_keys(separate["correct"], "entity_id", "request_time")
    pairs = brute_asof(to_long(parts["correct"]).toPandas(), labels.toPandas()[["entity_id", "request_time"]])
    wide = pairs.pivot(index=["entity_id", "request_time"], columns="feature_name", values="value")
    want = wide.dropna().reset_index()
    assert len(correct) == len(want)
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(correct[f], want[f])

    for rows_per_task in (None, 40):
        hot = rows_per_task and hot_entities(df, "ticker", "date", rows_per_task)
        both = by_keys(training.aligned_matrix(df, hot or None), "entity_id", "request_time")
        pd.testing.assert_frame_equal(both[["entity_id", "request_time"]], keys)
        merged = both.merge(correct, on=["entity_id", "request_time"])
        for f in FEATURE_NAMES:
            np.testing.assert_allclose(merged[f"{f}__correct"], merged[f], rtol=1e-9)
        assert (merged["label_x"] == merged["label_y"]).all()

    train, test = training.time_split(separate["correct"])
    cut = correct["request_time"].quantile(0.7)
    assert train.count() == (correct["request_time"] <= cut).sum()
    assert test.count() == (correct["request_time"] > cut).sum()


def newton(x, y, c=1.0):
    """Penalised optimum: half squared weights plus c times the summed log loss."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        grad = c * a.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(c * (a * (p * (1 - p))[:, None]).T @ a + penalty, grad)
    return w


def test_logistic_model(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    frame = pd.DataFrame(x, columns=list(FEATURE_NAMES))
    frame["label"] = y
    df = spark.createDataFrame(frame)
    scorer = training.fit_logistic(df)
    z = (x - x.mean(0)) / x.std(0)
    w = newton(z, y)
    np.testing.assert_allclose(scorer.model.coefficients.toArray(), w[:4], atol=1e-6)
    np.testing.assert_allclose(scorer.model.intercept, w[4], atol=1e-6)

    gap = df.limit(1).selectExpr("cast(null as double) rolling_5d_volatility", *FEATURE_NAMES[1:])
    vectors = df.select(*FEATURE_NAMES).unionByName(gap).selectExpr("'e' entity_id", "*")
    scored = scoring.score(vectors, scorer, "online").toPandas()
    p = 1 / (1 + np.exp(-(z @ w[:4] + w[4])))
    np.testing.assert_allclose(scored["p_up"][:500].astype(float), p, atol=6e-5)
    assert scored["status"].tolist() == ["ok"] * 500 + ["incomplete online features"]
    assert scored["signal"][500] is None and pd.isna(scored["p_up"][500])
    assert (scored["signal"][:500] == np.where(p >= 0.5, "bullish", "bearish")).all()
    assert scored["volume_zscore_band"].between(0, 1).all()


def test_evaluation(spark):
    rng = np.random.default_rng(2)
    n = 400
    frame = pd.DataFrame(
        {
            "entity_id": rng.choice(["a", "b"], n), "label": rng.integers(0, 2, n),
            "request_time": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "D"),
            "p_up": np.round(rng.random(n), 1) * 0.3 + 0.35, "ret": rng.normal(0, 0.01, n),
        }
    )
    frame.loc[5, "ret"] = None
    df = spark.createDataFrame(frame).withColumn("ret", training.F.expr("nanvl(ret, null)"))

    ranks = frame["p_up"].rank()
    pos = frame["label"] == 1
    n1, n0 = pos.sum(), (~pos).sum()
    assert bt.roc_auc(df) == pytest.approx((ranks[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
    hit = ((frame["p_up"] > 0.5).astype(int) == frame["label"]).mean()
    assert bt.accuracy(df).first()["accuracy"] == pytest.approx(hit)

    frame["pos"] = (2 * (frame["p_up"] - 0.5)).clip(-0.1, 0.1)
    held = frame.groupby("entity_id")["pos"].shift(1).fillna(0)
    cost = (frame["pos"] - held).abs() * 5e-4 + frame["pos"].abs() * 2e-4
    net = frame["pos"] * frame["ret"].fillna(0) - cost
    want = net.mean() / net.std(ddof=0) * np.sqrt(252)
    for rows_per_task in (None, 20):
        hot = rows_per_task and hot_entities(df, "entity_id", "request_time", rows_per_task)
        pnl = bt.strategy_pnl(df, hot or None)
        assert pnl.count() == n
        assert bt.pooled_sharpe(pnl).first()["sharpe"] == pytest.approx(want)
    flat = df.withColumn("p_up", training.F.lit(0.5))
    assert bt.pooled_sharpe(bt.strategy_pnl(flat, None)).first()["sharpe"] == 0.0


def test_reconcile_end_to_end(spark, bars):
    df = bars_frame(spark, bars)
    table = feature_table(df, hot=None)
    names = ["entity_id", "event_timestamp", "knowledge_timestamp"]
    pick = {
        m: to_long(table.selectExpr(*names, *(f"{f}__{m} {f}" for f in FEATURE_NAMES)))
        for m in ("correct", "leaked")
    }
    points = check_points(df, 20, hot=None)
    # A revision of the final close or a look-ahead shows; the causal path matches everywhere.
    report = reconcile(points, pick["correct"], pick["leaked"], pick["correct"], hot=None)
    total = summarize(report).first()
    assert total["n_checks"] == points.count() * 4
    assert total["correct_matches_online_frac"] == 1.0
    assert total["leaked_matches_online_frac"] < 0.5
    assert total["mean_abs_leaked_skew"] > 0

    early = spark.createDataFrame([("nobody", pd.Timestamp("2020-01-01").to_pydatetime())], points.schema)
    absent = reconcile(early, pick["correct"], pick["leaked"], pick["correct"], hot=None).toPandas()
    assert len(absent) == 4 and absent["correct_matches_online"].all()


def test_backtest(spark, bars):
    result = bt.backtest(bars_frame(spark, bars), hot=None)
    rows = result.collect()
    assert [r["variant"] for r in rows] == ["correct", "leaked"]
    assert rows[0]["n_train"] == rows[1]["n_train"] and rows[0]["n_test"] == rows[1]["n_test"]
    assert rows[0]["split_date"] == rows[1]["split_date"]
    # One look-ahead bar tells the label on a random walk.
    assert rows[1]["accuracy"] > rows[0]["accuracy"]
    edge = bt.phantom_edge(result).first()
    assert edge["accuracy"] == pytest.approx(rows[1]["accuracy"] - rows[0]["accuracy"])


def test_latest_vectors(spark, bars):
    wide = wide_features(bars_frame(spark, bars), hot=None)
    got = by_keys(latest_vectors(to_long(wide)), "entity_id")
    last = by_keys(wide, "entity_id", "event_timestamp").groupby("entity_id").tail(1)
    for f in FEATURE_NAMES:
        np.testing.assert_allclose(got[f], last[f])
