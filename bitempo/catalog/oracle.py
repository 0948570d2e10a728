"""The same results in plain SQL, written independently of the DataFrame code."""

from __future__ import annotations

from ..operators.scoring import BANDS
from ..schema import FEATURE_NAMES
from .queries import (
    FIXED, LAST_PULL, POINTS_PER_ENTITY, PULL_DATE, SINGLE_ENTITY, SINGLE_TIME, SNAPSHOT_CUT,
)

F4 = list(FEATURE_NAMES)


def r6(expr: str) -> str:
    return f"CASE WHEN round({expr}, 6) = 0 THEN 0.0 ELSE round({expr}, 6) END"


def even6(expr: str) -> str:
    return f"CASE WHEN round_even({expr}, 6) = 0 THEN 0.0 ELSE round_even({expr}, 6) END"


def r6_all(prefix: str = "") -> str:
    return ", ".join(f"{r6(prefix + f)} AS {f}" for f in F4)


def with_(final: str, *names: str) -> str:
    """A query over the named relations and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS[name]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({RELATIONS[n].strip()})" for n in order)
    return f"WITH {ctes}\n{final.strip()}"


SUBSCRIBED = """
SELECT 'U' || user_id AS ticker, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
       ts AS "timestamp", event_id
FROM (SELECT *, arg_max(event_type, row(ts, event_id)) FILTER (event_type IN ('purchase', 'error'))
                  OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS change
      FROM events)
WHERE change = 'purchase'
"""
BUSINESS_DAYS = """
SELECT b.ticker, b.date, k.passed - a.passed AS open_days, CAST(s.d AS VARCHAR) AS settles, CAST(p.d AS VARCHAR) AS before
FROM bars b
JOIN days a ON a.d = CAST(b.date AS DATE)
JOIN days k ON k.d = CAST(b.knowledge_date AS DATE)
JOIN days s ON s.is_open AND s.passed = a.passed + 2
JOIN days p ON p.is_open AND p.passed = a.passed - 1
"""
RELATIONS: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def relation(name: str, sql: str, *needs: str) -> None:
    RELATIONS[name], NEEDS[name] = sql, needs


relation("daily", """
SELECT ticker, date, arg_min(price, o) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, o) AS close, CAST(sum(volume) AS BIGINT) AS volume,
       arg_min(price, o) AS first_print_close, count(*) > 1 AS revised
FROM (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, l_shipdate AS date,
             l_extendedprice / l_quantity AS price, l_quantity AS volume,
             row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o
      FROM lineitem)
GROUP BY ticker, date
""")
relation("bars", """
SELECT ticker, date, open, high, low, close, volume, first_print_close, revised,
       CASE WHEN revised THEN coalesce(lead(date, 3) OVER (PARTITION BY ticker ORDER BY date), date)
            ELSE date END AS knowledge_date
FROM daily
""", "daily")

CORRECT = """
SELECT ticker AS entity_id, date AS event_timestamp, date AS knowledge_timestamp,
       CASE WHEN count(lr) OVER last5 >= 5 THEN stddev_samp(lr) OVER last5 END
         AS rolling_5d_volatility,
       c / nullif(lag(c, 20) OVER w, 0) - 1 AS rolling_20d_return,
       CASE WHEN count(v) OVER sofar >= 20
            THEN (v - avg(v) OVER sofar) / nullif(stddev_samp(v) OVER sofar, 0) END AS volume_zscore,
       c / nullif(lag(c, 10) OVER w, 0) - 1 AS price_momentum_10d
FROM (SELECT ticker, date, first_print_close AS c, CAST(volume AS DOUBLE) AS v,
             ln(first_print_close)
               - lag(ln(first_print_close)) OVER (PARTITION BY ticker ORDER BY date) AS lr
      FROM {source})
WINDOW w AS (PARTITION BY ticker ORDER BY date),
       last5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       sofar AS (PARTITION BY ticker ORDER BY date
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
LEAKED = """
SELECT ticker AS entity_id, date AS event_timestamp, date AS knowledge_timestamp,
       CASE WHEN count(lr) OVER around >= 5 THEN stddev_samp(lr) OVER around END
         AS rolling_5d_volatility,
       lead(c, 2) OVER w / nullif(lag(c, 18) OVER w, 0) - 1 AS rolling_20d_return,
       (v - avg(v) OVER whole) / nullif(stddev_samp(v) OVER whole, 0) AS volume_zscore,
       lead(c, 1) OVER w / nullif(lag(c, 9) OVER w, 0) - 1 AS price_momentum_10d
FROM (SELECT ticker, date, close AS c, CAST(volume AS DOUBLE) AS v,
             ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS lr
      FROM {source})
WINDOW w AS (PARTITION BY ticker ORDER BY date),
       whole AS (PARTITION BY ticker),
       around AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
"""
LIVE = """
SELECT * EXCLUDE (n) FROM (
SELECT ticker AS entity_id, {time} AS event_timestamp,
       CASE WHEN count(lr) OVER last5 >= 5 THEN stddev_samp(lr) OVER last5 END
         AS rolling_5d_volatility,
       (c - lag(c, 20) OVER w) / nullif(lag(c, 20) OVER w, 0) AS rolling_20d_return,
       (v - avg(v) OVER buf) / nullif(stddev_samp(v) OVER buf, 0) AS volume_zscore,
       (c - lag(c, 10) OVER w) / nullif(lag(c, 10) OVER w, 0) AS price_momentum_10d,
       count(*) OVER buf AS n
FROM (SELECT ticker, {time}, close AS c, CAST(volume AS DOUBLE) AS v,
             ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY {time}) AS lr
      FROM {source})
WINDOW w AS (PARTITION BY ticker ORDER BY {time}),
       last5 AS (PARTITION BY ticker ORDER BY {time} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       buf AS (PARTITION BY ticker ORDER BY {time} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
WHERE n >= 21 AND rolling_5d_volatility IS NOT NULL AND rolling_20d_return IS NOT NULL
  AND volume_zscore IS NOT NULL AND price_momentum_10d IS NOT NULL
"""


def melted(source: str) -> str:
    parts = (
        f"SELECT entity_id, '{f}' AS feature_name, {f} AS value, event_timestamp, "
        f"knowledge_timestamp FROM {source} WHERE {f} IS NOT NULL"
        for f in F4
    )
    return "\nUNION ALL ".join(parts)


relation("correct_w", CORRECT.format(source="daily"), "daily")
relation("leaked_w", LEAKED.format(source="daily"), "daily")
relation("correct", melted("correct_w"), "correct_w")
relation("leaked", melted("leaked_w"), "leaked_w")
relation("live", LIVE.format(source="daily", time="date"), "daily")
relation("revised", """
SELECT * FROM correct
UNION ALL
SELECT entity_id, feature_name, value + 1.0, event_timestamp, event_timestamp + INTERVAL 10 DAY
FROM correct WHERE (CAST(entity_id AS INT) + dayofyear(event_timestamp)) % 7 = 0
""", "correct")
relation("spine", """
SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS entity_id,
       l_shipdate + INTERVAL 36 HOUR AS request_time FROM lineitem
""")
# Latest event among the knowable: the unrevised store has knowledge = event, so ASOF is exact.
relation("pit", """
SELECT s.entity_id, s.request_time, f.feature_name, f.value, f.event_timestamp,
       f.knowledge_timestamp
FROM (SELECT * FROM spine, (SELECT DISTINCT feature_name FROM correct)) s
ASOF JOIN correct f ON s.entity_id = f.entity_id AND s.feature_name = f.feature_name
  AND s.request_time >= f.knowledge_timestamp
""", "spine", "correct")


def picked(spine: str, store: str, order: tuple[str, str]) -> str:
    return f"""
SELECT s.entity_id, s.request_time, f.feature_name,
       arg_max(f.value, row(f.{order[0]}, f.{order[1]})) AS value,
       max(row(f.{order[0]}, f.{order[1]})) AS times
FROM {spine} s JOIN {store} f
  ON s.entity_id = f.entity_id AND f.knowledge_timestamp <= s.request_time
GROUP BY ALL
"""


EVENT = ("event_timestamp", "knowledge_timestamp")
KNOWLEDGE = ("knowledge_timestamp", "event_timestamp")
relation("pit_revised", picked("spine", "revised", EVENT), "spine", "revised")
relation("online_revised", picked("spine", "revised", KNOWLEDGE), "spine", "revised")


def wide(source: str, keys: str = "entity_id, request_time") -> str:
    cols = ", ".join(
        f"{r6(f'''max(value) FILTER (feature_name = '{f}')''')} AS {f}" for f in F4
    )
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"


relation("known", """
SELECT * FROM revised WHERE (CAST(entity_id AS INT) + dayofyear(event_timestamp)) % 5 <> 0
""", "revised")
relation("pit_known", picked("spine", "known", EVENT), "spine", "known")
relation("quarters", """
SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, unnest(range(
         (SELECT date_trunc('quarter', min(l_shipdate)) FROM lineitem),
         (SELECT date_trunc('quarter', max(l_shipdate)) + INTERVAL 3 MONTH + INTERVAL 1 DAY FROM lineitem),
         INTERVAL 3 MONTH)) AS request_time
FROM supplier
""")
relation("pit_quarters", picked("quarters", "revised", EVENT), "quarters", "revised")

relation("days", """
SELECT d, is_open, count(*) FILTER (is_open)
         OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed
      FROM (SELECT d, isodow(d) < 6 AND d NOT IN (
                     SELECT CAST(l_shipdate AS DATE) FROM lineitem
                     WHERE strftime(l_shipdate, '%m-%d') IN ('01-01', '07-04', '12-25')) AS is_open
            FROM (SELECT CAST(unnest(generate_series((SELECT min(l_shipdate) - INTERVAL 40 DAY FROM lineitem),
                    (SELECT max(l_shipdate) + INTERVAL 40 DAY FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS d))
""")

relation("ticks", """
SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, ts
FROM events
""")


def ohlcv(ticker: str, width: str, source: str = "ticks", order: str = "row(ts, event_id)") -> str:
    return f"""
SELECT {ticker} AS ticker, time_bucket(INTERVAL {width}, ts) AS bar_start,
       arg_min(price, {order}) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, {order}) AS close, sum(volume) AS volume, max(ts) AS "timestamp"
FROM {source} GROUP BY 1, 2
"""


relation("two_providers", """
SELECT event_type, ts, price, volume, event_id FROM ticks WHERE event_id % 3 <> 0
UNION ALL
SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND,
       arg_max(price, row(ts, event_id)), arg_max(volume, row(ts, event_id)), arg_max(event_id, row(ts, event_id))
FROM ticks WHERE event_id % 3 = 0 GROUP BY 1, 2
""", "ticks")
TWO_PROVIDERS = ohlcv("event_type", "'3 hours'", "two_providers")
relation("bars3h", ohlcv("event_type", "'3 hours'"), "ticks")
relation("bars15m", ohlcv("event_type", "'15 minutes'"), "ticks")
relation("arrived", """
SELECT t.*, CAST(epoch_us(ts) >= low + step AS INT) + CAST(epoch_us(ts) >= low + 2 * step AS INT)
            + CAST(event_id % 50 = 7 AS INT) AS arrival
FROM ticks t, (SELECT epoch_us(min(ts)) AS low,
                      CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.0, 0) AS BIGINT) AS step FROM ticks)
""", "ticks")
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"
relation("closed15m", f"""
SELECT * FROM bars15m WHERE bar_start + INTERVAL 15 MINUTE <= {CLOSED}
""", "bars15m")
relation("live15m", LIVE.format(source="closed15m", time="bar_start"), "closed15m")
relation("live15m_known", "SELECT *, event_timestamp + INTERVAL 15 MINUTE AS knowledge_timestamp FROM live15m",
         "live15m")
relation("live15m_log", melted("live15m_known"), "live15m_known")
relation("quotes", """
SELECT event_type, time_bucket(INTERVAL '1 minute', ts) AS quote_minute,
       arg_max(price, row(ts, event_id)) AS price, arg_max(volume, row(ts, event_id)) AS volume,
       max(ts) AS ts
FROM ticks GROUP BY 1, 2
""", "ticks")

relation("pull1", f"SELECT * FROM daily WHERE date < TIMESTAMP '{SNAPSHOT_CUT}'", "daily")
relation("pull2", """
SELECT * REPLACE (CASE WHEN dayofmonth(date) = 3 THEN close * 1.01 ELSE close END AS close)
FROM daily
""", "daily")
BASE_COLUMNS = """ticker, date, open, high, low, close, volume, close AS first_print_close,
       false AS revised, date AS knowledge_date"""
GAPPED = "CASE WHEN dayofmonth(p.date) <> 5 THEN p.close END"
relation("vintages", f"""
SELECT {BASE_COLUMNS} FROM pull1
UNION ALL
SELECT p1.ticker, p1.date, p1.open, p1.high, p1.low, p2.close, p1.volume, p1.close, true,
       TIMESTAMP '{PULL_DATE}'
FROM pull1 p1 JOIN pull2 p2 USING (ticker, date) WHERE abs(p2.close - p1.close) > 1e-9
UNION ALL
SELECT {BASE_COLUMNS} FROM pull2 WHERE date >= TIMESTAMP '{SNAPSHOT_CUT}'
""", "pull1", "pull2")
relation("vintage_first", "SELECT * FROM vintages WHERE NOT revised", "vintages")
relation("vintage_last", """
SELECT * FROM vintages
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY knowledge_date DESC) = 1
""", "vintages")
relation("vf_w", CORRECT.format(source="vintage_first"), "vintage_first")
relation("vl_w", LEAKED.format(source="vintage_last"), "vintage_last")
relation("vf", melted("vf_w"), "vf_w")
relation("vl", melted("vl_w"), "vl_w")

relation("points", f"""
SELECT ticker AS entity_id, date AS request_time FROM (
  SELECT ticker, date FROM (
    SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
           count(*) OVER (PARTITION BY ticker) AS n
    FROM daily) WHERE i >= n // 2)
QUALIFY row_number() OVER (
  PARTITION BY ticker ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR)), date
) <= {POINTS_PER_ENTITY}
""", "daily")


def reconciled(store: str) -> str:
    return f"""
SELECT p.entity_id, p.request_time, p.feature_name, c.value AS offline_correct,
       l.value AS offline_leaked, o.value AS online,
       CASE WHEN o.value IS NULL THEN c.value IS NULL
            ELSE coalesce(abs(c.value - o.value) <= 1e-9 * (1 + abs(o.value)), false) END
         AS correct_matches_online,
       CASE WHEN o.value IS NULL THEN l.value IS NULL
            ELSE coalesce(abs(l.value - o.value) <= 1e-9 * (1 + abs(o.value)), false) END
         AS leaked_matches_online
FROM (SELECT * FROM points, (SELECT unnest({F4!r}) AS feature_name)) p
LEFT JOIN ({picked("points", store, EVENT)}) c USING (entity_id, request_time, feature_name)
LEFT JOIN ({picked("points", "leaked", EVENT)}) l USING (entity_id, request_time, feature_name)
LEFT JOIN ({picked("points", store, KNOWLEDGE)}) o USING (entity_id, request_time, feature_name)
"""


relation("report", reconciled("correct"), "points", "correct", "leaked")
relation("report_revised", reconciled("revised"), "points", "revised", "leaked")
SUMMARY = """
SELECT count(*) AS n_checks, count(online) AS n_comparable,
       round_even(avg(CAST(correct_matches_online AS INT)) FILTER (online IS NOT NULL), 6)
         AS correct_matches_online_frac,
       round_even(avg(CAST(leaked_matches_online AS INT)) FILTER (online IS NOT NULL), 6)
         AS leaked_matches_online_frac,
       round_even(avg(abs(offline_leaked - online)), 6) AS mean_abs_leaked_skew,
       round_even(max(abs(offline_leaked - online)), 6) AS max_abs_leaked_skew
FROM {source}
"""

relation("next_day", """
SELECT ticker AS entity_id, date AS request_time,
       CAST(lead(close) OVER w > close AS INT) AS label, lead(close) OVER w / close - 1 AS ret
FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)
""", "daily")


def matrix(variant: str) -> str:
    """Every day with a label and, per feature, the last value up to that day; complete rows."""
    joins = " ".join(
        f"ASOF LEFT JOIN (SELECT entity_id, event_timestamp, {f} AS v FROM {variant}_w "
        f"WHERE {f} IS NOT NULL) f{i} ON n.entity_id = f{i}.entity_id "
        f"AND n.request_time >= f{i}.event_timestamp"
        for i, f in enumerate(F4)
    )
    cols = ", ".join(f"f{i}.v AS {f}" for i, f in enumerate(F4))
    full = " AND ".join(f"f{i}.v IS NOT NULL" for i in range(len(F4)))
    return (
        f"SELECT n.entity_id, n.request_time, n.label, n.ret, {cols} FROM next_day n {joins} "
        f"WHERE n.label IS NOT NULL AND {full}"
    )


relation("m_correct", matrix("correct"), "next_day", "correct_w")
relation("m_leaked", matrix("leaked"), "next_day", "leaked_w")
relation("aligned", "SELECT c.* FROM m_correct c SEMI JOIN m_leaked l USING (entity_id, request_time)",
         "m_correct", "m_leaked")
relation("cut", "SELECT quantile_cont(request_time, 0.7) AS cut, count(*) AS n FROM aligned", "aligned")
relation("train", "SELECT * FROM aligned WHERE request_time <= (SELECT cut FROM cut)", "aligned", "cut")
relation("test", "SELECT * FROM aligned WHERE request_time > (SELECT cut FROM cut)", "aligned", "cut")
relation("scored", """
SELECT *, 0.5 + 0.1 * greatest(-1.0, least(1.0, price_momentum_10d)) AS p_up FROM test
""", "test")
relation("placed", """
SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY entity_id ORDER BY request_time), 0))
            AS turnover
FROM (SELECT *, greatest(-0.1, least(0.1, 2 * (p_up - 0.5))) AS pos FROM scored)
""", "scored")
relation("pnl", """
SELECT *, pos * coalesce(ret, 0) - cost AS net
FROM (SELECT *, turnover * 5 * 1e-4 + abs(pos) * 2 * 1e-4 AS cost FROM placed)
""", "placed")

SCORE = "1 / (1 + exp(-(0.02 + " + " + ".join(f"{w!r} * {f}" for f, w in FIXED.weights.items()) + ")))"
relation("latest_correct", f"""
SELECT entity_id, {", ".join(f"arg_max({f}, event_timestamp) FILTER ({f} IS NOT NULL) AS {f}" for f in F4)}
FROM correct_w GROUP BY 1 HAVING {" OR ".join(f"count({f}) > 0" for f in F4)}
""", "correct_w")
relation("latest_leaked", f"""
SELECT entity_id, {", ".join(f"arg_max({f}, event_timestamp) FILTER ({f} IS NOT NULL) AS {f}" for f in F4)}
FROM leaked_w SEMI JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier) USING (entity_id)
GROUP BY 1 HAVING {" OR ".join(f"count({f}) > 0" for f in F4)}
""", "leaked_w")


def scored_vectors(source: str, path: str) -> str:
    bands = ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN "
        f"{r6(f'greatest(0.0, least(1.0, ({f} - ({low})) / ({high - low})))')} END AS {f}_band"
        for f, (low, high) in BANDS.items()
    )
    return f"""
SELECT entity_id, '{path}' AS path,
       CASE WHEN p IS NULL THEN 'incomplete {path} features' ELSE 'ok' END AS status,
       round_even(p, 4) AS p_up,
       CASE WHEN p >= 0.5 THEN 'bullish' WHEN p IS NOT NULL THEN 'bearish' END AS signal,
       {r6_all()}, {bands}
FROM (SELECT *, {SCORE} AS p FROM {source})
"""


relation("aligned_both", """
SELECT 'correct' AS variant, c.* FROM m_correct c SEMI JOIN m_leaked l USING (entity_id, request_time)
UNION ALL
SELECT 'leaked', l.* FROM m_leaked l SEMI JOIN m_correct c USING (entity_id, request_time)
""", "m_correct", "m_leaked")
relation("fixed_test", f"""
SELECT *, pos * coalesce(ret, 0) - turnover * 5 * 1e-4 - abs(pos) * 2 * 1e-4 AS net,
       avg(i) OVER (PARTITION BY variant, p) AS r
FROM (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY variant, entity_id ORDER BY request_time), 0))
                  AS turnover,
             row_number() OVER (PARTITION BY variant ORDER BY p) AS i
      FROM (SELECT *, greatest(-0.1, least(0.1, 2 * (p - 0.5))) AS pos
            FROM (SELECT *, {SCORE} AS p FROM aligned_both WHERE request_time > (SELECT cut FROM cut))))
""", "aligned_both", "cut")
relation("fixed_result", """
SELECT variant, (SELECT n FROM cut) - count(*) AS n_train, count(*) AS n_test,
       (SELECT strftime(cut, '%Y-%m-%d') FROM cut) AS split_date,
       round(avg(CAST((CAST(p > 0.5 AS INT) = label) AS INT)), 4) AS accuracy,
       round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
             / (sum(label) * (count(*) - sum(label))), 4) AS roc_auc,
       round(avg(net) / stddev_pop(net) * sqrt(252), 3) AS strategy_sharpe
FROM fixed_test GROUP BY variant
""", "fixed_test", "cut")

LONG = f"SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp FROM "
LIVE_OUT = f"SELECT entity_id, event_timestamp, {r6_all()} FROM "
PIT_TOTALS = "SELECT entity_id, count(*) AS checked, count(*) FILTER ({bad}) AS violations FROM {source} GROUP BY 1"
UPDATES = (
    "SELECT entity_id AS ticker, " + ", ".join(f"{even6(f)} AS {f}" for f in F4) + ", "
    "strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS iso_time FROM "
)
TRADES = """
SELECT ticker, price, volume, date_trunc('milliseconds', ts) AS "timestamp", 'trades' AS source
FROM (SELECT event_type AS ticker, * EXCLUDE (event_type, user_id) FROM ticks WHERE event_type <> 'error'
      UNION ALL
      SELECT 'u' || user_id, * EXCLUDE (event_type, user_id) FROM ticks WHERE event_type <> 'error')
"""
STATUS = """
SELECT user_id AS ticker, arg_max(price, row(ts, event_id)) AS last_price,
       arg_max(volume, row(ts, event_id)) AS last_volume, max(ts) AS last_update,
       count(*) AS tick_count,
       least(50, count(DISTINCT time_bucket(INTERVAL '3 hours', ts)) - 1) AS bars_accumulated,
       count(DISTINCT time_bucket(INTERVAL '3 hours', ts)) - 1 >= 21 AS features_ready
FROM ticks GROUP BY 1
"""


FLUSHED = """
WITH RECURSIVE t AS (
  SELECT event_type AS ticker, ts, event_id, price, volume,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM (SELECT event_type, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)),
firsts AS (SELECT ticker, ts, min(rn) AS rn FROM t GROUP BY ALL),
succ AS (
  SELECT a.ticker, a.ts, next_ts, b.rn AS next_rn
  FROM (SELECT ticker, ts, min(ts) OVER (PARTITION BY ticker ORDER BY ts
                                         RANGE BETWEEN INTERVAL 3 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts
        FROM firsts) a JOIN firsts b ON a.ticker = b.ticker AND b.ts = next_ts),
chain AS (
  SELECT ticker, ts, 0::BIGINT AS rn FROM firsts WHERE rn = 1
  UNION ALL
  SELECT c.ticker, s.next_ts, s.next_rn FROM chain c JOIN succ s ON c.ticker = s.ticker AND c.ts = s.ts),
spans AS (
  SELECT ticker, ts AS since, rn AS low, lead(rn) OVER (PARTITION BY ticker ORDER BY rn) AS high FROM chain)
SELECT t.ticker, since, arg_min(price, t.rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, t.rn) AS close,
       sum(volume) AS volume, max(t.ts) AS "timestamp", count(*) AS ticks
FROM spans JOIN t ON t.ticker = spans.ticker AND t.rn > spans.low AND t.rn <= spans.high
GROUP BY t.ticker, since
"""


def oracle() -> dict[str, str]:
    pit_wide_revised = with_(wide("pit_revised"), "pit_revised")
    correct_long = with_(LONG + "correct", "correct")
    leaked_long = with_(LONG + "leaked", "leaked")
    all_bars = with_("SELECT * FROM bars", "bars")
    live_rows = with_(LIVE_OUT + "live", "live")
    report_columns = ", ".join(
        f"{r6(c)} AS {c}" for c in ("offline_correct", "offline_leaked", "online")
    )
    stats = " UNION ALL ".join(
        f"SELECT '{f}' AS feature_name, {r6(f'avg({f})')} AS mean, "
        f"{r6(f'stddev_pop({f})')} AS sd, count(*) AS n FROM train"
        for f in F4
    )
    return {
        "raw_bars": all_bars,
        "raw_bars_split": all_bars,
        "raw_bars_roundtrip": all_bars,
        "ohlcv_bars": with_("SELECT * FROM bars3h", "bars3h"),
        "ohlcv_bars_per_user": with_(ohlcv("user_id", "'1 day'"), "ticks"),
        "polled_quote_bars": with_(
            ohlcv("event_type", "'3 hours'", "quotes", "quote_minute"), "quotes"
        ),
        "parse_trades": with_(TRADES, "ticks"),
        "stream_trades": with_(TRADES, "ticks"),
        "subscribed_ticks": with_("""
SELECT 'U' || user_id AS ticker, price, volume, ts AS "timestamp", event_id FROM ticks
WHERE CAST(user_id AS BIGINT) IN
        (SELECT c_custkey FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY')
  AND CAST(user_id AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""", "ticks"),
        "subscribed_over_time": SUBSCRIBED,
        "subscribed_over_time_split": SUBSCRIBED,
        "business_day_gaps": with_(BUSINESS_DAYS, "bars", "days"),
        "latest_quote_per_ticker": with_("""
SELECT user_id AS ticker, arg_max(price, row(ts, event_id)) AS price,
       arg_max(volume, row(ts, event_id)) AS volume, max(ts) AS "timestamp", count(*) AS tick_count
FROM ticks GROUP BY 1
""", "ticks"),
        "ticker_status": with_(STATUS, "ticks"),
        "stream_status": with_(STATUS, "ticks"),
        "total_ticks": "SELECT count(DISTINCT user_id) AS tickers, count(*) AS total_ticks FROM events",
        "snapshot_baseline": with_(f"SELECT {BASE_COLUMNS} FROM pull2", "pull2"),
        "vintage_diff": with_("SELECT * FROM vintages", "vintages"),
        "vintage_counts": with_("""
SELECT ticker, count(*) AS stored, count(*) FILTER (revised) AS revised FROM vintages GROUP BY 1
""", "vintages"),
        "vintage_store": with_(f"""
SELECT p.ticker, p.date, p.open, p.high, p.low, {GAPPED} AS close, p.volume, {GAPPED} AS first_print_close,
       false AS revised, p.date AS knowledge_date
FROM pull1 p
UNION ALL
SELECT p1.ticker, p1.date, p1.open, p1.high, p1.low, p2.close, p1.volume, p1.first,
       true, TIMESTAMP '{PULL_DATE}'
FROM (SELECT p.*, {GAPPED} AS first FROM pull1 p) p1 JOIN pull2 p2 USING (ticker, date)
WHERE p1.first IS NULL OR abs(p2.close - p1.first) > 1e-9
UNION ALL
SELECT {BASE_COLUMNS} FROM pull2 WHERE date >= TIMESTAMP '{SNAPSHOT_CUT}'
""", "pull1", "pull2"),
        "vintage_store_rerun": with_(f"""
SELECT {BASE_COLUMNS} FROM pull1
UNION ALL
SELECT p1.ticker, p1.date, p1.open, p1.high, p1.low, p2.close, p1.volume, p1.close, true, TIMESTAMP '{PULL_DATE}'
FROM pull1 p1 JOIN pull2 p2 USING (ticker, date) WHERE abs(p2.close - p1.close) > 1e-9
UNION ALL
SELECT {BASE_COLUMNS} FROM pull2 WHERE date >= TIMESTAMP '{SNAPSHOT_CUT}'
UNION ALL
SELECT p2.ticker, p2.date, p2.open, p2.high, p2.low, p3.c, p2.volume,
       CASE WHEN p2.date >= TIMESTAMP '{SNAPSHOT_CUT}' THEN p2.close ELSE p3.close END, true, TIMESTAMP '{LAST_PULL}'
FROM (SELECT ticker, date, close, CASE WHEN dayofmonth(date) = 4 THEN close * 1.02 ELSE close END AS c FROM daily) p3
JOIN pull2 p2 USING (ticker, date) WHERE abs(p3.c - p2.close) > 1e-9
""", "pull1", "pull2", "daily"),
        "pit_join_null_knowledge": with_(wide("pit_known"), "pit_known"),
        "vintage_features": with_(LONG + "vf", "vf"),
        "vintage_leaked_features": with_(LONG + "vl", "vl"),
        "features_correct_long": correct_long,
        "features_correct_split": correct_long,
        "features_leaked_long": leaked_long,
        "features_leaked_split": leaked_long,
        "features_pivot": with_(wide("correct", "entity_id, event_timestamp"), "correct"),
        "feature_store_roundtrip": with_(
            f"SELECT *, 'correct' AS variant FROM ({LONG} correct) UNION ALL "
            f"SELECT *, 'leaked' AS variant FROM ({LONG} leaked)", "correct", "leaked"
        ),
        "live_features_batch": live_rows,
        "live_features_split": live_rows,
        "seed_history": with_("""
SELECT ticker, date, first_print_close AS close, CAST(volume AS DOUBLE) AS volume,
       CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS INT) AS bars_back
FROM daily QUALIFY bars_back <= 50
""", "daily"),
        "bitemporal_violations": with_(PIT_TOTALS.format(
            bad="(CAST(entity_id AS INT) + dayofyear(event_timestamp)) % 11 = 0", source="correct"
        ), "correct"),
        "entity_list": "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS entity_id FROM lineitem",
        "pit_join_long": with_(f"""
SELECT entity_id, request_time, feature_name, {r6('value')} AS value, event_timestamp,
       knowledge_timestamp FROM pit
""", "pit"),
        "pit_join_wide": with_(wide("pit"), "pit"),
        "pit_join_revised": pit_wide_revised,
        "pit_join_bucketed": pit_wide_revised,
        "pit_join_stored": pit_wide_revised,
        "pit_join_stored_large": pit_wide_revised,
        "pit_join_few": with_(wide("pit_quarters"), "pit_quarters"),
        "pit_single": with_(f"""
SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp
FROM revised
WHERE entity_id = '{SINGLE_ENTITY}' AND knowledge_timestamp <= TIMESTAMP '{SINGLE_TIME}'
QUALIFY row_number() OVER (PARTITION BY feature_name
                           ORDER BY event_timestamp DESC, knowledge_timestamp DESC) = 1
""", "revised"),
        "leakage_audit": with_(
            PIT_TOTALS.format(bad="dayofyear(request_time) % 13 = 0", source="pit"), "pit"
        ),
        "leakage_audit_clean": with_(
            "SELECT entity_id, count(*) AS checked, CAST(0 AS BIGINT) AS violations "
            "FROM pit_revised GROUP BY 1", "pit_revised"
        ),
        "online_latest": with_(f"""
SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp
FROM revised
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name
                           ORDER BY knowledge_timestamp DESC, event_timestamp DESC) = 1
""", "revised"),
        "online_vectors": with_(wide("""(
SELECT * FROM revised
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name
                           ORDER BY knowledge_timestamp DESC, event_timestamp DESC) = 1)""",
                                     "entity_id"), "revised"),
        "online_asof": with_(wide("online_revised"), "online_revised"),
        "replay_counts": with_("""
SELECT feature_name, count(*) AS writes, min(knowledge_timestamp) AS first_knowledge,
       max(knowledge_timestamp) AS last_knowledge
FROM revised GROUP BY 1
""", "revised"),
        "asof_order_divergence": with_("""
SELECT feature_name, count(*) AS compared, count(*) FILTER (e.value <> k.value) AS differing
FROM pit_revised e JOIN online_revised k USING (entity_id, request_time, feature_name)
GROUP BY 1
""", "pit_revised", "online_revised"),
        "feature_update_events": with_(UPDATES + "live", "live"),
        "check_points": with_("SELECT * FROM points", "points"),
        "reconcile_report": with_(
            f"SELECT * REPLACE ({report_columns}) FROM report", "report"
        ),
        "reconcile_summary": with_(SUMMARY.format(source="report"), "report"),
        "reconcile_revised": with_(SUMMARY.format(source="report_revised"), "report_revised"),
        "labels": with_(
            "SELECT entity_id, request_time, label FROM next_day WHERE label IS NOT NULL", "next_day"
        ),
        "realized_returns": with_(
            f"SELECT entity_id, request_time, {r6('ret')} AS ret FROM next_day "
            "WHERE ret IS NOT NULL", "next_day"
        ),
        "training_matrix": with_(
            f"SELECT entity_id, request_time, label, {r6_all()} FROM m_correct", "m_correct"
        ),
        "aligned_keys": with_("SELECT entity_id, request_time FROM aligned", "aligned"),
        "aligned_matrix": with_(
            "SELECT c.entity_id, c.request_time, c.label, "
            + f"{r6('c.ret')} AS ret, "
            + ", ".join(
                f"{r6(f'{a}.{f}')} AS {f}__{v}"
                for a, v in (("c", "correct"), ("l", "leaked")) for f in F4
            )
            + " FROM m_correct c JOIN m_leaked l USING (entity_id, request_time)",
            "m_correct", "m_leaked",
        ),
        "split_cut": with_("SELECT * FROM cut", "cut"),
        "tick_time_quantile": "SELECT quantile_cont(ts, 0.7) AS cut, count(*) AS n FROM events",
        "time_split_counts": with_("""
SELECT 'train' AS part, count(*) AS n, min(request_time) AS first_time,
       max(request_time) AS last_time FROM train
UNION ALL
SELECT 'test', count(*), min(request_time), max(request_time) FROM test
""", "train", "test"),
        "standardize_stats": with_(stats, "train"),
        "strategy_pnl": with_(
            "SELECT entity_id, request_time, "
            + ", ".join(f"{r6(c)} AS {c}" for c in ("pos", "turnover", "cost", "net"))
            + " FROM pnl", "pnl"
        ),
        "turnover": with_(
            f"SELECT entity_id, count(*) AS n, {r6('sum(turnover)')} AS turnover "
            "FROM placed GROUP BY 1", "placed"
        ),
        "sharpe": with_(
            f"SELECT count(*) AS n, {r6('avg(net) / stddev_pop(net) * sqrt(252)')} AS sharpe FROM pnl",
            "pnl",
        ),
        "auc_rank": with_("""
SELECT count(*) AS n,
       round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * (count(*) - p)), 6) AS auc
FROM (SELECT label, avg(i) OVER (PARTITION BY p_up) AS r, sum(label) OVER () AS p
      FROM (SELECT label, p_up, row_number() OVER (ORDER BY p_up) AS i FROM scored))
GROUP BY p
""", "scored"),
        "accuracy": with_(
            f"SELECT count(*) AS n, {r6('avg(CAST((CAST(p_up > 0.5 AS INT) = label) AS INT))')} "
            "AS accuracy FROM scored", "scored"
        ),
        "score_fixed_online": with_(scored_vectors("latest_correct", "online"), "latest_correct"),
        "score_fixed_leaked": with_(scored_vectors("latest_leaked", "leaked"), "latest_leaked"),
        "backtest_fixed": with_("SELECT * FROM fixed_result", "fixed_result"),
        "phantom_edge_fixed": with_("""
SELECT round_even(l.accuracy - c.accuracy, 4) AS accuracy, round_even(l.roc_auc - c.roc_auc, 4) AS roc_auc,
       c.strategy_sharpe AS sharpe_correct, l.strategy_sharpe AS sharpe_leaked
FROM fixed_result c, fixed_result l WHERE c.variant = 'correct' AND l.variant = 'leaked'
""", "fixed_result"),
        "logistic_slope": with_(
            f"SELECT unnest({['intercept', *F4]!r}) AS weight, 0.0::DOUBLE AS slope FROM (SELECT count(*) FROM m_correct)",
            "m_correct",
        ),
        "stream_bars": with_(
            f"SELECT * FROM bars3h WHERE bar_start + INTERVAL 3 HOUR <= {CLOSED}", "bars3h"
        ),
        "flush_bars": FLUSHED,
        "flush_bars_split": FLUSHED,
        "stream_features_seeded": with_(
            LIVE_OUT.replace("event_timestamp,", "event_timestamp, knowledge_timestamp,") + f"""live15m_known
WHERE event_timestamp >= (SELECT date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) FROM ticks)""",
            "live15m_known", "ticks",
        ),
        "stream_late_rows": with_("""
SELECT event_type AS ticker, price, volume, ts AS "timestamp", event_id,
       coalesce(time_bucket(INTERVAL 3 HOUR, ts) + INTERVAL 3 HOUR <= mark - INTERVAL 1 HOUR, false) AS late
FROM (SELECT t.*, (SELECT max(a.ts) FROM arrived a WHERE a.arrival < t.arrival) AS mark FROM arrived t)
""", "arrived"),
        "stream_bars_flushed": with_("SELECT * FROM bars3h", "bars3h"),
        "stream_features": with_(
            LIVE_OUT.replace("event_timestamp,", "event_timestamp, knowledge_timestamp,") + "live15m_known",
            "live15m_known",
        ),
        "stream_update_events": with_(
            UPDATES.replace("event_timestamp", "knowledge_timestamp") + "live15m_known", "live15m_known"
        ),
        "stream_live_latest": with_(f"""
SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp
FROM live15m_log
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY knowledge_timestamp DESC) = 1
""", "live15m_log"),
        "stream_two_providers": with_(TWO_PROVIDERS, "two_providers"),
        "two_provider_bars": with_(TWO_PROVIDERS, "two_providers"),
        "stream_subscribed": SUBSCRIBED,
        "stream_history": with_("""
SELECT feature_name, count(*) AS writes, min(knowledge_timestamp) AS first_knowledge,
       max(knowledge_timestamp) AS last_knowledge
FROM revised GROUP BY 1
""", "revised"),
        "stream_latest_bucketed": with_(f"""
SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp
FROM revised
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name
                           ORDER BY knowledge_timestamp DESC, event_timestamp DESC) = 1
""", "revised"),
        "stream_latest": with_(f"""
SELECT entity_id, feature_name, {r6('value')} AS value, event_timestamp, knowledge_timestamp
FROM revised
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_name
                           ORDER BY knowledge_timestamp DESC, event_timestamp DESC) = 1
""", "revised"),
    }
