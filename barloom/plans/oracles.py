"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Recurrences are written as recursive queries here and as closed forms in Spark, so
an algebra slip cannot pass both.
"""

from __future__ import annotations

from barloom.operators.evaluate import Cell
from barloom.plans.queries import (
    GRID,
    HOLD_COACH,
    HOLD_WINDOW,
    MART_COACH,
    MART_WINDOW,
    RATIO_COACH,
    RATIO_WINDOW,
    RISING_COACH,
    RISING_WINDOW,
    SWEEP,
)
from barloom.schemas import DIRECTIONAL_VALUES

BARS = """
bars AS (
  SELECT concat('S', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS date,
    arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
    sum(l_quantity) AS volume, arg_max(p, k) * (1 - arg_max(l_discount, k)) AS adjclose
  FROM (SELECT *, l_extendedprice / l_quantity AS p,
          (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
  GROUP BY 1, 2)"""

SPX = """
spx AS (
  SELECT 'SPX' AS symbol, CAST(o_orderdate AS DATE) AS date,
    arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
    CAST(count(*) AS DOUBLE) AS volume, arg_max(o_totalprice, o_orderkey) AS adjclose
  FROM orders GROUP BY 2)"""

UNIVERSE = """
universe AS (
  SELECT concat('S', s_suppkey) AS ticker, concat('N', s_nationkey) AS code,
    s_name AS name, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""

HISTORY = """
history AS (SELECT * FROM bars WHERE date < DATE '2001-01-01'),
delta AS (SELECT * REPLACE (volume + 1 AS volume) FROM bars WHERE date >= DATE '2000-12-01')"""

SHORT = """
counts AS (SELECT symbol, count(*) AS bars FROM bars WHERE date >= DATE '2000-01-01' GROUP BY symbol),
short AS (SELECT * FROM counts WHERE bars < (SELECT bars FROM counts WHERE symbol = 'S1'))"""

STALE = """
partly AS (SELECT * FROM history WHERE CAST(substr(symbol, 2) AS INTEGER) % 7 <> 0),
ends AS (SELECT min(date) AS first, max(date) AS last FROM history),
stale AS (
  SELECT u.ticker AS symbol, coalesce(max(h.date), any_value(first)) AS max_date,
    coalesce(min(h.date), any_value(first)) AS min_date
  FROM universe u CROSS JOIN ends LEFT JOIN partly h ON u.ticker = h.symbol
  GROUP BY 1 HAVING max(h.date) IS NULL OR max(h.date) <> any_value(last))"""

ADJUSTED = """
adjusted AS (
  SELECT *, adjclose / close * open AS adjopen, adjclose / close * high AS adjhigh,
    adjclose / close * low AS adjlow FROM bars)"""

# The chain of day-over-day ratios, where Spark divides by the first value.
NORMALIZED = """
chained AS (
  SELECT *, product(step) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS normclose
  FROM (SELECT *, coalesce(adjclose / lag(adjclose) OVER (PARTITION BY symbol ORDER BY date), 1.0) AS step
        FROM adjusted)),
normalized AS (
  SELECT * EXCLUDE (step), normclose / adjclose * adjopen AS normopen,
    normclose / adjclose * adjhigh AS normhigh, normclose / adjclose * adjlow AS normlow
  FROM chained)"""

RELATIVE = """
relative AS (
  SELECT a.symbol, a.date,
    a.adjopen / s.open * 10000 AS open, a.adjhigh / s.open * 10000 AS high,
    a.adjlow / s.open * 10000 AS low, a.adjclose / s.open * 10000 AS close,
    0.0::DOUBLE AS volume
  FROM adjusted a JOIN spx s ON a.date = s.date
  WHERE s.date > (SELECT min(date) FROM spx)),
rel AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
    count(*) OVER (PARTITION BY symbol) AS n
  FROM relative)"""

MEAN_INDEX = """
mean_index AS (
  SELECT 'IDXBIN' AS symbol, date, avg(normopen) AS normopen, avg(normhigh) AS normhigh,
    avg(normlow) AS normlow, avg(normclose) AS normclose, avg(volume) AS volume
  FROM normalized GROUP BY date)"""


def q(value: str, digits: int = 4) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"floor(({value}) * {scale} + 0.500001::DOUBLE) / {scale}"


def q_as(*names: str, digits: int = 4) -> str:
    return ", ".join(f"{q(name, digits)} AS {name}" for name in names)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE" if recursive else "WITH") + ",".join(parts) + "\n"


def average(n: int, price: str = "close") -> str:
    return (
        f"CASE WHEN i < {n - 1} THEN -1.0 ELSE avg({price}) OVER (PARTITION BY symbol "
        f"ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    )


MOVEMENT = """
movement AS (
  SELECT symbol, date, i, n,
    CASE WHEN i = 0 THEN -1.0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN i = 0 THEN -1.0 WHEN high - ph > pl - low THEN greatest(high - ph, 0) ELSE 0 END AS pdm1,
    CASE WHEN i = 0 THEN -1.0 WHEN pl - low > high - ph THEN greatest(pl - low, 0) ELSE 0 END AS mdm1
  FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
        FROM rel WINDOW w AS (PARTITION BY symbol ORDER BY date)))"""

ADX = (
    MOVEMENT
    + """,
smoothed(symbol, i, tr14, pdm14, mdm14) AS (
  SELECT symbol, 14, sum(tr), sum(pdm1), sum(mdm1) FROM movement
  WHERE n >= 28 AND i BETWEEN 1 AND 14 GROUP BY symbol
  UNION ALL
  SELECT m.symbol, m.i, s.tr14 - s.tr14 / 14 + m.tr, s.pdm14 - s.pdm14 / 14 + m.pdm1,
    s.mdm14 - s.mdm14 / 14 + m.mdm1
  FROM smoothed s JOIN movement m ON m.symbol = s.symbol AND m.i = s.i + 1),
directions AS (
  SELECT symbol, i, tr14, pdm14, mdm14, pdi14, mdi14, abs(pdi14 - mdi14) AS di14diff,
    pdi14 + mdi14 AS di14sum,
    coalesce(abs(pdi14 - mdi14) / nullif(pdi14 + mdi14, 0), 0) * 100 AS dx
  FROM (SELECT *, coalesce(pdm14 / nullif(tr14, 0), 0) * 100 AS pdi14,
          coalesce(mdm14 / nullif(tr14, 0), 0) * 100 AS mdi14 FROM smoothed)),
averaged(symbol, i, adx) AS (
  SELECT symbol, 27, avg(dx) FROM directions WHERE i BETWEEN 14 AND 27 GROUP BY symbol
  UNION ALL
  SELECT d.symbol, d.i, (a.adx * 13 + d.dx) / 14
  FROM averaged a JOIN directions d ON d.symbol = a.symbol AND d.i = a.i + 1),
adx AS (
  SELECT m.symbol, m.date, m.tr, m.pdm1, m.mdm1, coalesce(d.tr14, -1) AS tr14,
    coalesce(d.pdm14, -1) AS pdm14, coalesce(d.mdm14, -1) AS mdm14, coalesce(d.pdi14, -1) AS pdi14,
    coalesce(d.mdi14, -1) AS mdi14, coalesce(d.di14diff, -1) AS di14diff,
    coalesce(d.di14sum, -1) AS di14sum, coalesce(d.dx, -1) AS dx, coalesce(a.adx, -1) AS adx
  FROM movement m LEFT JOIN directions d ON m.symbol = d.symbol AND m.i = d.i
    LEFT JOIN averaged a ON m.symbol = a.symbol AND m.i = a.i
  WHERE m.n >= 28)"""
)

DUAL = f"""
dual AS (
  SELECT symbol, date, m1 AS close_mat1, m2 AS close_mat2, m1 / m2 AS mat_dual
  FROM (SELECT symbol, date, {average(8)} AS m1, {average(20)} AS m2 FROM rel) WHERE m2 > 0)"""

BREAKS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
    count(*) OVER (PARTITION BY symbol) AS n FROM bars),
flags AS (
  SELECT *, high >= max(high) OVER (w ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)
    AND high - low >= max(high - low) OVER (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS flag,
    lead(close, 1) OVER w AS c1, lead(close, 2) OVER w AS c2, lead(close, 3) OVER w AS c3,
    lead(close, 4) OVER w AS c4, lead(close, 5) OVER w AS c5, lag(high) OVER w AS ph
  FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY date)),
gaps AS (
  SELECT *, CAST(pflag AND high - ph >= 0.01 AS INTEGER) AS label
  FROM (SELECT *, lag(flag) OVER (PARTITION BY symbol ORDER BY date) AS pflag FROM flags)
  WHERE i >= 40)"""


def days_after(base: str) -> str:
    return ", ".join(
        f"CASE WHEN label = 1 THEN CAST(trunc(c{k} / {base}) AS INTEGER) ELSE -1 END AS fwd{k}"
        for k in range(1, 6)
    )


RATED = """
rated AS (
  SELECT r.symbol, r.date, r.open, r.high, r.low, r.close, r.volume, d.mat_dual, a.adx, a.pdi14,
    a.mdi14, g.label AS gupbreak, s.open AS spxopen, s.high AS spxhigh, s.low AS spxlow,
    s.close AS spxclose, s.volume AS spxvolume,
    row_number() OVER (PARTITION BY r.symbol ORDER BY r.date) - 1 AS i
  FROM rel r LEFT JOIN dual d ON r.symbol = d.symbol AND r.date = d.date
    LEFT JOIN adx a ON r.symbol = a.symbol AND r.date = a.date
    LEFT JOIN gaps g ON r.symbol = g.symbol AND r.date = g.date
    LEFT JOIN spx s ON r.date = s.date
  WHERE d.mat_dual > 0 AND a.adx > 0)"""

MART = (BARS, SPX, ADJUSTED, RELATIVE, ADX, DUAL, BREAKS, RATED)


def labels(name: str, window: int, coach: int, unlabeled: int, extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT symbol, date1, date2, date3, adx,
    CASE WHEN date3 IS NULL THEN -1.0 ELSE ahead END AS act_diff,
    CAST(date3 IS NOT NULL AS INTEGER) AS is_labeled,
    CASE WHEN date3 IS NULL THEN {unlabeled} WHEN ahead >= 1.0 THEN 1 ELSE 0 END AS label{extra}
  FROM (SELECT *, lag(date, {window}) OVER w AS date1, date AS date2,
          lead(date, {coach}) OVER w AS date3, lead(close, {coach}) OVER w / close AS ahead
        FROM {"terms" if extra else "rated"} WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WHERE i >= {window})"""


HOLD = labels("hold", HOLD_WINDOW, HOLD_COACH, -1)

LABELS = "symbol, date1, date2, date3, " + q_as("act_diff") + ", is_labeled, label"

FIRST_SPAN = """
SELECT {columns}, {prob} AS prob FROM hold
WHERE date1 >= DATE '1995-04-01' AND date3 < DATE '2001-06-01' AND date2 > DATE '1999-01-01'
  AND is_labeled = 1"""

SECOND_SPAN = """
SELECT {columns}, {prob} AS prob FROM hold
WHERE date1 >= DATE '1995-10-01' AND date3 < DATE '2002-01-01' AND date2 > DATE '1999-06-01'
  AND is_labeled = 1"""

HELD = (
    HOLD,
    "\nheld AS ("
    + "\nUNION ALL".join(
        span.format(columns="*", prob="(dayofyear(date2) % 10) / 10.0") for span in (FIRST_SPAN, SECOND_SPAN)
    )
    + ")",
)

BREADTH_5 = """
breadth_5 AS (
  SELECT date, sum(CASE WHEN r > 1 THEN 1 ELSE 0 END)::BIGINT AS pos,
    sum(CASE WHEN r <= 1 THEN 1 ELSE 0 END)::BIGINT AS neg
  FROM (SELECT date, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) AS r FROM relative)
  GROUP BY date)"""

# One price table, looked up by a correlated subquery for each date of a prediction.
PRICED = """
day_prices AS (
  SELECT coalesce(b.symbol, v.symbol) AS sym, coalesce(b.date, v.date) AS day,
    b.adjclose AS whole_price, b.close AS raw_price, v.close AS relative_price
  FROM bars b FULL JOIN relative v USING (symbol, date))"""


def price_at(column: str, date: str) -> str:
    return f"(SELECT {column} FROM day_prices WHERE sym = held.symbol AND day = held.{date})"


def open_at(date: str) -> str:
    return f"(SELECT max(open) FROM spx WHERE spx.date = held.{date})"


ENRICHED = f"""
enriched AS (
  SELECT symbol, date1, date2, date3, prob, label, act_diff,
    {price_at("relative_price", "date2")} AS relclose1, {price_at("relative_price", "date3")} AS relclose2,
    {price_at("whole_price", "date2")} AS close1, {price_at("whole_price", "date3")} AS close2,
    {open_at("date2")} AS spxopen1, {open_at("date3")} AS spxopen2,
    (SELECT pos FROM breadth_5 WHERE breadth_5.date = held.date3) AS num_pos,
    (SELECT neg FROM breadth_5 WHERE breadth_5.date = held.date3) AS num_neg
  FROM held WHERE is_labeled = 1)"""

LEDGER = f"""
pairs AS (
  SELECT symbol, date, close, mat1, mat2,
    row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i
  FROM (SELECT symbol, date, close, {average(14)} AS mat1, {average(200)} AS mat2 FROM rel)
  WHERE mat2 > 0),
trades(symbol, i, signal, cash, stock) AS (
  SELECT symbol, 0, 0, 10000.0::DOUBLE, 0.0::DOUBLE FROM pairs WHERE i = 0
  UNION ALL
  SELECT p.symbol, p.i,
    CASE WHEN p.mat1 > p.mat2 THEN CASE WHEN t.cash > 0 THEN 1 ELSE 0 END
         WHEN t.stock > 0 THEN 2 ELSE 0 END,
    CASE WHEN p.mat1 > p.mat2 THEN 0 ELSE t.cash + t.stock * p.close END,
    CASE WHEN p.mat1 > p.mat2 THEN t.stock + t.cash / p.close ELSE 0 END
  FROM trades t JOIN pairs p ON p.symbol = t.symbol AND p.i = t.i + 1),
ledger AS (
  SELECT p.symbol, p.date, p.close, p.mat1, p.mat2, t.signal, t.cash, t.stock,
    t.cash + t.stock * p.close AS net
  FROM pairs p JOIN trades t ON p.symbol = t.symbol AND p.i = t.i)"""

def calendar_average(source: str, n: int, ahead: int = 0) -> str:
    """Rows of ``symbol, date, window, rows, close_mat`` over calendar days, by an interval frame."""
    frame = f"RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND INTERVAL {ahead} DAY FOLLOWING"
    return f"""
SELECT DISTINCT symbol, date, CAST({n} AS INTEGER) AS "window", rows, {q("value")} AS close_mat FROM (
  SELECT symbol, date, count(*) OVER w AS rows,
    CASE WHEN min(date) OVER (PARTITION BY symbol) > date - {n - 1} THEN -1.0::DOUBLE ELSE avg(close) OVER w END AS value
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date {frame}))"""


LINES = """
lines AS (
  SELECT concat('S', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS close
  FROM lineitem)"""

OHLC = ("open", "high", "low", "close")
BAR_Q = q_as(*OHLC, "volume", "adjclose", digits=6)
SPX_Q = q_as(*OHLC, "volume", "adjclose")
LEDGER_Q = (
    "symbol, date, "
    + q_as("close", "mat1", "mat2")
    + ", CAST(signal AS INTEGER) AS signal, "
    + q_as("cash", "stock", "net")
)


def checksum(features: str) -> str:
    weighted = f"list_sum(list_transform(range(1, len({features}) + 1), lambda k: {features}[k] * k))"
    return (
        f"CAST(len({features}) AS INTEGER) AS n_features, {q(f'{features}[1]')} AS first_feature, "
        f"{q(f'{features}[-1]')} AS last_feature, {q(weighted)} AS weighted_sum"
    )


def ratio_points(source: str, window: int, coach: int) -> str:
    """Rows with ``features`` (one-bar ratios) and ``ahead`` per anchor, as a subquery."""
    return f"""(
  SELECT *, list(step) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS f
  FROM (SELECT symbol, date, close, close / lag(close) OVER w AS step,
          lead(close, {coach}) OVER w AS later, lead(close, {coach}) OVER w / close AS ahead,
          row_number() OVER w - 1 AS i
        FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date)))"""


def round2(value: str) -> str:
    return f"floor(({value}) * 100 + 0.5) / 100"


TERMS = f"""
steps AS (
  SELECT *, {round2("close / lag(close) OVER w")} AS one, {round2("close / lag(close, 2) OVER w")} AS two,
    CASE WHEN adx > 30 AND pdi14 > mdi14 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strong,
    {round2("coalesce(pdi14 / nullif(mdi14, 0), 0)")} AS direction
  FROM rated WINDOW w AS (PARTITION BY symbol ORDER BY date)),
terms AS (
  SELECT *, list_concat(list_concat(
      list(one) OVER (w ROWS BETWEEN {MART_WINDOW - 1} PRECEDING AND CURRENT ROW),
      list(two) OVER (w ROWS BETWEEN {MART_WINDOW - 2} PRECEDING AND CURRENT ROW)),
    list_concat(
      flatten(list([strong, direction]) OVER (w ROWS BETWEEN {MART_WINDOW - 1} PRECEDING AND CURRENT ROW)),
      [{round2("mat_dual")}, direction, trunc(adx / 30), coalesce(gupbreak, 0)::DOUBLE])) AS f
  FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def sweep(wanted: list[Cell] = SWEEP) -> str:
    cells = ", ".join(f"({c.threshold}, DATE '{c.start}', DATE '{c.end}')" for c in wanted)

    def share(part: str, whole: str) -> str:
        return f"CASE WHEN n > 0 THEN {part}::DOUBLE / {whole} ELSE 0.0 END"

    return f""",
cells(threshold, start, "end") AS (VALUES {cells}),
counted AS (
  SELECT c.threshold, c.start, c."end",
    count(*) FILTER (prob >= threshold AND act_diff >= 1.0) AS acc,
    count(*) FILTER (prob >= threshold AND close2 / close1 >= 1.0) AS acc2,
    count(*) FILTER (prob >= threshold) AS n,
    count(*) FILTER (prob >= 0 AND act_diff >= 1.0) AS wacc,
    count(*) FILTER (prob >= 0 AND close2 / close1 >= 1.0) AS wacc2,
    count(*) FILTER (prob >= 0) AS wn
  FROM cells c LEFT JOIN enriched e ON e.date2 >= c.start AND e.date2 < c."end"
  GROUP BY 1, 2, 3)
SELECT {q("threshold")} AS threshold, start, "end", acc, acc2, n AS "all",
  {q(share("acc", "n"))} AS "precision", {q(share("wacc", "wn"))} AS base_precision,
  {q(share("acc2", "n"))} AS precision2, {q(share("wacc2", "wn"))} AS base_precision2
FROM counted"""


ORACLES: dict[str, str] = {
    "bars_daily": with_(BARS) + f"SELECT symbol, date, {BAR_Q} FROM bars",
    "benchmark_daily": with_(SPX) + f"SELECT symbol, date, {SPX_Q} FROM spx",
    "universe_list": with_(UNIVERSE) + "SELECT * FROM universe",
    "bar_line_scan": with_(BARS) + f"SELECT symbol, date, {BAR_Q} FROM bars WHERE day(date) <> 13",
    "symbol_feed_scan": with_(SPX) + f"SELECT symbol, date, {SPX_Q} FROM spx WHERE day(date) <> 13",
    "benchmark_refresh": with_(SPX) + f"SELECT symbol, date, {SPX_Q} FROM spx",
    "refresh_gate": with_(SPX)
    + """SELECT count(*) AS bars, max(date) AS last, reload FROM spx, (VALUES ('short'), ('whole')) v(reload) GROUP BY reload""",
    "candidates": with_(BARS, UNIVERSE, HISTORY, STALE) + "SELECT * FROM stale",
    **{
        name: with_(BARS, UNIVERSE, HISTORY, STALE)
        + f"SELECT symbol, date, {BAR_Q} FROM delta JOIN stale USING (symbol) WHERE date > max_date"
        for name in ("incremental_landing", "landed_new_bars")
    },
    "ledger_landing": with_(BARS)
    + f"""SELECT symbol, date, {BAR_Q},
  CASE WHEN CAST(substr(symbol, 2) AS INTEGER) % 5 = 0 OR date >= DATE '2001-01-01' THEN 2 ELSE 1 END AS run FROM bars""",
    "merge_upsert": with_(BARS, HISTORY)
    + f"""SELECT symbol, date, {BAR_Q} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY source DESC) AS r
  FROM (SELECT *, 0 AS source FROM history UNION ALL SELECT *, 1 FROM delta)
  WHERE date >= DATE '1900-01-01' AND symbol IS NOT NULL)
WHERE r = 1""",
    "partition_merge": with_(BARS, HISTORY)
    + f"""SELECT symbol, date, {BAR_Q}, date >= DATE '2000-12-01' AS rewritten FROM (
  SELECT * FROM history WHERE date < DATE '2000-12-01' UNION ALL SELECT * FROM delta)""",
    "coverage_summary": with_(BARS)
    + "SELECT symbol, max(date) AS max_date, count(date) AS bars FROM bars GROUP BY symbol",
    "completeness_short": with_(BARS, SHORT) + "SELECT symbol, bars FROM short",
    "completeness_check": with_(BARS, SHORT)
    + "SELECT count(*) AS short_symbols, count(*) <= 35 AS passed FROM short",
    "calendar_bounds": with_(SPX)
    + "SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS bars FROM spx",
    "latest_date": with_(SPX) + "SELECT max(date) AS date FROM spx",
    "calendar_parts": with_(BARS)
    + """SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
  CAST(date + INTERVAL 1 DAY AS DATE) AS next_day FROM bars""",
    "fixture_slice": with_(SPX)
    + f"""SELECT symbol, date, {SPX_Q} FROM spx
WHERE symbol = 'SPX' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""",
    "adjust_prices": with_(BARS, ADJUSTED)
    + f"""SELECT symbol, date, {q_as(*OHLC, "volume", "adjclose", "adjopen", "adjhigh", "adjlow")}
FROM adjusted""",
    "normalize_prices": with_(BARS, ADJUSTED, NORMALIZED)
    + f"""SELECT symbol, date, {
        q_as(*OHLC, "volume", "adjclose", "adjopen", "adjhigh", "adjlow",
             "normopen", "normhigh", "normlow", "normclose")
    } FROM normalized""",
    "relative_prices": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"SELECT symbol, date, {q_as(*OHLC, 'volume')} FROM relative",
    "relative_ratios": with_(BARS, ADJUSTED, NORMALIZED, MEAN_INDEX)
    + f"""SELECT a.symbol, a.date, {q("a.adjopen / m.normopen * 10000", 2)} AS rltopen,
  {q("a.adjhigh / m.normhigh * 10000", 2)} AS rlthigh, {q("a.adjlow / m.normlow * 10000", 2)} AS rltlow,
  {q("a.adjclose / m.normclose * 10000", 2)} AS rltclose,
  {q("a.volume / (m.volume + 0.00001) * 10000", 2)} AS rltvolume
FROM adjusted a JOIN mean_index m ON a.date = m.date""",
    "mean_index": with_(BARS, ADJUSTED, NORMALIZED, MEAN_INDEX)
    + f"SELECT symbol, date, {q_as('normopen', 'normhigh', 'normlow', 'normclose', 'volume')} FROM mean_index",
    "median_index": with_(
        BARS,
        ADJUSTED,
        NORMALIZED,
        """
steps AS (
  SELECT date, quantile_cont(r, 0.5) AS step, row_number() OVER (ORDER BY date) AS k
  FROM (SELECT date, coalesce(normclose / lag(normclose) OVER (PARTITION BY symbol ORDER BY date), 1.0) AS r
        FROM normalized WHERE volume > 0)
  GROUP BY date),
idx(k, date, close) AS (
  SELECT k, date, 1.0::DOUBLE FROM steps WHERE k = 1
  UNION ALL
  SELECT s.k, s.date, i.close * s.step FROM idx i JOIN steps s ON s.k = i.k + 1)""",
        recursive=True,
    )
    + f"SELECT 'IDXBIN2' AS symbol, date, {q('ln(close)')} AS log_close FROM idx",
    "breadth_daily": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + """SELECT date, count(*) FILTER (r >= 1) AS pos, count(*) FILTER (r < 1) AS neg
FROM (SELECT date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS r FROM relative)
WHERE r IS NOT NULL GROUP BY date""",
    "breadth_5bar": with_(BARS, SPX, ADJUSTED, RELATIVE, BREADTH_5)
    + "SELECT date, pos, neg FROM breadth_5",
    "sma_calendar": with_(LINES) + calendar_average("lines", 7) + "\nUNION ALL" + calendar_average("lines", 30),
    "sma_calendar_ahead": with_(BARS, SPX, ADJUSTED, RELATIVE) + calendar_average("relative", 10, 1),
    "sma": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"""SELECT symbol, date, {q("close")} AS close, CAST(w AS INTEGER) AS "window", {q("m")} AS close_mat FROM (
  SELECT symbol, date, close, 8 AS w, {average(8)} AS m FROM rel WHERE n >= 8
  UNION ALL SELECT symbol, date, close, 20, {average(20)} FROM rel WHERE n >= 20)""",
    "sma_pair": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"""SELECT symbol, date, {q("close")} AS close, {q(average(8))} AS mat1,
  CASE WHEN n >= 100 THEN {q(average(100))} END AS mat2 FROM rel WHERE n >= 8""",
    "sma_dual": with_(BARS, SPX, ADJUSTED, RELATIVE, DUAL)
    + f"SELECT symbol, date, {q_as('close_mat1', 'close_mat2', 'mat_dual')} FROM dual",
    "true_range_dm": with_(BARS, SPX, ADJUSTED, RELATIVE, MOVEMENT)
    + f"SELECT symbol, date, {q_as('tr', 'pdm1', 'mdm1')} FROM movement",
    "adx": with_(BARS, SPX, ADJUSTED, RELATIVE, ADX, recursive=True)
    + "SELECT symbol, date, "
    + q_as("tr", "pdm1", "mdm1", "tr14", "pdm14", "mdm14", "pdi14", "mdi14", "di14diff", "di14sum", "dx", "adx")
    + " FROM adx",
    "indicators_next_days": with_(BARS, SPX, ADJUSTED, RELATIVE, ADX, recursive=True)
    + f"""SELECT symbol, date, {q_as("close", "mat8", "mat20", *DIRECTIONAL_VALUES)} FROM (
  SELECT symbol, date, close, {average(8)} AS mat8, {average(20)} AS mat20 FROM rel)
JOIN adx USING (symbol, date) WHERE date >= DATE '2001-01-01'""",
    "upbreak": with_(BARS, BREAKS)
    + f"""SELECT symbol, date, {BAR_Q}, label, {days_after("close")}
FROM (SELECT *, CAST(flag AS INTEGER) AS label FROM flags WHERE n > 40 AND i >= 39 AND i < n - 5)""",
    "gupbreak": with_(BARS, BREAKS)
    + f"SELECT symbol, date, {BAR_Q}, label, {days_after('high')} FROM gaps",
    "crossover_ledger": with_(BARS, SPX, ADJUSTED, RELATIVE, LEDGER, recursive=True)
    + f"SELECT {LEDGER_Q} FROM ledger",
    "backtest_summary": with_(BARS, SPX, ADJUSTED, RELATIVE, LEDGER, recursive=True)
    + f"""SELECT symbol, {q("max(net)")} AS max, {q("min(net)")} AS min,
  count(*) FILTER (net > 10000.00000001) AS more_count, count(*) FILTER (net < 9999.99999999) AS less_count,
  max(date) AS date, {q("arg_max(net, date)")} AS net FROM ledger GROUP BY symbol""",
    "ledger_export": with_(BARS, SPX, ADJUSTED, RELATIVE, LEDGER, recursive=True)
    + f"SELECT {LEDGER_Q} FROM ledger",
    "symbol_ids": with_(BARS)
    + """SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id, count(*) OVER () AS id_num
FROM (SELECT DISTINCT symbol FROM bars)""",
    "feature_mart": with_(*MART, recursive=True)
    + f""", ids AS (
  SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id, count(*) OVER () AS id_num
  FROM (SELECT DISTINCT symbol FROM relative))
SELECT symbol, date, {q_as(*OHLC, "volume", "mat_dual", "adx", "pdi14", "mdi14")}, gupbreak,
  {q_as("spxopen", "spxhigh", "spxlow", "spxclose", "spxvolume")}, id, id_num
FROM rated LEFT JOIN ids USING (symbol)""",
    "lag_ratio_features": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + "\nUNION ALL\n".join(
        f"""SELECT symbol, date, {q("ahead")} AS label, '{part}' AS part, {checksum("f")}
FROM {ratio_points(f"(SELECT * FROM relative WHERE date {op} DATE '1998-06-30')", RATIO_WINDOW, RATIO_COACH)}
WHERE i >= {RATIO_WINDOW} AND ahead IS NOT NULL"""
        for part, op in [("train", "<="), ("check", ">")]
    ),
    "sma_ratio_features": with_(BARS, SPX, ADJUSTED, RELATIVE, DUAL)
    + f"""SELECT symbol, date, CASE WHEN later > close THEN 1.0 ELSE 0.0 END::DOUBLE AS label, {checksum("f")}
FROM {ratio_points("(SELECT symbol, date, mat_dual AS close FROM dual)", RISING_WINDOW, RISING_COACH)}
WHERE i >= {RISING_WINDOW} AND ahead IS NOT NULL""",
    "mart_features": with_(
        *MART, TERMS, labels("points", MART_WINDOW, MART_COACH, 1, extra=", f"), recursive=True
    )
    + f"SELECT {LABELS}, {checksum('f')} FROM points",
    "forward_labels": with_(*MART, HOLD, recursive=True) + f"SELECT {LABELS} FROM hold",
    "time_split": with_(
        *MART, labels("points", MART_WINDOW, MART_COACH, 1), recursive=True
    )
    + f"""SELECT {LABELS}, 'train' AS part FROM points
WHERE date1 >= DATE '1995-04-01' AND date3 < DATE '1999-01-01' AND is_labeled = 1
UNION ALL
SELECT {LABELS}, 'check' FROM points
WHERE date1 >= DATE '1995-04-01' AND (date3 IS NULL OR date3 < DATE '2001-06-01')
  AND date2 > DATE '1999-01-01'""",
    "buy_hold_baseline": with_(*MART, HOLD, recursive=True)
    + FIRST_SPAN.format(columns=LABELS, prob="1.0")
    + "\nUNION ALL"
    + SECOND_SPAN.format(columns=LABELS, prob="1.0"),
    "prediction_enrichment": with_(*MART, *HELD, BREADTH_5, PRICED, ENRICHED, recursive=True)
    + f"""SELECT symbol, date1, date2, date3, {q_as("prob")}, label, {
        q_as("act_diff", "relclose1", "relclose2", "spxopen1", "spxopen2", "close1", "close2")
    }, num_pos, num_neg FROM enriched""",
    "prediction_prices": with_(*MART, *HELD, PRICED, recursive=True)
    + f"""SELECT symbol, date1, date2, date3, label, {q_as("act_diff", "prob")},
  {q(price_at("raw_price", "date2"))} AS close1, {q(price_at("raw_price", "date3"))} AS close2,
  {q(open_at("date2"))} AS spxopen1, {q(open_at("date3"))} AS spxopen2
FROM held""",
    "precision_sweep": with_(*MART, *HELD, BREADTH_5, PRICED, ENRICHED, recursive=True).rstrip() + sweep(),
    "precision_grid": with_(*MART, *HELD, BREADTH_5, PRICED, ENRICHED, recursive=True).rstrip() + sweep(GRID),
    "label_violations": with_(*MART, *HELD, BREADTH_5, PRICED, ENRICHED, recursive=True)
    + """SELECT count(*) FILTER ((label = 1 OR day(date2) = 13) AND relclose2 < relclose1) AS violations
FROM enriched""",
    "top_predictions": with_(*MART, *HELD, recursive=True)
    + f"""SELECT symbol, date2, {q("act_diff")} AS prediction, label, 'top' AS "end"
FROM (SELECT * FROM held ORDER BY act_diff DESC, symbol, date2, label LIMIT 100)
UNION ALL
SELECT symbol, date2, {q("act_diff")}, label, 'bottom'
FROM (SELECT * FROM held ORDER BY act_diff, symbol, date2, label LIMIT 100)""",
    "open_predictions": with_(*MART, HOLD, recursive=True)
    + f"""SELECT symbol, date2, is_labeled, {q("adx / 100")} AS prob FROM hold
WHERE is_labeled = 0 AND date2 = (SELECT max(date2) FROM hold WHERE is_labeled = 0)
ORDER BY prob DESC, symbol LIMIT 10""",
    "regression_errors": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"""SELECT {q("avg((ahead - list_sum(f) / len(f)) ** 2)")} AS mse, {q("avg((ahead - 1) ** 2)")} AS naive_mse
FROM {ratio_points("relative", 5, 2)} WHERE i >= 5 AND ahead IS NOT NULL""",
    "column_cosine_similarity": f"""WITH cells AS (
  SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
dots AS (
  SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS dot
  FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2)
SELECT CAST(d.i AS INTEGER) AS i, CAST(d.j AS INTEGER) AS j,
  {q("d.dot / (sqrt(n.dot) * sqrt(m.dot))", 6)} AS similarity
FROM dots d JOIN dots n ON n.i = d.i AND n.j = d.i JOIN dots m ON m.i = d.j AND m.j = d.j
WHERE d.i < d.j AND d.dot <> 0""",
    "libsvm_roundtrip": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"""SELECT {q("ahead")} AS label, {checksum("f")} FROM {ratio_points("relative", 10, 5)}
WHERE i >= 10 AND ahead IS NOT NULL""",
    "partition_overwrite": with_(BARS, HISTORY)
    + f"""SELECT symbol, date, {BAR_Q}, 'early' AS par FROM history
UNION ALL SELECT symbol, date, {BAR_Q}, 'late' FROM delta WHERE date >= DATE '2001-01-01'""",
    "table_append": with_(*MART, HOLD, recursive=True)
    + FIRST_SPAN.format(columns=LABELS, prob="1.0")
    + "\nUNION ALL"
    + SECOND_SPAN.format(columns=LABELS, prob="1.0"),
    "table_switch": with_(BARS, HISTORY)
    + f"""SELECT symbol, date, {BAR_Q}, 'old' AS step, 0 AS more, 'before commit' AS ended FROM history
UNION ALL SELECT symbol, date, {BAR_Q}, 'new', 1, 'after commit' FROM bars""",
    "table_bootstrap": with_(BARS, HISTORY) + f"SELECT symbol, date, {BAR_Q}, 0::BIGINT AS rows_before FROM delta",
    "table_copy": with_(UNIVERSE)
    + "SELECT *, true AS few_files FROM universe, (VALUES ('source'), ('copy')) v(part)",
    "table_ddl": with_(BARS)
    + """SELECT symbol, count(*) AS bars, max(date) AS last, concat_ws(', ', 'symbol string', 'date date',
  'open double', 'high double', 'low double', 'close double', 'volume double', 'adjclose double') AS columns
FROM bars GROUP BY symbol""",
    "gbt_regression_errors": with_(BARS, SPX, ADJUSTED, RELATIVE)
    + f"""SELECT count(*) AS scored, {q("avg((ahead - 1) ** 2)")} AS naive_mse, true AS has_mse,
  count(*) AS followed, true AS same_mse
FROM {ratio_points("(SELECT * FROM relative WHERE date > DATE '1998-06-30')", RATIO_WINDOW, RATIO_COACH)}
WHERE i >= {RATIO_WINDOW} AND ahead IS NOT NULL""",
    "label_feature_index": with_(
        *MART, TERMS, labels("points", MART_WINDOW, MART_COACH, 1, extra=", f"), recursive=True
    ).rstrip()
    + """, within AS (SELECT * FROM points WHERE date1 >= DATE '1995-04-01'),
cells AS (SELECT unnest(range(len(f))) AS place, unnest(f) AS value FROM within),
few AS (
  SELECT place, value FROM (SELECT DISTINCT place, value FROM cells)
  QUALIFY count(*) OVER (PARTITION BY place) <= 4)
SELECT 'label' AS kind, -1 AS place, label::DOUBLE AS value,
  CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS INTEGER) AS code
FROM within GROUP BY label
UNION ALL
SELECT 'feature', CAST(place AS INTEGER), value,
  CAST(row_number() OVER (PARTITION BY place ORDER BY value <> 0, value) - 1 AS INTEGER) FROM few""",
    "kept_model_scores": with_(
        *MART, TERMS, labels("points", MART_WINDOW, MART_COACH, 1, extra=", f"), recursive=True
    )
    + f"SELECT {LABELS}, true AS same_score FROM points WHERE date2 = (SELECT max(date2) FROM points)",
    **{
        f"{kind}_classifier_scores": with_(
            *MART, TERMS, labels("points", MART_WINDOW, MART_COACH, 1, extra=", f"), recursive=True
        )
        + f"""SELECT {LABELS}, true AS is_probability, true AS agrees, true AS follows_from_nodes FROM points
WHERE date1 >= DATE '1995-04-01' AND date2 > DATE '1999-01-01'"""
        for kind in ("tree", "forest", "logistic")
    },
}
