"""DuckDB definitions of the domain tables, written independently of the Spark ones."""

LINE = """SELECT l.*, p.p_brand AS symbol, CAST(l_shipdate AS DATE) AS day,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_c, CAST(round(l_discount * 100) AS BIGINT) AS disc_p
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""


def _bars(source: str, symbol: str, date: str) -> str:
    return f"""SELECT {symbol} AS symbol, {date} AS date,
  arg_min(l_extendedprice / l_quantity, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM {source} GROUP BY 1, 2"""


def _market(date: str) -> str:
    return f"""SELECT {date} AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close
  FROM lineitem GROUP BY 1"""


def _income(symbol: str) -> str:
    return f"""SELECT symbol, date, fiscal_year, period, rev AS revenue, rev - 0.6::DOUBLE * ext AS gross_profit,
  rev - 0.8::DOUBLE * ext AS operating_income, rev - 0.9::DOUBLE * ext AS net_income, rev - 0.75::DOUBLE * ext AS ebitda,
  (rev - 0.9::DOUBLE * ext) / shares AS eps_diluted, shares AS shares_diluted, rev_u
FROM (SELECT symbol, CAST(last_day(q + INTERVAL 2 MONTH) AS DATE) AS date, CAST(year(q) AS INTEGER) AS fiscal_year,
  'Q' || quarter(q) AS period, rev_u / 10000.0::DOUBLE AS rev, ext_u / 100.0::DOUBLE AS ext, qty::DOUBLE AS shares, rev_u
  FROM (SELECT {symbol} AS symbol, CAST(date_trunc('quarter', day) AS DATE) AS q,
    CAST(sum(ext_c * (100 - disc_p)) AS BIGINT) AS rev_u, CAST(sum(ext_c) AS BIGINT) AS ext_u,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lines GROUP BY 1, 2))"""


VIEWS = {
    "lines": LINE,
    "bars": _bars("lines", "symbol", "day"),
    "wbars": _bars("lines", "symbol", "CAST(date_trunc('week', day) AS DATE)"),
    "sbars": _bars("lineitem", "CAST(l_suppkey AS VARCHAR)", "CAST(date_trunc('month', l_shipdate) AS DATE)"),
    "market": _market("CAST(l_shipdate AS DATE)"),
    "wmarket": _market("CAST(date_trunc('week', l_shipdate) AS DATE)"),
    "profiles": """SELECT p_brand AS symbol, 'Maker ' || num AS name, 'S' || (num % 5) AS sector, 'I' || (num % 7) AS industry,
  CASE num % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'OTC' END AS exchange,
  CASE WHEN num % 2 = 0 THEN 'US' ELSE 'CA' END AS country, num % 4 <> 0 AS active, market_cap,
  lpad(CAST(num AS VARCHAR), 10, '0') AS cik, 'US' || lpad(CAST(num AS VARCHAR), 10, '0') AS isin,
  'C' || lpad(CAST(num AS VARCHAR), 8, '0') AS cusip
FROM (SELECT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num,
  CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS market_cap FROM part GROUP BY 1)""",
    "sprofiles": """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 'S' || (s_nationkey % 5) AS sector,
  CAST(CAST(round(s_acctbal * 100) AS BIGINT) + 200000 AS DOUBLE) / 100.0 AS market_cap FROM supplier""",
    "income": _income("symbol"),
    "balance": """SELECT symbol, date, fiscal_year, period, total_assets, 0.5::DOUBLE * total_assets AS total_equity,
  0.3::DOUBLE * total_assets AS total_debt, 0.2::DOUBLE * total_assets AS net_debt
FROM (SELECT symbol, date, fiscal_year, period,
  CAST(sum(rev_u) OVER (PARTITION BY symbol ORDER BY date) AS DOUBLE) / 10000.0 AS total_assets FROM income)""",
    "cashflow": """SELECT symbol, date, fiscal_year, period, 1.1::DOUBLE * net_income AS operating_cf, 0.8::DOUBLE * net_income AS free_cash_flow,
  -0.1::DOUBLE * net_income AS dividends_paid FROM income""",
    "earnings": """SELECT symbol, CAST(date + (10 + 7 * CAST(substr(period, 2, 1) AS INTEGER)) AS DATE) AS date, eps_diluted AS eps_actual,
  lag(eps_diluted) OVER w AS eps_estimated, revenue AS revenue_actual, lag(revenue) OVER w AS revenue_estimated
FROM income WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "grades": """SELECT symbol, CAST(o_orderdate AS DATE) AS date, 'C' || (o_custkey % 10) AS grading_company,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'upgrade' WHEN '5' THEN 'downgrade' ELSE 'maintain' END AS action
FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "macro": """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS series,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS value FROM orders GROUP BY 1, 2""",
    "spans": """SELECT symbol, min(date) AS first, max(date) AS last, max(date) < (SELECT max(date) FROM bars) AS left_early FROM bars GROUP BY 1""",
    "member_log": """SELECT symbol, first AS event_date, 'added' AS action FROM spans
UNION ALL SELECT symbol, last, 'removed' FROM spans WHERE left_early""",
    "member_now": "SELECT symbol FROM spans WHERE NOT left_early",
    "trades": """SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS trade_key, l_suppkey AS book,
  'sleeve' || (l_linenumber % 3) AS sleeve, CAST(year(day) AS INTEGER) AS window_year, day AS date,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action, symbol, l_quantity AS shares,
  l_extendedprice / l_quantity AS price, l_extendedprice AS amount, ext_c AS amount_cents,
  CASE WHEN l_returnflag <> 'R' THEN 'entry_signal' WHEN l_linenumber % 4 = 0 THEN 'stop_loss'
    WHEN l_linenumber % 4 = 1 THEN 'take_profit' WHEN l_linenumber % 4 = 2 THEN 'time_stop' ELSE 'backtest_end' END AS reason,
  CASE WHEN l_returnflag = 'R' THEN CAST(day - CAST(l_partkey % 90 + 1 AS INTEGER) AS DATE) END AS entry_date,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 90 + 1 AS INTEGER) END AS days_held,
  CASE WHEN l_returnflag = 'R' THEN CAST(4 - CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE) END AS pnl_pct,
  CASE WHEN l_returnflag = 'R' THEN ext_c * (4 - CAST(round(l_tax * 100) AS BIGINT)) END AS pnl_units,
  CASE WHEN l_returnflag = 'R' THEN CAST(ext_c * (4 - CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 10000.0 END AS pnl FROM lines""",
    "accounts": """SELECT CAST(n_regionkey AS VARCHAR) AS fund, o_custkey AS investor, CAST(o_orderdate AS DATE) AS date,
  o_orderkey AS flow_id, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "claims": """SELECT id, run, universe, CASE WHEN id % 2 = 0 THEN '{' || a || ',' || b || ',' || c || ',' || d || '}' ELSE '{' || d || ',' || c || ',' || b || ',' || a || '}' END AS test_spec,
  '{' || a || ',' || replace(b, ':', ':"') || '",' || c || ',' || d || '}' AS canon, p, o, h, y, status, regime_conditions, promotions, created FROM
  (SELECT *, '"conditioning_factor":"' || o || '"' AS a, '"horizon_days":' || h AS b, '"hypothesis":"' || y || '"' AS c, '"primary_factor":"' || p || '"' AS d FROM
   (SELECT c_custkey AS id, c_nationkey AS run, c_mktsegment AS universe, ['mom', 'rev', 'vol'][c_custkey % 3 + 1] AS p, ['rev', 'vol', 'mom', 'mom'][c_custkey % 4 + 1] AS o, ['21', '63', '0'][c_custkey % 7 % 3 + 1] AS h,
    CASE WHEN c_custkey % 11 = 0 THEN 'unclear' ELSE 'cheap_beats_expensive' END AS y, ['validated', 'rejected', 'candidate', 'regime_reversing', 'validated_conditional'][c_custkey % 5 + 1] AS status,
    CASE c_custkey % 6 WHEN 0 THEN 'holds in calm; REVERSES in hot' WHEN 1 THEN 'holds in calm' WHEN 2 THEN 'REVERSES in hot' END AS regime_conditions, c_custkey % 13 AS promotions, CAST(round(c_acctbal * 100) AS BIGINT) AS created FROM customer))""",
    "calendar": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM bars)",
    "scalendar": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM sbars)",
}
