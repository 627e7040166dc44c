"""Market tables derived from the driver's tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events documents pages labels".split()

#: Table -> SQL; tables in braces are base tables or other entries.
SQL = {
    "bars": """
WITH d AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS sd,
         SUM(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) AS h, SUM(l_quantity) AS q
  FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
e AS (
  SELECT k, CAST(h AS BIGINT) AS h, q, ROW_NUMBER() OVER (PARTITION BY k ORDER BY sd) AS n,
         SUM(((h % 4001) - 2000) * (1 + k % 4)) OVER (PARTITION BY k ORDER BY sd
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
  FROM d),
c AS (
  SELECT k, n, h, CAST(q * 1000 AS BIGINT) AS volume,
         CAST(ROUND(EXP(cs / CAST(100000 AS DOUBLE)) * 1000000) AS BIGINT) AS ct FROM e),
o AS (SELECT *, COALESCE(LAG(ct) OVER (PARTITION BY k ORDER BY n), 1000000) AS ot FROM c),
g AS (SELECT *, GREATEST(ot, ct) AS hi, LEAST(ot, ct) AS lo FROM o)
SELECT k AS ticker, CAST(n AS INT) AS session_no, DATE '2020-01-01' + CAST(n - 1 AS INT) AS trade_date,
       ot / CAST(10000 AS DOUBLE) AS open,
       (hi + CAST((hi * (h % 97) - (hi * (h % 97)) % 10000) / 10000 AS BIGINT)) / CAST(10000 AS DOUBLE) AS high,
       (lo - CAST((lo * (h % 89) - (lo * (h % 89)) % 10000) / 10000 AS BIGINT)) / CAST(10000 AS DOUBLE) AS low,
       ct / CAST(10000 AS DOUBLE) AS close, volume
FROM g
""",
    "articles": """
SELECT d.doc_id AS id, d.doc_id % s.n AS ticker,
       CASE CAST(SUBSTR(d.source, 4) AS INT) % 8 WHEN 0 THEN 'wsj' WHEN 1 THEN 'benzinga' WHEN 2 THEN 'reuters'
            WHEN 3 THEN 'yahoo' WHEN 4 THEN 'alphav' WHEN 5 THEN 'marketwatch' WHEN 6 THEN 'finviz' ELSE 'finnhub' END AS source,
       SUBSTR(d.text, 1, 80) AS headline, SUBSTR(d.text, 81, 300) AS body_snippet,
       CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CONCAT('http://news.example/', CAST(d.doc_id % 900 AS VARCHAR(20))) END AS url,
       e.ts AS published_at,
       CASE WHEN l.doc_id IS NULL THEN NULL ELSE (l.quality * 100 - l.toxic * 80 - 40 + d.n_chars % 21) / CAST(100 AS DOUBLE) END AS sentiment
FROM {documents} d CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) s
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
LEFT JOIN {events} e ON e.event_id = d.doc_id
""",
    # what articles say, without what their joins add
    "article_texts": """
SELECT doc_id AS id, SUBSTR(text, 1, 80) AS headline, SUBSTR(text, 81, 300) AS body_snippet FROM {documents}
""",
    "earnings_events": """
SELECT o_custkey % s.n AS ticker, CONCAT('Q-', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))) AS period,
       CAST(o_orderdate AS DATE) AS report_date,
       ((o_orderkey * 37) % 400 - 20) / CAST(100 AS DOUBLE) AS eps_estimate,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE ((o_orderkey * 41) % 420 - 20) / CAST(100 AS DOUBLE) END AS eps_actual,
       o_orderstatus = 'P' AS is_upcoming, o_orderkey AS seq
FROM {orders} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) s
""",
    "analyst_rating_events": """
SELECT event_id AS external_id, user_id % s.n AS ticker, ts AS published_at,
       CASE event_type WHEN 'signup' THEN 'Upgrades' WHEN 'error' THEN 'Downgrades' WHEN 'view' THEN 'Initiates'
            WHEN 'click' THEN 'Maintains' ELSE 'Reiterates' END AS action_company,
       CASE event_id % 3 WHEN 0 THEN 'Raises' WHEN 1 THEN 'Lowers' ELSE '' END AS action_pt,
       CASE event_id % 5 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Overweight' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Sell' ELSE 'Underperform' END AS rating_current
FROM {events} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) s
""",
    "option_quotes": """
SELECT b.ticker, b.trade_date, b.trade_date + x.dte AS expiration, x.dte, r.opt_right,
       CAST(ROUND(b.close * (1000 + 25 * m.i) / CAST(10 AS DOUBLE)) AS BIGINT) AS strike_cents, b.close AS underlying_price,
       (20 + 12 * (b.ticker % 4) + ABS(m.i) + CASE WHEN r.opt_right = 'P' THEN 2 ELSE 0 END + x.dte % 5) / CAST(100 AS DOUBLE) AS iv,
       (b.ticker * 31 + b.session_no * 17 + (m.i + 9) * 101 + x.dte * 7) % 1500 AS open_interest,
       (b.ticker * 13 + b.session_no * 5 + (m.i + 9) * 29 + x.dte * 3) % 120 AS volume
FROM {bars} b
CROSS JOIN (SELECT * FROM (VALUES (14), (35), (63), (91)) AS t(dte)) x
CROSS JOIN (SELECT * FROM (VALUES (-8), (-6), (-4), (-3), (-2), (-1), (0), (1), (2), (3), (4), (6), (8)) AS t(i)) m
CROSS JOIN (SELECT * FROM (VALUES ('C'), ('P')) AS t(opt_right)) r
WHERE b.session_no % 21 = 0
""",
    "option_chain": """
WITH a AS (
  SELECT *, CAST(ROUND(underlying_price * 100) AS BIGINT) AS sc, CAST(ROUND(iv * 100) AS BIGINT) AS ivp,
         CASE dte WHEN 14 THEN 20 WHEN 35 THEN 31 WHEN 63 THEN 42 ELSE 50 END AS sq FROM {option_quotes}),
b AS (
  SELECT *, CASE WHEN opt_right = 'C' THEN GREATEST(0, sc - strike_cents) ELSE GREATEST(0, strike_cents - sc) END AS intr,
         sc * ivp * sq * 4 AS num, 100000 + 40 * ABS(sc - strike_cents) * 100000 / sc AS den0 FROM a),
c AS (SELECT *, CAST(FLOOR(den0) AS BIGINT) AS den FROM b),
d AS (SELECT *, intr + CAST((num - num % den) / den AS BIGINT) AS mid FROM c),
e AS (SELECT *, 1 + CAST((mid * 3 - (mid * 3) % 100) / 100 AS BIGINT) AS half FROM d)
SELECT ticker, trade_date, expiration, dte, opt_right, strike_cents / CAST(100 AS DOUBLE) AS strike, underlying_price,
       GREATEST(0, mid - half) / CAST(100 AS DOUBLE) AS bid, (mid + half) / CAST(100 AS DOUBLE) AS ask,
       CASE WHEN open_interest % 11 = 0 THEN NULL ELSE iv END AS iv, open_interest, volume
FROM e
""",
    "predictions": """
SELECT ticker, trade_date AS prediction_date, session_no,
       ((ticker * 7919 + session_no * 104729) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS score, 5 AS horizon_days
FROM {bars} WHERE session_no % 3 = 0
""",
    "trades": """
SELECT o_orderkey AS id, o_custkey % s.n AS ticker, DATE '2020-01-01' + CAST(40 + o_orderkey % 380 AS INT) AS opened_date,
       CASE WHEN o_orderkey % 3 = 0 THEN 'BEARISH' ELSE 'BULLISH' END AS direction,
       CASE WHEN o_orderkey % 4 = 0 THEN 'STOCK' ELSE 'OPTION' END AS instrument_type,
       CASE WHEN o_orderkey % 5 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS entry_type, o_orderpriority AS strategy,
       CASE WHEN o_orderstatus = 'P' THEN 'OPEN' ELSE 'CLOSED' END AS status,
       1 + o_orderkey % 5 AS quantity, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 100 END AS multiplier,
       (100 + o_orderkey % 700) / CAST(100 AS DOUBLE) AS entry_value, (50 + (o_orderkey * 13) % 900) / CAST(100 AS DOUBLE) AS exit_value,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(100 + (o_orderkey * 3) % 900 AS DOUBLE) END AS planned_max_loss,
       2 + o_orderkey % 40 AS holding_days
FROM {orders} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) s
""",
    "macro_events": """
SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN 'FOMC minutes' WHEN 1 THEN 'Consumer price index' WHEN 2 THEN 'Core CPI' WHEN 3 THEN 'ADP employment'
         WHEN 4 THEN 'GDP second estimate' WHEN 5 THEN 'Retail sales' WHEN 6 THEN 'ISM services' WHEN 7 THEN 'Housing starts' WHEN 8 THEN 'Trade balance'
         WHEN 9 THEN '10-year auction' WHEN 10 THEN 'Nonfarm payroll' ELSE 'Town parade' END AS name,
       DATE '2020-01-01' + CAST(o_orderkey % 400 AS INT) AS event_date, CAST(o_orderkey % 24 AS INT) AS event_hour
FROM {orders} WHERE o_orderkey % 5 = 1
""",
    "rates": """
SELECT trade_date, CASE WHEN SUM(volume) % 17 = 0 THEN NULL ELSE (250 + SUM(volume * 3) % 260) / CAST(100 AS DOUBLE) END AS two_year,
       (300 + SUM(volume * 7) % 200) / CAST(100 AS DOUBLE) AS ten_year FROM {bars} GROUP BY trade_date
""",
    "snapshots": """
SELECT s_suppkey AS ticker, (500 + (s_suppkey * 7919) % 20000) / CAST(100 AS DOUBLE) AS price, ((s_suppkey * 104729) % 801 - 400) / CAST(100 AS DOUBLE) AS change_pct,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE ((s_suppkey * 31) % 140) / CAST(10 AS DOUBLE) END AS short_ratio,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN ((s_suppkey * 13) % 30) / CAST(100 AS DOUBLE) ELSE CAST((s_suppkey * 13) % 30 AS DOUBLE) END AS short_pct_float,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (10 + (s_suppkey * 17) % 40) / CAST(10 AS DOUBLE) END AS analyst_mean_score,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (500 + (s_suppkey * 7907) % 26000) / CAST(100 AS DOUBLE) END AS target_price,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey * 29) % 95 - 5 END AS pe_ratio,
       CASE s_suppkey % 6 WHEN 0 THEN 'Strong Buy' WHEN 1 THEN 'buy' WHEN 2 THEN 'Hold' WHEN 3 THEN 'UNDERPERFORM' WHEN 4 THEN NULL ELSE 'not rated' END AS analyst_rating,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE ((s_suppkey * 23) % 250) / CAST(100 AS DOUBLE) END AS beta,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST((s_suppkey * 37) % 101 AS DOUBLE) END AS iv_rank,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN ((s_suppkey * 41) % 90) / CAST(100 AS DOUBLE) ELSE CAST((s_suppkey * 41) % 90 AS DOUBLE) END AS iv
FROM {supplier}
""",
    "contract_quotes": """
WITH a AS (
  SELECT b.ticker, b.trade_date, b.session_no, DATE '2020-01-01' + CAST(28 * x.j AS INT) AS expiration, CAST(28 * x.j - (b.session_no - 1) AS INT) AS dte, r.opt_right,
         40 + 5 * m.i AS strike, b.close AS underlying_price, CAST(ROUND(b.close * 100) AS BIGINT) AS sc, CAST(100 * (40 + 5 * m.i) AS BIGINT) AS kc, 20 + 12 * (b.ticker % 4) + m.i % 3 AS ivp
  FROM {bars} b
  CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22)) AS t(j)) x
  CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27), (28), (29), (30), (31), (32)) AS t(i)) m
  CROSS JOIN (SELECT * FROM (VALUES ('C'), ('P')) AS t(opt_right)) r
  WHERE b.session_no % 7 = 0 AND (b.ticker * 3 + b.session_no) % 35 <> 0 AND 28 * x.j - (b.session_no - 1) BETWEEN 5 AND 75 AND 40 + 5 * m.i BETWEEN b.close * 0.8 AND b.close * 1.2),
c AS (SELECT *, CASE WHEN opt_right = 'C' THEN GREATEST(0, sc - kc) ELSE GREATEST(0, kc - sc) END AS intr, sc * ivp * (15 + dte) AS num, 100000 + CAST((40 * ABS(sc - kc) * 1000 - (40 * ABS(sc - kc) * 1000) % sc) / sc AS BIGINT) * 100 AS den FROM a),
d AS (SELECT *, intr + CAST((num - num % den) / den AS BIGINT) AS mid FROM c),
e AS (SELECT *, 1 + CAST((mid * 3 - (mid * 3) % 100) / 100 AS BIGINT) AS half FROM d)
SELECT ticker, trade_date, expiration, dte, opt_right, CAST(strike AS DOUBLE) AS strike, underlying_price, GREATEST(0, mid - half) / CAST(100 AS DOUBLE) AS bid, (mid + half) / CAST(100 AS DOUBLE) AS ask,
       ivp / CAST(100 AS DOUBLE) AS iv, (ticker * 31 + session_no * 17 + kc) % 900 AS open_interest FROM e
""",
    "keywords": """
SELECT d.doc_id % s.n AS ticker, LOWER(TRIM(SUBSTR(d.text, 21, 3 + CAST(d.doc_id % 10 AS INT)))) AS term
FROM {documents} d CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) s WHERE LENGTH(TRIM(SUBSTR(d.text, 21, 3 + CAST(d.doc_id % 10 AS INT)))) > 1
""",
    "ticks": """
SELECT event_id, ts, user_id % 8 AS ticker, 100 + (event_id * 7919 % 401 - 200) / CAST(100 AS DOUBLE) AS price,
       CAST(1 + event_id % 50 AS BIGINT) * 10 AS size FROM {events}
""",
}


#: Entry -> base table -> column -> all that the entry reads of it: else the whole column is moved and cut afterwards.
READS = {"articles": {"documents": {"text": "SUBSTR(text, 1, 380)"}}, "bars": {"lineitem": {"l_shipdate": "CAST(l_shipdate AS DATE)"}}}
#: Entry -> base table -> column by which it is dealt first: groups and windows of the entry, and what comes after by the same key, then
#: stay where they are, and rows are moved once.
DEALT = {"bars": {"lineitem": "l_suppkey"}}


def _read(df: DataFrame, entry: str, name: str) -> DataFrame:
    d = df.withColumns({c: F.expr(e) for c, e in READS.get(entry, {}).get(name, {}).items()})
    by = DEALT.get(entry, {}).get(name)
    return d.repartition(by) if by else d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a market table over the base tables of ``sf_dir``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{k: _read(table(spark, sf_dir, k), name, k) for k in set(re.findall(r"{(\w+)}", SQL[name]))})


def inline(sql: str) -> str:
    """Plain SQL over the base tables: every market table in braces becomes a subquery."""
    return re.sub(r"{(\w+)}", lambda m: m[1] if m[1] in BASE else f"({inline(SQL[m[1]])})", sql)
