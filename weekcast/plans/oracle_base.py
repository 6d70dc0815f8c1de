"""DuckDB text of the adapter tables, shared by every oracle query.

``with_tables(body)`` prefixes a query body with CTEs ``raw_sales``,
``features`` and ``stores`` (nation grain) derived from the pre-registered
test views, mirroring ``weekcast.sources.adapter``.
"""

from __future__ import annotations

ADAPTER_CTES = """
fact AS (
  SELECT CAST(s.s_nationkey + 1 AS INTEGER) AS store_id,
         CAST(CASE WHEN p.p_type LIKE 'ECONOMY%' THEN 1
                   WHEN p.p_type LIKE 'LARGE%' THEN 2
                   WHEN p.p_type LIKE 'MEDIUM%' THEN 3
                   WHEN p.p_type LIKE 'PROMO%' THEN 4
                   WHEN p.p_type LIKE 'SMALL%' THEN 5
                   ELSE 6 END AS INTEGER) AS dept_id,
         CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date,
         l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_linenumber
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
raw_sales AS (
  SELECT store_id, dept_id, date,
         CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS weekly_sales,
         weekofyear(date) IN (6, 36, 47, 52) AS is_holiday
  FROM fact GROUP BY store_id, dept_id, date
),
feat_agg AS (
  SELECT store_id, date,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS m_qty,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS m_tax,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS m_price,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS m_disc,
         CAST(SUM(CASE WHEN l_linenumber = 1 AND l_discount >= 0.05 THEN CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) END) AS DECIMAL(18,2)) AS markdown1,
         CAST(SUM(CASE WHEN l_linenumber = 2 AND l_discount >= 0.05 THEN CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) END) AS DECIMAL(18,2)) AS markdown2,
         CAST(SUM(CASE WHEN l_linenumber = 3 AND l_discount >= 0.05 THEN CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) END) AS DECIMAL(18,2)) AS markdown3,
         CAST(SUM(CASE WHEN l_linenumber = 4 AND l_discount >= 0.05 THEN CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) END) AS DECIMAL(18,2)) AS markdown4,
         CAST(SUM(CASE WHEN l_linenumber = 5 AND l_discount >= 0.05 THEN CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) END) AS DECIMAL(18,2)) AS markdown5
  FROM fact GROUP BY store_id, date
),
features AS (
  SELECT store_id, date,
         CAST(FLOOR(m_qty * 100.0) / 100.0 AS DECIMAL(5,2)) AS temperature,
         CAST(FLOOR((2.5 + 20.0 * m_tax) * 1000.0) / 1000.0 AS DECIMAL(5,3)) AS fuel_price,
         markdown1, markdown2, markdown3, markdown4, markdown5,
         CAST(FLOOR((126.0 + m_price / 1000.0) * 10000000.0) / 10000000.0 AS DECIMAL(12,7)) AS cpi,
         CAST(FLOOR((3.0 + 100.0 * m_disc) * 1000.0) / 1000.0 AS DECIMAL(5,3)) AS unemployment,
         weekofyear(date) IN (6, 36, 47, 52) AS is_holiday
  FROM feat_agg
  WHERE store_id % 7 <> 0 OR weekofyear(date) <> 10
),
stores AS (
  SELECT CAST(n_nationkey + 1 AS INTEGER) AS store_id,
         CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS store_type,
         CAST(30000 + (CAST(n_nationkey AS BIGINT) * 7919) % 190000 AS INTEGER) AS size
  FROM nation
)
"""


def with_tables(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` (a SELECT, possibly starting with more CTEs via ``extra_ctes``)."""
    ctes = ADAPTER_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return "WITH " + ctes + "\n" + body.strip()
