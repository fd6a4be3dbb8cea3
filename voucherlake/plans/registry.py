"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# The mapping of fixtures.py, restated in SQL.
LINES_SQL = """
lines AS (
  SELECT 'unit_' || l_orderkey AS unit_id, l_linenumber AS line_no, '*商品*' || l_partkey AS item_name,
         CAST(l_quantity AS DECIMAL(28,12)) AS quantity, line_amount,
         CAST(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INTEGER) AS VARCHAR) || '%' AS tax_rate,
         line_tax_amount, CAST(line_amount + line_tax_amount AS DECIMAL(18,2)) AS line_total_with_tax,
         l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate
  FROM (SELECT *, CAST(round(line_amount * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS line_tax_amount
        FROM (SELECT *, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
                        AS DECIMAL(18,2)) AS line_amount FROM lineitem))
)"""

INVOICES_SQL = """
invoices AS (
  SELECT 'unit_' || o_orderkey AS unit_id, '/in/' || o_orderpriority || '/order_' || o_orderkey || '.xml' AS source_file,
         'standard-invoice' AS schema_id, 'digital-invoice-form' AS variant_id,
         lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS invoice_no, CAST(o_orderdate AS DATE) AS invoice_date,
         c_name AS buyer_name, '91B' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS buyer_tax_id,
         'Seller ' || o_orderpriority AS seller_name,
         '91S' || lpad(substr(o_orderpriority, 1, 1), 15, '0') AS seller_tax_id,
         '电子发票（普通发票）' AS invoice_type,
         amount_total, CAST(total_with_tax - amount_total AS DECIMAL(18,2)) AS tax_total, total_with_tax,
         CASE WHEN o_orderstatus = 'P' THEN 'review_required' ELSE 'ready' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN 'missing buyer_tax_id; conflict seller_name' ELSE '通过当前字段校验。' END AS remark,
         0.95 AS confidence, o_orderkey, o_orderstatus, o_orderpriority
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS total_with_tax,
               CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100 / 113, 2) AS DECIMAL(18,2)) AS amount_total FROM orders)
  LEFT JOIN customer ON o_custkey = c_custkey
)"""

SUMS_SQL = """
sums AS (
  SELECT unit_id, count(*) AS n_lines,
         CAST(sum(line_amount) AS DECIMAL(18,2)) AS lines_amount,
         CAST(sum(line_tax_amount) AS DECIMAL(18,2)) AS lines_tax,
         CAST(sum(line_total_with_tax) AS DECIMAL(18,2)) AS lines_total
  FROM lines GROUP BY unit_id
)"""


def differs_sql(label: str, detail: str, header: str, total: str) -> str:
    """SQL of one reconciliation message."""
    return f"""CASE WHEN {header} IS NULL OR {total} IS NULL THEN '待复核：{label}或{detail}缺失'
      WHEN {header} <> {total} THEN '待复核：{label}与{detail}不一致，{label} ' || {header} || '，明细合计 ' || {total}
           || '，差额 ' || CAST({total} - {header} AS DECIMAL(18,2)) END"""


RECONCILED_SQL = f"""
reconciled AS (
  SELECT i.*, s.n_lines, s.lines_amount, s.lines_tax, s.lines_total,
    CASE WHEN s.n_lines IS NULL THEN '待复核：明细缺失' ELSE concat_ws('；',
      {differs_sql('汇总金额', '明细金额合计', 'amount_total', 'lines_amount')},
      {differs_sql('汇总税额', '明细税额合计', 'tax_total', 'lines_tax')},
      {differs_sql('汇总价税合计', '明细价税合计', 'total_with_tax', 'lines_total')}) END AS reconciliation_remark
  FROM invoices i LEFT JOIN sums s USING (unit_id)
)"""


def key_sql(prefix: str, *parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}' || substr(sha1({joined}), 1, 20)"
