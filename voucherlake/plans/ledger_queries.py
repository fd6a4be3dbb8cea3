"""Queries: keys, reconciliation, ledger rows, roll-ups, checks, VAT, dedup, notices, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voucherlake.functions import keys as K
from voucherlake.functions import labels as L
from voucherlake.functions import money as M
from voucherlake.functions import review as R
from voucherlake.operators import checks, dedup, ledger, notices, ordered, pages, reports, routes, vat
from voucherlake.plans import fixtures as fx
from voucherlake.rules.catalog import VAT_RULES
from voucherlake.session import staged
from voucherlake.plans.registry import INVOICES_SQL, LINES_SQL, RECONCILED_SQL, SUMS_SQL, key_sql, query

RUN = "run-1"
AT = "2024-01-02T03:04:05"
# A total order of lines inside an invoice.
LINE_ORDER = ["line_no", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "line_amount", "line_tax_amount"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)

INVOICE_KEY_SQL = key_sql("inv_", "seller_tax_id", "invoice_no", "invoice_date", "total_with_tax")


@query("stable_keys", f"""
WITH {LINES_SQL}, {INVOICES_SQL}, keyed AS (SELECT *, {INVOICE_KEY_SQL} AS invoice_key FROM invoices)
SELECT invoice_key, {key_sql('line_', 'invoice_key', 'line_no', 'item_name', 'l.line_amount', 'l.line_tax_amount')} AS invoice_line_key,
       {key_sql('draft_', "'run-1'", 'unit_id', 'line_no')} AS draft_row_id
FROM keyed JOIN lines l USING (unit_id)""")
def stable_keys(spark, sf):
    header = fx.invoices(spark, sf).select("unit_id", K.invoice_key(
        F.col("seller_tax_id"), F.col("invoice_no"), F.col("invoice_date"), F.col("total_with_tax")).alias("invoice_key"))
    return header.join(fx.lines(spark, sf), "unit_id").select(
        "invoice_key",
        K.line_key(F.col("invoice_key"), F.col("line_no"), F.col("item_name"), F.col("line_amount"),
                   F.col("line_tax_amount")).alias("invoice_line_key"),
        K.draft_row_id(F.lit(RUN), F.col("unit_id"), F.col("line_no")).alias("draft_row_id"))


@query("reconcile_invoices", f"""
WITH {LINES_SQL}, {INVOICES_SQL}, {SUMS_SQL}, {RECONCILED_SQL}
SELECT unit_id, amount_total, tax_total, total_with_tax, n_lines, lines_amount, lines_tax, lines_total,
       CASE WHEN reconciliation_remark = '' THEN '通过' ELSE '需复核' END AS reconciliation_status, reconciliation_remark
FROM reconciled""")
def reconcile_invoices(spark, sf):
    return ledger.reconcile(fx.invoices(spark, sf), fx.lines(spark, sf)).select(
        "unit_id", "amount_total", "tax_total", "total_with_tax", "n_lines", "lines_amount", "lines_tax",
        "lines_total", "reconciliation_status", "reconciliation_remark")


REVIEW_HEAD_SQL = "'请对照原票补充购买方纳税人识别号；请对照原票确认销售方名称，当前识别结果有冲突。'"

LEDGER_SQL = f"""
WITH {LINES_SQL}, {INVOICES_SQL}, {SUMS_SQL}, {RECONCILED_SQL},
headed AS (SELECT *, {INVOICE_KEY_SQL} AS invoice_key,
  concat_ws('；', CASE WHEN status = 'review_required' THEN {REVIEW_HEAD_SQL} END,
                  CASE WHEN reconciliation_remark <> '' THEN reconciliation_remark END) AS review_remark,
  CASE WHEN reconciliation_remark <> '' THEN 'review_required' ELSE status END AS recognition_status FROM reconciled),
ledger_rows AS (SELECT h.unit_id, h.invoice_key, coalesce(l.line_no, 1) AS line_no, l.item_name, l.quantity, l.tax_rate,
  CASE WHEN l.line_no IS NULL THEN h.amount_total ELSE l.line_amount END AS line_amount,
  CASE WHEN l.line_no IS NULL THEN h.tax_total ELSE l.line_tax_amount END AS line_tax_amount,
  CASE WHEN l.line_no IS NULL THEN h.total_with_tax ELSE l.line_total_with_tax END AS line_total_with_tax,
  h.invoice_no, h.invoice_date, h.buyer_name, h.buyer_tax_id, h.seller_name, h.seller_tax_id, h.invoice_type,
  h.total_with_tax AS invoice_total_with_tax, h.recognition_status, h.review_remark, h.source_file,
  l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate, h.o_orderkey
  FROM headed h LEFT JOIN lines l USING (unit_id)),
keyed_rows AS (SELECT *, {key_sql('line_', 'invoice_key', 'line_no', 'item_name', 'line_amount', 'line_tax_amount')} AS invoice_line_key,
  {key_sql('draft_', "'run-1'", 'unit_id', 'line_no')} AS draft_row_id FROM ledger_rows)
"""


@query("ledger_rows", LEDGER_SQL + """
SELECT draft_row_id, invoice_key, invoice_line_key, line_no, item_name, quantity, line_amount, tax_rate,
       line_tax_amount, line_total_with_tax, invoice_no, CAST(invoice_date AS VARCHAR) AS invoice_date, seller_name,
       invoice_total_with_tax, recognition_status, review_remark,
       regexp_extract(source_file, '[^/]*$') AS source_file, '是' AS is_positive_invoice
FROM keyed_rows""")
def ledger_rows(spark, sf):
    rows = ledger.ledger_rows(fx.invoices(spark, sf), fx.lines(spark, sf), RUN, AT)
    return rows.select(
        "draft_row_id", "invoice_key", "invoice_line_key", "line_no", "item_name", "quantity", "line_amount", "tax_rate",
        "line_tax_amount", "line_total_with_tax", "invoice_no", "invoice_date", "seller_name", "invoice_total_with_tax",
        "recognition_status", "review_remark", "source_file", "is_positive_invoice")


@query("invoice_rollup", f"""
WITH {LINES_SQL}
SELECT unit_id, count(*) AS n_lines,
  CASE WHEN count(*) = 1 THEN min(item_name)
       ELSE arg_min(item_name, ROW({LINE_ORDER_SQL})) || '等' || count(*) || '项' END AS summary_name,
  CASE WHEN count(*) = 1 THEN min(tax_rate)
       WHEN count(DISTINCT tax_rate) FILTER (line_total_with_tax <> 0) = 1
       THEN min(tax_rate) FILTER (line_total_with_tax <> 0) END AS summary_rate
FROM lines GROUP BY unit_id""")
def invoice_rollup(spark, sf):
    return ledger.invoice_rollup(fx.lines(spark, sf), LINE_ORDER)


@query("invoice_summary", LEDGER_SQL + """
SELECT invoice_key, min(invoice_no) AS invoice_no, min(invoice_total_with_tax) AS invoice_total_with_tax,
       min(line_no) AS line_no, arg_min(line_amount, ROW(line_no, coalesce(l_partkey, 0), coalesce(l_suppkey, 0),
       coalesce(l_quantity, 0), coalesce(l_extendedprice, 0), line_amount, line_tax_amount)) AS line_amount
FROM keyed_rows GROUP BY invoice_key""")
def invoice_summary(spark, sf):
    # Order of the rows of one invoice: line number, then part and supplier, carried by the item columns.
    lines = fx.lines(spark, sf)
    rows = ledger.ledger_rows(fx.invoices(spark, sf), lines.withColumn("spec_model", F.format_string(
        "%012d|%012d|%010.2f|%014.2f", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")), RUN, AT)
    return ledger.invoice_summary(rows, ["line_no", "spec_model", "line_amount", "line_tax_amount"]).select(
        "invoice_key", "invoice_no", "invoice_total_with_tax", "line_no", "line_amount")


@query("output_rows", LEDGER_SQL + """
SELECT invoice_line_key AS draft_row_id, CASE WHEN recognition_status = 'ready' THEN '通过' ELSE '需复核' END AS recognition_status,
       CAST(NULL AS VARCHAR) AS invoice_no, invoice_no AS digital_invoice_no, invoice_date, line_amount, tax_rate, invoice_type
FROM keyed_rows""")
def output_rows(spark, sf):
    rows = ledger.ledger_rows(fx.invoices(spark, sf), fx.lines(spark, sf), RUN, AT)
    shown = ledger.project_output(ledger.output_values(rows), "detail")
    return shown.select("draft_row_id", "recognition_status", "invoice_no", "digital_invoice_no", "invoice_date",
                        "line_amount", "tax_rate", "invoice_type")


@query("row_numbers", f"""
WITH {LINES_SQL}
SELECT l_orderkey, line_no, l_partkey, line_amount, 1000 + row_number() OVER (ORDER BY l_orderkey // 10000, line_no // 1000000, l_orderkey,
  {LINE_ORDER_SQL}) AS row_sequence FROM lines""")
def row_numbers(spark, sf):
    numbered = ledger.number_rows(fx.lines(spark, sf), ["l_orderkey", *LINE_ORDER], 1000)
    return numbered.select("l_orderkey", "line_no", "l_partkey", "line_amount", "row_sequence")


# ---- checks --------------------------------------------------------------

ALL_CHECKS = {"standard-invoice": list(checks.AMOUNT_CHECKS)}
# Broken copies of headers and lines, so that every check has something to find.
CHECKED_SQL = f"""
WITH {LINES_SQL}, {INVOICES_SQL}, {SUMS_SQL},
bad_invoices AS (SELECT * REPLACE (
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE amount_total END AS amount_total,
    CASE WHEN o_orderpriority = '5-LOW' THEN CAST(tax_total + 1 AS DECIMAL(18,2)) ELSE tax_total END AS tax_total) FROM invoices),
bad_lines AS (SELECT *, CAST(l_extendedprice / l_quantity AS DECIMAL(18,2)) AS price,
    CASE WHEN l_linestatus = 'F' THEN CAST(line_total_with_tax + 0.05 AS DECIMAL(18,2)) ELSE line_total_with_tax END AS bad_total FROM lines),
issues AS (
  SELECT unit_id, 7000000 AS seq, 'incomplete amount breakdown: missing amount_total' AS text FROM bad_invoices WHERE amount_total IS NULL
  UNION ALL SELECT unit_id, 1000007000000, 'amount_total + tax_total != total_with_tax' FROM bad_invoices
    WHERE abs(amount_total + tax_total - total_with_tax) > 0.02
  UNION ALL SELECT unit_id, 2000007000000 + line_no, 'line ' || line_no || ': line_amount + line_tax_amount != line_total_with_tax'
    FROM bad_lines WHERE abs(line_amount + line_tax_amount - bad_total) > 0.02
  UNION ALL SELECT unit_id, 3000007000000 + line_no, 'line ' || line_no || ': quantity * unit_price != line_amount'
    FROM bad_lines WHERE abs(CAST(quantity AS DECIMAL(12,2)) * price - line_amount) > 0.02
  UNION ALL SELECT unit_id, 4000007000000, 'sum line_amount != amount_total' FROM bad_invoices LEFT JOIN sums USING (unit_id)
    WHERE abs(coalesce(lines_amount, 0) - amount_total) > 0.02
  UNION ALL SELECT unit_id, 5000007000000, 'sum line_tax_amount != tax_total' FROM bad_invoices LEFT JOIN sums USING (unit_id)
    WHERE abs(coalesce(lines_tax, 0) - tax_total) > 0.02)
"""


def broken(spark, sf):
    invoices = fx.invoices(spark, sf)
    invoices = invoices.withColumn("amount_total", F.when(F.col("o_orderstatus") != "P", F.col("amount_total"))).withColumn(
        "tax_total", F.when(F.col("o_orderpriority") == "5-LOW", (F.col("tax_total") + 1).cast(M.MONEY)).otherwise(F.col("tax_total")))
    lines = fx.lines(spark, sf)
    lines = lines.withColumn("unit_price", (F.col("l_extendedprice") / F.col("l_quantity")).cast(M.MONEY)).withColumn(
        "line_total_with_tax", F.when(F.col("l_linestatus") == "F", (F.col("line_total_with_tax") + F.lit("0.05").cast(M.MONEY)).cast(M.MONEY))
        .otherwise(F.col("line_total_with_tax")))
    return invoices, lines


@query("amount_checks", CHECKED_SQL + "SELECT unit_id, seq, text FROM issues")
def amount_checks(spark, sf):
    return checks.amount_checks(*broken(spark, sf), ALL_CHECKS)


@query("validation_status", CHECKED_SQL + """,
distinct_issues AS (SELECT * FROM issues),
joined AS (SELECT unit_id, string_agg(text, '; ' ORDER BY seq, text) AS remark FROM distinct_issues GROUP BY unit_id)
SELECT unit_id, CASE WHEN j.remark IS NULL THEN 'ready' ELSE 'review_required' END AS status,
       CAST(CASE WHEN j.remark IS NULL THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence, coalesce(j.remark, '通过当前字段校验。') AS remark
FROM invoices LEFT JOIN joined j USING (unit_id)""")
def validation_status(spark, sf):
    invoices, lines = broken(spark, sf)
    issues = checks.amount_checks(invoices, lines, ALL_CHECKS)
    return checks.validate(invoices, issues).select("unit_id", "status", "confidence", "remark")


@query("review_wording", CHECKED_SQL + """,
joined AS (SELECT unit_id, string_agg(text, '; ' ORDER BY seq, text) AS remark FROM issues GROUP BY unit_id),
said AS (SELECT unit_id, seq, min(line) AS line, CASE
    WHEN text LIKE 'incomplete%' THEN '请对照原票补充金额'
    WHEN text LIKE 'amount_total +%' THEN '请核对票面金额、税额和价税合计，三者对不上'
    WHEN text LIKE 'sum line_amount%' THEN '请核对明细金额和票面金额，合计数对不上'
    WHEN text LIKE 'sum line_tax%' THEN '请核对明细税额和票面税额，合计数对不上'
    WHEN text LIKE 'line %qu%' THEN '请核对第 ' || line || ' 行的数量、单价和金额，三者对不上'
    ELSE '请核对第 ' || line || ' 行的金额、税额和价税合计，三者对不上' END AS message
  FROM (SELECT *, regexp_extract(text, 'line (\\d+):', 1) AS line FROM issues) GROUP BY unit_id, seq, text, line),
ranked AS (SELECT unit_id, message, row_number() OVER (PARTITION BY unit_id ORDER BY min(seq)) AS rn FROM said GROUP BY unit_id, message)
SELECT unit_id, CASE WHEN bool_or(message LIKE '%') THEN '金额不一致' END AS issue_type, string_agg(message, '；' ORDER BY rn) || '。' AS action
FROM ranked WHERE rn <= 3 AND unit_id NOT IN (SELECT unit_id FROM joined WHERE remark = 'incomplete amount breakdown: missing amount_total') GROUP BY unit_id
UNION ALL SELECT unit_id, '识别结果需确认', '请对照原票补充金额。' FROM joined WHERE remark = 'incomplete amount breakdown: missing amount_total'""")
def review_wording(spark, sf):
    invoices, lines = broken(spark, sf)
    # Printed line numbers repeat in these tables; an issue said twice is one issue.
    remarks = checks.issue_remarks(checks.amount_checks(invoices, lines, ALL_CHECKS), once=True)
    return remarks.select("unit_id", R.issue_label(F.col("issue_remark")).alias("issue_type"),
                          R.review_text(F.col("issue_remark")).alias("action"))


REQUIRED = {("standard-invoice", None): ["invoice_no", "invoice_date", "total_with_tax", "buyer_name", "items", "unit_price", "item_name"]}


@query("missing_required", f"""
WITH {LINES_SQL}, {INVOICES_SQL}, has_lines AS (SELECT DISTINCT unit_id FROM lines),
flat AS (SELECT unit_id, CASE WHEN o_orderpriority = '1-URGENT' THEN '  ' ELSE buyer_name END AS buyer_name,
         h.unit_id IS NOT NULL AS has FROM invoices LEFT JOIN has_lines h USING (unit_id))
SELECT unit_id, seq, text FROM (
  SELECT unit_id, has, unnest([CASE WHEN trim(buyer_name) = '' THEN 'missing buyer_name' END, CASE WHEN NOT has THEN 'missing items' END,
    'missing unit_price', CASE WHEN NOT has THEN 'missing item_name' END]) AS text, buyer_name FROM flat),
  LATERAL (SELECT 2000000 + CASE text WHEN 'missing buyer_name' THEN 0 WHEN 'missing items' THEN CASE WHEN trim(buyer_name) = '' THEN 1 ELSE 0 END
    WHEN 'missing unit_price' THEN (CASE WHEN trim(buyer_name) = '' THEN 1 ELSE 0 END) + (CASE WHEN has THEN 0 ELSE 1 END)
    ELSE (CASE WHEN trim(buyer_name) = '' THEN 1 ELSE 0 END) + 2 END AS seq)
WHERE text IS NOT NULL""")
def missing_required(spark, sf):
    invoices = fx.invoices(spark, sf).withColumn(
        "buyer_name", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("  ")).otherwise(F.col("buyer_name")))
    return checks.missing_required(invoices, fx.lines(spark, sf), REQUIRED)


EVIDENCE_FIELDS = ["invoice_no", "buyer_name", "unit_price", "item_name", "total_with_tax"]


@query("field_evidence", f"""
WITH {LINES_SQL}, {INVOICES_SQL}, has_lines AS (SELECT DISTINCT unit_id FROM lines),
f AS (SELECT i.*, h.unit_id IS NOT NULL AS has FROM invoices i LEFT JOIN has_lines h USING (unit_id)),
found AS (
  SELECT unit_id, 0 AS place, 4 AS pos, 'low confidence invoice_no' AS text FROM f WHERE o_orderstatus = 'O'
  UNION ALL SELECT unit_id, 1, 0, 'missing evidence buyer_name' FROM f WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND buyer_name IS NOT NULL
  UNION ALL SELECT unit_id, 3, 1, 'conflict item_name' FROM f WHERE has AND o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'
  UNION ALL SELECT unit_id, 3, 4, 'low confidence item_name' FROM f WHERE has AND o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT unit_id, 3, 0, 'missing evidence item_name' FROM f WHERE has AND o_orderpriority = '5-LOW'
  UNION ALL SELECT unit_id, 4, 0, 'missing evidence total_with_tax' FROM f
  UNION ALL SELECT unit_id, 5, 1, 'conflict seller_name' FROM f WHERE o_orderpriority = '4-NOT SPECIFIED'
  UNION ALL SELECT unit_id, 6, 1, 'conflict items' FROM f WHERE has AND o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'
  UNION ALL SELECT unit_id, 6, 4, 'low confidence items' FROM f WHERE has AND o_orderpriority = '3-MEDIUM')
SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY place, pos) AS nth, text FROM found""")
def field_evidence(spark, sf):
    """Orders with a decision on the number, mostly one on the buyer and one on the lines, and none on the total."""
    invoices = fx.invoices(spark, sf)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")

    def decided(field, when, confidence=F.lit(0.9), evidence="line", conflict=F.lit(False), risks=F.array().cast("array<string>")):
        evidence = F.lit(evidence) if isinstance(evidence, str) else evidence
        return F.when(when, F.struct(F.lit(field).alias("field"), confidence.alias("confidence"), evidence.alias("evidence"), conflict.alias("conflict"), risks.alias("risks")))

    made = F.array(
        decided("invoice_no", F.lit(True), F.when(status == "O", 0.5).otherwise(0.9)),
        decided("buyer_name", priority != "1-URGENT", evidence=F.when(priority == "2-HIGH", F.lit(" ")).otherwise(F.lit("line"))),
        decided("items", priority != "5-LOW", conflict=status == "P", risks=F.when(priority == "3-MEDIUM", F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))),
        decided("seller_name", F.lit(True), conflict=priority == "4-NOT SPECIFIED"),
        decided("spec_model", F.lit(True), evidence=""),
    )
    decisions = invoices.select("unit_id", F.explode(F.filter(made, lambda d: d.isNotNull())).alias("d")).select("unit_id", "d.*")
    lines = fx.lines(spark, sf)
    required = checks.required_list({("standard-invoice", None): EVIDENCE_FIELDS})
    found = checks.field_evidence(checks.present_fields(invoices, lines), decisions, required, F.lit(True), lines.columns)
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("seq"))
    return found.select("unit_id", nth.alias("nth"), "text")


@query("identity_issues", f"""
WITH {INVOICES_SQL}, odd AS (SELECT * REPLACE (
   CASE WHEN o_orderstatus = 'O' THEN substr(invoice_no, 5) ELSE invoice_no END AS invoice_no,
   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN buyer_name || ' ' ELSE seller_name END AS seller_name),
   CASE WHEN o_orderstatus = 'P' THEN '011001900111' END AS invoice_code FROM invoices)
SELECT unit_id, 4000000 AS seq, 'digital invoice number invalid' AS text FROM odd WHERE length(invoice_no) <> 20
UNION ALL SELECT unit_id, 4000000, 'digital invoice has invoice_code' FROM odd WHERE length(invoice_no) = 20 AND invoice_code IS NOT NULL
UNION ALL SELECT unit_id, 5000000, 'buyer_name equals seller_name with different tax ids' FROM odd WHERE trim(buyer_name) = trim(seller_name)""")
def identity_issues(spark, sf):
    odd = (
        fx.invoices(spark, sf)
        .withColumn("invoice_no", F.when(F.col("o_orderstatus") == "O", F.substring("invoice_no", 5, 20)).otherwise(F.col("invoice_no")))
        .withColumn("seller_name", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat("buyer_name", F.lit(" ")))
                    .otherwise(F.col("seller_name")))
        .withColumn("invoice_code", F.when(F.col("o_orderstatus") == "P", F.lit("011001900111"))))
    return checks.variant_issues(odd, ["standard-invoice"]).unionByName(checks.party_issues(odd))


# ---- VAT -----------------------------------------------------------------

# Priority -> document type of the VAT queries; the others have no rule.
VAT_TYPES = {"1-URGENT": ("road-bus-ticket", None), "2-HIGH": ("railway-ticket", None),
             "3-MEDIUM": ("air-ticket-itinerary", "legacy-air-itinerary")}


def fares(spark, sf):
    """Tax-inclusive fares: no tax shown, gross value on the line."""
    lines = fx.lines(spark, sf)
    name = F.when(F.col("l_returnflag") == "R", F.lit("机场建设费")).when(
        F.col("l_linestatus") == "F", F.lit("燃油附加费")).otherwise(F.lit("票价"))
    lines = lines.withColumn("item_name", name).withColumn("line_tax_amount", F.lit(0).cast(M.MONEY)).withColumn(
        "line_total_with_tax", F.col("line_amount")).withColumn("tax_rate", F.lit(None).cast("string"))
    schema = F.create_map(*[F.lit(x) for k, v in VAT_TYPES.items() for x in (k, v[0])])
    invoices = fx.invoices(spark, sf).withColumn("schema_id", F.coalesce(
        F.try_element_at(schema, F.col("o_orderpriority")), F.lit("standard-invoice"))).withColumn(
        "variant_id", F.when(F.col("schema_id") == "air-ticket-itinerary", F.lit("legacy-air-itinerary"))).withColumn(
        "tax_total", F.lit(0).cast(M.MONEY))
    return invoices, lines


FARES_SQL = f"""
WITH {LINES_SQL}, {INVOICES_SQL},
fares AS (SELECT l.unit_id, line_no, l_partkey, l_suppkey, l_quantity, l_extendedprice, l.line_amount, l.line_tax_amount,
    CASE WHEN l_returnflag = 'R' THEN '机场建设费' WHEN l_linestatus = 'F' THEN '燃油附加费' ELSE '票价' END AS item_name,
    CAST(l.line_amount * 100 AS BIGINT) AS cents,
    CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 9 WHEN '3-MEDIUM' THEN 9 ELSE 0 END AS rate,
    o_orderpriority, (o_orderpriority <> '3-MEDIUM' OR l_returnflag <> 'R') AS taxable
  FROM lines l JOIN invoices USING (unit_id)),
shares AS (SELECT *, cents * rate // (100 + rate) AS floor_cents, (cents * rate) % (100 + rate) AS remainder FROM fares),
ranked AS (SELECT *, (sum(CASE WHEN taxable THEN cents * rate END) OVER u * 2 + 100 + rate) // (2 * (100 + rate))
      - sum(CASE WHEN taxable THEN floor_cents END) OVER u AS left_over,
    row_number() OVER (PARTITION BY unit_id, taxable ORDER BY remainder DESC, line_no, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rk,
    bool_or(taxable) OVER u AS any_taxable
  FROM shares WINDOW u AS (PARTITION BY unit_id)),
split AS (SELECT *, CASE WHEN rate > 0 AND taxable THEN CAST((floor_cents + CASE WHEN rk <= left_over THEN 1 ELSE 0 END) AS DECIMAL(18,2)) / 100
    ELSE 0 END AS tax FROM ranked),
split_lines AS (SELECT unit_id, line_no, l_partkey, item_name, rate, any_taxable, taxable, CAST(cents AS DECIMAL(18,2)) / 100 AS gross,
    CAST(round(tax, 2) AS DECIMAL(18,2)) AS line_tax_amount,
    CAST(round(cents / 100 - tax, 2) AS DECIMAL(18,2)) AS line_amount FROM split)
"""


@query("vat_split_lines", FARES_SQL + """
SELECT unit_id, line_no, l_partkey, item_name, line_amount, line_tax_amount,
       CASE WHEN rate > 0 AND taxable AND any_taxable THEN rate || '%' END AS tax_rate FROM split_lines""")
def vat_split_lines(spark, sf):
    _, lines = vat.apply_vat_rules(*fares(spark, sf), VAT_RULES, LINE_ORDER[:5])
    return lines.select("unit_id", "line_no", "l_partkey", "item_name", "line_amount", "line_tax_amount", "tax_rate")


@query("vat_split_totals", FARES_SQL + """,
totals AS (SELECT unit_id, CAST(sum(line_amount) AS DECIMAL(18,2)) AS a, CAST(sum(line_tax_amount) AS DECIMAL(18,2)) AS t,
   bool_or(rate > 0 AND any_taxable) AS done, bool_or(rate > 0) AS ruled FROM split_lines GROUP BY unit_id)
SELECT i.unit_id, CASE WHEN done THEN a ELSE i.amount_total END AS amount_total,
  CASE WHEN done THEN t ELSE CAST(0 AS DECIMAL(18,2)) END AS tax_total,
  CASE WHEN done THEN CAST(a + t AS DECIMAL(18,2)) ELSE i.total_with_tax END AS total_with_tax,
  CASE WHEN coalesce(ruled, false) THEN 'split' ELSE 'none' END AS vat_action
FROM invoices i LEFT JOIN totals USING (unit_id)""")
def vat_split_totals(spark, sf):
    invoices, _ = vat.apply_vat_rules(*fares(spark, sf), VAT_RULES, LINE_ORDER[:5])
    return invoices.select("unit_id", "amount_total", "tax_total", "total_with_tax", "vat_action")


@query("vat_review_gate", f"""
WITH {LINES_SQL}, {INVOICES_SQL},
typed AS (SELECT i.unit_id, o_orderpriority, l.line_no, l.item_name, l_partkey,
   CASE WHEN l_returnflag = 'R' THEN -l.line_amount ELSE l.line_amount END AS gross
   FROM invoices i JOIN lines l USING (unit_id) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
flags AS (SELECT unit_id, o_orderpriority, bool_or(gross < 0) AS neg,
   string_agg(item_name, '、' ORDER BY line_no, item_name) FILTER (gross < 0) AS names,
   arg_min(item_name, ROW(line_no, item_name)) AS first_name FROM typed GROUP BY ALL)
SELECT unit_id, CASE WHEN neg THEN 'negative' WHEN o_orderpriority = '3-MEDIUM' THEN 'uncovered' ELSE 'split' END AS vat_action,
  CASE WHEN neg THEN '待复核：可抵扣税额规则遇到负数项目 ' || names
       WHEN o_orderpriority = '3-MEDIUM' THEN '待复核：可抵扣税额规则未覆盖项目' ELSE '' END AS message
FROM flags""")
def vat_review_gate(spark, sf):
    invoices, _ = fares(spark, sf)
    lines = fx.lines(spark, sf).withColumn("line_tax_amount", F.lit(0).cast(M.MONEY)).withColumn(
        "line_amount", F.when(F.col("l_returnflag") == "R", -F.col("line_amount")).otherwise(F.col("line_amount"))).withColumn(
        "line_total_with_tax", F.col("line_amount"))
    judged, _ = vat.apply_vat_rules(invoices, lines, VAT_RULES, LINE_ORDER[:5])
    return judged.filter("vat_action <> 'none'").select(
        "unit_id", "vat_action",
        F.when(F.col("vat_action") == "negative", F.split("remark", "; ")[0])
        .when(F.col("vat_action") == "uncovered", F.split("remark", " ")[0]).otherwise(F.lit("")).alias("message"))


@query("discount_links", f"""
WITH {LINES_SQL}, signed AS (SELECT *, l_returnflag = 'R' AS neg FROM lines)
SELECT unit_id, line_no, l_partkey, l_suppkey, CASE WHEN neg THEN last_value(CASE WHEN NOT neg THEN line_no END IGNORE NULLS) OVER
  (PARTITION BY unit_id ORDER BY line_no, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END
  AS discount_for_line_no FROM signed""")
def discount_links(spark, sf):
    lines = fx.lines(spark, sf).withColumn("line_amount", F.when(
        F.col("l_returnflag") == "R", -F.col("line_amount")).otherwise(F.col("line_amount")))
    return vat.link_discounts(lines, LINE_ORDER[:5]).select("unit_id", "line_no", "l_partkey", "l_suppkey", "discount_for_line_no")


# ---- dedup ---------------------------------------------------------------

def _history(spark, sf):
    """A ledger of lines shipped before 1997, and a batch of lines shipped from 1996 on."""
    invoices = fx.invoices(spark, sf).filter("o_orderkey is not null")
    lines = fx.lines(spark, sf)
    before = ledger.ledger_rows(invoices, lines.filter("l_shipdate < '1997-01-01'"), "run-0", AT)
    batch = ledger.ledger_rows(invoices, lines.filter("l_shipdate >= '1996-01-01'"), RUN, AT)
    keep = F.col("item_name").isNotNull()
    # Rows of one priority have no number: a weak identity.
    weak = F.col("seller_name") == "Seller 3-MEDIUM"

    def prepare(rows):
        bare = rows.filter(keep).withColumn("invoice_no", F.when(~weak, F.col("invoice_no")))
        return dedup.with_fingerprint(bare)

    order = F.substring("unit_id", 6, 20).cast("bigint")
    # Only what judging needs is stored.
    needed = [*dedup.IDENTITY, "invoice_no", *dedup.CARRIED, "doc", "line_no", "item_name", "line_amount", "context_remark"]
    # Numbering reads its rows several times; the joins behind them are done once.
    known = staged(prepare(before).withColumn("doc", order).select(*needed), "before")
    numbered = ledger.number_rows(known, ["doc", "line_no", "invoice_line_key"])
    return staged(numbered.select(*needed, "row_sequence"), "ledger"), staged(prepare(batch).withColumn("doc", order).select(*needed), "batch")


BATCH_ORDER = ["doc", "line_no", "invoice_line_key"]
HISTORY_SQL = f"""
WITH RECURSIVE {LINES_SQL}, {INVOICES_SQL},
keyed AS (SELECT *, {INVOICE_KEY_SQL} AS invoice_key FROM invoices),
all_rows AS (SELECT k.unit_id, o_orderkey AS doc, o_orderpriority = '3-MEDIUM' AS weak, l.line_no, l.item_name, l.line_amount, l.line_tax_amount,
   l.l_shipdate, k.invoice_key, k.invoice_no, l.line_total_with_tax, k.total_with_tax,
   {key_sql('line_', 'k.invoice_key', 'l.line_no', 'l.item_name', 'l.line_amount', 'l.line_tax_amount')} AS invoice_line_key,
   {key_sql('draft_', "'run-1'", 'k.unit_id', 'l.line_no')} AS draft_row_id
   FROM keyed k JOIN lines l USING (unit_id)),
history AS (SELECT *, row_number() OVER (ORDER BY doc, line_no, invoice_line_key) AS row_sequence FROM all_rows WHERE l_shipdate < '1997-01-01'),
batch AS (SELECT * FROM all_rows WHERE l_shipdate >= '1996-01-01'),
prints AS (SELECT unit_id, item_name, line_amount, line_tax_amount FROM history),
known AS (SELECT b.*, b.invoice_line_key IN (SELECT invoice_line_key FROM history)
   OR (unit_id, item_name, line_amount, line_tax_amount) IN (SELECT ROW(unit_id, item_name, line_amount, line_tax_amount) FROM prints) AS in_ledger FROM batch b),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no, invoice_line_key) AS step FROM known),
walk AS (
  SELECT DISTINCT doc, 0::BIGINT AS step, []::VARCHAR[] AS drafts, []::VARCHAR[] AS line_keys, false AS repeated FROM steps
  UNION ALL
  SELECT doc, step, CASE WHEN weak OR NOT again THEN list_append(drafts, draft_row_id) ELSE drafts END,
    CASE WHEN weak OR NOT again THEN list_append(line_keys, invoice_line_key) ELSE line_keys END, again
  FROM (SELECT s.doc, s.step, s.weak, s.draft_row_id, s.invoice_line_key, w.drafts, w.line_keys,
          s.in_ledger OR list_contains(w.drafts, s.draft_row_id) OR list_contains(w.line_keys, s.invoice_line_key) AS again
        FROM walk w JOIN steps s ON s.doc = w.doc AND s.step = w.step + 1)),
decided AS (SELECT s.*, repeated,
  CASE WHEN repeated AND weak THEN 'added_weak' WHEN repeated THEN 'skipped' ELSE 'added' END AS action
  FROM steps s JOIN walk USING (doc, step)),
judged AS (SELECT invoice_line_key, any_value(weak) AS weak, bool_or(in_ledger) AS in_ledger,
   any_value(unit_id) AS unit_id, any_value(item_name) AS item_name, any_value(line_amount) AS line_amount, any_value(line_tax_amount) AS line_tax_amount
   FROM known GROUP BY invoice_line_key)
"""


@query("ledger_dedup", HISTORY_SQL + """
SELECT invoice_line_key, draft_row_id, count(*) AS n_rows, action FROM decided GROUP BY ALL""")
def ledger_dedup(spark, sf):
    history, batch = _history(spark, sf)
    return dedup.dedup(batch, dedup.ledger_keys(history), BATCH_ORDER).select("invoice_line_key", "draft_row_id", "n_rows", "action")


@query("ledger_new_rows", HISTORY_SQL + """
SELECT invoice_line_key, CASE WHEN repeated THEN '疑似重复（弱身份票），请人工确认' ELSE '' END AS context_remark
FROM decided WHERE action <> 'skipped'""")
def ledger_new_rows(spark, sf):
    history, batch = _history(spark, sf)
    return dedup.new_rows(batch, dedup.ledger_keys(history), BATCH_ORDER).select("invoice_line_key", "context_remark")


@query("duplicate_locations", HISTORY_SQL + """,
by_line AS (SELECT invoice_line_key, max(row_sequence) AS r FROM history GROUP BY ALL),
by_print AS (SELECT unit_id, item_name, line_amount, line_tax_amount, min(row_sequence) AS r FROM history GROUP BY ALL)
SELECT j.invoice_line_key, coalesce(l.r, p.r) AS existing_row, h.item_name AS existing_item, h.line_amount AS existing_amount
FROM judged j LEFT JOIN by_line l USING (invoice_line_key)
LEFT JOIN by_print p USING (unit_id, item_name, line_amount, line_tax_amount)
LEFT JOIN history h ON h.row_sequence = coalesce(l.r, p.r) WHERE j.in_ledger""")
def duplicate_locations(spark, sf):
    history, batch = _history(spark, sf)
    judged = dedup.dedup(batch, dedup.ledger_keys(history), BATCH_ORDER).filter("in_ledger")
    return dedup.existing_context(judged.select("invoice_line_key", "existing_row"), history).select(
        "invoice_line_key", "existing_row", "existing_item", "existing_amount")


@query("duplicate_notices", HISTORY_SQL + f""",
by_line AS (SELECT invoice_line_key, max(row_sequence) AS r FROM history GROUP BY ALL),
by_print AS (SELECT unit_id, item_name, line_amount, line_tax_amount, min(row_sequence) AS r FROM history GROUP BY ALL),
by_number AS (SELECT invoice_no, min(row_sequence) AS r FROM history WHERE NOT weak GROUP BY ALL),
located AS (SELECT j.*, coalesce(l.r, p.r, n.r) AS r FROM decided j LEFT JOIN by_line l USING (invoice_line_key)
  LEFT JOIN by_print p USING (unit_id, item_name, line_amount, line_tax_amount)
  LEFT JOIN by_number n ON NOT j.weak AND n.invoice_no = j.invoice_no WHERE j.action <> 'added')
SELECT {key_sql('notice_', 'invoice_key', "'疑似重复'", "CASE WHEN NOT weak THEN invoice_no END")} AS notice_id,
  CASE WHEN weak THEN '已写入' ELSE '未写入' END AS severity,
  arg_min(CASE WHEN r IS NOT NULL THEN '采集表第 ' || r || ' 行' WHEN weak THEN '采集表按文件名或金额搜索' ELSE '采集表按发票号码搜索' END,
    ROW(doc, line_no, invoice_line_key)) AS check_location, min(total_with_tax) AS amount_total, min(unit_id) AS unit_id
FROM located GROUP BY invoice_key, weak, invoice_no""")
def duplicate_notices(spark, sf):
    history, batch = _history(spark, sf)
    judged = dedup.dedup(batch, dedup.ledger_keys(history), BATCH_ORDER)
    return notices.duplicate_notices(judged, BATCH_ORDER).select(
        "notice_id", "severity", "check_location", "amount_total", "unit_id")


@query("fresh_notices", HISTORY_SQL + f""",
ids AS (SELECT {key_sql('notice_', 'unit_id', "'金额不一致'", "''")} AS notice_id, bool_or(l_shipdate < '1997-01-01') AS old FROM all_rows GROUP BY unit_id)
SELECT notice_id FROM ids WHERE NOT old""")
def fresh_notices(spark, sf):
    history, batch = _history(spark, sf)

    def ids(rows):
        return rows.select("unit_id", K.notice_id(F.col("unit_id"), F.lit("金额不一致"), F.lit(None)).alias("notice_id"))

    both = ids(history).unionByName(ids(batch))
    return notices.fresh_notices(both, ids(history)).select("notice_id")


# ---- notices and reports -------------------------------------------------

def _units(spark, sf):
    """One unit per order; P orders failed, F orders are unmodeled, low priority ones have a broken unit."""
    return fx.invoices(spark, sf).select(
        "unit_id", "source_file", F.array(F.lit(1)).alias("page_range"), "invoice_no", "total_with_tax",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("failed")).otherwise(F.lit("ready")).alias("unit_status"),
        F.when(F.col("o_orderstatus") == "P", F.lit("failed")).when(F.col("o_orderstatus") == "F", F.lit("unmodeled"))
        .otherwise(F.lit("ready")).alias("record_status"), "o_orderstatus")


@query("notices", LEDGER_SQL + f""",
review AS (SELECT unit_id, any_value(review_remark) AS review_remark, any_value(invoice_total_with_tax) AS total, any_value(invoice_no) AS invoice_no
  FROM keyed_rows k JOIN orders o USING (o_orderkey) WHERE o_orderstatus = 'O' AND recognition_status = 'review_required' GROUP BY unit_id),
by_row AS (SELECT unit_id, '需复核' AS severity, CASE WHEN review_remark LIKE '%明细缺失%' THEN '缺少发票明细' ELSE '识别结果需确认' END AS issue_type, invoice_no, total AS amount_total,
  '采集表已写入行' AS check_location FROM review),
by_unit AS (SELECT unit_id, '未写入' AS severity, CASE WHEN o_orderpriority = '5-LOW' THEN '无法生成台账记录' WHEN o_orderstatus = 'P' THEN '识别失败' ELSE '暂不支持此票种' END AS issue_type,
  invoice_no, total_with_tax AS amount_total, '原文件第 1 页' AS check_location FROM invoices
  WHERE (o_orderpriority = '5-LOW' OR o_orderstatus <> 'O') AND unit_id NOT IN (SELECT unit_id FROM by_row))
SELECT {key_sql('notice_', 'unit_id', 'issue_type', "''")} AS notice_id, * FROM (SELECT * FROM by_row UNION ALL SELECT * FROM by_unit)""")
def all_notices(spark, sf):
    invoices = fx.invoices(spark, sf).filter("o_orderstatus = 'O'")
    rows = ledger.ledger_rows(invoices, fx.lines(spark, sf), RUN, AT)
    built = notices.build_notices(rows, _units(spark, sf), ["line_no", "invoice_line_key"])
    return built.select("notice_id", "unit_id", "severity", "issue_type", "invoice_no", "amount_total", "check_location")


@query("notice_actions", LEDGER_SQL + """
SELECT unit_id, CASE WHEN any_value(review_remark) LIKE '请%' THEN CASE WHEN any_value(review_remark) LIKE '%。' THEN any_value(review_remark) ELSE any_value(review_remark) || '。' END
  WHEN any_value(review_remark) LIKE '%明细缺失%' THEN '请对照原票补充发票明细。' ELSE
  concat_ws('；', CASE WHEN any_value(amount_total) <> any_value(lines_amount) THEN '请核对票面金额和明细金额合计，二者相差 ' || abs(any_value(lines_amount) - any_value(amount_total)) || ' 元' END,
    CASE WHEN any_value(tax_total) <> any_value(lines_tax) THEN '请核对票面税额和明细税额合计，二者相差 ' || abs(any_value(lines_tax) - any_value(tax_total)) || ' 元' END,
    CASE WHEN any_value(total_with_tax) <> any_value(lines_total) THEN '请核对票面价税合计和明细价税合计，二者相差 ' || abs(any_value(lines_total) - any_value(total_with_tax)) || ' 元' END) || '。' END AS action
FROM headed WHERE review_remark <> '' GROUP BY unit_id""")
def notice_actions(spark, sf):
    rows = ledger.ledger_rows(fx.invoices(spark, sf), fx.lines(spark, sf), RUN, AT)
    return notices.row_notices(rows, ["line_no", "invoice_line_key"]).select("unit_id", "action")


@query("issue_rows", LEDGER_SQL + """
SELECT draft_row_id, invoice_line_key FROM keyed_rows WHERE recognition_status <> 'ready' OR review_remark <> ''""")
def issue_rows(spark, sf):
    rows = ledger.ledger_rows(fx.invoices(spark, sf), fx.lines(spark, sf), RUN, AT)
    return notices.issue_rows(rows).select("draft_row_id", "invoice_line_key")


@query("run_summary", LEDGER_SQL + """,
by_unit AS (SELECT unit_id, count(*) FILTER (recognition_status = 'ready') AS a, count(*) FILTER (recognition_status = 'review_required') AS b FROM keyed_rows
  WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY unit_id)
SELECT (SELECT count(*) FROM orders) AS input_count, (SELECT count(*) FROM orders) AS invoice_units,
  count(*) FILTER (a > 0 AND b = 0) AS ready_units, count(*) FILTER (b > 0) AS review_required_units, CAST(sum(a) AS BIGINT) AS ready_rows,
  CAST(sum(b) AS BIGINT) AS review_required_rows, 0 AS weak_identity_units,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS unmodeled_units, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS failed_units,
  'partial' AS run_status FROM by_unit""")
def run_summary(spark, sf):
    invoices = fx.invoices(spark, sf).filter("o_orderstatus = 'O'")
    rows = ledger.ledger_rows(invoices, fx.lines(spark, sf), RUN, AT)
    return reports.run_summary(rows, _units(spark, sf))


def _two_routes(spark, sf):
    """Direct results per document (status by language), OCR results per label (status by quality and toxic)."""
    documents = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = fx.table(spark, sf, "labels")
    direct = documents.filter("lang <> 'es'").select(
        F.col("doc_id").alias("unit_id"),
        F.when(F.col("lang") == "en", F.lit("review_required")).when(F.col("lang") == "fr", F.lit("unmodeled"))
        .otherwise(F.lit("failed")).alias("status"),
        F.lit("pdf_text").alias("source"), F.col("n_chars").alias("value"))
    ocr = labels.select(
        F.col("doc_id").alias("unit_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("ready")).when(F.col("quality") == 1, F.lit("review_required"))
        .when(F.col("toxic") == 0, F.lit("unmodeled")).otherwise(F.lit("failed")).alias("status"),
        (F.col("doc_id") + 1000000).alias("value"))
    return direct, ocr


ROUTES_SQL = """
WITH d AS (SELECT doc_id AS unit_id, CASE lang WHEN 'en' THEN 'review_required' WHEN 'fr' THEN 'unmodeled' ELSE 'failed' END AS status, n_chars AS value
  FROM documents WHERE lang <> 'es'),
o AS (SELECT doc_id AS unit_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'ready' WHEN quality = 1 THEN 'review_required' WHEN toxic = 0 THEN 'unmodeled' ELSE 'failed' END AS status,
  doc_id + 1000000 AS value FROM labels),
ranks(status, rank) AS (VALUES ('ready', 3), ('review_required', 2), ('unmodeled', 1), ('failed', 0)),
j AS (SELECT coalesce(d.unit_id, o.unit_id) AS unit_id, d.status AS ds, o.status AS os, d.value AS dv, o.value AS ov,
  d.unit_id IS NULL AS only_ocr, o.unit_id IS NULL AS only_direct,
  (SELECT rank FROM ranks WHERE status = o.status) > (SELECT rank FROM ranks WHERE status = d.status) AS better
  FROM d FULL JOIN o ON d.unit_id = o.unit_id),
routes AS (SELECT unit_id, CASE WHEN only_ocr OR better THEN os ELSE ds END AS record_status, CASE WHEN only_ocr OR better THEN ov ELSE dv END AS value,
  CASE WHEN only_ocr OR better THEN 'ocr' ELSE 'pdf_text' END AS selected_source, NOT only_ocr AND NOT only_direct AS fallback_attempted,
  CASE WHEN only_ocr THEN 'ocr_required' WHEN NOT only_direct THEN 'direct_not_ready' END AS fallback_reason, ds AS direct_status, os AS ocr_status,
  CASE WHEN only_ocr THEN 'ocr_required' WHEN only_direct THEN 'direct_ready_or_ocr_not_available' WHEN better THEN 'ocr_status_higher'
  ELSE 'same_or_higher_direct_status' END AS selection_reason FROM j)
"""


@query("select_route", ROUTES_SQL + "SELECT * FROM routes")
def select_route(spark, sf):
    direct, ocr = _two_routes(spark, sf)
    return routes.select_route(direct, ocr, ["value"])


@query("route_summary", ROUTES_SQL + """,
by_file AS (SELECT unit_id % 10 AS f, bool_or(direct_status IS NOT NULL) AS direct, bool_or(coalesce(direct_status = 'ready', false)) AS direct_ready,
  bool_or(coalesce(fallback_reason = 'ocr_required', false)) AS req, bool_or(fallback_attempted) AS fb, bool_or(selection_reason = 'ocr_status_higher') AS imp,
  bool_or((coalesce(fallback_reason = 'ocr_required', false) OR fallback_attempted) AND coalesce(ocr_status = 'failed', false)) AS bad,
  sum(CASE WHEN fallback_reason = 'ocr_required' THEN 1 ELSE 0 END + CASE WHEN fallback_attempted THEN 1 ELSE 0 END) AS pages FROM routes GROUP BY 1)
SELECT count(*) FILTER (direct) AS direct_files, count(*) FILTER (direct_ready) AS direct_ready_files, 0 AS structured_files,
  count(*) FILTER (req) AS ocr_required_files, count(*) FILTER (fb) AS ocr_fallback_files, count(*) FILTER (imp) AS ocr_improved_files,
  count(*) FILTER (bad) AS ocr_failed_files, CAST(sum(pages) AS BIGINT) AS ocr_required_pages FROM by_file""")
def route_summary(spark, sf):
    direct, ocr = _two_routes(spark, sf)
    chosen = routes.select_route(direct, ocr, ["value"])
    # Ten source files; the unit number tells the file.
    filed = chosen.withColumn("source_file", (F.col("unit_id") % 10).cast("string")).withColumn("page_range", F.array(F.lit(1)))
    return reports.route_summary(filed)


@query("preflight_report", """
WITH u AS (SELECT doc_id, source, CASE WHEN n_chars >= 2000 THEN 'pdf_page' WHEN n_chars >= 500 THEN 'pdf_ocr_page' ELSE 'text_file' END AS unit_type,
  CASE lang WHEN 'en' THEN 'ready' WHEN 'fr' THEN 'unmodeled' ELSE 'review_required' END AS status FROM documents),
f AS (SELECT source, bool_or(unit_type <> 'pdf_ocr_page') AS direct, bool_or(unit_type <> 'pdf_ocr_page' AND status = 'ready') AS ready, bool_or(unit_type = 'pdf_ocr_page') AS req,
  bool_or(unit_type = 'pdf_page' AND status <> 'ready') AS fb, bool_or(status = 'unmodeled') AS uns,
  sum(CASE WHEN unit_type = 'pdf_ocr_page' THEN 1 ELSE 0 END + CASE WHEN unit_type = 'pdf_page' AND status <> 'ready' THEN 1 ELSE 0 END) AS pages FROM u GROUP BY source)
SELECT count(*) FILTER (direct) AS direct_files, count(*) FILTER (ready) AS direct_ready_files, 0 AS structured_files, count(*) FILTER (req) AS ocr_required_files,
  count(*) FILTER (fb) AS ocr_fallback_files, count(*) FILTER (uns) AS unsupported_files, CAST(sum(pages) AS BIGINT) AS ocr_required_pages,
  'ocr_required' AS status, 3 AS return_code FROM f""")
def preflight_report(spark, sf):
    documents = fx.table(spark, sf, "documents")
    unit_type = F.when(F.col("n_chars") >= 2000, F.lit("pdf_page")).when(F.col("n_chars") >= 500, F.lit("pdf_ocr_page")).otherwise(F.lit("text_file"))
    status = F.when(F.col("lang") == "en", F.lit("ready")).when(F.col("lang") == "fr", F.lit("unmodeled")).otherwise(F.lit("review_required"))
    results = documents.select(
        F.col("source").alias("source_file"), unit_type.alias("unit_type"), status.alias("record_status"), F.array(F.lit(1)).alias("page_range"),
        F.when(unit_type == "pdf_ocr_page", F.lit("none")).when(unit_type == "pdf_page", F.lit("pdf_text")).otherwise(F.lit("text_file")).alias("selected_source"),
        F.lit(False).alias("fallback_attempted"),
        F.when((unit_type == "pdf_page") & (status != "ready"), F.lit("direct_not_ready")).alias("fallback_reason"),
        F.when(status == "unmodeled", F.lit("当前票种未建模。")).alias("reason"))
    return reports.preflight_report(results, ocr_enabled=True, ocr_available=False)


@query("ocr_worklist", """
WITH u AS (SELECT doc_id AS unit_id, CASE WHEN n_chars >= 2000 THEN 'pdf_page' WHEN n_chars >= 500 THEN 'image' ELSE 'text_file' END AS unit_type,
  CASE lang WHEN 'en' THEN 'ready' WHEN 'fr' THEN 'unmodeled' ELSE 'review_required' END AS status, source FROM documents)
SELECT unit_id, CASE unit_type WHEN 'pdf_page' THEN 'pdf_ocr_page' ELSE unit_type END AS unit_type,
  CASE unit_type WHEN 'image' THEN 'ocr_required' ELSE 'direct_not_ready' END AS fallback_reason
FROM u WHERE unit_type = 'image' OR (unit_type = 'pdf_page' AND status <> 'ready' AND NOT (status = 'unmodeled' AND source LIKE '%1%'))""")
def ocr_worklist(spark, sf):
    documents = fx.table(spark, sf, "documents")
    unit_type = F.when(F.col("n_chars") >= 2000, F.lit("pdf_page")).when(F.col("n_chars") >= 500, F.lit("image")).otherwise(F.lit("text_file"))
    status = F.when(F.col("lang") == "en", F.lit("ready")).when(F.col("lang") == "fr", F.lit("unmodeled")).otherwise(F.lit("review_required"))
    results = documents.select(
        F.col("doc_id").alias("unit_id"), unit_type.alias("unit_type"), status.alias("status"),
        F.when(status == "unmodeled", F.lit("unmodeled")).otherwise(F.lit("matched")).alias("decision"),
        F.when(F.col("source").contains("1"), F.lit("当前票种未建模。")).otherwise(F.lit("未匹配标准发票类关键结构。")).alias("reason"))
    return routes.ocr_worklist(results).select("unit_id", "unit_type", "fallback_reason")


@query("reuse_results", """
WITH r AS (SELECT min(text) AS text, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' GROUP BY text)
SELECT d.doc_id, r.doc_id AS hit, r.doc_id IS NOT NULL AS reused FROM documents d LEFT JOIN r ON d.text = r.text""")
def reuse_results(spark, sf):
    documents = fx.table(spark, sf, "documents")
    results = documents.select("text", F.col("doc_id").alias("hit"), F.when(F.col("lang") == "en", F.lit("ready")).otherwise(F.lit("failed")).alias("status"))
    return routes.reuse_results(documents.select("doc_id", "text"), results, ["text"], ["hit"]).select("doc_id", "hit", "reused")


@query("route_failures", """
SELECT page_id, CASE WHEN regexp_matches(html, '^<!DOCTYPE html>') THEN 'ready' ELSE 'failed' END AS status,
  CASE WHEN regexp_matches(html, '^<!DOCTYPE html>') THEN '' ELSE '读取输入文件失败' END AS remark FROM pages""")
def route_failures(spark, sf):
    pages_table = fx.table(spark, sf, "pages").withColumn("ok", F.col("html").rlike("^<!DOCTYPE html>"))
    good, failed = routes.split_failures(pages_table, "ok", "读取输入文件失败")
    both = routes.union_routes(good.withColumn("status", F.lit("ready")), failed)
    return both.select("page_id", "status", F.coalesce("remark", F.lit("")).alias("remark"))


@query("contract_check", """
WITH h AS (SELECT DISTINCT lang AS table_name, source AS header FROM documents),
p AS (SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('zz')) t(table_name), (VALUES ('src0', true), ('src1', true), ('src2', false), ('nope', true), ('other', false)) f(header, required)),
counts AS (SELECT lang AS table_name, source AS header, count(*) AS n FROM documents GROUP BY ALL)
SELECT DISTINCT table_name AS table_key, 'missing_sheet' AS violation, '' AS subject FROM p WHERE table_name NOT IN (SELECT table_name FROM h)
UNION ALL SELECT table_name, 'missing_required_field', 'f_' || header FROM p WHERE required AND table_name IN (SELECT table_name FROM h)
  AND (table_name, header) NOT IN (SELECT (table_name, header) FROM h)
UNION ALL SELECT table_name, 'duplicate_header', header FROM counts WHERE n > 1 AND table_name IN ('en', 'fr', 'de')
UNION ALL SELECT table_name, 'extra_header', header FROM h WHERE table_name IN ('en', 'fr', 'de') AND header NOT IN ('src0', 'src1', 'src2', 'nope', 'other')""")
def contract_check(spark, sf):
    # Languages play the tables of the target, sources its headers.
    headers = fx.table(spark, sf, "documents").select(F.col("lang").alias("table_name"), F.col("source").alias("header"))
    fields = [("src0", True), ("src1", True), ("src2", False), ("nope", True), ("other", False)]
    profile = {t: {"name": t, "fields": [(f"f_{h}", h, r, None) for h, r in fields]} for t in ("en", "fr", "de", "zz")}
    return reports.contract_check(headers, reports.profile_table(spark, profile)).select("table_key", "violation", "subject")


@query("compare_expected", """
WITH a AS (SELECT 'doc_' || doc_id AS file, lang, source FROM documents WHERE lang <> 'de' UNION ALL SELECT 'doc_' || doc_id, lang, source FROM documents WHERE source = 'src3' AND lang <> 'de'),
e AS (SELECT 'doc_' || doc_id AS file, CASE quality WHEN 1 THEN 'en' ELSE 'fr' END AS lang, CASE toxic WHEN 1 THEN 'src1' END AS source FROM labels),
c AS (SELECT file, count(*) AS n, min(lang) AS lang, min(source) AS source FROM a GROUP BY file)
SELECT file, 'expected file is missing' AS issue FROM e WHERE file NOT IN (SELECT file FROM c)
UNION ALL SELECT file, 'file has no expectation' FROM c WHERE file NOT IN (SELECT file FROM e)
UNION ALL SELECT file, 'expected one invoice unit, got ' || n FROM c JOIN e USING (file) WHERE n <> 1
UNION ALL SELECT file, 'lang: expected ' || e.lang || ', got ' || c.lang FROM c JOIN e USING (file) WHERE n = 1 AND e.lang <> c.lang
UNION ALL SELECT file, 'source: expected ' || e.source || ', got ' || c.source FROM c JOIN e USING (file) WHERE n = 1 AND e.source <> c.source""")
def compare_expected(spark, sf):
    documents = fx.table(spark, sf, "documents").filter("lang <> 'de'").select(
        F.concat(F.lit("doc_"), "doc_id").alias("file"), "lang", "source")
    actual = documents.unionByName(documents.filter("source = 'src3'"))
    expected = fx.table(spark, sf, "labels").select(
        F.concat(F.lit("doc_"), "doc_id").alias("file"), F.when(F.col("quality") == 1, F.lit("en")).otherwise(F.lit("fr")).alias("lang"),
        F.when(F.col("toxic") == 1, F.lit("src1")).alias("source"))
    return reports.compare_expected(actual, expected, ["lang", "source"])


@query("set_difference", """
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_difference(spark, sf):
    return reports.set_difference(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id")


@query("missing_values", """
SELECT DISTINCT 'file_' || l_orderkey AS file, 'items.part: missing ' || l_partkey AS issue FROM lineitem a
WHERE l_shipdate >= '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_shipdate < '1997-01-01')""")
def missing_values(spark, sf):
    item = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("file_"), "l_orderkey").alias("file"), F.lit("part").alias("field"), F.col("l_partkey").cast("string").alias("value"), "l_shipdate")
    return reports.missing_values(item.filter("l_shipdate < '1997-01-01'"), item.filter("l_shipdate >= '1997-01-01'").drop("l_shipdate"))


# ---- pages ---------------------------------------------------------------

@query("text_quality", """
WITH p AS (SELECT conv_id AS file, CASE WHEN length(trim(text)) >= 40 THEN 'good' WHEN length(trim(text)) > 0 THEN 'poor' ELSE 'none' END AS q FROM conversations)
SELECT CAST(file AS VARCHAR) AS file, count(*) AS page_count, CASE WHEN count(DISTINCT q) = 1 THEN min(q) ELSE 'mixed' END AS text_layer_quality,
  bool_or(q = 'none') AS ocr_required, bool_or(q <> 'none') AS has_text_layer, 'ready' AS status,
  CASE WHEN count(*) = 1 THEN 'single' ELSE 'split_by_page' END AS unit_strategy FROM p GROUP BY file""")
def text_quality(spark, sf):
    table = fx.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("page"), "text")
    return pages.profile_files(pages.profile_pages(table))


@query("build_units", """
WITH f AS (SELECT conv_id, count(*) AS n, bool_or(length(trim(text)) = 0) AS e FROM conversations GROUP BY conv_id)
SELECT 'unit_' || substr(sha1('conv_' || conv_id || '.pdf|' || (turn + 1) || '|' || substr(sha1(CAST(conv_id AS VARCHAR)), 1, 16)), 1, 16) AS unit_id,
  CASE WHEN length(trim(text)) = 0 THEN 'pdf_ocr_page' ELSE 'pdf_page' END AS unit_type, CAST(turn + 1 AS VARCHAR) AS pages, 'ready' AS status FROM conversations""")
def build_units(spark, sf):
    name = F.concat(F.lit("conv_"), "conv_id", F.lit(".pdf"))
    table = fx.table(spark, sf, "conversations").select(name.alias("file"), (F.col("turn") + 1).alias("page"), "text", "conv_id")
    profiled = pages.profile_pages(table)
    files = pages.profile_files(profiled).join(
        table.select("file", F.substring(F.sha1(F.col("conv_id").cast("string")), 1, 16).alias("content_sha")).distinct(), "file").withColumn(
        "file_type", F.lit("pdf")).withColumn("messages", F.lit(None).cast("string"))
    return pages.build_units(files, profiled).select("unit_id", "unit_type", L.list_text(F.col("page_range")).alias("pages"), "status")


@query("merge_pages", """
WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN turn < 2 THEN 2 ELSE n - 2 END AS pages, CASE WHEN turn < 2 THEN turn + 1 ELSE turn - 1 END AS number,
  CASE WHEN turn < 2 THEN 'A' ELSE 'B' END AS who, CASE WHEN conv_id % 5 = 0 THEN role ELSE 'x' END AS buyer FROM c),
runs AS (SELECT conv_id, pages, who, buyer, min(turn) AS first_page FROM p WHERE pages >= 2 GROUP BY conv_id, pages, who, buyer, turn - number
  HAVING count(*) = pages AND min(number) = 1 AND max(number) = pages)
SELECT p.conv_id AS file, p.turn AS page_idx, coalesce(r.first_page, p.turn) AS unit_page, r.first_page IS NOT NULL AS merged,
  CASE WHEN r.first_page IS NULL THEN 1 ELSE p.pages END AS n_pages
FROM p LEFT JOIN runs r ON p.conv_id = r.conv_id AND p.pages = r.pages AND p.who = r.who AND p.buyer = r.buyer AND p.turn >= r.first_page AND p.turn < r.first_page + r.pages""")
def merge_pages(spark, sf):
    table = fx.table(spark, sf, "conversations")
    size = table.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    # Turns 0 and 1 print "2 pages, page 1/2", the other turns count through the rest of the file.
    total = F.when(F.col("turn") < 2, F.lit(2)).otherwise(F.col("n") - 2)
    number = F.when(F.col("turn") < 2, F.col("turn") + 1).otherwise(F.col("turn") - 1)
    marked = table.join(size, "conv_id").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("page_idx"), F.lit("pdf_text").alias("source"),
        F.concat(F.col("text"), F.lit("\n共 "), total.cast("string"), F.lit(" 页 第 "), number.cast("string"), F.lit(" 页")).alias("text"),
        F.when(F.col("turn") < 2, F.lit("A")).otherwise(F.lit("B")).alias("invoice_no"),
        F.lit("2024-01-01").alias("invoice_date"),
        F.when(F.col("conv_id") % 5 == 0, F.col("role")).otherwise(F.lit("x")).alias("buyer_name"),
        F.lit("b").alias("buyer_tax_id"), F.lit("s").alias("seller_name"), F.lit("t").alias("seller_tax_id"))
    return pages.merge_pages(marked)
