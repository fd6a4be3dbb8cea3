"""Queries over documents rendered from orders: each order is written out as a printed document and read back.

The SQL twin never sees the text; it states what the order says, so it checks the whole
way from lines of text to records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions.money import MONEY
from voucherlake.operators import candidates as C
from voucherlake.operators import doc_text as X
from voucherlake.operators.extract import item_rows
from voucherlake.plans import fixtures as fx
from voucherlake.plans import pipeline
from voucherlake.plans.registry import query
from voucherlake.plans.text_queries import han, han_sql
from voucherlake.rules.tables import shipped
from voucherlake.session import keyed, staged

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def some_rules(*names: str) -> dict[str, dict]:
    return {n: r for n, r in shipped().items() if n in names}


def money_text() -> Column:
    return F.col("o_totalprice").cast(MONEY).cast("string")


def day_text() -> Column:
    day = F.col("o_orderdate")
    return F.concat(F.year(day), F.lit("年"), F.lpad(F.month(day).cast("string"), 2, "0"), F.lit("月"),
                    F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), F.lit("日"))


def long_no() -> Column:
    return F.lpad(F.col("o_orderkey").cast("string"), 20, "0")


def short_no() -> Column:
    return F.lpad(F.col("o_orderkey").cast("string"), 8, "1")


def buyer_id() -> Column:
    return F.concat(F.lit("91B"), F.lpad(F.col("o_custkey").cast("string"), 15, "0"))


def by_priority(values: dict[str, Column]) -> Column:
    choice = None
    for priority, value in values.items():
        test = F.col("o_orderpriority") == priority
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice


def lines_of(*parts) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def said(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


# Documents of one task, at most about as many.
TASK_DOCUMENTS = 50_000


def orders(spark, sf) -> DataFrame:
    """Orders spread over all cores before they are rendered: reading texts is the costly part.

    The number of parts follows the number of orders, so that what one task reads, sorts and groups does not grow with them.
    """
    rows = fx.table(spark, sf, "orders")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_DOCUMENTS))
    return rows.repartition(parts, "o_orderkey")


def headers_of(docs: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Candidates are written once, since they are read twice; lines, which no header reads, are not."""
    extracted = staged(pipeline.recognise(docs, rules, keep=False).select("unit_id", "found"), "found")
    return C.header_fields(C.resolve(C.upsert(C.long_candidates(extracted, "found"))))


def lines_read(docs: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Lines are written once before they become rows, else each filter on them would read the texts again; candidates are not."""
    extracted = pipeline.recognise(docs, rules, keep=False).select("unit_id", "schema_id", "variant_id", "items")
    return item_rows(staged(extracted, "items"))


# ---- tickets -------------------------------------------------------------

def ticket_docs(spark, sf) -> DataFrame:
    city = F.concat(han("o_custkey"), F.lit("站"))
    texts = {
        "1-URGENT": lines_of("电子发票（铁路电子客票）", said("发票号码：", long_no()), said("开票日期：", day_text()), city, "终点站",
                             said("票价：￥", money_text()), said("统一社会信用代码：", buyer_id()), F.concat(F.lit("："), han("o_custkey"), F.lit("有限公司"))),
        "2-HIGH": lines_of("水路旅客运输客票", said("发票号码 ", short_no()), "乘船日期", day_text(), "承运人", F.concat(han("o_custkey"), F.lit("航运有限公司")),
                           "票价", said("￥", money_text())),
        "3-MEDIUM": lines_of("安徽省出租", "机打发票", said("发票代码", F.lit("134000000000")), said("发票号码", short_no()), said("日期 ", day_text()), "皖C 12345",
                             F.concat(han("o_custkey"), F.lit("出租汽车有限公")), "公司", said("金额 ", money_text())),
        "4-NOT SPECIFIED": lines_of("合肥地铁定额发票", "发票代码：134000000001", said("发票号码：", short_no()), "伍元整"),
        "5-LOW": lines_of("公路汽车客票", "始发地 目的地", said("发票代码 ", F.lit("134000000002")), said("发票号码 ", short_no()), said("乘车日期 ", day_text()),
                          said("票价 ￥", money_text())),
    }
    return orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), by_priority(texts).alias("lines"))


TICKET_RULES = ("railway-ticket", "water-passenger-ticket", "taxi-machine-invoice", "metro-quota-invoice", "road-bus-ticket")
DAY_SQL = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
TOTAL_SQL = "CAST(o_totalprice AS DECIMAL(18,2))"
SHORT_SQL = "lpad(CAST(o_orderkey AS VARCHAR), 8, '1')"


@query("ticket_headers", f"""
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '1-URGENT' THEN lpad(CAST(o_orderkey AS VARCHAR), 20, '0') ELSE {SHORT_SQL} END AS invoice_no,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN '134000000000' WHEN '4-NOT SPECIFIED' THEN '134000000001' WHEN '5-LOW' THEN '134000000002' END AS invoice_code,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL ELSE {DAY_SQL} END AS invoice_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN '中国铁路' WHEN '2-HIGH' THEN {han_sql('o_custkey')} || '航运有限公司'
    WHEN '3-MEDIUM' THEN '蚌埠市' || {han_sql('o_custkey')} || '出租汽车有限公司' WHEN '4-NOT SPECIFIED' THEN '合肥地铁' END AS seller_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN '电子发票（铁路电子客票）' WHEN '2-HIGH' THEN '水路旅客运输客票' WHEN '3-MEDIUM' THEN '出租车机打发票'
    WHEN '4-NOT SPECIFIED' THEN '合肥地铁定额发票' ELSE '公路汽车客票' END AS invoice_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN '91B' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') END AS buyer_tax_id,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 5.00 ELSE {TOTAL_SQL} END::DECIMAL(18,2) AS amount_total, 0.00::DECIMAL(18,2) AS tax_total,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 5.00 ELSE {TOTAL_SQL} END::DECIMAL(18,2) AS total_with_tax FROM orders""")
def ticket_headers(spark, sf):
    header = headers_of(ticket_docs(spark, sf), some_rules(*TICKET_RULES))
    return header.select("unit_id", "invoice_no", "invoice_code", "invoice_date", "seller_name", "invoice_type", "buyer_tax_id",
                         "amount_total", "tax_total", "total_with_tax")


@query("ticket_lines", f"""
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '1-URGENT' THEN {han_sql('o_custkey')} || '站至终点站铁路客票' WHEN '2-HIGH' THEN '水路客票' WHEN '3-MEDIUM' THEN '出租车费'
    WHEN '4-NOT SPECIFIED' THEN '地铁定额票' ELSE '公路汽车客票' END AS item_name, CASE o_orderpriority WHEN '3-MEDIUM' THEN '次' ELSE '张' END AS unit,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 5.00 ELSE {TOTAL_SQL} END::DECIMAL(18,2) AS line_amount FROM orders""")
def ticket_lines(spark, sf):
    rules = some_rules(*TICKET_RULES)
    return lines_read(ticket_docs(spark, sf), rules).select("unit_id", "item_name", "unit", "line_amount")


# ---- standard invoices ---------------------------------------------------

AMOUNT = "o_totalprice"


def standard_docs(spark, sf) -> DataFrame:
    """Digital invoices whose one line is printed in a layout per priority; tax is 13% or none."""
    total = F.col("o_totalprice").cast(MONEY)
    tax = F.round(total * 13 / 100, 2).cast(MONEY)
    amount, tax_text, whole = total.cast("string"), tax.cast("string"), (total + tax).cast(MONEY).cast("string")
    name = F.concat(F.lit("*商品*"), han("o_custkey"))
    items = {
        "1-URGENT": lines_of(name, "个", "1", amount, amount, "13%", tax_text),
        "2-HIGH": lines_of(name, "续名", "X1型", "13%", "台", amount, tax_text, amount, "1"),
        "3-MEDIUM": lines_of(name, "13%", "次", amount, tax_text),
        "4-NOT SPECIFIED": lines_of(name, "张", "1", amount, amount, "*", "*"),
        "5-LOW": lines_of(F.concat(name, F.lit(" 台 1 "), amount, F.lit(" "), amount, F.lit(" 13% "), tax_text)),
    }
    exempt = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    shown_tax = F.when(exempt, F.lit("0.00")).otherwise(tax_text)
    shown_total = F.when(exempt, amount).otherwise(whole)
    head = lines_of("电子发票（普通发票）", said("发票号码：", long_no()), said("开票日期：", day_text()), "购买方信息",
                    F.concat(F.lit("购买方名称："), han("o_custkey"), F.lit("有限公司")), said("统一社会信用代码/纳税人识别号：", buyer_id()),
                    "销售方信息", "销售方名称：测试销售有限公司", "统一社会信用代码/纳税人识别号：91S000000000000001")
    foot = lines_of(F.concat(F.lit("合 计 ¥"), amount, F.lit(" ¥"), shown_tax), said("价税合计（大写） （小写）¥", shown_total))
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("unit_id"), F.concat(F.lit("/in/"), "o_orderkey", F.lit(".txt")).alias("source_file"),
        F.concat(head, by_priority(items), foot).alias("lines"))


STANDARD_SQL = f"""
WITH o AS (SELECT *, {TOTAL_SQL} AS a, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.00 ELSE CAST(round({TOTAL_SQL} * CAST(0.13 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) END::DECIMAL(18,2) AS t FROM orders),
std AS (SELECT *, CAST(a + t AS DECIMAL(18,2)) AS w, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS no, '91B' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS bid,
  {han_sql('o_custkey')} || '有限公司' AS bname, '*商品*' || {han_sql('o_custkey')} || CASE WHEN o_orderpriority = '2-HIGH' THEN '续名' ELSE '' END AS item FROM o)
"""


@query("invoice_headers", STANDARD_SQL + f"""
SELECT o_orderkey AS unit_id, no AS invoice_no, {DAY_SQL} AS invoice_date, bname AS buyer_name, bid AS buyer_tax_id, '测试销售有限公司' AS seller_name, '91S000000000000001' AS seller_tax_id,
  '电子发票（普通发票）' AS invoice_type, a AS amount_total, t AS tax_total, w AS total_with_tax FROM std""")
def invoice_headers(spark, sf):
    header = headers_of(standard_docs(spark, sf), some_rules("standard-invoice"))
    return header.select("unit_id", "invoice_no", "invoice_date", "buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id", "invoice_type",
                         "amount_total", "tax_total", "total_with_tax")


@query("sequence_items", STANDARD_SQL + """
SELECT o_orderkey AS unit_id, 1 AS line_no, item AS item_name, CASE o_orderpriority WHEN '2-HIGH' THEN 'X1型' END AS spec_model,
  CASE o_orderpriority WHEN '1-URGENT' THEN '个' WHEN '3-MEDIUM' THEN '次' WHEN '4-NOT SPECIFIED' THEN '张' ELSE '台' END AS unit,
  CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 1.00 END::DECIMAL(18,2) AS quantity, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN a END AS unit_price, a AS line_amount,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '*' ELSE '13%' END AS tax_rate, t AS line_tax_amount, w AS line_total_with_tax FROM std""")
def sequence_items(spark, sf):
    rules = some_rules("standard-invoice")
    rows = lines_read(standard_docs(spark, sf), rules)
    return rows.select("unit_id", "line_no", "item_name", "spec_model", "unit", F.col("quantity").cast(MONEY).alias("quantity"),
                       F.col("unit_price").cast(MONEY).alias("unit_price"), "line_amount", "tax_rate", "line_tax_amount", "line_total_with_tax")


@query("documents_to_ledger", STANDARD_SQL + f"""
SELECT no AS invoice_no, item AS item_name, a AS line_amount, t AS line_tax_amount, w AS line_total_with_tax, w AS invoice_total_with_tax, bname AS buyer_name,
  o_orderkey || '.txt' AS source_file, 'ready' AS recognition_status, '通过' AS reconciliation_status, '' AS review_remark FROM std""")
def documents_to_ledger(spark, sf):
    outcome = pipeline.process(standard_docs(spark, sf), "run-1", "2024-01-02T03:04:05", some_rules("standard-invoice"))
    return outcome.rows.select("invoice_no", "item_name", "line_amount", "line_tax_amount", "line_total_with_tax", "invoice_total_with_tax", "buyer_name",
                               "source_file", "recognition_status", "reconciliation_status", "review_remark")


# ---- context: red invoices, toll, lease ----------------------------------

def context_docs(spark, sf) -> DataFrame:
    amount = money_text()
    name = F.concat(F.lit("*经营租赁*"), han("o_custkey"))
    texts = {
        "1-URGENT": lines_of("通行费", said("发票号码：", long_no()), "*通行费*过路", F.concat(F.lit("次 1 ")), said("皖A12345 合肥站入 芜湖站出 2024-03-05 10:20:30", F.lit("")),
                             "不征税"),
        "2-HIGH": lines_of("不动产经营租赁服务", said("发票号码：", long_no()), F.concat(name, F.lit(" 台 1 "), amount, F.lit(" "), amount, F.lit(" 9% 1.00")),
                           said("皖", F.col("o_orderkey").cast("string")), "平方米", F.concat(F.lit("不动产地址："), han("o_custkey"), F.lit("路；租赁期起止：2024-01-01 至 2024-12-31")),
                           "跨地（市）标志：否"),
        "3-MEDIUM": lines_of("电子发票（普通发票）", said("发票号码：", long_no()), "开票日期 红字发票", F.concat(F.lit("被红冲蓝字发票号码："), long_no(), F.lit(" 红字发票信息确认单编号：34"), long_no())),
        "4-NOT SPECIFIED": lines_of("电子发票（增值税专用发票）", said("发票号码：", long_no()), "开票日期"),
        "5-LOW": lines_of("建筑服务", said("发票号码：", long_no()), "*建筑服务*工程款", "合肥市", "9%", "项", "100.00", "9.00", F.concat(han("o_custkey"), F.lit("项目")), "合计"),
    }
    return orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), by_priority(texts).alias("lines"))


CONTEXT_RULES = ("standard-invoice", "toll-invoice", "real-estate-operating-lease", "building-service")


@query("context_headers", """
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '1-URGENT' THEN '通行费' WHEN '2-HIGH' THEN '不动产经营租赁服务' WHEN '5-LOW' THEN '建筑服务' END AS special_invoice_type,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN '是' END AS is_red_invoice, CASE o_orderpriority WHEN '3-MEDIUM' THEN lpad(CAST(o_orderkey AS VARCHAR), 20, '0') END AS red_original_no,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN '34' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') END AS red_confirm_no,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN '电子发票（普通发票）' WHEN '4-NOT SPECIFIED' THEN '电子发票（增值税专用发票）' END AS invoice_type FROM orders""")
def context_headers(spark, sf):
    header = headers_of(context_docs(spark, sf), some_rules(*CONTEXT_RULES))
    return header.select("unit_id", "special_invoice_type", "is_red_invoice", "red_original_no", "red_confirm_no", "invoice_type")


@query("context_lines", f"""
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '2-HIGH' THEN '皖' || o_orderkey END AS property_certificate_no, CASE o_orderpriority WHEN '2-HIGH' THEN '平方米' END AS area_unit,
  CASE o_orderpriority WHEN '2-HIGH' THEN {han_sql('o_custkey')} || '路' END AS real_estate_address, CASE o_orderpriority WHEN '2-HIGH' THEN '2024-01-01' END AS lease_start_date,
  CASE o_orderpriority WHEN '2-HIGH' THEN '2024-12-31' END AS lease_end_date, CASE o_orderpriority WHEN '2-HIGH' THEN '否' END AS cross_city_flag,
  CASE o_orderpriority WHEN '5-LOW' THEN '合肥市' END AS service_location, CASE o_orderpriority WHEN '5-LOW' THEN {han_sql('o_custkey')} || '项目' END AS project_name
FROM orders WHERE o_orderpriority IN ('2-HIGH', '5-LOW')""")
def context_lines(spark, sf):
    rules = some_rules(*CONTEXT_RULES)
    rows = lines_read(context_docs(spark, sf), rules)
    return rows.select("unit_id", "property_certificate_no", "area_unit", "real_estate_address", "lease_start_date", "lease_end_date", "cross_city_flag",
                       "service_location", "project_name")


# ---- documents with boxes ------------------------------------------------

def block(text, x: float, y: float, width: float = 60.0, height: float = 10.0) -> Column:
    value = text if isinstance(text, Column) else F.lit(text)
    return F.struct(value.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + width).alias("x1"), F.lit(y + height).alias("y1"))


def receipt_docs(spark, sf) -> DataFrame:
    amount = money_text()
    blocks = {
        "1-URGENT": F.array(
            block("安徽省医疗门诊收费票据", 300.0, 20.0), block(said("开票日期：", day_text()), 600.0, 60.0), block("检查费", 100.0, 200.0), block(amount, 400.0, 202.0),
            block("治疗费", 100.0, 230.0), block("2", 250.0, 231.0), block("10.00", 400.0, 231.0), block(said("金额合计（小写）￥", amount), 100.0, 300.0),
            block(F.concat(F.lit("收款单位（章）："), han("o_custkey"), F.lit("医院 复核人：某")), 100.0, 340.0)),
        "2-HIGH": F.array(
            block("税收完税证明", 400.0, 20.0), block("（20241）皖国证 00123456", 700.0, 60.0), block(said("填发日期：", day_text()), 300.0, 100.0),
            block("税务机关：国家税务总局合肥市税务局", 300.0, 130.0), block("张三", 800.0, 200.0), block("车辆购置税", 300.0, 350.0), block(amount, 600.0, 352.0), block("金额合计", 200.0, 500.0)),
        "3-MEDIUM": F.array(
            block("安徽省国家税务局通用机打发票", 300.0, 20.0), block(said("发票代码：", F.lit("134000000003")), 600.0, 40.0), block(said("发票号码：", short_no()), 600.0, 60.0),
            block(said("开票日期：", day_text()), 100.0, 90.0), block(F.concat(F.lit("顾客名称："), han("o_custkey"), F.lit("公司")), 100.0, 120.0), block("轮胎", 150.0, 350.0),
            block("条", 600.0, 351.0), block("2", 700.0, 351.0), block("50.00", 800.0, 352.0), block(amount, 950.0, 350.0), block(said("合计（小写）￥", amount), 150.0, 600.0),
            block("开票单位（盖章）：合肥汽配公司", 100.0, 650.0)),
        "4-NOT SPECIFIED": F.array(
            block("电子发票（机动车销售统一发票）", 300.0, 20.0), block("购买方名称", 50.0, 100.0), block(F.concat(han("o_custkey"), F.lit("公司 "), buyer_id()), 150.0, 101.0, 200.0),
            block("车辆类型", 50.0, 140.0), block("轿车 A6L 产地 中国", 150.0, 141.0, 200.0), block("合格证号 HG123", 50.0, 170.0), block("发动机号码 EN1 车辆识别代号/车架号码 VIN1", 50.0, 200.0, 300.0),
            block("价税合计", 50.0, 230.0), block(said("（小写）", amount), 150.0, 231.0), block("销货单位名称 合肥汽车公司", 50.0, 260.0, 200.0), block("纳税人识别号 91S000000000000001", 50.0, 290.0, 200.0),
            block("增值税税率 13% 税额 1.30", 50.0, 320.0, 200.0), block("不含税价 10.00", 50.0, 350.0, 200.0)),
        "5-LOW": F.array(
            block("电子发票（航空运输电子客票行程单）", 300.0, 20.0), block(said("发票号码：", long_no()), 600.0, 40.0), block(said("填开日期：", day_text()), 600.0, 60.0),
            block(said("CNY ", amount), 100.0, 200.0), block("CNY 10.00", 200.0, 200.0), block("9%", 300.0, 200.0), block("CNY 90.00", 400.0, 200.0), block("民航发展基金 CNY 50.00", 500.0, 200.0),
            block(said("CNY ", (F.col("o_totalprice").cast(MONEY) + 150).cast(MONEY).cast("string")), 700.0, 200.0), block("：中国东方航空股份有限公司", 100.0, 300.0, 200.0),
            block(F.concat(F.lit("："), han("o_custkey"), F.lit("测试单位有限公司")), 100.0, 330.0, 200.0)),
    }
    rendered = orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), by_priority(blocks).alias("blocks"))
    return X.from_blocks(rendered).drop("blocks")


RECEIPT_RULES = ("medical-fiscal-receipt", "tax-payment-certificate", "general-machine-invoice", "motor-vehicle-unified", "air-ticket-itinerary")


@query("receipt_headers", f"""
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '2-HIGH' THEN '（20241）皖国证00123456' WHEN '3-MEDIUM' THEN {SHORT_SQL} WHEN '5-LOW' THEN lpad(CAST(o_orderkey AS VARCHAR), 20, '0') END AS invoice_no,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL ELSE {DAY_SQL} END AS invoice_date,
  CASE o_orderpriority WHEN '2-HIGH' THEN '张三' WHEN '3-MEDIUM' THEN {han_sql('o_custkey')} || '公司' WHEN '4-NOT SPECIFIED' THEN {han_sql('o_custkey')} || '公司'
    WHEN '5-LOW' THEN {han_sql('o_custkey')} || '测试单位有限公司' END AS buyer_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN {han_sql('o_custkey')} || '医院' WHEN '2-HIGH' THEN '国家税务总局合肥市税务局' WHEN '3-MEDIUM' THEN '合肥汽配公司' WHEN '4-NOT SPECIFIED' THEN '合肥汽车公司'
    ELSE '中国东方航空股份有限公司' END AS seller_name,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 10.00 WHEN '5-LOW' THEN {TOTAL_SQL} + 60 ELSE {TOTAL_SQL} END::DECIMAL(18,2) AS amount_total,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1.30 WHEN '5-LOW' THEN 90.00 ELSE 0.00 END::DECIMAL(18,2) AS tax_total,
  CASE o_orderpriority WHEN '5-LOW' THEN {TOTAL_SQL} + 150 ELSE {TOTAL_SQL} END::DECIMAL(18,2) AS total_with_tax FROM orders""")
def receipt_headers(spark, sf):
    header = headers_of(receipt_docs(spark, sf), some_rules(*RECEIPT_RULES))
    return header.select("unit_id", "invoice_no", "invoice_date", "buyer_name", "seller_name", "amount_total", "tax_total", "total_with_tax")


@query("receipt_lines", f"""
SELECT o_orderkey AS unit_id, line_no, name AS item_name, unit, CAST(q AS DECIMAL(18,2)) AS quantity, CAST(a AS DECIMAL(18,2)) AS line_amount, CAST(t AS DECIMAL(18,2)) AS line_tax_amount FROM (
  SELECT o_orderkey, 1 AS line_no, '检查费' AS name, NULL AS unit, NULL AS q, {TOTAL_SQL} AS a, 0.00 AS t FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 2, '治疗费', NULL, 2, 10.00, 0 FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, 1, '车辆购置税', NULL, NULL, {TOTAL_SQL}, 0 FROM orders WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT o_orderkey, 1, '轮胎', '条', 2, {TOTAL_SQL}, 0 FROM orders WHERE o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT o_orderkey, 1, '轿车', NULL, NULL, 10.00, 1.30 FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
  UNION ALL SELECT o_orderkey, 1, '航空运输服务（票价+燃油附加费）', NULL, 1, {TOTAL_SQL} + 10, 90 FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT o_orderkey, 2, '民航发展基金', NULL, 1, 50, 0 FROM orders WHERE o_orderpriority = '5-LOW')""")
def receipt_lines(spark, sf):
    rules = some_rules(*RECEIPT_RULES)
    rows = lines_read(receipt_docs(spark, sf), rules)
    return rows.select("unit_id", "line_no", "item_name", "unit", F.col("quantity").cast(MONEY).alias("quantity"), "line_amount", "line_tax_amount")


# ---- the fixed-layout form and the legacy itinerary -----------------------

def form_docs(spark, sf) -> DataFrame:
    amount = money_text()
    blocks = F.array(
        block("机器编号 发票号码 开票日期", 0.0, 5.0), block("034001900111", 200.0, 20.0), block(short_no(), 460.0, 38.0), block(day_text(), 470.0, 55.0),
        block(F.concat(F.lit("称："), han("o_custkey"), F.lit("有限公司")), 100.0, 85.0), block(buyer_id(), 100.0, 105.0),
        block("货物或应税劳务、服务名称", 10.0, 160.0), block(F.concat(F.lit("*商品*"), han("o_custkey")), 10.0, 175.0), block("A1", 120.0, 175.0), block("个", 180.0, 175.0),
        block("1", 220.0, 175.0), block("5.55", 260.0, 175.0), block(amount, 330.0, 175.0), block("13%", 400.0, 175.0), block("13.00", 450.0, 175.0), block("续名", 10.0, 190.0),
        block("合 计", 50.0, 258.0), block(said("¥", amount), 400.0, 258.0), block("¥13.00", 500.0, 258.0),
        block(said("（小写）¥", (F.col("o_totalprice").cast(MONEY) + 13).cast(MONEY).cast("string")), 400.0, 278.0),
        block("称：测试销售有限公司", 100.0, 300.0), block("91S000000000000001", 100.0, 312.0))
    rendered = orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), blocks.alias("blocks"))
    return X.from_blocks(rendered).drop("blocks")


@query("form_headers", f"""
SELECT o_orderkey AS unit_id, '034001900111' AS invoice_code, {SHORT_SQL} AS invoice_no, {DAY_SQL} AS invoice_date, {han_sql('o_custkey')} || '有限公司' AS buyer_name,
  '91B' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS buyer_tax_id, '测试销售有限公司' AS seller_name, '91S000000000000001' AS seller_tax_id,
  {TOTAL_SQL} AS amount_total, 13.00::DECIMAL(18,2) AS tax_total, ({TOTAL_SQL} + 13)::DECIMAL(18,2) AS total_with_tax FROM orders""")
def form_headers(spark, sf):
    header = headers_of(form_docs(spark, sf), some_rules("standard-invoice"))
    return header.select("unit_id", "invoice_code", "invoice_no", "invoice_date", "buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id",
                         "amount_total", "tax_total", "total_with_tax")


@query("form_lines", f"""
SELECT o_orderkey AS unit_id, '*商品*' || {han_sql('o_custkey')} || '续名' AS item_name, 'A1' AS spec_model, '个' AS unit, 1.00::DECIMAL(18,2) AS quantity, 5.55::DECIMAL(18,2) AS unit_price,
  {TOTAL_SQL} AS line_amount, '13%' AS tax_rate, 13.00::DECIMAL(18,2) AS line_tax_amount FROM orders""")
def form_lines(spark, sf):
    rows = lines_read(form_docs(spark, sf), some_rules("standard-invoice"))
    return rows.select("unit_id", "item_name", "spec_model", "unit", F.col("quantity").cast(MONEY).alias("quantity"),
                       F.col("unit_price").cast(MONEY).alias("unit_price"), "line_amount", "tax_rate", "line_tax_amount")


def legacy_air_docs(spark, sf) -> DataFrame:
    whole = (F.col("o_totalprice").cast(MONEY) + 130).cast(MONEY).cast("string")
    lines = lines_of(
        "航空运输电子客票行程单", F.concat(F.lit("781"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")), "李四", "东方航空", "2024-01-01",
        said("CNY ", money_text()), "CN 50.00", "YQ 80.00", said("CNY ", whole), said("填开日期 ", day_text()))
    return orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), lines.alias("lines"))


@query("legacy_air_records", f"""
WITH v AS (SELECT *, CAST({TOTAL_SQL} * 100 AS BIGINT) AS f FROM orders),
t AS (SELECT *, CAST((f + 8000) * 9 AS HUGEINT) AS share FROM v),
x AS (SELECT *, (2 * share + 109) // 218 AS tax FROM t)
SELECT o_orderkey AS unit_id, '781' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS invoice_no, {DAY_SQL} AS invoice_date, '李四' AS buyer_name, '东方航空' AS seller_name,
  CAST(tax AS DECIMAL(18,2)) / 100 = CAST(tax AS DECIMAL(18,2)) / 100 AS split, CAST((f + 13000) / 100 AS DECIMAL(18,2)) AS total_with_tax,
  CAST(tax / 100 AS DECIMAL(18,2)) AS tax_total, 3 AS n_lines FROM x""")
def legacy_air_records(spark, sf):
    outcome = pipeline.process(legacy_air_docs(spark, sf), "run-1", "2024-01-02T03:04:05", some_rules("air-ticket-itinerary"))
    size = outcome.records.lines.groupBy("unit_id").agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
    return outcome.records.invoices.join(keyed(size), "unit_id").select(
        "unit_id", "invoice_no", "invoice_date", "buyer_name", "seller_name", F.lit(True).alias("split"), "total_with_tax", "tax_total", "n_lines")


@query("untaxed_invoices", f"""
SELECT o_orderkey AS unit_id, CASE o_orderstatus WHEN 'P' THEN NULL ELSE {TOTAL_SQL} END AS amount_total, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 0.00 END::DECIMAL(18,2) AS tax_total, {TOTAL_SQL} AS total_with_tax FROM orders""")
def untaxed_invoices(spark, sf):
    amount = money_text()
    rate = F.when(F.col("o_orderstatus") == "P", F.lit("免税")).otherwise(F.lit("不征税"))
    lines = lines_of("电子发票（普通发票）", said("发票号码：", long_no()), said("开票日期：", day_text()), "*预付卡*充值", "次", "1", amount, F.concat(amount, F.lit(" "), rate),
                     said("价税合计（小写）￥", amount))
    docs = orders(spark, sf).select(F.col("o_orderkey").alias("unit_id"), lines.alias("lines"))
    return headers_of(docs, some_rules("standard-invoice")).select("unit_id", "amount_total", "tax_total", "total_with_tax")
