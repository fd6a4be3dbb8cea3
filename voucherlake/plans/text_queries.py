"""Queries: column helpers over the tables, routing, extraction and candidate resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from voucherlake.functions import dates as D
from voucherlake.functions import labels as L
from voucherlake.functions import money as M
from voucherlake.functions import text as T
from voucherlake.operators import candidates as C
from voucherlake.operators import extract as E
from voucherlake.operators import ordered, routing
from voucherlake.plans import fixtures as fx
from voucherlake.plans.registry import query
from voucherlake.rules.tables import cycles, effective_rules, inheritance_closure, shipped

HAN = "零壹贰叁肆伍陆柒捌玖"


def han(name: str):
    """A key written in Chinese digits, so that names are all Han."""
    return F.translate(F.col(name).cast("string"), "0123456789", HAN)


def han_sql(name: str) -> str:
    return f"translate(CAST({name} AS VARCHAR), '0123456789', '{HAN}')"


# ---- column helpers ------------------------------------------------------

@query("money_formats", """
WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CAST(l_tax AS DECIMAL(4,2)) AS r, l_partkey FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, v AS parsed, CAST(v AS VARCHAR) AS printed, CAST(round(v / 8, 2) AS DECIMAL(18,2)) IS NOT NULL AS eighth_known,
  CAST(v AS VARCHAR) || '|' || CAST(r AS VARCHAR) AS found, CASE WHEN r = 0 THEN '0' ELSE CAST(CAST(r * 100 AS INTEGER) AS VARCHAR) END || '%' AS percent,
  CAST(CAST(r * 100 AS INTEGER) AS DECIMAL(9,6)) / 100 = r AS ratio_same, 2 AS scale FROM v""")
def money_formats(spark, sf):
    value = F.col("l_extendedprice").cast(M.MONEY)
    rate = F.col("l_tax").cast("decimal(4,2)")
    text = F.concat(F.lit(" ￥ "), F.format_number(value, 2))
    line = F.concat(F.lit("金额 ￥"), F.format_number(value, 2), F.lit(" 税 "), rate.cast("string"))
    percent = M.rate_to_percent(rate)
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", M.to_money(text).alias("parsed"), M.format_money(M.to_money(text)).alias("printed"),
        M.to_money(F.lit("x")).isNull().alias("eighth_known"), F.array_join(M.money_values(line), "|").alias("found"),
        percent.alias("percent"), (M.percent_to_ratio(percent) == rate).alias("ratio_same"), M.decimal_scale(text).alias("scale"))


@query("date_formats", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS han, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS slash,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS spaced, CAST(NULL AS VARCHAR) AS impossible FROM orders""")
def date_formats(spark, sf):
    day = F.col("o_orderdate")
    parts = [F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")]
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        D.iso_date(F.concat(F.lit("开票日期："), parts[0], F.lit(" 年"), parts[1], F.lit("月 "), parts[2], F.lit("日"))).alias("han"),
        D.iso_date(F.concat_ws("/", *parts)).alias("slash"), D.spaced_iso_date(F.concat_ws("  ", *parts)).alias("spaced"),
        D.iso_date(F.concat(parts[0], F.lit("-13-"), parts[2])).alias("impossible"))


@query("token_class", """
WITH t AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents),
c AS (SELECT CASE WHEN token = '' THEN 'blank' WHEN token = '*' THEN 'star' WHEN starts_with(token, '*') THEN 'name'
  WHEN regexp_full_match(token, '[0-9]+(\\.[0-9]+)?%') THEN 'rate'
  WHEN regexp_full_match(replace(replace(replace(token, ',', ''), '￥', ''), '¥', ''), '-?[0-9]+(\\.[0-9]+)?') THEN 'number'
  WHEN regexp_full_match(token, '[¥￥]?-?[0-9][0-9,]*(\\.[0-9]+)?') THEN 'money'
  WHEN regexp_matches(token, '[0-9]') THEN 'spec'
  WHEN length(regexp_replace(token, '[^(（]', '', 'g')) > length(regexp_replace(token, '[^)）]', '', 'g')) THEN 'open'
  WHEN regexp_matches(token, '[一-鿿]') THEN 'han' ELSE 'text' END AS class FROM t)
SELECT class, count(*) AS n FROM c GROUP BY class""")
def token_class(spark, sf):
    tokens = fx.table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("token"))
    return tokens.groupBy(T.token_class(F.col("token")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("identity_predicates", """
SELECT o_orderkey, length(k) = 20 AS digital, CASE WHEN length(k) >= 15 AND (o_orderstatus = 'P' OR length(k) IN (15, 18)) THEN k ELSE '' END AS tax_ids, o_orderstatus = 'F' AS secondary, o_orderstatus = 'O' AS identity
FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'A' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') WHEN 'F' THEN lpad(CAST(o_orderkey AS VARCHAR), 18, '0') ELSE lpad(CAST(o_orderkey AS VARCHAR), 20, '0') END AS k FROM orders)""")
def identity_predicates(spark, sf):
    key = F.col("o_orderkey").cast("string")
    status = F.col("o_orderstatus")
    number = F.when(status == "P", F.concat(F.lit("A"), F.lpad(key, 15, "0"))).when(status == "F", F.lpad(key, 18, "0")).otherwise(F.lpad(key, 20, "0"))
    line = F.concat(F.when(status == "F", F.lit("原 发 票 ")).when(status == "O", F.lit("纳税人 识别号 ")).otherwise(F.lit("编号 ")), number)
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", T.is_digital_no(number).alias("digital"), F.array_join(T.tax_ids(line), "|").alias("tax_ids"),
        T.secondary_context(line).alias("secondary"), T.identity_context(line).alias("identity"))


@query("folded_text", """
SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS compact, md5(text) AS folded, 'A1(株)' || doc_id AS wide FROM documents""")
def folded_text(spark, sf):
    wide = F.concat(F.lit("Ａ１㈱"), F.col("doc_id"))
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("compact"), F.md5(T.nfkc(F.col("text"))).alias("folded"),
        T.nfkc(wide).alias("wide"))


@query("party_names", f"""
SELECT s_suppkey, {han_sql('s_suppkey')} || '贸易有限公司' AS company, '名称 ' || s_name AS cleaned, s_name AS plain FROM supplier""")
def party_names(spark, sf):
    printed = F.concat(F.lit("名称： "), han("s_suppkey"), F.lit("贸易 有限公司 "), F.col("s_name"))
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey", T.company_name(F.concat(F.lit("："), F.split_part(printed, F.lit("： "), F.lit(2)))).alias("company"),
        T.clean_label_value(F.concat(F.lit(" ：名称 "), "s_name", F.lit("。 "))).alias("cleaned"),
        T.clean_label_value(F.concat(F.lit("；"), "s_name", F.lit("，"))).alias("plain"))


@query("line_remarks", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN '货运：货车 皖C' || l_suppkey || '；' || l_suppkey || '→' || l_partkey || '；货物：' || l_partkey ELSE '' END
  || CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN '；' ELSE '' END || '折扣行，关联第' || l_linenumber || '行' ELSE '' END AS remark,
  CASE WHEN l_returnflag = 'A' THEN '否' ELSE '是' END AS positive,
  CASE WHEN l_returnflag = 'A' THEN '红冲发票；被红冲蓝字号码：' || l_partkey ELSE '' END AS red FROM lineitem""")
def line_remarks(spark, sf):
    freight = F.col("l_returnflag") == "R"

    def text(value):
        return F.when(freight, value.cast("string"))

    fields = {
        "transport_vehicle_type": text(F.lit("货车")), "transport_vehicle_no": text(F.concat(F.lit("皖C"), "l_suppkey")),
        "origin_place": text(F.col("l_suppkey")), "destination_place": text(F.col("l_partkey")), "transport_goods_name": text(F.col("l_partkey")),
        "discount_for_line_no": F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))}
    red = F.when(F.col("l_returnflag") == "A", F.lit("是"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", L.line_remark(fields).alias("remark"), L.positive_flag(F.lit(1), red).alias("positive"),
        L.red_context(red, F.col("l_partkey").cast("string"), F.lit(None).cast("string"), F.lit("")).alias("red"))


@query("price_quantity_split", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, CAST(900 + l_partkey % 97 AS INTEGER) || '.' || lpad(CAST(l_suppkey % 90 + 10 AS VARCHAR), 2, '0') AS price FROM lineitem),
s AS (SELECT *, price || q AS glued, CAST(price AS DECIMAL(18,2)) * q AS amount FROM p),
cuts AS (SELECT *, n, substr(glued, 1, length(glued) - n) AS cp, right(glued, n) AS cq FROM s, (SELECT unnest(range(1, 7)) AS n)),
ok AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, glued, amount ORDER BY n) AS rn FROM cuts
  WHERE regexp_full_match(cq, '[0-9]+') AND abs(TRY_CAST(cp AS DECIMAL(18,6)) * TRY_CAST(cq AS DECIMAL(18,0)) - amount) <= 0.05)
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, cp AS price, cq AS quantity FROM ok WHERE rn = 1""")
def price_quantity_split(spark, sf):
    price = F.concat((900 + F.col("l_partkey") % 97).cast("int").cast("string"), F.lit("."), F.lpad((F.col("l_suppkey") % 90 + 10).cast("string"), 2, "0"))
    quantity = F.col("l_quantity").cast("int")
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(price, quantity.cast("string")).alias("glued"),
        (price.cast("decimal(18,2)") * quantity).cast(M.MONEY).alias("amount"))
    split = M.split_price_quantity(F.col("glued"), F.col("amount"))
    return rows.withColumn("s", split).select("l_orderkey", "l_linenumber", "l_partkey", "s.price", "s.quantity").distinct()


@query("spec_split", """
SELECT p_partkey, p_name || '型' AS item_name, p_size || 'm，' || p_size || 'mm' AS spec_model, p_name AS without_spec FROM part""")
def spec_split(spark, sf):
    size = F.col("p_size").cast("string")
    spec = F.concat(size, F.lit("m，"), size, F.lit("mm"))
    name = F.concat("p_name", F.lit("型 "), spec)
    parts = T.split_embedded_spec(name, F.lit(None).cast("string"))
    return fx.table(spark, sf, "part").withColumn("s", parts).select(
        "p_partkey", "s.item_name", "s.spec_model", T.remove_spec(F.concat("p_name", F.lit(" "), F.upper("p_brand")), F.col("p_brand")).alias("without_spec"))


@query("printed_labels", """
SELECT doc_id, CASE lang WHEN 'en' THEN '通过' WHEN 'fr' THEN '需复核' WHEN 'de' THEN '失败' ELSE lang END AS status,
  CASE WHEN n_chars % 3 = 0 THEN '未识别页码' WHEN n_chars % 3 = 1 THEN '第 1 页' ELSE '第 1-3 页' END AS pages, 'd' || doc_id || '.pdf' AS file, '''=' || doc_id AS cell FROM documents""")
def printed_labels(spark, sf):
    status = F.when(F.col("lang") == "en", F.lit("ready")).when(F.col("lang") == "fr", F.lit("review_required")).when(
        F.col("lang") == "de", F.lit("failed")).otherwise(F.col("lang"))
    third = F.col("n_chars") % 3
    pages = F.when(third == 0, F.array(F.lit(0))).when(third == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(3), F.lit(1), F.lit(0)))
    return fx.table(spark, sf, "documents").select(
        "doc_id", L.status_label(status).alias("status"), L.page_text(pages).alias("pages"),
        L.file_name(F.concat(F.lit("/in\\x/d"), "doc_id", F.lit(".pdf"))).alias("file"), L.csv_safe(F.concat(F.lit("="), "doc_id")).alias("cell"))


# ---- rules ---------------------------------------------------------------

@query("rule_inheritance", """
WITH own AS (
  SELECT 'region_' || r_regionkey AS id, NULL AS parent, 'name' AS path, r_name AS value FROM region UNION ALL SELECT 'region_' || r_regionkey, NULL, 'region', r_name FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'name', n_name FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'name' ELSE 'segment' END, c_mktsegment FROM customer),
link AS (SELECT DISTINCT id, parent FROM own),
closure AS (SELECT id, id AS anc, 0 AS depth FROM link UNION ALL SELECT a.id, a.parent, 1 FROM link a WHERE a.parent IS NOT NULL
  UNION ALL SELECT a.id, b.parent, 2 FROM link a JOIN link b ON a.parent = b.id WHERE b.parent IS NOT NULL),
ranked AS (SELECT c.id, path, value, depth, row_number() OVER (PARTITION BY c.id, path ORDER BY depth) AS rn FROM closure c JOIN own o ON c.anc = o.id)
SELECT id AS schema_id, path, value, depth FROM ranked WHERE rn = 1""")
def rule_inheritance(spark, sf):
    def rows(name, key, parent, path, value):
        return fx.table(spark, sf, name).select(key.alias("schema_id"), parent.cast("string").alias("extends"), path.alias("path"), value.alias("value"))

    region = F.concat(F.lit("region_"), "r_regionkey")
    rules = (
        rows("region", region, F.lit(None), F.lit("name"), F.col("r_name"))
        .unionByName(rows("region", region, F.lit(None), F.lit("region"), F.col("r_name")))
        .unionByName(rows("nation", F.concat(F.lit("nation_"), "n_nationkey"), F.concat(F.lit("region_"), "n_regionkey"), F.lit("name"), F.col("n_name")))
        .unionByName(rows("customer", F.concat(F.lit("customer_"), "c_custkey"), F.concat(F.lit("nation_"), "c_nationkey"),
                          F.when(F.col("c_acctbal") < 0, F.lit("name")).otherwise(F.lit("segment")), F.col("c_mktsegment"))))
    return effective_rules(rules)


@query("rule_cycles", """
SELECT 'nation_' || n_nationkey AS schema_id, 'nation_' || n_nationkey || ' -> ' || 'region_' || n_regionkey || ' -> ' || 'nation_' || n_nationkey AS chain FROM nation
 WHERE n_nationkey = (SELECT min(b.n_nationkey) FROM nation b WHERE b.n_regionkey = nation.n_regionkey)
UNION ALL SELECT 'region_' || r_regionkey, 'region_' || r_regionkey || ' -> nation_' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) || ' -> region_' || r_regionkey FROM region
UNION ALL SELECT 'nation_' || n_nationkey, 'nation_' || n_nationkey || ' -> region_' || n_regionkey || ' -> nation_' || (SELECT min(b.n_nationkey) FROM nation b WHERE b.n_regionkey = nation.n_regionkey) || ' -> region_' || n_regionkey
 FROM nation WHERE n_nationkey <> (SELECT min(b.n_nationkey) FROM nation b WHERE b.n_regionkey = nation.n_regionkey)""")
def rule_cycles(spark, sf):
    # Every region inherits from its first nation, which inherits from the region.
    nation = fx.table(spark, sf, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    links = nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("schema_id"), F.concat(F.lit("region_"), "n_regionkey").alias("extends")).unionByName(
        first.select(F.concat(F.lit("region_"), "n_regionkey").alias("schema_id"), F.concat(F.lit("nation_"), "first").alias("extends")))
    return cycles(inheritance_closure(links)).select("schema_id", "chain")


# ---- routing -------------------------------------------------------------

WORD_RULES = {
    "alpha": {"schema_id": "alpha", "match_rules": {"required_any": ["the", "and", "of", "in"], "min_required_any": 2, "exclude_any": ["@"]},
              "variants": ["plain"], "variant_rules": {"mail": {"keywords": ["http"]}}},
    "beta": {"schema_id": "beta", "match_rules": {"required_all": ["der"], "required_any": ["und", "die", "ein"]}, "default_variant": "deutsch"},
    "gamma": {"schema_id": "gamma", "match_rules": {"required_any": ["que", "les", "des", "une"], "min_required_any": 3}, "variants": ["x", "y"]},
    "rest": {"schema_id": "rest", "match_rules": {"required_any": ["a", "e", "zz"]}, "variants": ["only"]},
}


@query("route_documents", """
WITH s AS (SELECT doc_id, text,
  CASE WHEN contains(text, '@') THEN 0 WHEN contains(text, 'the')::INT + contains(text, 'and')::INT + contains(text, 'of')::INT + contains(text, 'in')::INT < 2 THEN 0
    ELSE contains(text, 'the')::INT + contains(text, 'and')::INT + contains(text, 'of')::INT + contains(text, 'in')::INT END AS a,
  CASE WHEN NOT contains(text, 'der') THEN 0 WHEN contains(text, 'und')::INT + contains(text, 'die')::INT + contains(text, 'ein')::INT < 1 THEN 0
    ELSE 1 + contains(text, 'und')::INT + contains(text, 'die')::INT + contains(text, 'ein')::INT END AS b,
  CASE WHEN contains(text, 'que')::INT + contains(text, 'les')::INT + contains(text, 'des')::INT + contains(text, 'une')::INT < 3 THEN 0
    ELSE contains(text, 'que')::INT + contains(text, 'les')::INT + contains(text, 'des')::INT + contains(text, 'une')::INT END AS g,
  contains(text, 'a')::INT + contains(text, 'e')::INT AS r FROM documents),
d AS (SELECT *, CASE WHEN greatest(a, b, g) > 0 THEN CASE WHEN a >= b AND a >= g THEN 'alpha' WHEN b >= g THEN 'beta' ELSE 'gamma' END WHEN r >= 2 THEN 'rest' END AS schema_id FROM s)
SELECT doc_id AS unit_id, schema_id, CASE schema_id WHEN 'alpha' THEN CASE WHEN contains(text, 'http') THEN 'mail' ELSE 'plain' END WHEN 'beta' THEN 'deutsch' WHEN 'rest' THEN 'only' END AS variant_id,
  CAST(round(CASE WHEN schema_id IS NULL THEN 0 WHEN schema_id = 'rest' THEN 0.45 + r * 0.12 ELSE least(0.99, 0.55 + greatest(a, b, g) * 0.08) END, 4) AS DOUBLE) AS confidence,
  CASE WHEN schema_id IS NULL THEN 'unmodeled' ELSE 'matched' END AS decision FROM d""")
def route_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.split("text", "\n").alias("lines"))
    decided = routing.route(docs, WORD_RULES, "rest")
    return decided.select("unit_id", "schema_id", "variant_id", F.round("route_confidence", 4).alias("confidence"), "decision")


# Rendered documents: every order becomes a document whose words follow from its row.
TYPE_TEXTS = {
    "1-URGENT": ("railway-ticket", ["电子发票（铁路电子客票）", "票价 1.00"]),
    "2-HIGH": ("toll-invoice", ["通行费", "皖A12345 合肥站入 芜湖站出", "发票号码", "不征税"]),
    "3-MEDIUM": ("standard-invoice", ["电子发票（普通发票）", "发票号码：1", "开票日期", "成品油制品"]),
    "4-NOT SPECIFIED": ("refined-oil", ["电子发票(普通发票)", " 成品油 ", "发票号码：1", "纳税人识别号"]),
    "5-LOW": (None, ["普通文本", "价税合计"]),
}


def routed_orders(spark, sf):
    lines = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(t) for t in x]) for p, (_s, t) in TYPE_TEXTS.items() for x in (p, t)])
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit_id"), F.concat(F.try_element_at(lines, F.col("o_orderpriority")), F.array(F.col("o_orderstatus"))).alias("lines"))


ROUTED_SQL = """
SELECT o_orderkey AS unit_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'railway-ticket' WHEN '2-HIGH' THEN 'toll-invoice' WHEN '3-MEDIUM' THEN 'standard-invoice'
   WHEN '4-NOT SPECIFIED' THEN 'refined-oil' END AS schema_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'railway-electronic-ticket' WHEN '2-HIGH' THEN '不征税通行费' WHEN '3-MEDIUM' THEN 'digital-invoice-form' WHEN '4-NOT SPECIFIED' THEN 'digital-invoice-form' END AS variant_id,
  CAST(round(CASE o_orderpriority WHEN '1-URGENT' THEN 0.55 + 2 * 0.08 WHEN '2-HIGH' THEN 0.55 + 4 * 0.08 WHEN '3-MEDIUM' THEN 0.45 + 2 * 0.12 WHEN '4-NOT SPECIFIED' THEN 0.55 + 3 * 0.08 ELSE 0 END, 4) AS DOUBLE) AS confidence
FROM orders"""


@query("route_shipped_rules", ROUTED_SQL)
def route_shipped_rules(spark, sf):
    decided = routing.route(routed_orders(spark, sf))
    return decided.select("unit_id", "schema_id", "variant_id", F.round("route_confidence", 4).alias("confidence"))


@query("route_spans", ROUTED_SQL)
def route_spans(spark, sf):
    spans = routed_orders(spark, sf).select("unit_id", F.explode("lines").alias("text"))
    decided = routing.route_spans(spans)
    return decided.select("unit_id", "schema_id", "variant_id", F.round("route_confidence", 4).alias("confidence"))


# ---- candidates ----------------------------------------------------------

def _event_candidates(spark, sf):
    """Events as candidates: unit = user, field = type, value = k of the props, confidence from the value."""
    events = fx.table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("unit_id"), F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("pos"),
        (F.pmod(F.round(F.col("value") * 100).cast("int"), F.lit(41)) / 100 + 0.59).alias("confidence"),
        F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("event "), "event_id")).alias("evidence"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("low_confidence_ocr"))).otherwise(F.array().cast("array<string>")).alias("risks"))


CANDIDATES_SQL = """
WITH c AS (SELECT user_id AS unit_id, event_type AS field, json_extract_string(props, '$.k') AS value, event_id AS pos,
   (CAST(round(value * 100) AS INTEGER) % 41 + 41) % 41 / 100 + 0.59 AS confidence, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'event ' || event_id END AS evidence, event_id % 5 = 0 AS low FROM events),
u AS (SELECT unit_id, field, value, min(pos) AS pos, max(confidence) AS confidence, arg_max(evidence, ROW(confidence, -pos)) AS evidence, arg_max(low, ROW(confidence, -pos)) AS low FROM c GROUP BY ALL),
best AS (SELECT unit_id, field, arg_max(value, ROW(confidence, -pos)) AS value, max(confidence) AS confidence, arg_max(evidence, ROW(confidence, -pos)) AS evidence,
   arg_max(low, ROW(confidence, -pos)) AS low, count(*) AS candidate_count FROM u GROUP BY ALL),
rivals AS (SELECT u.unit_id, u.field, u.value, u.confidence FROM u JOIN best b USING (unit_id, field) WHERE u.value <> b.value AND u.confidence >= 0.85 AND b.confidence >= 0.85
   AND abs(b.confidence - u.confidence) <= 0.05)
"""


@query("candidate_upsert", CANDIDATES_SQL + "SELECT unit_id, field, value, pos, round(confidence, 4) AS confidence, evidence FROM u")
def candidate_upsert(spark, sf):
    return C.upsert(_event_candidates(spark, sf)).select("unit_id", "field", "value", "pos", F.round("confidence", 4).alias("confidence"), "evidence")


@query("candidate_resolve", CANDIDATES_SQL + """
SELECT b.unit_id, b.field, b.value, round(b.confidence, 4) AS confidence, candidate_count, coalesce(n, 0) AS n_conflicts,
  concat_ws(',', CASE WHEN low THEN 'low_confidence_ocr' END, CASE WHEN n > 0 THEN 'conflict' END, CASE WHEN trim(evidence) = '' THEN 'missing_evidence' END, CASE WHEN low THEN 'low_confidence' END) AS risks
FROM best b LEFT JOIN (SELECT unit_id, field, count(*) AS n FROM rivals GROUP BY ALL) USING (unit_id, field)""")
def candidate_resolve(spark, sf):
    decided = C.resolve(C.upsert(_event_candidates(spark, sf)))
    return decided.select("unit_id", "field", "value", F.round("confidence", 4).alias("confidence"), "candidate_count", "n_conflicts",
                          F.array_join("risks", ",").alias("risks"))


@query("conflicts", CANDIDATES_SQL + "SELECT unit_id, field, value, round(confidence, 4) AS confidence FROM rivals")
def conflicts(spark, sf):
    return C.conflicts(C.upsert(_event_candidates(spark, sf))).select("unit_id", "field", "value", F.round("confidence", 4).alias("confidence"))


@query("unit_confidence", CANDIDATES_SQL + "SELECT unit_id, round(avg(confidence), 2) AS confidence FROM u GROUP BY unit_id")
def unit_confidence(spark, sf):
    means = C.unit_confidence(C.upsert(_event_candidates(spark, sf)))
    return means.select("unit_id", F.round("confidence", 2).alias("confidence"))


@query("evidence_issues", CANDIDATES_SQL + """,
d AS (SELECT b.*, coalesce(n, 0) > 0 AS conflict FROM best b LEFT JOIN (SELECT unit_id, field, count(*) AS n FROM rivals GROUP BY ALL) USING (unit_id, field))
SELECT unit_id, 'missing evidence ' || field AS text FROM d WHERE trim(evidence) = '' UNION ALL SELECT unit_id, 'conflict ' || field FROM d WHERE conflict
UNION ALL SELECT unit_id, 'low confidence ' || field FROM d WHERE confidence < 0.6 OR low""")
def evidence_issues(spark, sf):
    from voucherlake.operators import checks

    return checks.evidence_issues(C.resolve(C.upsert(_event_candidates(spark, sf)))).select("unit_id", "text")


@query("items_decision", CANDIDATES_SQL + """,
i AS (SELECT unit_id, pos AS line_no, confidence, evidence, low FROM c)
SELECT unit_id, count(*) || ' item candidate(s)' AS value, round(min(confidence), 4) AS confidence, count(*) AS candidate_count,
  CASE WHEN bool_or(low) THEN 'low_confidence_ocr,low_confidence' ELSE '' END AS risks, coalesce(string_agg(evidence, '; ' ORDER BY line_no) FILTER (trim(evidence) <> ''), '') AS evidence
FROM i GROUP BY unit_id""")
def items_decision(spark, sf):
    items = _event_candidates(spark, sf).withColumnRenamed("pos", "line_no")
    decided = C.items_decision(items)
    return decided.select("unit_id", "value", F.round("confidence", 4).alias("confidence"), "candidate_count", F.array_join("risks", ",").alias("risks"), "evidence")


@query("low_confidence_risks", """
WITH c AS (SELECT doc_id % 50 AS unit_id, source AS value, min('ev ' || doc_id) AS evidence FROM documents GROUP BY ALL),
low AS (SELECT DISTINCT item_id % 50 AS unit_id, 'x src' || item_id || ' y' AS text FROM benchmark),
hit AS (SELECT DISTINCT c.unit_id, c.value FROM c JOIN low USING (unit_id) WHERE contains(low.text, c.value))
SELECT c.unit_id, c.value, CASE WHEN h.value IS NOT NULL THEN 'low_confidence_ocr' ELSE '' END AS risks FROM c LEFT JOIN hit h USING (unit_id, value)""")
def low_confidence_risks(spark, sf):
    documents = fx.table(spark, sf, "documents")
    candidates = documents.groupBy((F.col("doc_id") % 50).alias("unit_id"), F.col("source").alias("value")).agg(
        F.min(F.concat(F.lit("ev "), "doc_id")).alias("evidence")).withColumn("risks", F.array().cast("array<string>"))
    spans = fx.table(spark, sf, "benchmark").select(
        (F.col("item_id") % 50).alias("unit_id"), F.concat(F.lit("x src"), "item_id", F.lit(" y")).alias("text"), F.lit(0.5).alias("confidence"))
    return C.low_confidence_risks(candidates, spans).select("unit_id", "value", F.array_join("risks", ",").alias("risks"))


# ---- ordered windows -----------------------------------------------------

def _turns(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("ord"), "role", F.length("text").alias("size"))


@query("label_lookahead", """
SELECT conv_id, turn + 1 AS ord, coalesce(lag(role, 2) OVER w, '') || '|' || coalesce(lag(role, 1) OVER w, '') AS before,
  coalesce(lead(role, 1) OVER w, '') || '|' || coalesce(lead(role, 2) OVER w, '') || '|' || coalesce(lead(role, 3) OVER w, '') AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def label_lookahead(spark, sf):
    # Chunks of two rows, so that every window crosses a border.
    near = ordered.neighbours(_turns(spark, sf), ["conv_id"], "ord", "role", 2, 3, size=2)

    def at(name, index):
        return F.coalesce(F.get(name, index), F.lit(""))

    prev = F.size("prev")
    before = F.concat_ws("|", F.when(prev >= 2, at("prev", prev - 2)).otherwise(F.lit("")), F.when(prev >= 1, at("prev", prev - 1)).otherwise(F.lit("")))
    after = F.concat_ws("|", *[at("next", F.lit(i)) for i in range(3)])
    return near.select("conv_id", "ord", before.alias("before"), after.alias("after"))


@query("nearest_role", """
SELECT conv_id, turn + 1 AS ord, last_value(CASE WHEN role = 'user' THEN turn + 1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations""")
def nearest_role(spark, sf):
    turns = _turns(spark, sf)
    marked = ordered.last_before(turns, ["conv_id"], ["ord"], F.when(F.col("role") == "user", F.col("ord")), "last_user", size=2)
    summed = ordered.running_sum(marked, ["conv_id"], ["ord"], F.col("size"), "running", size=2)
    return summed.select("conv_id", "ord", "last_user", "running")
