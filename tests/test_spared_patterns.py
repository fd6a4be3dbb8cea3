"""Tests of texts that spare patterns tell the same as the patterns."""

from pyspark.sql import functions as F

from voucherlake.functions import dates as D
from voucherlake.functions import money as M
from voucherlake.functions import text as T
from voucherlake.operators.extract import party_texts, rule_column


def test_shortest_terms():
    assert T.shortest(["红字发票信息", "红字发票", "红冲", "红冲"]) == ["红字发票", "红冲"]
    assert T.shortest(["", "a"]) == [""] and T.shortest([]) == []


def test_spared_patterns_give_the_same(spark):
    texts = ["", " ", "12", "1,234. 50", "¥ 12", "１２", "-3.5", "1.2.3", "a1", "13%", "货13 %", "不征税", "免税额", "*", "2024年 1 月2日", "2024/1-2", "年/月", "12\n",
             "(甲)", "甲）", "红 字发票 1", "纳税人　识别号", "识别", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.translate(F.trim(t), ",￥¥", "")
    pairs = {
        "number": (M.is_number(t), F.regexp_replace(plain, r"(?U)\s*\.\s*", ".").rlike(M.NUMBER_FULL)),
        "rate": (M.is_rate(t), F.trim(t).rlike(M.RATE_FULL)),
        "rated": (M.has_rate(t), F.regexp_extract(t, M.RATE_PATTERN, 1) != ""),
        "date": (D.has_date(t), t.rlike(D.DATE_PATTERN)),
        "brackets": (T.full_width_brackets(t), F.translate(t, "()", "（）")),
        "second": (T.secondary_context(t), T.compact(t).rlike("|".join(T.SECONDARY_IDENTITY_TERMS))),
        "identity": (T.identity_context(t), T.compact(t).rlike("|".join(T.IDENTITY_NUMBER_TERMS))),
    }
    for name, (now, was) in pairs.items():
        assert [r.t for r in rows.filter(~now.eqNullSafe(was)).collect()] == [], name


def test_names_by_labels_among_other_lines(spark):
    rules = {"x": {"text_labels": {"buyer_name_labels": ["购买方名称"], "seller_name_labels": ["销售方名称"], "generic_name_label": "名称"}}}
    lines = ["表头", "名称：甲公司", None, "购买方名称：乙公司", "别的", "销售方名称 丙公司", "名称：丁公司"]
    docs = spark.createDataFrame([("x", lines), ("x", ["名称：甲公司", "名称：乙公司"]), ("x", [])], "schema_id string, lines array<string>")
    found = docs.select(F.posexplode(F.array(F.filter("lines", lambda t: t.isNotNull()))).alias("i", "l"), "schema_id").select(
        party_texts(F.col("l"), rule_column(rules, {})).alias("p")).collect()
    names = [[(c.field, c.value) for c in r.p if c is not None] for r in found]
    assert names == [[("buyer_name", "乙公司"), ("seller_name", "丙公司")], [("buyer_name", "甲公司")], []]
