import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from voucherlake.functions import dates, labels, money, review, text


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "s string")
    return tuple(df.select(*columns).first())


def test_money_is_rounded_half_up_and_junk_is_null(spark):
    s = F.col("s")
    assert one(spark, "￥1,234.565", money.to_money(s))[0] == Decimal("1234.57")
    assert one(spark, "-0.125", money.to_money(s))[0] == Decimal("-0.13")
    for junk in ("未知", "N/A", "", "12a"):
        assert one(spark, junk, money.to_money(s))[0] is None


def test_money_lines(spark):
    s = F.col("s")
    assert one(spark, "合计 ¥1,000.5 ￥ 13 . 00", money.money_values(s))[0] == ["1000.50", "13.00"]
    assert one(spark, "第 12 页", money.money_values(s))[0] == []


def test_rates(spark):
    rows = spark.sql("select cast('0.13' as decimal(9,6)) a, cast('0.065' as decimal(9,6)) b, cast('0.1' as decimal(9,6)) c")
    assert tuple(rows.select(*[money.rate_to_percent(F.col(c)) for c in "abc"]).first()) == ("13%", "6.5%", "10%")


def test_dates(spark):
    s = F.col("s")
    assert one(spark, "2024 年 1月 5 日", dates.iso_date(s))[0] == "2024-01-05"
    assert one(spark, "2024-02-30", dates.iso_date(s))[0] is None
    assert one(spark, "2024  01 05", dates.spaced_iso_date(s))[0] == "2024-01-05"


def test_width_folding_equals_the_standard_form(spark):
    samples = ["电子发票（普通发票）", "Ａ１㈱①", "ﬁ⽇", "é", "plain", "½ ㎡ Ⅷ", "가"]
    df = spark.createDataFrame([(v,) for v in samples], "s string")
    for row in df.select("s", text.nfkc(F.col("s")).alias("n")).collect():
        assert row.n == unicodedata.normalize("NFKC", row.s)


def test_tax_ids_leave_out_bank_lines(spark):
    s = F.col("s")
    assert one(spark, "识别号：91340000MA00000001", text.tax_ids(s))[0] == ["91340000MA00000001"]
    assert one(spark, "银行账号 134000000000000001", text.tax_ids(s))[0] == []
    assert one(spark, "12345678901234567", text.tax_ids(s))[0] == []


def test_price_and_quantity_are_split_by_their_product(spark):
    df = spark.sql("select '25.5012' s, cast(306.00 as decimal(18,2)) a")
    split = df.select(money.split_price_quantity(F.col("s"), F.col("a")).alias("p")).first().p
    assert (split.price, split.quantity) == ("25.50", "12")


def test_review_wording(spark):
    s = F.col("s")
    cases = {
        "missing invoice_no; amount_total + tax_total != total_with_tax": (
            "缺少发票号码", "请对照原票补充发票号码或数电发票号码；请核对票面金额、税额和价税合计，三者对不上。"),
        "conflict seller_name; low confidence items": (
            "信息有冲突", "请对照原票确认销售方名称，当前识别结果有冲突；请对照原票核对明细行的货物或服务名称、规格型号、数量、单价、金额、税额、价税合计，图片可能识别不清。"),
        "待复核：汇总金额与明细金额合计不一致，汇总金额 1.00，明细合计 3.00，差额 -2.00": (
            "识别结果需确认", "请核对票面金额和明细金额合计，二者相差 2.00 元。"),
        "待复核：可抵扣税额规则遇到负数项目 折扣": ("负数金额需确认", "请确认“折扣”的负数金额是否与原票一致。"),
        "incomplete amount breakdown: missing tax_total, amount_total": ("识别结果需确认", "请对照原票补充税额、金额。"),
        "something else": ("识别结果需确认", "请对照原票核对识别结果。"),
    }
    for remark, expected in cases.items():
        assert one(spark, remark, review.issue_label(s), review.review_text(s)) == expected
    assert one(spark, "", review.review_text(s))[0] == ""
    four = "missing items; sum line_amount != amount_total; sum line_tax_amount != tax_total; digital invoice number invalid"
    assert one(spark, four, review.review_text(s))[0].count("；") == 2


def test_labels(spark):
    df = spark.range(1)
    got = df.select(
        labels.page_text(F.array(F.lit(3), F.lit(1), F.lit(1))), labels.page_text(F.array().cast("array<int>")),
        labels.status_label(F.lit("unmodeled")), labels.status_label(F.lit("other")), labels.csv_safe(F.lit("=1+1")),
        labels.freight_context(F.lit("货车"), F.lit("皖A1"), F.lit("甲"), F.lit(None), F.lit("煤"))).first()
    assert tuple(got) == ("第 1-3 页", "未识别页码", "当前未建模", "other", "'=1+1", "货运：货车 皖A1；甲；货物：煤")
