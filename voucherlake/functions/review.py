"""Issue codes to short labels and to reviewer wording, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlake.functions.text import any_term, let

# Field labels and wording.
FIELD_LABELS = {
    "invoice_code": "发票代码",
    "invoice_no": "发票号码或数电发票号码",
    "invoice_date": "开票日期",
    "buyer_name": "购买方名称",
    "buyer_tax_id": "购买方纳税人识别号",
    "seller_name": "销售方名称",
    "seller_tax_id": "销售方纳税人识别号",
    "invoice_type": "发票票种",
    "amount_total": "金额",
    "tax_total": "税额",
    "total_with_tax": "价税合计",
    "line_amount": "明细金额",
    "line_tax_amount": "明细税额",
    "line_total_with_tax": "明细价税合计",
    "items": "明细行",
}
REVIEW_TARGETS = {
    **FIELD_LABELS,
    "items": "明细行的货物或服务名称、规格型号、数量、单价、金额、税额、价税合计",
}
SUMMARY_LABELS = {"汇总金额": "票面金额", "汇总税额": "票面税额", "汇总价税合计": "票面价税合计"}
SUMMARY_WORDS = "(汇总金额|汇总税额|汇总价税合计)"
DETAIL_WORDS = "(明细金额合计|明细税额合计|明细价税合计)"

# First matching row gives the label.
AMOUNT_TERMS = (
    "amount_total + tax_total", "sum line_amount", "sum line_tax_amount", "line_amount + line_tax_amount",
    "quantity * unit_price", "item amount comparison failed", "金额不一致", "税额不一致",
    "金额、税额和价税合计，三者对不上", "明细金额和票面金额，合计数对不上", "明细税额和票面税额，合计数对不上",
    "三者对不上", "二者相差", "其中一项未识别",
)
ISSUE_LABEL_TERMS = (
    (("missing items", "明细缺失", "补充发票明细"), "缺少发票明细"),
    (AMOUNT_TERMS, "金额不一致"),
    (("conflict ", "uncertain party role", "购买方和销售方", "可能填反", "有冲突"), "信息有冲突"),
    (("low confidence ", "识别不清"), "识别不清"),
    (("负数项目", "负数金额"), "负数金额需确认"),
    (("未验收变体",), "票据版式需确认"),
    (("missing evidence ",), "信息需确认"),
)
EXACT_MESSAGES = {
    "amount_total + tax_total != total_with_tax": "请核对票面金额、税额和价税合计，三者对不上",
    "sum line_amount != amount_total": "请核对明细金额和票面金额，合计数对不上",
    "sum line_tax_amount != tax_total": "请核对明细税额和票面税额，合计数对不上",
    "item amount comparison failed": "请核对发票明细金额，票面不同位置的金额对不上",
    "buyer_name equals seller_name with different tax ids": "请核对购买方和销售方名称，当前识别结果相同",
    "digital invoice has invoice_code": "请核对发票代码和数电发票号码，当前可能填错列",
    "digital invoice number invalid": "请核对票面上的数电发票号码，当前号码格式不对",
}


def issue_label(remark: Column) -> Column:
    text = F.coalesce(remark, F.lit(""))
    label = F.when(
        text.contains("missing invoice_no") | (text.contains("发票号码") & any_term(text, ("缺", "补充"))),
        F.lit("缺少发票号码"),
    )
    for terms, name in ISSUE_LABEL_TERMS:
        label = label.when(any_term(text, terms), F.lit(name))
    return label.otherwise(F.lit("识别结果需确认"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def _behind(issue: Column, prefix: str) -> Column:
    return F.trim(F.substring(issue, F.lit(len(prefix) + 1), F.length(issue)))


def _part(kind: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def _translate(issue: Column) -> Column:
    """One issue to an array of (kind, text)."""
    nothing = F.array().cast("array<struct<kind:string,text:string>>")
    breakdown = "incomplete amount breakdown: missing "
    line_total = r"^line (\d+): line_amount \+ line_tax_amount != line_total_with_tax"
    line_product = r"^line (\d+): quantity \* unit_price != line_amount"
    negative = r"^可抵扣税额规则遇到负数项目\s*(.*)"
    uncovered = r"^可抵扣税额规则未覆盖项目\s*(.*)"
    differs = f"^{SUMMARY_WORDS}与{DETAIL_WORDS}不一致，.*差额\\s*(-?\\d+(?:\\.\\d+)?)"
    absent = f"^{SUMMARY_WORDS}或{DETAIL_WORDS}缺失"

    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(issue, pattern, index)

    def named(pattern: str, fallback: str) -> Column:
        found = F.trim(group(pattern, 1))
        return F.when(found == "", F.lit(fallback)).otherwise(found)

    # No other issue begins like those of lines, and of lines there are many.
    of_line = (
        F.when(issue.contains("line_total_with_tax") & issue.rlike(line_total), _part("message", F.concat(
            F.lit("请核对第 "), group(line_total, 1), F.lit(" 行的金额、税额和价税合计，三者对不上"))))
        .when(issue.rlike(line_product), _part("message", F.concat(
            F.lit("请核对第 "), group(line_product, 1), F.lit(" 行的数量、单价和金额，三者对不上"))))
        .otherwise(nothing)
    )
    result = F.when(issue.startswith("line "), of_line)
    for code, message in EXACT_MESSAGES.items():
        result = result.when(issue == code, _part("message", F.lit(message)))
    return (
        result
        .when(issue.isin("missing items", "明细缺失"), _part("missing", F.lit("发票明细")))
        .when(issue.startswith("missing evidence "),
              _part("evidence", _lookup(FIELD_LABELS, _behind(issue, "missing evidence "))))
        .when(issue.startswith("missing "), _part("missing", _lookup(FIELD_LABELS, _behind(issue, "missing "))))
        .when(issue.startswith("conflict "), _part("conflict", _lookup(FIELD_LABELS, _behind(issue, "conflict "))))
        .when(issue.startswith("low confidence "),
              _part("low", _lookup(REVIEW_TARGETS, _behind(issue, "low confidence "))))
        .when(issue.startswith(breakdown),
              F.transform(F.split(_behind(issue, breakdown), ","),
                          lambda f: F.struct(F.lit("missing").alias("kind"),
                                             _lookup(FIELD_LABELS, F.trim(f)).alias("text"))))
        .when(issue.startswith("uncertain party role "), _part("message", F.lit("请核对购买方和销售方识别号，可能填反")))
        .when(issue.rlike(negative), _part("message", F.concat(
            F.lit("请确认“"), named(negative, "负数项目"), F.lit("”的负数金额是否与原票一致"))))
        .when(issue.rlike(uncovered), _part("message", F.concat(
            F.lit("请确认“"), named(uncovered, "该项目"), F.lit("”是否可以抵扣进项税"))))
        .when(issue.startswith("未验收变体 "), _part("message", F.lit("请确认票据版式和票面信息是否识别正确")))
        .when(issue.rlike(differs), _part("message", F.concat(
            F.lit("请核对"), _lookup(SUMMARY_LABELS, group(differs, 1)), F.lit("和"), group(differs, 2),
            F.lit("，二者相差 "), F.regexp_replace(group(differs, 3), "^-+", ""), F.lit(" 元"))))
        .when(issue.rlike(absent), _part("message", F.concat(
            F.lit("请核对"), _lookup(SUMMARY_LABELS, group(absent, 1)), F.lit("和"), group(absent, 2),
            F.lit("，其中一项未识别"))))
        .otherwise(nothing)
    )


def review_text(remark: Column, most: int = 3) -> Column:
    """Issue codes to at most `most` distinct actions, in a fixed priority order."""
    text = F.trim(F.coalesce(remark, F.lit("")))

    def wording(t: Column) -> Column:
        return (
            F.when(t == "", F.lit(""))
            .when(t.startswith("请"), F.when(t.rlike("[。！？]$"), t).otherwise(F.concat(t, F.lit("。"))))
            .otherwise(let(_messages(t), lambda m: _shown(m, most)))
        )

    return let(text, wording)


def _messages(text: Column) -> Column:
    """All actions of a remark, in priority order."""
    issues = F.filter(F.transform(F.split(text, "[;；]"), lambda x: F.trim(x)), lambda i: i != "")
    stripped = F.transform(issues, lambda i: F.trim(F.regexp_replace(i, "^(待复核|需复核)：", "")))
    return let(F.flatten(F.transform(stripped, _translate)), _ranked)


def _ranked(parts: Column) -> Column:
    def texts(kind: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: p["text"])

    def listed(kind: str, before: str, behind: str = "") -> Column:
        def said(names: Column) -> Column:
            known = F.array_distinct(F.filter(names, lambda t: t != ""))
            return F.when(F.size(names) > 0, F.array(F.concat(
                F.lit(before), F.array_join(known, "、"), F.lit(behind)))).otherwise(F.array().cast("array<string>"))

        return let(texts(kind), said)

    return reduce(F.concat, [
        listed("missing", "请对照原票补充"),
        texts("message"),
        listed("conflict", "请对照原票确认", "，当前识别结果有冲突"),
        listed("low", "请对照原票核对", "，图片可能识别不清"),
        listed("evidence", "请对照原票确认"),
    ])


def _shown(messages: Column, most: int) -> Column:
    first = F.slice(F.array_distinct(messages), 1, most)
    return F.when(F.size(messages) == 0, F.lit("请对照原票核对识别结果。")).otherwise(
        F.concat(F.array_join(first, "；"), F.lit("。")))


# How a remark part is told to be a review issue.
REVIEW_PREFIXES = (
    "missing evidence ", "missing ", "conflict ", "low confidence ", "amount_total + tax_total",
    "incomplete amount breakdown", "sum line_amount", "sum line_tax_amount", "line ", "digital invoice ",
    "failed", "error", "待复核：", "需复核：",
)


def remark_parts(remark: Column) -> Column:
    plain = F.replace(F.trim(F.coalesce(remark, F.lit(""))), F.lit(";"), F.lit("；"))
    return F.filter(F.transform(F.split(plain, "；"), lambda x: F.trim(x)), lambda p: p != "")


def _is_review_part(part: Column) -> Column:
    hit = part.contains("不一致") | part.contains("缺失")
    for prefix in REVIEW_PREFIXES:
        hit = hit | part.startswith(prefix)
    return hit


def display_remark(status: Column, review: Column, context: Column, remark: Column) -> Column:
    """The printed remark: review wording first, then business context."""
    fields = F.struct(
        F.coalesce(review, F.lit("")).alias("review"), F.coalesce(context, F.lit("")).alias("context"),
        remark_parts(remark).alias("parts"), status.alias("status"))

    def choose(f: Column) -> Column:
        split = (f["review"] == "") & (f["context"] == "")
        code = F.when(split, F.when(f["status"] == "ready", F.lit("")).otherwise(
            F.array_join(F.filter(f["parts"], _is_review_part), "；"))).otherwise(f["review"])
        business = F.when(split, F.filter(f["parts"], lambda p: (f["status"] == "ready") | ~_is_review_part(p))).otherwise(
            remark_parts(f["context"]))
        head = let(review_text(code), lambda w: F.when(w != "", F.array(w)).otherwise(F.array().cast("array<string>")))
        return F.array_join(F.concat(head, business), "；")

    return let(fields, choose)
