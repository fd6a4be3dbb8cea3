"""Expressions over the lines of one document: annotated lines, label look-ups, money and dates.

A document is one row with `lines array<string>` (trimmed, none blank). Everything here
is an expression on that row, so extraction needs no shuffle, however many documents
there are; the look-ahead and look-back windows are array slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions import dates as D
from voucherlake.functions import money as M
from voucherlake.functions import text as T

NO_STRINGS = "array<string>"


def first_known(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(1))


def filled(value: Column) -> Column:
    """Empty text to null."""
    return F.nullif(value, F.lit(""))


def from_blocks(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Documents from rows that carry their text blocks as an array of structs.

    A block has text and optionally page, order, x0, y0, x1, y1 and confidence. Blank blocks
    are dropped, the rest is sorted by page and order; an absent box is all zeros.
    """
    names = set(df.schema[blocks].dataType.elementType.names)

    def part(b: Column, name: str, default: Column, kind: str) -> Column:
        return F.coalesce(b[name], default).cast(kind) if name in names else default.cast(kind)

    def span(b: Column, i: Column) -> Column:
        zero = F.lit(0.0)
        return F.struct(
            part(b, "page", F.lit(1), "int").alias("page"), part(b, "order", i + 1, "int").alias("ord"),
            F.trim(b["text"]).alias("t"), *[part(b, n, zero, "double").alias(n) for n in ("x0", "y0", "x1", "y1")],
            (b["confidence"] if "confidence" in names else F.lit(None)).cast("double").alias("confidence"))

    spans = F.array_sort(F.filter(F.transform(blocks, span), lambda s: s["t"] != ""))
    return df.withColumn("spans", spans).withColumn("lines", F.transform("spans", lambda s: s["t"]))


def with_spans(docs: DataFrame) -> DataFrame:
    """Documents that have lines but no boxes get spans with zero boxes."""
    if "spans" in docs.columns:
        return docs
    zero = F.lit(0.0)
    return docs.withColumn("spans", F.transform("lines", lambda t, i: F.struct(
        F.lit(1).alias("page"), (i + 1).alias("ord"), t.alias("t"), zero.alias("x0"), zero.alias("y0"),
        zero.alias("x1"), zero.alias("y1"), F.lit(None).cast("double").alias("confidence"))))


def annotate(docs: DataFrame) -> DataFrame:
    """Add `info`, the lines with the flags that number look-ups need.

    sec/idc: the line speaks of another invoice / of an identity number; secline: one of the four
    lines above does; idline: this line or the one above; direct: the line above announces another
    invoice and holds no number itself; n: a bare number; d: a date.
    """
    # Whether a line holds a number is asked only of lines about another invoice; a bare number may end with a line break.
    base = F.transform("lines", lambda t: T.let(T.secondary_context(t), lambda sec: F.struct(
        t.alias("t"), sec.alias("sec"), T.identity_context(t).alias("idc"), F.when(sec, t.rlike(T.LONG_NUMBER_PATTERN)).alias("long"),
        ((F.length(t) >= 8) & (F.length(t) <= 22) & t.rlike("^[0-9]{8,20}$")).alias("n"), D.has_date(t).alias("d"))))

    # Most documents do not speak of another invoice; then no line looks at those above for that.
    foreign = F.coalesce(F.exists("_base", lambda b: b["sec"]), F.lit(True))

    def around(x: Column, i: Column) -> Column:
        above = F.slice("_base", F.greatest(i - 3, F.lit(1)), F.least(F.lit(4), i))
        previous = F.try_element_at(F.col("_base"), F.when(i > 0, i).otherwise(F.size("_base") + 1))
        return F.struct(
            x["t"].alias("t"), x["sec"].alias("sec"), x["idc"].alias("idc"), x["n"].alias("n"), x["d"].alias("d"),
            F.when(F.col("_foreign"), F.exists(above, lambda a: a["sec"])).otherwise(F.lit(False)).alias("secline"),
            (x["idc"] | F.coalesce(previous["idc"], F.lit(False))).alias("idline"),
            (F.col("_foreign") & F.coalesce(previous["sec"] & ~previous["long"], F.lit(False))).alias("direct"))

    return docs.withColumn("_base", base).withColumn("_foreign", foreign).withColumn("info", F.transform("_base", around)).drop("_base", "_foreign")


def ahead(values: Column, index: Column, count: int) -> Column:
    """The next `count` entries behind a zero-based index."""
    return F.slice(values, index + 2, F.lit(count))


def behind(values: Column, index: Column, count: int) -> Column:
    """The `count` entries before a zero-based index, nearest last."""
    return F.slice(values, F.greatest(index - (count - 1), F.lit(1)), F.least(F.lit(count), index))


def number_after_label(info: Column, label: str, pattern: str) -> Column:
    """Number behind a label or on one of the next three lines, outside foreign contexts."""
    bounded = rf"(?<![0-9A-Z])({pattern})(?![0-9A-Z])"
    whole = rf"^(?:{pattern})$"

    def on_next(c: Column) -> Column:
        has = c["t"].contains(label)
        value = T.clean_label_value(F.when(has, T.after(c["t"], label)).otherwise(c["t"]))
        blocked = c["sec"] | c["idc"] | (has & c["direct"]) | (~has & (c["secline"] | c["idline"]))
        return F.when(~blocked, F.when(value.rlike(whole), value).when(
            has, filled(F.regexp_extract(value, bounded, 1))))

    def on_line(x: Column, i: Column) -> Column:
        usable = x["t"].contains(label) & ~x["sec"] & ~x["idc"] & ~x["direct"]
        inline = filled(F.regexp_extract(T.clean_label_value(T.after(x["t"], label)), bounded, 1))
        below = F.when(~x["secline"], first_known(F.transform(ahead(info, i, 3), on_next)))
        return F.when(usable, F.coalesce(inline, below))

    return first_known(F.transform(info, on_line))


def value_after_labels(lines: Column, labels: Sequence[str], lookahead: int = 4) -> Column:
    """Cleaned text behind a label, else the next line with Chinese text."""
    def on_line(t: Column, i: Column) -> Column:
        tries = []
        for label in labels:
            below = first_known(F.transform(ahead(lines, i, lookahead), lambda c: F.when(
                T.has_han(T.clean_label_value(c)), T.clean_label_value(c))))
            tries.append(F.when(t.contains(label), F.coalesce(filled(T.clean_label_value(T.after(t, label))), below)))
        return F.coalesce(*tries)

    return first_known(F.transform(lines, on_line))


def company_after_labels(lines: Column, labels: Sequence[str]) -> Column:
    def on_line(t: Column, i: Column) -> Column:
        below = first_known(F.transform(ahead(lines, i, 3), T.company_name))
        return F.coalesce(*[F.when(t.contains(label), F.coalesce(
            filled(T.clean_label_value(T.after(t, label))), below)) for label in labels])

    return first_known(F.transform(lines, on_line))


def money_after_labels(lines: Column, labels: Sequence[str]) -> Column:
    """Last money value of the first line that has one, from a label line to two lines below."""
    def on_line(t: Column, i: Column) -> Column:
        near = F.slice(lines, i + 1, F.lit(3))
        values = F.transform(near, lambda c: F.try_element_at(M.money_values(c), F.lit(-1)))
        return F.when(T.any_term(t, labels), first_known(values))

    return first_known(F.transform(lines, on_line))


def date_after_labels(lines: Column, labels: Sequence[str]) -> Column:
    def on_line(t: Column, i: Column) -> Column:
        near = F.slice(lines, i + 1, F.lit(4))
        return F.when(T.any_term(t, labels), first_known(F.transform(near, D.iso_date)))

    return first_known(F.transform(lines, on_line))


def dated_lines(lines: Column) -> Column:
    """(date, line) of every printed date, in order."""
    return F.flatten(F.transform(lines, lambda t: F.when(
        D.has_date(t), F.transform(D.all_dates(t), lambda d: F.struct(d.alias("date"), t.alias("line"))))
        .otherwise(F.array().cast("array<struct<date:string,line:string>>"))))


def money_hits(lines: Column) -> Column:
    """(amount, value, line) of every money value on lines that carry a money marker."""
    return F.flatten(F.transform(lines, lambda t: F.transform(M.money_values(t), lambda v: F.struct(
        v.try_cast(M.MONEY).alias("amount"), v.alias("value"), t.alias("line")))))


def largest(hits: Column) -> Column:
    """The largest hit, the earliest of equals."""
    return F.aggregate(
        hits, F.lit(None).cast("struct<amount:decimal(18,2),value:string,line:string>"),
        lambda best, h: F.when(best.isNull() | (h["amount"] > best["amount"]), h).otherwise(best))


def first_regex(text: Column, pattern: str) -> Column:
    return filled(F.trim(F.regexp_extract(text, "(?U)" + pattern, 1)))


def first_line_with(lines: Column, terms: Sequence[str], most: int | None = None) -> Column:
    scope = F.slice(lines, 1, most) if most else lines
    return first_where(scope, lambda t: T.any_term(t, terms))


def last_money_on(lines: Column, terms: Sequence[str]) -> Column:
    """Last money value of the last line that names a term and holds money."""
    found = F.transform(lines, lambda t: F.when(
        T.any_term(t, terms), F.try_element_at(M.money_values(t), F.lit(-1))))
    return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(-1))


# ---- boxes ---------------------------------------------------------------

def center_y(s: Column) -> Column:
    return (s["y0"] + s["y1"]) / 2


def center_x(s: Column) -> Column:
    return (s["x0"] + s["x1"]) / 2


def has_box(s: Column) -> Column:
    return (s["x0"] != 0) | (s["y0"] != 0) | (s["x1"] != 0) | (s["y1"] != 0)


def in_box(s: Column, box: dict) -> Column:
    """Left edge and vertical centre inside a box; a missing bound is open."""
    x, y = s["x0"], center_y(s)
    test = F.lit(True)
    for name, check in (("min_x", lambda b: x >= b), ("max_x", lambda b: x <= b), ("min_y", lambda b: y >= b),
                        ("max_y", lambda b: y <= b)):
        if name in box:
            test = test & check(float(box[name]))
    return test


def by_place(spans: Column) -> Column:
    """Spans from top to bottom, then left to right, then in reading order."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        center_y(s).alias("cy"), s["x0"].alias("cx"), s["ord"].alias("co"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def in_box_by_place(spans: Column, box: dict) -> Column:
    return by_place(F.filter(spans, lambda s: in_box(s, box)))


def company_in(spans: Column) -> Column:
    """First company name of placed spans, else the first plain name that says it is a company."""
    return T.let(F.transform(spans, lambda s: s["t"]), _company_of)


def plain_company(text: Column) -> Column:
    """A text that says it is a company and is no label, tax id or total; else null."""
    blocked = text.isin(*[b for b in PARTY_BLOCKED if len(b) == 1]) | T.any_term(text, [b for b in PARTY_BLOCKED if len(b) > 1])
    return F.when(
        T.has_han(text) & (F.length(text) > 1) & ~text.rlike(T.TAX_ID_PATTERN) & ~blocked
        & T.any_term(text, ("公司", "有限公司", "经营部", "分公司")), text)


def _company_of(texts: Column) -> Column:
    return F.coalesce(first_known(F.transform(texts, T.company_name)), first_known(F.transform(texts, plain_company)))


def tax_id_in(spans: Column) -> Column:
    return first_known(F.transform(spans, lambda s: F.try_element_at(
        F.filter(F.regexp_extract_all(s["t"], F.lit(T.TAX_ID_PATTERN), 0), T.is_tax_id), F.lit(1))))


# Words that are no party name.
PARTY_BLOCKED = (
    "名称", "纳税人识别号", "地址", "电话", "开户行", "账号", "价税合计", "合计", "元整", "圆整", "机器编号", "发票代码",
    "购买方信息", "销售方信息", "购买方", "销售方", "购", "买", "方", "销", "售", "信", "息",
)


def visual_lines(spans: Column, tolerance: float | None = None) -> Column:
    """Spans of one visual row as one line: (page, text, y0, y1, x0, confidence), top to bottom.

    A row starts where a span lies more than the tolerance below the first span of the
    row before. Spans without a box stay lines of their own.
    """
    real = F.filter(spans, has_box)
    if tolerance is None:
        heights = F.array_sort(F.filter(F.transform(real, lambda s: s["y1"] - s["y0"]), lambda h: h > 0))
        reach = T.let(heights, lambda h: F.greatest(F.lit(8.0), F.coalesce(array_median(h) * 0.6, F.lit(8.0))))
    else:
        reach = F.lit(float(tolerance))
    keyed = F.array_sort(F.transform(real, lambda s: F.struct(
        s["page"].alias("page"), center_y(s).alias("cy"), s["x0"].alias("x"), s["ord"].alias("o"), s.alias("s"))))
    group = ("array<struct<page:int,anchor:double,units:array<struct<x:double,o:int,t:string,x0:double,y0:double,"
             "x1:double,y1:double,confidence:double>>>>")

    def unit(k: Column) -> Column:
        s = k["s"]
        return F.struct(k["x"].alias("x"), k["o"].alias("o"), s["t"].alias("t"), s["x0"].alias("x0"), s["y0"].alias("y0"),
                        s["x1"].alias("x1"), s["y1"].alias("y1"), s["confidence"].alias("confidence"))

    def fold(groups: Column, k: Column, reach: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joins = F.coalesce((last["page"] == k["page"]) & (k["cy"] - last["anchor"] <= reach), F.lit(False))
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(
            last["page"].alias("page"), last["anchor"].alias("anchor"), F.concat(last["units"], F.array(unit(k))).alias("units"))))
        fresh = F.concat(groups, F.array(F.struct(k["page"].alias("page"), k["cy"].alias("anchor"), F.array(unit(k)).alias("units"))))
        return F.when(joins, grown).otherwise(fresh)

    # The reach is bound outside the fold, else every span would measure the page again.
    groups = T.let(reach, lambda bound: F.aggregate(keyed, F.array().cast(group), lambda found, k: fold(found, k, bound)))

    def line(g: Column) -> Column:
        units = F.array_sort(g["units"])
        return F.struct(
            g["page"].alias("page"), F.array_min(F.transform(units, lambda u: u["y0"])).alias("y0"),
            F.array_min(F.transform(units, lambda u: u["x0"])).alias("x0"),
            F.array_max(F.transform(units, lambda u: u["y1"])).alias("y1"), F.lit(True).alias("boxed"),
            F.array_join(F.transform(units, lambda u: u["t"]), " ").alias("t"),
            F.array_min(F.transform(units, lambda u: u["confidence"])).alias("confidence"))

    def bare(s: Column) -> Column:
        return F.struct(s["page"].alias("page"), s["ord"].cast("double").alias("y0"), s["ord"].cast("double").alias("x0"),
                        F.lit(0.0).alias("y1"), F.lit(False).alias("boxed"), s["t"].alias("t"), s["confidence"].alias("confidence"))

    loose = F.transform(F.filter(spans, lambda s: ~has_box(s)), bare)
    return F.array_sort(F.concat(F.transform(groups, line), loose))


def array_median(sorted_values: Column) -> Column:
    """Exact median of a sorted array; null if it is empty."""
    size = F.size(sorted_values)
    low = F.try_element_at(sorted_values, F.floor((size + 1) / 2).cast("int"))
    high = F.try_element_at(sorted_values, F.floor(size / 2).cast("int") + 1)
    return F.when(size > 0, (low + high) / 2)
