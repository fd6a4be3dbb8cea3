"""Positioned spans as a table: visual rows, columns, label values, parties, table items.

Input is one row per span: unit_id, page, ord, text, x0, y0, x1, y1, confidence. Joins are on
(unit_id, page) with a side that has one row per unit and label, column or row, so no
operator pairs the spans of a page with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.functions import money as M
from voucherlake.functions import text as T
from voucherlake.functions.money import MONEY
from voucherlake.operators.doc_text import plain_company
from voucherlake.operators.ordered import running_sum
from voucherlake.session import keyed


def center_x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def center_y() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def has_box() -> Column:
    return (F.col("x0") != 0) | (F.col("y0") != 0) | (F.col("x1") != 0) | (F.col("y1") != 0)


def measures(units: DataFrame) -> DataFrame:
    """Per unit: exact median height and page width (the right-most edge)."""
    height = F.col("y1") - F.col("y0")
    return units.filter(has_box()).groupBy("unit_id").agg(
        F.median(F.when(height > 0, height)).alias("median_height"), F.max("x1").alias("page_width"))


def in_boxes(units: DataFrame, boxes: dict[str, dict]) -> DataFrame:
    """(span, box) for every named box that holds a span's left edge and vertical centre; open bounds are open."""
    tests = []
    for name, box in boxes.items():
        test = F.lit(True)
        for key, value, upper in (("min_x", F.col("x0"), False), ("max_x", F.col("x0"), True),
                                  ("min_y", center_y(), False), ("max_y", center_y(), True)):
            if key in box:
                test = test & ((value <= float(box[key])) if upper else (value >= float(box[key])))
        tests.append(F.when(test, F.lit(name)))
    held = F.filter(F.array(*tests), lambda b: b.isNotNull())
    return units.withColumn("box", F.explode(held))


# ---- visual rows ---------------------------------------------------------

def row_anchors(heights: DataFrame, keys: Sequence[str], tolerance: str = "tolerance") -> DataFrame:
    """(keys, y, anchor) for distinct heights: a row starts where y lies more than the tolerance below its anchor.

    `heights` holds keys, y and the tolerance. Heights are made distinct first. A page is then cut wherever
    nothing lies within the tolerance; only a connected run of heights is folded, and its
    size is bounded by the printed resolution of a page, not by the number of spans.
    """
    distinct = heights.select(*keys, "y", tolerance).distinct().withColumn("_cell", F.floor(F.col("y") / F.col(tolerance)))
    cells = distinct.groupBy(*keys, "_cell").agg(F.min("y").alias("_low"), F.max("y").alias("_high"), F.first(tolerance).alias("_tol"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    apart = F.coalesce(F.col("_low") - F.lag("_high").over(order) > F.col("_tol"), F.lit(True))
    runs = cells.withColumn("_apart", apart.cast("int")).withColumn("_run", F.sum("_apart").over(order)).select(*keys, "_cell", "_run")
    grouped = distinct.join(keyed(runs), [*keys, "_cell"]).groupBy(*keys, "_run").agg(
        F.array_sort(F.collect_list("y")).alias("_ys"), F.first(tolerance).alias("_tol"))
    kind = "array<struct<y:double,anchor:double>>"

    def fold(acc: Column, y: Column) -> Column:
        anchor = F.try_element_at(acc, F.lit(-1))["anchor"]
        next_ = F.when(F.coalesce(y - anchor <= F.col("_tol"), F.lit(False)), anchor).otherwise(y)
        return F.concat(acc, F.array(F.struct(y.alias("y"), next_.alias("anchor"))))

    folded = F.aggregate(F.transform("_ys", lambda y: y.cast("double")), F.array().cast(kind), fold)
    return grouped.select(*keys, F.explode(folded).alias("_p")).select(*keys, "_p.y", "_p.anchor")


def visual_rows(units: DataFrame, tolerance: float | None = None, top: bool = False) -> DataFrame:
    """Add `anchor`, the height of the first span of the visual row; by centres, or by tops for table rows.

    The default reach is 0.6 of the median height, at least 8; for table rows a quarter of it.
    """
    boxed = units.filter(has_box() & (F.trim("text") != ""))
    y = F.col("y0") if top else center_y()
    if tolerance is None:
        reach = measures(units).select("unit_id", (
            F.coalesce("median_height", F.lit(12.0)) / 4 if top else F.greatest(
                F.lit(8.0), F.coalesce(F.col("median_height") * 0.6, F.lit(8.0)))).alias("tolerance"))
        boxed = boxed.join(keyed(reach), "unit_id")
    else:
        boxed = boxed.withColumn("tolerance", F.lit(float(tolerance)))
    placed = boxed.withColumn("y", y.cast("double"))
    anchors = row_anchors(placed, ["unit_id", "page"])
    return placed.join(keyed(anchors), ["unit_id", "page", "y"]).drop("tolerance")


def visual_lines(rows: DataFrame) -> DataFrame:
    """One line per visual row: text by x joined with blanks, outer box, lowest confidence."""
    return rows.groupBy("unit_id", "page", "anchor").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min("confidence").alias("confidence"))


def reading_order(rows: DataFrame) -> DataFrame:
    """Position inside a unit by (page, row, x, order); each page is one chunk of the numbering."""
    return running_sum(rows, ["unit_id"], ["page", "anchor", "x0", "ord"], F.lit(1), "position", size=1)


# ---- label and value -----------------------------------------------------

def nearest_values(units: DataFrame, labels: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Value of a label by position: right of it in the same row, or below it in the same column.

    `labels` maps a field to (label, right or below, full pattern). The first span with the label
    counts; the nearest fitting span wins. One label row per unit and field joins the spans.
    """
    compact = T.compact(F.col("text"))
    named = F.array(*[F.when(compact.contains(label), F.struct(
        F.lit(field).alias("field"), F.lit(mode).alias("mode"), F.lit(f"^(?:{pattern})$").alias("pattern")))
        for field, (label, mode, pattern) in labels.items()])
    hits = units.select("unit_id", "page", "ord", "x0", "x1", "y0", "y1", F.explode(F.filter(named, lambda n: n.isNotNull())).alias("_n"), compact.alias("_own"))
    heads = hits.groupBy("unit_id", F.col("_n.field").alias("field")).agg(F.min_by(F.struct(
        "page", F.col("x1").alias("lx1"), ((F.col("x0") + F.col("x1")) / 2).alias("lcx"), ((F.col("y0") + F.col("y1")) / 2).alias("lcy"),
        F.col("_own").alias("own"), F.col("_n.mode").alias("mode"), F.col("_n.pattern").alias("pattern")), F.struct("page", "ord")).alias("_h")
    ).select("unit_id", "field", "_h.*")
    joined = units.withColumn("_cx", center_x()).withColumn("_cy", center_y()).withColumn("_compact", compact).join(keyed(heads), ["unit_id", "page"])
    dy = F.col("_cy") - F.col("lcy")
    right = (F.col("mode") == "right") & (F.col("x0") >= F.col("lx1") - 3) & (F.abs(dy) < 16)
    below = (F.col("mode") == "below") & (dy > 2) & (F.abs(F.col("_cx") - F.col("lcx")) < 55)
    value = F.trim("text")
    fits = (right | below) & (F.col("_compact") != F.col("own")) & (value != "") & ~value.rlike("[：:]$") & F.rlike(value, F.col("pattern"))
    near = F.when(F.col("mode") == "right", F.struct(F.col("x0").alias("a"), F.abs(dy).alias("b"), F.col("ord").alias("c"))).otherwise(
        F.struct(F.col("_cy").alias("a"), F.lit(0.0).alias("b"), F.col("ord").alias("c")))
    return joined.filter(fits).groupBy("unit_id", "field").agg(F.min_by(value, near).alias("value"))


# ---- parties by column ---------------------------------------------------

# Headings of the two party columns and of the line table.
ROLE_HEADINGS = {"buyer": ("购买方", "购买方信息"), "seller": ("销售方", "销售方信息")}
DETAIL_HEADINGS = ("项目名称", "货物或应税劳务服务名称", "规格型号", "单位", "数量", "单价", "金额", "税率征收率", "税额")


def column_parties(units: DataFrame) -> DataFrame:
    """(unit_id, field, value): names and tax ids left or right of the middle, between the headings and the table.

    What holds for a unit or one of its sides is told to its rows by windows: spans are shuffled and sorted by unit once.
    """
    boxed = units.filter(has_box() & (F.trim("text") != "") & F.col("unit_id").isNotNull())
    compact = T.compact(F.col("text"))
    bare = F.regexp_replace("text", r"(?U)[\s/、，,:：]+", "")
    unit, side = Window.partitionBy("unit_id"), Window.partitionBy("unit_id", "_role")
    open_end = F.lit(float("inf"))

    def head(role: str) -> Column:
        return F.when(F.col("_head") == role, F.col("y0"))

    def head_x(role: str) -> Column:
        return F.avg(F.when(F.col("_head") == role, F.col("_cx"))).over(unit)

    heading = F.when(compact.isin(*ROLE_HEADINGS["buyer"]), F.lit("buyer")).when(compact.isin(*ROLE_HEADINGS["seller"]), F.lit("seller"))
    told = boxed.select(
        "unit_id", "ord", "text", "x0", "x1", "y0", center_x().alias("_cx"), center_y().alias("_cy"), heading.alias("_head"), bare.isin(*DETAIL_HEADINGS).alias("_of_detail"))
    framed = told.select(
        "*", F.max("x1").over(unit).alias("_width"), F.min(head("buyer")).over(unit).alias("_buyer"), F.min(head("seller")).over(unit).alias("_seller"),
        head_x("buyer").alias("_bx"), head_x("seller").alias("_sx")).filter("_buyer is not null and _seller is not null and _bx <> _sx")
    below = F.col("_of_detail") & (F.col("_cy") > F.least("_buyer", "_seller"))
    framed = framed.withColumn("_detail", F.min(F.when(below, F.col("_cy"))).over(unit))
    role = F.when(F.col("_cx") < F.col("_width") / 2, F.lit("buyer")).otherwise(F.lit("seller"))
    framed = framed.withColumn("_role", role).withColumn("_top", F.when(F.col("_role") == "buyer", F.col("_buyer")).otherwise(F.col("_seller")) - 5)
    band = framed.filter((F.col("_cy") >= F.col("_top")) & (F.col("_cy") <= F.coalesce("_detail", open_end)))
    tax = F.when(F.col("_cy") < F.coalesce("_detail", open_end), F.try_element_at(T.tax_ids(F.col("text")), F.lit(1)))
    held = band.select("unit_id", "_role", "_cy", "x0", "ord", "_top", "_detail", tax.alias("_tax"), T.company_name(F.col("text")).alias("_name")).filter(
        "_tax is not null or _name is not null")
    # Without a table below, names reach down to the first tax id of the column.
    held = held.withColumn("_id_y", F.min(F.when(F.col("_tax").isNotNull(), F.col("_cy"))).over(side))
    near = F.col("_detail").isNotNull() | (F.col("_cy") <= F.coalesce("_id_y", F.col("_top")))
    place = F.struct("_cy", "x0", "ord")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), place))

    found = held.groupBy("unit_id", "_role").agg(first(F.col("_tax")).alias("tax_id"), first(F.when(near, F.col("_name"))).alias("name"))
    both = F.array(*[F.struct(F.concat("_role", F.lit(f"_{n}")).alias("field"), F.col(n).alias("value")) for n in ("tax_id", "name")])
    return found.select("unit_id", F.explode(both).alias("_f")).select("unit_id", "_f.*").filter("value is not null")


def band_parties(units: DataFrame, rule: dict) -> DataFrame:
    """Names and tax ids of the two parties: what stands in a band of heights, left and right of a share of the page's width.

    rule: split_x_ratio, name_band and tax_band (min_y, max_y; terms of exclude_terms are no name). The first company name of a
    side counts, from top to bottom, else the first plain text that says it is a company; the first tax id of a side.
    """
    boxed = units.filter(has_box() & (F.trim("text") != "")).withColumn("_cy", center_y())
    width = boxed.groupBy("unit_id").agg(F.max("x1").alias("_width")).filter("_width <> 0")
    left = F.col("x0") < F.col("_width") * float(rule["split_x_ratio"])
    sided = boxed.join(keyed(width), "unit_id").withColumn("_side", F.when(left, F.lit("buyer")).otherwise(F.lit("seller")))
    place = F.struct("_cy", "x0", "ord")

    def within(band: dict) -> Column:
        return F.col("_cy").between(float(band["min_y"]), float(band["max_y"]))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), place))

    terms = [t for t in rule["name_band"].get("exclude_terms", []) if t]
    named = within(rule["name_band"]) & (~T.any_term(F.col("text"), terms) if terms else F.lit(True))
    name, plain = F.when(named, T.company_name(F.col("text"))), F.when(named, plain_company(F.trim("text")))
    tax = F.when(within(rule["tax_band"]), F.try_element_at(T.tax_ids(F.col("text")), F.lit(1)))
    found = sided.filter(named | within(rule["tax_band"])).groupBy("unit_id", "_side").agg(
        F.coalesce(first(name), first(plain)).alias("name"), first(tax).alias("tax_id"))
    both = F.array(*[F.struct(F.concat("_side", F.lit(f"_{n}")).alias("field"), F.col(n).alias("value")) for n in ("name", "tax_id")])
    return found.select("unit_id", F.explode(both).alias("_f")).select("unit_id", "_f.*").filter("value is not null")


def sub_table_rows(units: DataFrame, header_aliases: dict[str, list[str]], triggers: Sequence[str], stops: Sequence[str]) -> DataFrame:
    """(unit_id, row_no, columns): rows of a second table on the page, with headers of its own.

    All triggers must be printed as texts. The header row is the height with most known headers, as many as triggers at least.
    A text below it belongs to the nearest header by its centre, within half the smallest distance of two headers; the table
    ends one header height above the first text below that holds a stop word. A row has as many columns as there are triggers.
    """
    columns = header_columns(header_aliases)
    lookup = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    compact = T.compact(F.col("text"))
    rows = units.filter(F.trim("text") != "").withColumn("_y", F.bround("y0").cast("int")).withColumn("_column", F.try_element_at(lookup, compact))
    wanted = ["".join(t.split()) for t in triggers]
    due = rows.filter(compact.isin(*wanted)).groupBy("unit_id").agg(F.count_distinct(compact).alias("_n")).filter(F.col("_n") == len(set(wanted)))
    order = F.struct("page", "ord")
    heads = rows.filter("_column is not null").join(keyed(due.select("unit_id")), "unit_id", "left_semi")
    centres = heads.groupBy("unit_id", "_y", "_column").agg(
        F.max_by(center_x(), order).alias("_c"), F.min(order).alias("_at"), F.max("y1").alias("_low"), F.max(F.col("y1") - F.col("y0")).alias("_tall"))
    levels = centres.groupBy("unit_id", "_y").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_at"), F.max("_low").alias("bottom"), F.max("_tall").alias("tall"),
        F.sort_array(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_column").alias("column")))).alias("anchors"))
    ranked = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("_n"), "_at"))
    head = levels.withColumn("_rank", ranked).filter((F.col("_rank") == 1) & (F.col("_n") >= len(wanted))).select(
        "unit_id", F.col("_y").alias("header_y"), "bottom", "tall", "anchors")
    framed = rows.join(keyed(head), "unit_id")
    # The joined rows lie by unit already: what ends the table is told to them without another shuffle.
    unit = Window.partitionBy("unit_id")
    stop = F.min(F.when((F.col("y0") > F.col("header_y")) & T.any_term(F.col("text"), stops), F.col("y0"))).over(unit)
    limit = F.coalesce(stop, F.max("y1").over(unit) + 1) - F.col("tall")
    gaps = F.transform(F.slice("anchors", 2, F.size("anchors")), lambda a, i: a["c"] - F.get("anchors", i)["c"])
    reach = F.coalesce(F.array_min(gaps) / 2, F.lit(45.0))
    away = F.transform("anchors", lambda a: F.struct(F.abs(a["c"] - center_x()).alias("d"), a["c"].alias("c"), a["column"].alias("column")))
    inside = framed.withColumn("limit", limit).filter((F.col("y0") > F.col("bottom")) & (F.col("y0") < F.col("limit")))
    near = inside.withColumn("_near", F.array_min(away)).filter(F.col("_near.d") <= reach)
    names = list(dict.fromkeys(columns.values()))
    cells = near.groupBy("unit_id", "_y").agg(*[
        F.max_by(F.trim("text"), F.when(F.col("_near.column") == n, order)).alias(n) for n in names])
    filled = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    kept = cells.filter(filled >= len(wanted))
    # A running sum reads its rows twice; these are few by unit, and numbering them holds none.
    return kept.select("unit_id", F.row_number().over(Window.partitionBy("unit_id").orderBy("_y")).alias("row_no"), *names)


# ---- table items ---------------------------------------------------------

def header_columns(header_aliases: dict[str, list[str]]) -> dict[str, str]:
    """Printed header without blanks -> column name."""
    return {"".join(alias.split()): column for column, names in header_aliases.items() for alias in names}


def header_rows(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(unit_id, page, header_y): the visual row with most distinct known headers, at least two, the upper of equals."""
    lookup = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    named = rows.withColumn("column", F.try_element_at(lookup, T.compact(F.col("text")))).filter("column is not null")
    counted = named.select("unit_id", "page", "anchor", "column").distinct().groupBy("unit_id", "page", "anchor").agg(
        F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy("unit_id", "page").agg(F.max_by(F.struct("anchor", "_n"), F.struct("_n", -F.col("anchor"))).alias("_b"))
    return best.filter("_b._n >= 2").select("unit_id", "page", F.col("_b.anchor").alias("header_y"))


def column_edges(rows: DataFrame, headers: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(unit_id, column, left, right): edges are midpoints between header centres; the outer ones are open."""
    lookup = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    on_header = rows.join(keyed(headers), ["unit_id", "page"]).filter("anchor = header_y").withColumn(
        "column", F.try_element_at(lookup, T.compact(F.col("text")))).filter("column is not null")
    centres = on_header.groupBy("unit_id", "column").agg(F.avg(center_x()).alias("_c"))
    # As many rows per unit as there are columns.
    order = Window.partitionBy("unit_id").orderBy("_c", "column")
    left, right = F.lag("_c").over(order), F.lead("_c").over(order)
    return centres.select(
        "unit_id", "column", F.coalesce((F.col("_c") + left) / 2, F.lit(float("-inf"))).alias("left"),
        F.coalesce((F.col("_c") + right) / 2, F.lit(float("inf"))).alias("right"))


def assign_columns(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Add `column`: the first whose right edge lies beyond the centre of the span.

    The edges of a unit travel as one small array, so a span row stays one row.
    """
    packed = edges.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("right", "column"))).alias("_edges"))
    first = F.try_element_at(F.filter("_edges", lambda e: center_x() < e["right"]), F.lit(1))
    return rows.join(keyed(packed), "unit_id").withColumn("column", first["column"]).drop("_edges")


def table_end(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(unit_id, page, end_y): top of the first row below the header that says 合计, 小计 or 备注.

    An amount printed up to one and a half median heights above belongs to that row: the end is then its top.
    """
    below = rows.join(keyed(headers), ["unit_id", "page"]).filter("anchor > header_y")
    texts = visual_lines(below).withColumn("_t", T.compact(F.col("text")))
    ends = texts.filter(T.any_term(F.col("_t"), ("合计", "小计", "备注"))).groupBy("unit_id", "page").agg(F.min_by("y0", "anchor").alias("end_y"))
    height = F.col("y1") - F.col("y0")
    heights = rows.groupBy("unit_id", "page").agg(F.median(F.when(height > 0, height)).alias("_height"))
    gap = F.coalesce(F.col("_height") * 1.5, F.lit(15.0))
    above = rows.filter(M.is_money(F.trim("text"))).join(keyed(ends), ["unit_id", "page"]).join(keyed(heights), ["unit_id", "page"])
    pulled = above.filter(F.col("y0").between(F.col("end_y") - gap, F.col("end_y"))).groupBy("unit_id", "page").agg(F.min("y0").alias("_pulled"))
    return ends.join(keyed(pulled), ["unit_id", "page"], "left").select("unit_id", "page", F.least("end_y", "_pulled").alias("end_y"))


def segment_items(rows: DataFrame, headers: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the item area with `item_no`: a `*` text left of the name edge opens a new item."""
    area = rows.join(keyed(headers), ["unit_id", "page"]).join(keyed(ends), ["unit_id", "page"], "left").filter(
        (F.col("anchor") > F.col("header_y")) & (F.col("y0") < F.coalesce("end_y", F.lit(float("inf")))))
    name_edge = edges.filter("column = 'item_name'").select("unit_id", F.col("right").alias("_edge"))
    area = area.join(keyed(name_edge), "unit_id", "left")
    start = F.col("text").startswith("*") & (center_x() <= F.coalesce("_edge", F.lit(float("inf"))))
    numbered = running_sum(area, ["unit_id"], ["page", "anchor", "x0", "ord"], start.cast("int"), "item_no", size=1)
    return numbered.filter("item_no > 0").drop("header_y", "end_y", "_edge")


# The columns of a line table.
TABLE_COLUMNS = ("item_name", "spec_model", "unit", "quantity", "unit_price", "line_amount", "tax_rate", "line_tax_amount")


def table_items(rows: DataFrame, header_aliases: dict[str, list[str]], spec_tokens: Sequence[str] = (),
                extra: Sequence[str] = ()) -> DataFrame:
    """Lines of a printed table: header row, column edges, item segments, one row per item.

    `rows` are visual rows by tops; they are read several times, so a caller may store them first.

    Items without a name, an amount, a rate or a tax are dropped; `*` for rate and tax means zero tax.
    """
    columns = header_columns(header_aliases)
    headers = header_rows(rows, columns)
    edges = column_edges(rows, headers, columns)
    cells = assign_columns(segment_items(rows, headers, table_end(rows, headers), edges), edges)
    text = F.trim("text")
    number, money, rate = M.is_number(text), M.is_money(text), text.rlike(M.RATE_FULL)
    cells = cells.filter(~T.is_total_marker(text))
    spec = T.looks_like_spec(text) | (text.isin(*spec_tokens) if spec_tokens else F.lit(False))
    stray = ~number & ~money
    column = F.col("column")
    # Text in the spec column that is neither spec nor number goes on with the name.
    target = (
        F.when((column == "item_name") & ~(text.startswith("*") | stray), F.lit(None).cast("string"))
        .when((column == "spec_model") & ~spec, F.when(stray, F.lit("item_name")))
        .when((column == "unit") & ~(stray & ~rate), F.lit(None).cast("string"))
        .otherwise(column))
    order = F.struct(F.when(column == "spec_model", F.lit(1)).otherwise(F.lit(0)).alias("late"), "page", "y0", "x0", "ord")
    kept = cells.withColumn("_target", target).withColumn("_order", order).withColumn("_text", text)

    def joined(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("_target") == name, F.struct("_order", "_text"))))
        return F.nullif(F.array_join(F.transform(parts, lambda p: p["_text"]), ""), F.lit(""))

    def last(name: str, test: Column) -> Column:
        return F.max_by(F.when((F.col("_target") == name) & test, F.col("_text")), F.when((F.col("_target") == name) & test, F.col("_order")))

    cells_of = kept.groupBy("unit_id", "item_no").agg(
        joined("item_name").alias("_name"), joined("spec_model").alias("_spec"), joined("unit").alias("_unit"),
        last("quantity", number).alias("quantity"), last("unit_price", number).alias("unit_price"),
        last("line_amount", money).alias("_amount"), last("tax_rate", rate | (F.col("_text") == "*")).alias("tax_rate"),
        last("line_tax_amount", money | (F.col("_text") == "*")).alias("_tax"), *[joined(name).alias(name) for name in extra])
    split = T.split_embedded_spec(F.col("_name"), F.col("_spec"))
    tax = F.when((F.col("_tax") == "*") & (F.col("tax_rate") == "*"), F.lit(0).cast(MONEY)).otherwise(M.to_money(F.col("_tax")))
    built = cells_of.withColumn("_s", split).select(
        "unit_id", "item_no", F.col("_s.item_name").alias("item_name"), F.col("_s.spec_model").alias("spec_model"),
        T.full_width_brackets(F.col("_unit")).alias("unit"), M.to_number(F.col("quantity")).alias("quantity"),
        M.to_number(F.col("unit_price")).alias("unit_price"), M.to_money(F.col("_amount")).alias("line_amount"), "tax_rate",
        tax.alias("line_tax_amount"), *extra)
    # A quantity with more than two digits behind the point that equals the amount is the price of one.
    is_price = F.col("unit_price").isNull() & (F.round("quantity", 2) == F.col("line_amount")) & (F.round("quantity", 2) != F.col("quantity"))
    price = F.when(is_price, F.col("quantity")).otherwise(F.col("unit_price"))
    quantity = F.when(is_price, F.lit(1).cast(M.QUANTITY)).otherwise(F.col("quantity"))
    whole = built.filter("item_name is not null and line_amount is not null and tax_rate is not null and line_tax_amount is not null")
    whole = whole.withColumn("unit_price", price).withColumn("quantity", quantity).withColumn(
        "line_total_with_tax", (F.col("line_amount") + F.col("line_tax_amount")).cast(MONEY))
    # A running sum would read the table twice.
    line_no = F.row_number().over(Window.partitionBy("unit_id").orderBy("item_no")).cast("bigint")
    return whole.withColumn("line_no", line_no).drop("item_no")


def merge_by_position(lines: DataFrame, sub_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The n-th sub-table row goes to the n-th line, surplus rows to the last; later non-empty values win."""
    counts = lines.groupBy("unit_id").agg(F.max("line_no").alias("_last"))
    placed = sub_rows.join(keyed(counts), "unit_id").withColumn("line_no", F.least("row_no", "_last"))

    def latest(name: str) -> Column:
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        return F.max_by(F.when(filled, F.col(name)), F.when(filled, F.col("row_no")))

    merged = placed.groupBy("unit_id", "line_no").agg(*[latest(c).alias(f"_{c}") for c in columns])
    joined = lines.join(keyed(merged), ["unit_id", "line_no"], "left")
    for name in columns:
        known = F.col(name) if name in lines.columns else F.lit(None).cast("string")
        joined = joined.withColumn(name, F.coalesce(F.col(f"_{name}"), known)).drop(f"_{name}")
    return joined


def better_lines(sequence: DataFrame, coordinate: DataFrame, headers: DataFrame) -> DataFrame:
    """Per unit the better of two line sets, tagged `method`.

    More lines by position win; at equal counts the smaller distance to the header amount does, ties to
    position; where a line cannot be compared, the text lines stay with a risk.
    """
    def facts(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("unit_id").agg(
            F.count(F.lit(1)).alias(f"_{tag}_n"), F.sum("line_amount").alias(f"_{tag}_sum"),
            F.bool_or(F.col("line_amount").isNull()).alias(f"_{tag}_open"))

    both = facts(sequence, "s").join(keyed(facts(coordinate, "c")), "unit_id", "full_outer").join(
        keyed(headers.select("unit_id", "amount_total")), "unit_id", "left")
    s_n, c_n = F.coalesce("_s_n", F.lit(0)), F.coalesce("_c_n", F.lit(0))
    equal = (s_n == c_n) & F.col("amount_total").isNotNull()
    open_ = equal & (F.col("_s_open") | F.col("_c_open"))
    nearer = F.abs(F.col("_s_sum") - F.col("amount_total")) < F.abs(F.col("_c_sum") - F.col("amount_total"))
    method = F.when((c_n == 0) | (c_n < s_n) | open_, F.lit("sequence")).when(equal & nearer, F.lit("sequence")).otherwise(F.lit("coordinate"))
    chosen = both.select("unit_id", method.alias("method"), F.coalesce(open_, F.lit(False)).alias("comparison_failed"))
    text = sequence.join(keyed(chosen.filter("method = 'sequence'")), "unit_id")
    placed = coordinate.join(keyed(chosen.filter("method = 'coordinate'")), "unit_id")
    return text.unionByName(placed, allowMissingColumns=True)
