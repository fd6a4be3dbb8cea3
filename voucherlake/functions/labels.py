"""Printed labels: file names, pages, status words, remarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words.
STATUS_LABELS = {
    "ready": "通过",
    "review_required": "需复核",
    "unmodeled": "当前未建模",
    "failed": "失败",
    "duplicate": "重复跳过",
    "corrected": "已修正",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def page_text(pages: Column) -> Column:
    known = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull() & (p != 0))))
    first, last = F.try_element_at(known, F.lit(1)), F.try_element_at(known, F.lit(-1))
    return (
        F.when(F.size(known) == 0, F.lit("未识别页码"))
        .when(F.size(known) == 1, F.concat(F.lit("第 "), first, F.lit(" 页")))
        .otherwise(F.concat(F.lit("第 "), first, F.lit("-"), last, F.lit(" 页")))
    )


def status_label(status: Column, labels: dict[str, str] | None = None) -> Column:
    """Printed word of a status; an unknown status stays as it is."""
    pairs = [F.lit(x) for pair in (labels or STATUS_LABELS).items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), status)


def positive_flag(total: Column, is_red: Column) -> Column:
    return F.when(F.coalesce(total < 0, F.lit(False)) | F.coalesce(is_red == "是", F.lit(False)), F.lit("否")).otherwise(
        F.lit("是")
    )


def csv_safe(text: Column) -> Column:
    """Text a spreadsheet would read as a formula, marked as text."""
    return F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def list_text(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def freight_context(vehicle_type: Column, vehicle_no: Column, origin: Column, destination: Column, goods: Column) -> Column:
    vehicle = F.concat_ws(" ", F.when(_filled(vehicle_type), vehicle_type), F.when(_filled(vehicle_no), vehicle_no))
    route = F.when(_filled(origin) & _filled(destination), F.concat(origin, F.lit("→"), destination)).otherwise(
        F.coalesce(F.when(_filled(origin), origin), F.when(_filled(destination), destination))
    )
    body = F.concat_ws(
        "；",
        F.when(vehicle != "", vehicle),
        route,
        F.when(_filled(goods), F.concat(F.lit("货物："), goods)),
    )
    return F.when(body != "", F.concat(F.lit("货运："), body)).otherwise(F.lit(""))


def red_context(is_red: Column, original_no: Column, original_code: Column, confirm_no: Column) -> Column:
    body = F.concat_ws(
        "；",
        F.lit("红冲发票"),
        F.when(_filled(original_no), F.concat(F.lit("被红冲蓝字号码："), original_no)),
        F.when(_filled(original_code), F.concat(F.lit("被红冲蓝字代码："), original_code)),
        F.when(_filled(confirm_no), F.concat(F.lit("红字信息确认单："), confirm_no)),
    )
    return F.when(F.coalesce(is_red == "是", F.lit(False)), body).otherwise(F.lit(""))


# Labelled parts of a line remark, in print order.
LINE_REMARK_LABELS = (
    ("toll_variant", "通行费类型"),
    ("vehicle_plate_no", "车牌号"),
    ("toll_entrance", "入口"),
    ("toll_exit", "出口"),
    ("passage_time", "通行时间"),
)


def line_remark(item: dict[str, Column]) -> Column:
    """Remark of one line; absent columns count as null."""
    null = F.lit(None).cast("string")

    def get(name: str) -> Column:
        return item.get(name, null)

    def labelled(name: str, label: str) -> Column:
        return F.when(_filled(get(name)), F.concat(F.lit(f"{label}："), get(name)))

    freight = freight_context(*[get(n) for n in (
        "transport_vehicle_type", "transport_vehicle_no", "origin_place", "destination_place", "transport_goods_name")])
    parts = [
        F.when(_filled(get("context_remark")), F.trim(get("context_remark"))),
        labelled("service_location", "建筑服务发生地"),
        labelled("project_name", "建筑项目名称"),
        F.when(freight != "", freight),
        *[labelled(name, label) for name, label in LINE_REMARK_LABELS],
        F.when(get("discount_for_line_no").isNotNull(),
               F.concat(F.lit("折扣行，关联第"), get("discount_for_line_no").cast("string"), F.lit("行"))),
    ]
    distinct = F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")))
    return F.array_join(distinct, "；")
