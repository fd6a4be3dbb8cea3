"""Records to ledger rows: reconciliation, row building, roll-ups, output projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.functions import keys as K
from voucherlake.functions import labels as L
from voucherlake.functions import review as R
from voucherlake.functions.money import MONEY, format_money
from voucherlake.functions.text import is_digital_no
from voucherlake.operators.ordered import first_rows
from voucherlake.session import keyed

HEADER_MONEY = ("amount_total", "tax_total", "total_with_tax")

def zero() -> Column:
    return F.lit(0).cast(MONEY)


def line_total(amount: str = "line_amount", tax: str = "line_tax_amount", total: str = "line_total_with_tax") -> Column:
    return F.coalesce(F.col(total), (F.col(amount) + F.col(tax)).cast(MONEY))


def line_sums(lines: DataFrame) -> DataFrame:
    """One row per unit: strict sums (null if any line is null) and plain sums (null as zero)."""
    def strict(value: Column) -> Column:
        return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value)).cast(MONEY)

    total = line_total()
    return lines.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        strict(F.col("line_amount")).alias("lines_amount"),
        strict(F.col("line_tax_amount")).alias("lines_tax"),
        strict(total).alias("lines_total"),
        F.sum(F.coalesce("line_amount", zero())).cast(MONEY).alias("plain_amount"),
        F.sum(F.coalesce("line_tax_amount", zero())).cast(MONEY).alias("plain_tax"),
    )


def _difference(label: str, detail_label: str, header: Column, detail: Column) -> Column:
    gap = (detail - header).cast(MONEY)
    return (
        F.when(gap.isNull(), F.lit(f"待复核：{label}或{detail_label}缺失"))
        .when(gap != 0, F.concat(
            F.lit(f"待复核：{label}与{detail_label}不一致，{label} "), format_money(header),
            F.lit("，明细合计 "), format_money(detail), F.lit("，差额 "), format_money(gap)))
    )


def reconcile(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Header against line sums: adds the sums, reconciliation_status and reconciliation_remark."""
    joined = invoices.join(keyed(line_sums(lines)), "unit_id", "left")
    issues = F.concat_ws(
        "；",
        _difference("汇总金额", "明细金额合计", F.col("amount_total"), F.col("lines_amount")),
        _difference("汇总税额", "明细税额合计", F.col("tax_total"), F.col("lines_tax")),
        _difference("汇总价税合计", "明细价税合计", F.col("total_with_tax"), F.col("lines_total")),
    )
    remark = F.when(F.col("n_lines").isNull(), F.lit("待复核：明细缺失")).otherwise(issues)
    return joined.withColumn("reconciliation_remark", remark).withColumn(
        "reconciliation_status", F.when(F.col("reconciliation_remark") == "", F.lit("通过")).otherwise(F.lit("需复核"))
    )


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


LINE_COLUMNS = (
    ("item_name", "string"), ("spec_model", "string"), ("unit", "string"), ("quantity", "decimal(28,12)"),
    ("unit_price", "decimal(28,12)"), ("line_amount", MONEY), ("tax_rate", "string"),
    ("line_tax_amount", MONEY), ("line_total_with_tax", MONEY),
)
LINE_CONTEXT = (
    "context_remark", "service_location", "project_name", "transport_vehicle_type", "transport_vehicle_no",
    "origin_place", "destination_place", "transport_goods_name", "toll_variant", "vehicle_plate_no",
    "toll_entrance", "toll_exit", "passage_time",
)


def ledger_rows(invoices: DataFrame, lines: DataFrame, run_id: str, processed_at: str) -> DataFrame:
    """One ledger row per line; a unit without lines gets one row from its header.

    Units that are unmodeled or failed give no rows. The header side has one
    row per unit, so only the line side can be skewed, and a skewed join
    partition is split on the line side.
    """
    kept = invoices.filter(~F.col("status").isin("unmodeled", "failed"))
    header = reconcile(kept, lines)

    remark = F.coalesce(F.col("remark"), F.lit(""))
    no_number = F.coalesce(F.trim("invoice_no"), F.lit("")) == ""
    checked = F.when(F.col("status") == "ready", F.lit("")).otherwise(R.review_text(remark))
    header = header.withColumn("_checked", checked)
    add_number = no_number & ~remark.contains("invoice_no") & ~F.col("_checked").contains("发票号码")
    header = (
        header.withColumn("_status", F.when(no_number, F.lit("review_required")).otherwise(F.col("status")))
        .withColumn("_review", F.concat_ws(
            "；",
            F.when(F.col("_checked") != "", F.col("_checked")),
            F.when(add_number, R.review_text(F.lit("missing invoice_no"))),
            F.when(F.col("reconciliation_remark") != "", F.col("reconciliation_remark")),
        ))
        .withColumn("recognition_status", F.when(
            F.col("reconciliation_status") == "需复核", F.lit("review_required")).otherwise(F.col("_status")))
        .withColumn("invoice_key", K.invoice_key(
            F.col("seller_tax_id"), F.col("invoice_no"), F.col("invoice_date"), F.col("total_with_tax")))
        .withColumn("_red", L.red_context(
            _column(invoices, "is_red_invoice"), _column(invoices, "red_original_no"),
            _column(invoices, "red_original_code"), _column(invoices, "red_confirm_no")))
        .withColumn("is_positive_invoice", L.positive_flag(
            F.col("total_with_tax"), _column(invoices, "is_red_invoice")))
    )

    item_columns = [_column(lines, name, kind).alias(name) for name, kind in LINE_COLUMNS]
    context = {name: _column(lines, name) for name in LINE_CONTEXT}
    context["discount_for_line_no"] = _column(lines, "discount_for_line_no", "int")
    details = lines.select("unit_id", "line_no", *item_columns, L.line_remark(context).alias("_line_remark"))
    joined = header.join(keyed(details), "unit_id", "left")

    # A unit without lines gets one line that repeats the header money.
    empty = F.col("line_no").isNull()
    joined = (
        joined.withColumn("line_amount", F.when(empty, F.col("amount_total")).otherwise(F.col("line_amount")))
        .withColumn("line_tax_amount", F.when(empty, F.col("tax_total")).otherwise(F.col("line_tax_amount")))
        .withColumn("line_total_with_tax", F.when(empty, F.col("total_with_tax")).otherwise(F.col("line_total_with_tax")))
        .withColumn("line_no", F.coalesce("line_no", F.lit(1)))
    )
    joined = joined.withColumn("context_remark", F.concat_ws(
        "；",
        F.when(F.coalesce("_line_remark", F.lit("")) != "", F.col("_line_remark")),
        F.when(F.col("_red") != "", F.col("_red")),
    ))
    pages = F.col("page_range") if "page_range" in invoices.columns else F.array(F.lit(1))
    return joined.select(
        F.lit("明细").alias("row_type"),
        K.draft_row_id(F.lit(run_id), F.col("unit_id"), F.col("line_no")).alias("draft_row_id"),
        F.lit(run_id).alias("run_id"),
        L.file_name(F.col("source_file")).alias("source_file"),
        pages.cast("array<int>").alias("page_range"),
        "unit_id",
        _column(invoices, "schema_id").alias("schema_id"),
        _column(invoices, "variant_id").alias("variant_id"),
        "invoice_key",
        K.line_key(F.col("invoice_key"), F.col("line_no"), F.col("item_name"), F.col("line_amount"),
                   F.col("line_tax_amount")).alias("invoice_line_key"),
        F.col("line_no").cast("int").alias("line_no"),
        F.lit(processed_at).alias("processed_at"),
        _column(invoices, "invoice_code").alias("invoice_code"),
        "invoice_no",
        F.col("invoice_date").cast("string").alias("invoice_date"),
        _column(invoices, "buyer_name").alias("buyer_name"),
        _column(invoices, "buyer_tax_id").alias("buyer_tax_id"),
        _column(invoices, "seller_name").alias("seller_name"),
        _column(invoices, "seller_tax_id").alias("seller_tax_id"),
        _column(invoices, "invoice_type").alias("invoice_type"),
        "is_positive_invoice",
        "item_name", "spec_model", "unit", "quantity", "unit_price", "line_amount", "tax_rate", "line_tax_amount",
        line_total().alias("line_total_with_tax"),
        F.col("amount_total").alias("invoice_amount_total"),
        F.col("tax_total").alias("invoice_tax_total"),
        F.col("total_with_tax").alias("invoice_total_with_tax"),
        "recognition_status", "reconciliation_status",
        _column(invoices, "confidence", "double").alias("confidence"),
        F.col("_review").alias("review_remark"),
        "context_remark",
        F.concat_ws("；", F.when(F.col("_review") != "", F.col("_review")),
                    F.when(F.col("context_remark") != "", F.col("context_remark"))).alias("remark"),
        F.lit("original").alias("correction_status"),
        F.lit(None).cast("string").alias("correction_time"),
        F.lit(None).cast("string").alias("correction_remark"),
    )


def invoice_summary(rows: DataFrame, position: list[str]) -> DataFrame:
    """One row per invoice key: a row typed 汇总 (the last one) wins, else the first row.

    Rows are ranked, so that columns nobody asks for afterwards are neither built nor shuffled.
    """
    place = F.struct(*position)
    return first_rows(rows, ["invoice_key"], [F.desc_nulls_last(F.when(F.col("row_type") == "汇总", place)), place])


def invoice_rollup(lines: DataFrame, order: list[str]) -> DataFrame:
    """Printed name and common rate of an invoice.

    One line gives its own name and rate; several give `name等n项` and the rate
    only if all lines with money share one. Everything is a partial aggregate.
    """
    name = F.trim(F.coalesce("item_name", F.lit("")))
    place = F.struct(*order)
    contributes = F.coalesce(line_total(), F.col("line_amount"), zero()) != 0
    rate = F.when(F.coalesce("tax_rate", F.lit("")) != "", F.col("tax_rate"))
    grouped = lines.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min_by("item_name", place).alias("_only_name"),
        F.min_by("tax_rate", place).alias("_only_rate"),
        F.min_by(F.when(name != "", name), F.when(name != "", place)).alias("_first_name"),
        F.min(F.when(contributes, rate)).alias("_low"),
        F.max(F.when(contributes, rate)).alias("_high"),
        F.count_if(contributes & rate.isNull()).alias("_bare"),
    )
    many = F.concat(F.coalesce("_first_name", F.lit("发票明细")), F.lit("等"), F.col("n_lines").cast("string"), F.lit("项"))
    return grouped.select(
        "unit_id", "n_lines",
        F.when(F.col("n_lines") == 1, F.col("_only_name")).otherwise(many).alias("summary_name"),
        F.when(F.col("n_lines") == 1, F.col("_only_rate"))
        .when((F.col("_bare") == 0) & (F.col("_low") == F.col("_high")), F.col("_low")).alias("summary_rate"),
    )


# Printed headers of the three output tables, with (header, required, source).
OUTPUT_PROFILE = {
    "detail": {
        "name": "发票信息采集",
        "fields": [
            ("row_sequence", "序号", True, None), ("source_file", "文件名", True, None),
            ("processed_at", "处理时间", True, None), ("invoice_code", "发票代码", True, None),
            ("invoice_no", "发票号码", True, None), ("digital_invoice_no", "数电发票号码", True, None),
            ("seller_tax_id", "销方识别号", False, None), ("seller_name", "销方名称", True, None),
            ("buyer_tax_id", "购方识别号", False, None), ("buyer_name", "购买方名称", False, None),
            ("invoice_date", "开票日期", False, None), ("item_name", "货物或应税劳务名称", True, None),
            ("spec_model", "规格型号", False, None), ("unit", "单位", False, None),
            ("quantity", "数量", False, None), ("unit_price", "单价", False, None),
            ("line_amount", "金额", True, None), ("tax_rate", "税率", False, None),
            ("line_tax_amount", "税额", False, None), ("line_total_with_tax", "价税合计", True, None),
            ("invoice_type", "发票票种", True, None), ("is_positive_invoice", "是否正数发票", False, None),
            ("confidence", "置信度", True, None), ("recognition_status", "识别状态", True, None),
            ("remark", "备注", False, None), ("draft_row_id", "票据ID", True, "invoice_line_key"),
        ],
    },
    "summary": {
        "name": "发票基础信息",
        "fields": [
            ("row_sequence", "序号", True, None), ("invoice_code", "发票代码", True, None),
            ("invoice_no", "发票号码", True, None), ("digital_invoice_no", "数电发票号码", True, None),
            ("seller_tax_id", "销方识别号", False, None), ("seller_name", "销方名称", True, None),
            ("buyer_tax_id", "购方识别号", False, None), ("buyer_name", "购买方名称", False, None),
            ("invoice_date", "开票日期", False, None), ("invoice_amount_total", "金额", True, None),
            ("invoice_tax_total", "税额", False, None), ("invoice_total_with_tax", "价税合计", True, None),
            ("invoice_type", "发票票种", True, None), ("is_positive_invoice", "是否正数发票", False, None),
            ("remark", "备注", False, None), ("draft_row_id", "票据ID", True, "invoice_line_key"),
        ],
    },
    "issues": {
        "name": "识别提示",
        "fields": [
            ("severity", "状态", True, None), ("issue_type", "问题", True, None), ("source_file", "文件", True, None),
            ("page_text", "页码", True, None), ("invoice_no", "发票号码", False, None),
            ("amount_total", "价税合计", False, None), ("check_location", "核对位置", True, None),
            ("action", "处理方式", True, None), ("draft_row_id", "票据ID", True, "notice_id"),
        ],
    },
}


def output_values(rows: DataFrame) -> DataFrame:
    """Values as printed: 20-digit numbers in their own column, dates, status words, remark."""
    digital = is_digital_no(F.col("invoice_no"))
    return (
        rows.withColumn("remark", R.display_remark(
            F.col("recognition_status"), F.col("review_remark"), F.col("context_remark"), F.col("remark")))
        .withColumn("digital_invoice_no", F.when(digital, F.col("invoice_no")))
        .withColumn("invoice_no", F.when(~digital, F.col("invoice_no")))
        .withColumn("invoice_date", F.col("invoice_date").try_cast("date"))
        .withColumn("processed_at", F.col("processed_at").try_cast("timestamp"))
        .withColumn("recognition_status", L.status_label(F.col("recognition_status")))
        .withColumn("page_range", L.list_text(F.col("page_range")))
    )


def project_output(rows: DataFrame, table: str = "detail", headers: bool = False) -> DataFrame:
    """Select the columns of one output table; with `headers` under their printed names."""
    columns = []
    for name, header, _required, source in OUTPUT_PROFILE[table]["fields"]:
        origin = source or name
        if origin in rows.columns:
            columns.append(F.col(origin).alias(header if headers else name))
    return rows.select(*columns)


CELL_ROWS = 200_000


def number_rows(rows: DataFrame, order: list[str], start: Column | int = 0, documents: int | None = None, lines: int = 1_000_000) -> DataFrame:
    """Continue a row sequence without a global window.

    `order[0]` is the numeric document position and `order[1]` the numeric line
    position. Rows fall into cells of `documents` documents and `lines` lines; cells are
    numbered inside, and a table with one row per cell carries the offsets. A document
    of more than `lines` lines spreads over several cells. Unless given, `documents` is
    chosen so that a cell holds CELL_ROWS rows in the mean, whatever the size of the batch.
    """
    if documents is None:
        low, high, n = rows.agg(F.min(order[0]), F.max(order[0]), F.count(F.lit(1))).first()
        documents = max(1, int((high - low + 1) * CELL_ROWS / n)) if n and low is not None else 1
    celled = rows.withColumn("_cell", F.floor(F.col(order[0]) / documents)).withColumn(
        "_strip", F.floor(F.col(order[1]) / lines))
    counts = celled.groupBy("_cell", "_strip").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_cell", "_strip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_cell", "_strip").orderBy(*order))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        celled.withColumn("_local", local).join(keyed(offsets), ["_cell", "_strip"])
        .withColumn("row_sequence", base + F.col("_offset") + F.col("_local"))
        .drop("_cell", "_strip", "_local", "_offset")
    )


def continue_sequence(rows: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Number new rows behind the last row of a ledger."""
    last = ledger.agg(F.coalesce(F.max("row_sequence"), F.lit(0)).alias("_last")).scalar()
    return number_rows(rows, order).withColumn("row_sequence", F.col("row_sequence") + last)
