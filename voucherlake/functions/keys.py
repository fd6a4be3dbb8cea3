"""Content-derived identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(_joined(*parts)), 1, 20)


def unit_id(file_name: Column, pages: Column, content: Column) -> Column:
    """Unit id from the name, the pages and the content of a file."""
    page_part = F.when(F.size(pages) > 0, F.array_join(pages.cast("array<string>"), "-")).otherwise(F.lit("none"))
    digest = F.coalesce(F.substring(F.sha1(content), 1, 16), F.lit("missing"))
    return F.concat(F.lit("unit_"), F.substring(F.sha1(F.concat_ws("|", file_name, page_part, digest)), 1, 16))


def invoice_key(seller_tax_id: Column, invoice_no: Column, invoice_date: Column, total: Column) -> Column:
    return F.concat(F.lit("inv_"), stable_hash(seller_tax_id, invoice_no, invoice_date, total))


def line_key(invoice_key_: Column, line_no: Column, item_name: Column, amount: Column, tax: Column) -> Column:
    return F.concat(F.lit("line_"), stable_hash(invoice_key_, line_no, item_name, amount, tax))


def draft_row_id(run_id: Column, unit_id_: Column, line_no: Column) -> Column:
    return F.concat(F.lit("draft_"), stable_hash(run_id, unit_id_, line_no))


def notice_id(unit_id_: Column, issue_type: Column, key: Column) -> Column:
    return F.concat(F.lit("notice_"), stable_hash(unit_id_, issue_type, key))


def result_fingerprint(*parts: Column) -> Column:
    return F.sha2(_joined(*parts), 256)


# The columns whose equality makes two ledger rows the same.
FINGERPRINT_COLUMNS = (
    "invoice_code", "invoice_no", "digital_invoice_no", "invoice_date", "seller_tax_id", "buyer_tax_id",
    "item_name", "line_amount", "line_tax_amount", "line_total_with_tax", "invoice_total_with_tax",
)


def row_fingerprint(df, names=FINGERPRINT_COLUMNS) -> Column:
    """Hash of the fingerprint columns a target table has; null when all are blank."""
    types = dict(df.dtypes)
    parts = []
    for name in names:
        if name in types:
            text = F.col(name).cast("string")
            if types[name].startswith("decimal"):
                text = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
            parts.append(F.coalesce(F.trim(text), F.lit("")))
    joined = F.concat_ws("|", *parts)
    return F.when(F.ltrim(joined, F.lit("|")) != "", F.sha1(joined))
