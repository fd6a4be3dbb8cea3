"""Text clean-up, width folding and line predicates."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voucherlake.functions import money as M

# Context words and patterns of the line predicates.
TAX_ID_PATTERN = r"(?<![0-9A-Za-z_\p{L}\p{N}])[0-9A-Z]{15,20}(?![0-9A-Za-z_\p{L}\p{N}])"
LONG_NUMBER_PATTERN = r"(?U)(?<![\w])\d{8,20}(?![\w])"
CODE_PATTERN = r"(?U)(?<![\w])\d{10,12}(?![\w])"
TAX_ID_EXCLUDED_TERMS = ("银行账号", "开户银行", "开户行", "账号", "电话", "地址")
IDENTITY_NUMBER_TERMS = ("纳税人识别号", "统一社会信用代码", "社会信用代码", "身份证", "证件号码", "识别号")
SECONDARY_IDENTITY_TERMS = (
    "原发票", "原蓝字", "对应蓝字", "红字信息", "红字发票", "红字发票信息", "红字发票信息表", "信息表编号", "冲红", "红冲",
)
COMPANY_PATTERN = r"([一-鿿]{2,}(?:有限责任公司|股份有限公司|有限公司|公司))"
EMBEDDED_SPEC = r"(?U)\s+(\d+(?:\.\d+)?m，\d+(?:\.\d+)?mm(?:，[^，\s]+)?)"
LABEL_EDGE = "：:;；,，.。"
TOTAL_MARKERS = ("合", "计", "合计")


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression; `body` gets it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shortest(terms) -> list[str]:
    """Terms without those that hold another of them: a text that holds the longer one holds the shorter one."""
    words = list(dict.fromkeys(terms))
    return [w for w in words if not any(v != w and v in w for v in words)]


def holds(text: Column, terms) -> Column:
    """Like any_term, for a text that is at hand: a look at bytes per term costs far less than a regular expression."""
    hit = F.lit(False)
    for term in shortest(terms):
        hit = hit | text.contains(term)
    return hit


def any_term(text: Column, terms) -> Column:
    """True if a text holds any of the terms; one expression, however many terms."""
    words = shortest(terms)
    if not words:
        return F.lit(False)
    if len(words) == 1:
        return text.contains(words[0])
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def all_terms(text: Column, terms) -> Column:
    hit = F.lit(True)
    for term in terms:
        hit = hit & text.contains(term)
    return hit


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def clean_label_value(text: Column) -> Column:
    return F.trim(F.btrim(F.trim(text), F.lit(LABEL_EDGE)))


def has_han(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")


def after(text: Column, label: str) -> Column:
    """Everything behind the first occurrence of a label."""
    return F.substring(text, F.instr(text, label) + len(label), F.length(text))


def contains_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


# ---- width folding -------------------------------------------------------

@lru_cache(maxsize=1)
def _single_char_folds() -> tuple[str, str]:
    """Code points of the basic plane whose compatibility form is one other character."""
    source, target = [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFKC", char)
        if len(folded) == 1 and folded != char and ord(folded) < 0x10000:
            source.append(char)
            target.append(folded)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _residual_chars() -> str:
    """Characters a one-to-one fold cannot settle: expansions and combining marks."""
    chars = []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFKC", char)
        plain_fold = len(folded) == 1 and point < 0x10000 and ord(folded) < 0x10000
        if (folded != char and not plain_fold) or unicodedata.combining(char) or 0x1160 <= point <= 0x11FF:
            chars.append(char)
    return "".join(chars)


@F.pandas_udf(StringType())
def _full_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_width(text: Column) -> Column:
    """Compatibility folding of every one-to-one code point, inside the JVM."""
    source, target = _single_char_folds()
    return F.when(_is_ascii(text), text).otherwise(F.translate(text, source, target))


def needs_full_nfkc(text: Column) -> Column:
    without = F.translate(text, _residual_chars(), "")
    return ~_is_ascii(text) & (F.char_length(without) < F.char_length(text))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; Python sees only rows a one-to-one fold cannot settle."""
    return F.coalesce(_full_nfkc(F.when(needs_full_nfkc(text), text)), fold_width(text))


# ---- predicates ----------------------------------------------------------

def is_digital_no(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^[0-9]{20}$"), F.lit(False))


def tax_ids(line: Column) -> Column:
    """Tax ids of a line; lines about banks, phones or addresses have none."""
    found = F.regexp_extract_all(line, F.lit(TAX_ID_PATTERN), 0)
    # The shortest id first: the whole pattern looks around every place of a line.
    return F.when((F.length(line) < 15) | ~line.rlike("[0-9A-Z]{15}") | any_term(line, TAX_ID_EXCLUDED_TERMS), F.array().cast("array<string>")).otherwise(
        F.filter(found, is_tax_id)
    )


def is_tax_id(value: Column) -> Column:
    return value.rlike("[A-Za-z]") | F.length(value).isin(15, 18)


def any_term_compact(line: Column, terms) -> Column:
    """any_term of the line without its blanks; terms hold no blanks, so a hit with blanks is one without."""
    return holds(line, terms) | (line.rlike(r"(?U)\s") & any_term(compact(line), terms))


def secondary_context(line: Column) -> Column:
    return any_term_compact(line, SECONDARY_IDENTITY_TERMS)


def identity_context(line: Column) -> Column:
    return any_term_compact(line, IDENTITY_NUMBER_TERMS)


def has_unclosed_parenthesis(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[(（]")) > F.regexp_count(text, F.lit("[)）]"))


def is_total_marker(text: Column) -> Column:
    return text.isin(*TOTAL_MARKERS) | text.contains("价税合计")


def looks_like_spec(text: Column) -> Column:
    return text.rlike(r"(?U)\d") & ~M.is_number(text) & ~text.rlike(M.RATE_FULL)


def token_class(token: Column, unit_tokens=(), spec_tokens=()) -> Column:
    """One class per token, first matching rule wins."""
    folded = F.translate(F.trim(token), "()", "（）")
    return (
        F.when(contains_blank(token), F.lit("blank"))
        .when(F.trim(token) == "*", F.lit("star"))
        .when(token.startswith("*"), F.lit("name"))
        .when(M.is_rate(token), F.lit("rate"))
        .when(M.is_number(token), F.lit("number"))
        .when(M.is_money(token), F.lit("money"))
        .when(is_total_marker(F.trim(token)), F.lit("total"))
        .when(folded.isin(*unit_tokens) if unit_tokens else F.lit(False), F.lit("unit"))
        .when(F.trim(token).isin(*spec_tokens) if spec_tokens else F.lit(False), F.lit("text_spec"))
        .when(looks_like_spec(token), F.lit("spec"))
        .when(has_unclosed_parenthesis(token), F.lit("open"))
        .when(has_han(token), F.lit("han"))
        .otherwise(F.lit("text"))
    )


def company_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(compact(text), COMPANY_PATTERN, 1), F.lit(""))


def split_embedded_spec(item_name: Column, spec: Column) -> Column:
    """Pull `…m，…mm` out of a name when no spec is known."""
    found = F.regexp_extract(item_name, EMBEDDED_SPEC, 1)
    movable = item_name.isNotNull() & (F.coalesce(spec, F.lit("")) == "") & (found != "")
    return F.struct(
        F.when(movable, F.trim(F.replace(item_name, F.regexp_extract(item_name, EMBEDDED_SPEC, 0), F.lit(""))))
        .otherwise(item_name).alias("item_name"),
        F.when(movable, found).otherwise(spec).alias("spec_model"),
    )


def remove_spec(item_name: Column, spec: Column) -> Column:
    """Drop the spec from a name, whatever its letter case."""
    at = F.instr(F.lower(item_name), F.lower(spec))
    cut = F.concat(
        F.substring(item_name, F.lit(1), at - 1),
        F.substring(item_name, at + F.length(spec), F.length(item_name)),
    )
    return F.when((F.coalesce(spec, F.lit("")) == "") | (at == 0), item_name).otherwise(F.trim(cut))


def full_width_brackets(text: Column) -> Column:
    # Translating goes letter by letter; hardly a text has brackets.
    return F.when(text.contains("(") | text.contains(")"), F.translate(text, "()", "（）")).otherwise(text)


def join_parts(parts: Column) -> Column:
    cleaned = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")
    return F.nullif(F.array_join(cleaned, ""), F.lit(""))
