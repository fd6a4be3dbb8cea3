"""Money, quantities and rates as decimals; all parsing is null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
QUANTITY = "decimal(28,12)"

# The shapes of printed money, numbers and rates.
MONEY_PATTERN = r"(?U)[¥￥]?\s*(-?\d[\d,]*(?:\s*\.\s*\d+)?)"
NUMBER_FULL = r"(?U)^-?\d+(?:\.\d+)?$"
MONEY_FULL = r"(?U)^[¥￥]?-?\d[\d,]*(?:\s*\.\s*\d+)?(?:\s+不征税)?$"
RATE_PATTERN = r"(?U)(\d+(?:\.\d+)?%|不征税|免税|零税率)"
RATE_FULL = r"(?U)^(\d+(?:\.\d+)?%|不征税|免税|零税率)$"
RATE_MARKERS = ("%", "不征税", "免税", "零税率")
NUMBER_CHARS = r"(?U)^[\d.,￥¥\s-]+$"
MONEY_MARKERS = (".", ",", "¥", "￥", "CNY", "YQ")
CHINESE_DIGITS = {
    "零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9,
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
}


def compact_number(text: Column) -> Column:
    return F.translate(F.trim(text), ",￥¥ ", "")


def to_number(text: Column) -> Column:
    """Text to an unscaled quantity; null words, blanks and junk give null."""
    return compact_number(text).try_cast(QUANTITY)


def to_money(text: Column) -> Column:
    """Text to cents, rounded half up."""
    return F.round(to_number(text), 2).try_cast(MONEY)


def money(value: Column) -> Column:
    return value.cast(MONEY)


def format_money(value: Column) -> Column:
    return value.cast(MONEY).cast("string")


def format_decimal(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def decimal_scale(text: Column) -> Column:
    """Digits after the point as printed; 0 for text that is no number."""
    plain = compact_number(text)
    return F.when(
        plain.try_cast(QUANTITY).isNotNull() & plain.contains("."),
        F.length(F.substring_index(plain, ".", -1)),
    ).otherwise(F.lit(0))


def _any_of(text: Column, marks) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | text.contains(mark)
    return hit


def money_matches(text: Column) -> Column:
    """Every money value of a line, printed with two digits, in order."""
    found = F.regexp_extract_all(text, F.lit(MONEY_PATTERN), 1)
    return F.filter(F.transform(found, lambda m: format_money(to_money(m))), lambda m: m.isNotNull())


def money_values(text: Column) -> Column:
    """Like money_matches, but only for lines that carry a money marker."""
    return F.when(_any_of(text, MONEY_MARKERS), money_matches(text)).otherwise(F.array().cast("array<string>"))


def is_number(text: Column) -> Column:
    plain = F.translate(F.trim(text), ",￥¥", "")
    # A text with any other letter is none, and need not be rewritten to see that.
    return text.rlike(NUMBER_CHARS) & F.regexp_replace(plain, r"(?U)\s*\.\s*", ".").rlike(NUMBER_FULL)


def is_money(text: Column) -> Column:
    return F.trim(text).rlike(MONEY_FULL)


def is_rate(text: Column) -> Column:
    return has_rate_mark(text) & F.trim(text).rlike(RATE_FULL)


def has_rate_mark(text: Column) -> Column:
    """Every rate holds one of the marks, and few lines do; the pattern of a rate tries every place of a line."""
    return _any_of(text, RATE_MARKERS)


def has_rate(text: Column) -> Column:
    return has_rate_mark(text) & (F.regexp_extract(text, RATE_PATTERN, 1) != "")


def rate_to_percent(ratio: Column) -> Column:
    """0.13 -> 13%, 0.065 -> 6.5%, 0.1 -> 10%."""
    return F.concat(format_decimal((ratio.cast("decimal(18,9)") * 100).cast(QUANTITY)), F.lit("%"))


def percent_to_ratio(rate: Column) -> Column:
    return (F.translate(F.trim(rate), "%", "").try_cast("decimal(12,6)") / 100).try_cast("decimal(9,6)")


def chinese_yuan(text: Column) -> Column:
    """The single Chinese digit before 元, printed as money."""
    digits = "".join(CHINESE_DIGITS)
    digit = F.regexp_extract(text, f"([{digits}])元", 1)
    arabic = F.translate(digit, digits, "".join(str(v) for v in CHINESE_DIGITS.values()))
    return F.when(digit != "", F.concat(arabic, F.lit(".00")))


def split_price_quantity(suffix: Column, amount: Column) -> Column:
    """Split glued digits into price and quantity so that their product is the amount.

    The shortest quantity of 1 to 6 digits within 0.05 of the amount wins.
    """
    glued = F.trim(suffix)
    length = F.length(glued)

    def cut(n: Column) -> Column:
        price_len = length - n
        return F.struct(
            F.substring(glued, F.lit(1), price_len).alias("price"),
            F.substring(glued, price_len + 1, n).alias("quantity"),
        )

    def fits(part: Column) -> Column:
        price, quantity = to_number(part["price"]), to_number(part["quantity"])
        return (
            part["quantity"].rlike("^[0-9]+$")
            & price.isNotNull()
            & (F.abs(price.cast("decimal(18,6)") * quantity.cast("decimal(18,0)") - amount) <= 0.05)
        )

    cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(6), length - 1)), cut)
    return F.when(length > 1, F.try_element_at(F.filter(cuts, fits), F.lit(1)))
