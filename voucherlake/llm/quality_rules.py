"""Quality rules as a short-circuit cascade: what a rule costs and rejects is estimated on a sample, then rules are put in order.

The measures that rules share (words, symbols, repeated lines and windows) are computed once for every document. Each rule is an
expression over them or over the text, and they stand in one CASE: a document that one rejects is not shown to the next.
At every place of the order stands the rule that rejects most of the sample's remaining documents per second. The
order changes the time only, never a verdict. Everything is a DataFrame expression: no Python runs on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged

#: Documents that costs and rejections are estimated on (a Bernoulli sample of so many expected rows), and the runs timed.
SAMPLE_DOCS, RUNS = 2_000, 2
#: A document with fewer words, or with more per cent of its words in repeated windows of so many words, fails from the start.
MIN_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

Rule = Callable[[Callable[[str], Column]], Column]


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _share_of_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern))) / F.greatest(F.size(lines), F.lit(1))


#: Name -> expression that is true for a document to reject; its argument gives a column of measured() by name.
RULES: Mapping[str, Rule] = {
    "word_length": lambda c: ~(c("word_chars") / c("n_words")).between(2.5, 15),
    "symbols": lambda c: c("n_symbols") * 10 > c("n_words"),
    "repeated_lines": lambda c: c("n_dup_lines") * 2 > F.size(c("lines")),
    "letters": lambda c: _size_without(c("text"), r"\P{L}+") * 10 < c("word_chars") * 7,
    "capitals": lambda c: _size_without(c("text"), r"\P{Lu}+") * 10 > c("word_chars") * 4,
    "cut_lines": lambda c: _share_of_lines(c("lines"), r"(\.\.\.|…)[\x20\x09-\x0D]*\z") > 0.3,
    "bullets": lambda c: _share_of_lines(c("lines"), r"^[\x20\x09]*[-*•‣●]") > 0.9,
    "broken_signs": lambda c: (F.length(c("text")) - _size_without(c("text"), r"[\x00-\x08\x0E-\x1F\x{FFFD}]+")) * 100 > c("word_chars"),
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(value: Column) -> Column:
    """value, computed at this place: a filter or projection above reads it instead of repeating the expression."""
    return F.explode(F.array(value))


def _repeated_words(words: Column, windows: Column, starts: Column) -> tuple[Column, Column, Column]:
    """The steps to the words in windows found twice: windows by hash, first words of repeated ones, words they cover."""
    ahead = [F.lit(k) for k in range(1, WINDOW)]
    firsts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashed = F.sort_array(
        F.transform(firsts, lambda w, i: F.struct(F.xxhash64(w, *[F.get(words, i + k) for k in ahead]).alias("h"), i.alias("i")))
    )
    twice = F.filter(windows, lambda x, i: (x["h"] == F.get(windows, i - 1)["h"]) | (x["h"] == F.get(windows, i + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    gaps = F.transform(starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return hashed, places, F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; lines: those with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashed, places, covered = _repeated_words(F.col("words"), F.col("windows"), F.col("starts"))
    own = ["doc_id", "text", "lines", "n_words", "word_chars", "n_symbols"]
    cut = docs.select("doc_id", text.alias("text"))
    cut = cut.select("doc_id", "text", _once(F.array_remove(F.split("text", SPACES), "")).alias("words"))
    cut = cut.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - _size_without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _once(hashed).alias("windows"),
    )
    cut = cut.select(*own, _once(places).alias("starts"))
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    told = _once(F.struct("lines", "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), covered.alias("n_repeat_words")))
    return cut.select("doc_id", "text", told.alias("m")).select("doc_id", "text", "m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def ordered(sample: DataFrame, rules: Mapping[str, Rule]) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected of what the rules before leave) in the order to apply them.

    sample: rows of measured(). At each place stands the rule with the most rejections per second among the documents that
    those before it leave. Rules that reject none of them come last, the cheapest first.
    """
    names = list(rules)

    def seconds(condition: Column) -> float:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    bits = F.concat(*[F.when(rules[name](F.col), "1").otherwise("0") for name in names]) if names else F.lit("")
    # one row per distinct combination of verdicts: the sample's rows at most
    left = {r["bits"]: r["count"] for r in sample.groupBy(bits.alias("bits")).count().collect()}
    rows = max(1, sum(left.values()))
    idle = seconds(F.col("n_words") >= 0)
    cost = {name: max(seconds(rules[name](F.col)) - idle, 1e-4) / rows for name in names}
    order = []
    while len(order) < len(names):
        remaining = max(1, sum(left.values()))
        rejects = {name: sum(n for b, n in left.items() if b[i] == "1") for i, name in enumerate(names) if name not in [o[0] for o in order]}
        best = max(rejects, key=lambda name: (rejects[name] / cost[name], -cost[name]))
        order.append((best, cost[best], rejects[best] / remaining))
        left = {b: n for b, n in left.items() if b[names.index(best)] != "1"}
    return order


def estimate(docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, float, float]]:
    """ordered() for docs, on a sample of `sample_docs` expected rows of those that the base limits leave."""
    total = docs.count()
    sample = docs.select("doc_id", "text").sample(min(1.0, sample_docs / max(1, total)), seed=13)
    return ordered(staged(measured(sample).where(~base_failed()), "rules"), rules)


def verdict(order: list[str], rules: Mapping[str, Rule] = RULES) -> Column:
    """True for a document that no rule rejects: one CASE, whose later rules are reached by what the earlier ones leave."""
    kept = F.when(base_failed(), False)
    for name in order:
        kept = kept.when(rules[name](F.col), False)
    return kept.otherwise(True)


def judge(docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of docs (doc_id, text).

    Words are runs of characters other than ASCII space. word_chars: code points in words; n_symbols: characters of SYMBOLS;
    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words inside windows of three words that the text
    holds twice or more. base_failed: under 50 words, or over half of them repeated; kept: neither that nor rejected by a rule.
    A null, empty or blank text has no words and fails. Equal texts have equal rows. Rows keep their count; doc_id may be null
    or repeat; other columns are not read. Windows are compared by a 64-bit hash inside one text. An empty table gives no rows.
    """
    order = [name for name, _, _ in estimate(docs, rules, sample_docs)]
    return measured(docs).select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(order, rules).alias("kept"))


def keep_good(docs: DataFrame, rules: Mapping[str, Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text) of the rows that the cascade keeps, whole texts."""
    order = [name for name, _, _ in estimate(docs, rules, sample_docs)]
    return measured(docs).where(verdict(order, rules)).select("doc_id", "text")
