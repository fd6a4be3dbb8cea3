"""Which document type is this? Keyword scores over whole texts, decided in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions.text import nfkc
from voucherlake.rules.catalog import BASE_VARIANTS
from voucherlake.rules.tables import shipped
from unicodedata import normalize

FALLBACK = "standard-invoice"
Test = Callable[[str], Column]


def _term(term: object) -> str:
    return normalize("NFKC", str(term))


def _count(hit: Test, terms) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.when(hit(_term(term)), F.lit(1)).otherwise(F.lit(0))
    return total


def _all(hit: Test, terms) -> Column:
    test = F.lit(True)
    for term in terms:
        test = test & hit(_term(term))
    return test


def _any(hit: Test, terms) -> Column:
    test = F.lit(False)
    for term in terms:
        test = test | hit(_term(term))
    return test


def _unverified(rule: dict, hit: Test) -> list[tuple[str, list[str], Column]]:
    found = []
    for variant in rule.get("unverified_variants", []):
        terms = rule.get("unverified_variant_rules", {}).get(variant, {}).get("required_all", [])
        if terms:
            found.append((variant, terms, _all(hit, terms)))
    return found


def match_score(rule: dict, hit: Test, exact: Test) -> Column:
    """Score of one rule: 0 unless every condition holds, else the number of matched terms."""
    match = rule.get("match_rules", {})
    required_all = match.get("required_all", [])
    exact_lines = match.get("required_exact_lines", [])
    required_any = match.get("required_any", [])
    least = int(match.get("min_required_any", 1 if required_any else 0))
    gate = _all(hit, required_all) & _all(exact, exact_lines) & ~_any(hit, match.get("exclude_any", []))
    fixed = len(required_all) + len(exact_lines)
    # The gate fails for almost every document, so the counted terms are rarely looked at.
    any_score = _count(hit, required_any)
    score = F.when(~gate, F.lit(0)).when(any_score < least, F.lit(0)).otherwise(any_score + fixed)
    for _variant, terms, test in reversed(_unverified(rule, hit)):
        score = F.when(test, F.lit(len(terms))).otherwise(score)
    return score


def variant_of(rule: dict, hit: Test) -> Column:
    """Variant in order: unverified, own keyword variants, the default, base keyword variants, a sole variant."""
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for variant, _terms, test in _unverified(rule, hit):
        choice = choice.when(test, F.lit(variant))
    keyword_rules = rule.get("variant_rules", {})
    for variant, spec in keyword_rules.items():
        if variant not in BASE_VARIANTS:
            choice = choice.when(_any(hit, spec.get("keywords", [])), F.lit(variant))
    if rule.get("default_variant"):
        return choice.otherwise(F.lit(rule["default_variant"]))
    for variant, spec in keyword_rules.items():
        choice = choice.when(_any(hit, spec.get("keywords", [])), F.lit(variant))
    variants = rule.get("variants", [])
    return choice.otherwise(F.lit(variants[0] if len(variants) == 1 else None).cast("string"))


def _decide(df: DataFrame, rules: dict[str, dict], hit: Test, exact: Test, fallback: str | None) -> DataFrame:
    names = [s for s in rules if s != fallback]
    no_match = F.struct(F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit(None).cast("string").alias("schema_id"))
    scored = F.array(no_match, *[
        F.struct(match_score(rules[s], hit, exact).alias("score"), F.lit(-pos).alias("order"), F.lit(s).alias("schema_id"))
        for pos, s in enumerate(names)])
    decided = df.withColumn("_best", F.array_max(scored))
    matched = F.col("_best.score") > 0
    schema = F.when(matched, F.col("_best.schema_id"))
    confidence = F.when(matched, F.least(F.lit(0.99), F.lit(0.55) + F.col("_best.score") * 0.08))
    reason = F.when(matched, F.lit("匹配票面结构关键词。"))
    refused = F.lit(False)
    if fallback:
        match = rules[fallback].get("match_rules", {})
        decided = decided.withColumn("_signals", F.when(~matched, _count(hit, match.get("required_any", []))))
        for spec in match.get("unsupported_current", []):
            refused = refused | hit(_term(spec["keyword"]))
        standard = ~matched & ~refused & (F.col("_signals") >= 2)
        schema = schema.when(standard, F.lit(fallback))
        confidence = confidence.when(standard, F.least(F.lit(0.99), F.lit(0.45) + F.col("_signals") * 0.12))
        reason = reason.when(standard, F.lit("匹配标准发票结构关键词。"))
    confidence = confidence.when(refused, F.lit(0.8)).otherwise(F.lit(0.0))
    reason = reason.when(refused, F.lit("当前票种未建模。")).otherwise(F.lit("未匹配标准发票类关键结构。"))
    variant = F.when(F.lit(False), F.lit(None).cast("string"))
    decided = decided.withColumn("schema_id", schema)
    for name, rule in rules.items():
        variant = variant.when(F.col("schema_id") == name, variant_of(rule, hit))
    return (
        decided.withColumn("variant_id", variant)
        .withColumn("route_confidence", confidence)
        .withColumn("decision", F.when(F.col("schema_id").isNotNull(), F.lit("matched")).otherwise(F.lit("unmodeled")))
        .withColumn("route_reason", reason)
        .drop("_best", *(["_signals"] if fallback else []))
    )


def route(docs: DataFrame, rules: dict[str, dict] | None = None, fallback: str | None = FALLBACK) -> DataFrame:
    """Decide every document of a table with `lines array<string>`; no shuffle, no join.

    Adds schema_id, variant_id, route_confidence, decision and route_reason. Ties go to
    the earlier rule. The whole text is looked at.
    """
    rules = rules or shipped()
    text = docs.withColumn("_text", nfkc(F.array_join("lines", "\n")))
    text = text.withColumn("_exact", F.transform(F.split("_text", "\n"), lambda x: F.trim(x)))
    decided = _decide(text, rules, lambda t: F.col("_text").contains(t), lambda t: F.array_contains("_exact", t), fallback)
    return decided.drop("_text", "_exact")


def route_spans(units: DataFrame, rules: dict[str, dict] | None = None, fallback: str | None = FALLBACK) -> DataFrame:
    """The same decision for a table of text spans, one row per unit.

    Every span gives the set of terms it holds; the sets are merged by a partial aggregate,
    so a unit of any size sends one small set per task.
    """
    rules = rules or shipped()
    contained, whole = _vocabulary(rules)
    text = nfkc(F.col("text"))
    spans = units.select("unit_id", text.alias("_text"))
    flags = [F.max(F.col("_text").contains(t)).alias(f"_t{i}") for i, t in enumerate(contained)]
    flags += [F.max(F.trim("_text") == t).alias(f"_e{i}") for i, t in enumerate(whole)]
    found = spans.groupBy("unit_id").agg(*flags)
    decided = _decide(
        found, rules, lambda t: F.col(f"_t{contained.index(t)}"), lambda t: F.col(f"_e{whole.index(t)}"), fallback)
    return decided.select("unit_id", "schema_id", "variant_id", "route_confidence", "decision", "route_reason")


def _vocabulary(rules: dict[str, dict]) -> tuple[list[str], list[str]]:
    contained: dict[str, None] = {}
    whole: dict[str, None] = {}
    for rule in rules.values():
        match = rule.get("match_rules", {})
        for key in ("required_all", "required_any", "exclude_any"):
            contained.update((_term(t), None) for t in match.get(key, []))
        contained.update((_term(s["keyword"]), None) for s in match.get("unsupported_current", []))
        whole.update((_term(t), None) for t in match.get("required_exact_lines", []))
        for spec in rule.get("variant_rules", {}).values():
            contained.update((_term(t), None) for t in spec.get("keywords", []))
        for spec in rule.get("unverified_variant_rules", {}).values():
            contained.update((_term(t), None) for t in spec.get("required_all", []))
    return list(contained), list(whole)


def hit_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(unit_id, terms): which of the terms each document holds, by plain containment."""
    folded = docs.withColumn("_text", nfkc(F.array_join("lines", "\n")))
    pairs = F.array(*[F.when(F.col("_text").contains(_term(t)), F.lit(t)) for t in terms])
    return folded.select("unit_id", F.filter(pairs, lambda t: t.isNotNull()).alias("terms"))
