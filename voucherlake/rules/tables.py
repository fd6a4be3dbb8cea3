"""Rule documents: inheritance for building expressions, and as tables for any number of documents.

A rule set is configuration: a few dozen small documents. `resolve` merges them in plain
Python, because the keywords become literals of the plan. `effective_rules` does the same
merge for rule tables of any size with joins.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voucherlake.rules.catalog import CATALOG
from voucherlake.session import staged

RULE_SCHEMA = "schema_id string, extends string, path string, value string, field_pos int"


def merge(parent: dict, child: dict) -> dict:
    """Child over parent: mappings merge, anything else is replaced."""
    merged = dict(parent)
    for key, value in child.items():
        both = isinstance(merged.get(key), dict) and isinstance(value, dict)
        merged[key] = merge(merged[key], value) if both else value
    return merged


def resolve(documents: list[dict]) -> list[dict]:
    """Documents with everything they inherit; a cycle raises with the full chain."""
    by_id = {d["schema_id"]: d for d in documents}

    def full(schema_id: str, chain: tuple[str, ...]) -> dict:
        if schema_id in chain:
            raise ValueError("rule documents inherit in a cycle: " + " -> ".join((*chain, schema_id)))
        document = by_id[schema_id]
        parent = document.get("extends")
        return merge(full(parent, (*chain, schema_id)), document) if parent else dict(document)

    return [full(d["schema_id"], ()) for d in documents]


def shipped() -> dict[str, dict]:
    """The shipped rules by schema id, in catalogue order."""
    return {d["schema_id"]: d for d in resolve(CATALOG)}


def read_documents(folder: str) -> list[dict]:
    """Rule documents of a folder, JSON or (where a parser is installed) YAML, by file name."""
    documents = []
    for path in sorted(Path(folder).iterdir()):
        if path.suffix == ".json":
            documents.append(json.loads(path.read_text(encoding="utf-8")))
        elif path.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as error:
                raise ValueError(f"no YAML parser is installed to read {path.name}; use JSON") from error
            documents.append(yaml.safe_load(path.read_text(encoding="utf-8")))
    return documents


def flatten(document: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value) of every leaf; a list is one leaf, since it is replaced as a whole."""
    rows: list[tuple[str, str]] = []
    for key, value in document.items():
        path = f"{prefix}{key}"
        if isinstance(value, dict):
            rows.extend(flatten(value, f"{path}."))
        else:
            rows.append((path, json.dumps(value, ensure_ascii=False)))
    return rows


def rule_rows(spark: SparkSession, documents: list[dict]) -> DataFrame:
    rows = [
        (d["schema_id"], d.get("extends"), path, value, pos)
        for d in documents for pos, (path, value) in enumerate(flatten(d)) if path != "extends"
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def inheritance_closure(rules: DataFrame) -> DataFrame:
    """(schema_id, ancestor, depth, chain) over all generations; a cycle ends its chain.

    Each generation is one equi-join on the parent id over distinct (document, parent) pairs, far fewer than rules,
    and is written before the next, until no document has a further ancestor.
    """
    parents = staged(rules.select("schema_id", "extends").distinct(), "parents")
    current = parents.select("schema_id", F.col("schema_id").alias("ancestor"), F.col("extends").alias("_next"),
                             F.lit(0).alias("depth"), F.array("schema_id").alias("chain"))
    closure = current
    links = parents.select(F.col("schema_id").alias("_parent"), F.col("extends").alias("_grand"))
    while True:
        current = staged(current.filter("_next is not null and not array_contains(slice(chain, 1, size(chain) - 1), ancestor)").join(
            links, F.col("_next") == F.col("_parent")).select(
            "schema_id", F.col("_parent").alias("ancestor"), F.col("_grand").alias("_next"),
            (F.col("depth") + 1).alias("depth"), F.concat("chain", F.array("_parent")).alias("chain")), "generation")
        if not current.take(1):
            break
        closure = closure.unionByName(current)
    return closure.drop("_next")


def cycles(closure: DataFrame) -> DataFrame:
    """Chains that come back to a document already in them."""
    earlier = F.slice("chain", F.lit(1), F.size("chain") - 1)
    return closure.filter(F.array_contains(earlier, F.col("ancestor"))).select(
        "schema_id", F.array_join("chain", " -> ").alias("chain"))


def effective_rules(rules: DataFrame) -> DataFrame:
    """(schema_id, path, value, depth): every path from the nearest document that states it; a cycle raises."""
    closure = inheritance_closure(rules)
    looped = cycles(closure).first()
    if looped:
        raise ValueError(f"rule documents inherit in a cycle: {looped.chain}")
    closure = closure.select("schema_id", "ancestor", "depth")
    own = rules.select(F.col("schema_id").alias("ancestor"), "path", "value")
    inherited = closure.join(own, "ancestor")
    nearest = F.row_number().over(Window.partitionBy("schema_id", "path").orderBy("depth"))
    return inherited.withColumn("_rank", nearest).filter("_rank = 1").select("schema_id", "path", "value", "depth")


def required_fields(rules: dict[str, dict]) -> dict[tuple[str, str | None], list[str]]:
    """Required fields per (schema, variant), for checks.required_list."""
    required: dict[tuple[str, str | None], list[str]] = {}
    for schema_id, rule in rules.items():
        base = [name for name, spec in rule.get("fields", {}).items() if spec.get("required")]
        extra = rule.get("variant_required_fields", {})
        required[(schema_id, None)] = list(base)
        for variant, names in extra.items():
            required[(schema_id, variant)] = list(dict.fromkeys([*base, *names]))
    # A standard invoice of unknown form is held to the digital form.
    if ("standard-invoice", "digital-invoice-form") in required and "standard-invoice" in rules:
        base = required[("standard-invoice", None)]
        required[("standard-invoice", "traditional-vat-form")] = list(base)
        required[("standard-invoice", None)] = required[("standard-invoice", "digital-invoice-form")]
    return required


def required_number(section: dict, name: str) -> float:
    """A layout setting that must be there and must be a number."""
    if name not in section:
        raise ValueError(f"layout setting {name} is missing")
    try:
        return float(section[name])
    except (TypeError, ValueError) as error:
        raise ValueError(f"layout setting {name} is not a number") from error


def aliases(rule: dict, name: str) -> list[str]:
    return list(rule.get("fields", {}).get(name, {}).get("aliases", []))
