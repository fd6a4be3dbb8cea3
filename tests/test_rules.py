import json

import pytest
from pyspark.sql import functions as F

from voucherlake.operators import routing
from voucherlake.rules import tables


def test_children_inherit_and_override():
    rules = tables.shipped()
    oil = rules["refined-oil"]
    assert oil["validation"]["require_field_evidence"] is True
    assert oil["match_rules"]["required_exact_lines"] == ["成品油"]
    assert oil["match_rules"]["required_any"] == rules["standard-invoice"]["match_rules"]["required_any"]
    assert rules["toll-invoice"]["variants"] == ["征税通行费", "不征税通行费"]


def test_cycles_raise_with_the_chain():
    documents = [{"schema_id": "a", "extends": "b"}, {"schema_id": "b", "extends": "a"}]
    with pytest.raises(ValueError, match="a -> b -> a"):
        tables.resolve(documents)


def test_documents_are_read_from_a_folder(tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"schema_id": "x", "fields": {"invoice_no": {"required": True}}}))
    documents = tables.read_documents(str(tmp_path))
    assert tables.required_fields({d["schema_id"]: d for d in documents})[("x", None)] == ["invoice_no"]


def test_rule_tables_agree_with_the_merge(spark):
    from voucherlake.rules.catalog import CATALOG

    rows = tables.effective_rules(tables.rule_rows(spark, CATALOG)).filter("schema_id = 'toll-invoice'")
    got = {r.path: json.loads(r.value) for r in rows.collect()}
    merged = {p: json.loads(v) for p, v in tables.flatten(tables.shipped()["toll-invoice"]) if p != "extends"}
    assert got == merged


def test_layout_numbers_must_be_there():
    with pytest.raises(ValueError, match="missing"):
        tables.required_number({}, "min_y")
    with pytest.raises(ValueError, match="not a number"):
        tables.required_number({"min_y": "x"}, "min_y")


def test_routes_and_look_alikes(spark):
    heads = ["电子发票（普通发票）", "发票号码：1", "开票日期", "价税合计"]
    cases = {
        "oil": (heads + ["成品油"], "refined-oil"),
        "oil_name": (heads + ["*成品油配送服务*费"], "standard-invoice"),
        "building": (heads + ["建筑服务"], "building-service"),
        "material": (heads + ["建筑服务", "建筑材料"], "standard-invoice"),
        "freight": (heads + ["货物运输服务", "运输工具种类", "起运地", "到达地"], "freight-transport-service"),
        "parcel": (heads + ["货物运输服务", "运输工具种类", "起运地", "到达地", "收派服务"], "standard-invoice"),
        "narrow": (["电子发票(普通发票)", "发票号码:1", "开票日期"], "standard-invoice"),
        "nothing": (["价税合计"], None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "unit_id string, lines array<string>")
    got = {r.unit_id: r for r in routing.route(df).collect()}
    assert {k: r.schema_id for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got["narrow"].variant_id == "digital-invoice-form"
    spans = df.select("unit_id", F.explode("lines").alias("text"))
    by_span = {r.unit_id: r.schema_id for r in routing.route_spans(spans).collect()}
    assert by_span == {k: v[1] for k, v in cases.items()}
