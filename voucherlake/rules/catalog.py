"""The shipped document rules.

Fixed values: identifiers, keywords, aliases, patterns, layout numbers and required
fields must stay as printed on the documents. They are plain data in catalogue order;
a document that `extends` another inherits what it does not state itself.
"""

from __future__ import annotations

RECEIPT_CHECKS = [
    "amount_total_plus_tax_total_equals_total_with_tax",
    "line_amount_plus_line_tax_amount_equals_line_total_with_tax",
    "sum_line_amount_equals_amount_total",
    "sum_line_tax_amount_equals_tax_total",
]


def field(aliases=(), required=False) -> dict:
    return {"aliases": list(aliases), "required": required}


def receipt_fields(code, no, date, buyer, buyer_id, seller, seller_id, kind, amount, tax, total) -> dict:
    """The eleven header fields of a receipt, each as (aliases, required)."""
    names = ("invoice_code", "invoice_no", "invoice_date", "buyer_name", "buyer_tax_id", "seller_name",
             "seller_tax_id", "invoice_type", "amount_total", "tax_total", "total_with_tax")
    given = (code, no, date, buyer, buyer_id, seller, seller_id, kind, amount, tax, total)
    return {name: field(*spec) for name, spec in zip(names, given)}


MOTOR_VEHICLE = {
    "schema_id": "motor-vehicle-unified", "name": "数电机动车销售统一发票", "variants": ["digital-motor-vehicle-unified"],
    "match_rules": {"required_all": ["电子发票", "机动车销售统一发票"], "required_any": ["车辆识别代号", "发票号码", "价税合计"],
                    "min_required_any": 1},
    "fields": receipt_fields(
        ((), False), (["发票号码"], True), (["开票日期"], True), (["购买方名称"], True),
        (["统一社会信用代码", "纳税人识别号"], True), (["销货单位名称"], True), (["纳税人识别号"], True),
        (["电子发票（机动车销售统一发票）"], True), (["不含税价"], True), (["增值税税额"], True), (["价税合计"], True)),
    "amount_checks": ["amount_completeness_check", *RECEIPT_CHECKS],
    "line_table": {"required": True},
}

MEDICAL_RECEIPT = {
    "schema_id": "medical-fiscal-receipt", "name": "医疗收费票据", "variants": ["outpatient-medical-fiscal-receipt"],
    "match_rules": {"required_all": ["医疗", "收费票据"], "required_any": ["门诊", "检查费", "治疗费", "收款单位"],
                    "min_required_any": 1},
    "fields": {
        **receipt_fields(
            ((), False), (["票据号码"], False), (["开票日期"], True), (["交款人"], False), ((), False),
            (["收款单位"], True), ((), False), (["收费票据"], True), (["小写"], True), ((), True), (["小写"], True)),
        "item_name": field(["项目名称"]), "line_amount": field(["金额"]), "line_tax_amount": field(),
    },
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "layout_rules": {"simple_items": {
        "total_fallback_y": 520, "min_y": 190, "max_y_before_total": 20, "max_name_x": 780,
        "exclude_terms": ["项目名称", "数量", "单位", "金额", "备注", "合计"]}},
}

AIR_TICKET = {
    "schema_id": "air-ticket-itinerary", "name": "航空运输电子客票行程单",
    "variants": ["digital-air-itinerary", "legacy-air-itinerary"],
    "variant_rules": {
        "digital-air-itinerary": {"keywords": ["民航发展基金", "增值税税额", "电子发票（航空运输电子客票行程单）"]},
        "legacy-air-itinerary": {"keywords": []}},
    "default_variant": "legacy-air-itinerary",
    "match_rules": {"required_all": ["航空运输电子客票行程单"],
                    "required_any": ["电子客票号码", "ITINERARY", "AIR TRANSPORT", "机票"], "min_required_any": 0},
    "fields": receipt_fields(
        ((), False), (["电子客票号码"], True), (["填开日期", "DATE OF ISSUED"], True), (["旅客姓名"], True),
        (["有效身份证件号码"], False), (["承运人"], True), ((), False), (["航空运输电子客票行程单"], True),
        (["合计"], True), ((), True), (["合计"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "layout_rules": {"passenger_name": {"min_len": 1, "max_len": 6, "max_x": 260, "max_y": 180, "exclude_terms": ["旅客"]}},
}

MACHINE_INVOICE = {
    "schema_id": "general-machine-invoice", "name": "通用机打发票", "variants": ["local-general-machine-invoice"],
    "match_rules": {"required_all": ["通用机打发票"], "required_any": ["发票代码", "发票号码", "顾客名称", "开票单位"],
                    "min_required_any": 2},
    "fields": receipt_fields(
        (["发票代码"], True), (["发票号码"], True), (["开票日期"], True), (["顾客名称"], True), (["备注"], False),
        (["开票单位"], True), (["销货方识别号"], False), (["通用机打发票"], True), (["合计"], True), ((), True),
        (["小写"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "layout_rules": {"item_row": {
        "total_fallback_y": 650, "min_y": 300, "max_y_before_total": 30, "max_item_x": 380, "max_item_len": 12,
        "min_amount_delta_x": 300, "unit_min_x": 560, "unit_max_x": 780, "max_unit_len": 3,
        "unit_tokens": ["条", "个", "张", "件", "次", "份", "台", "套", "kg", "KG"]}},
}

TAX_CERTIFICATE = {
    "schema_id": "tax-payment-certificate", "name": "税收完税证明", "variants": ["tax-payment-certificate"],
    "match_rules": {"required_all": ["税收完税证明"], "required_any": ["填发日期", "税务机关", "纳税人识别号", "税种"],
                    "min_required_any": 1},
    "fields": receipt_fields(
        ((), False), (["税收完税证明号"], True), (["填发日期"], True), (["纳税人名称"], True), (["纳税人识别号"], False),
        (["税务机关"], True), ((), False), (["税收完税证明"], True), (["金额合计"], True), ((), True), (["金额合计"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "layout_rules": {
        "taxpayer_name": {"min_y": 190, "max_y": 280, "min_x": 700, "max_x": 900, "min_len": 1, "max_len": 5},
        "simple_items": {"min_y": 300, "max_y": 470, "max_name_x": 700,
                         "exclude_terms": ["原凭证号", "税种", "品目名称", "税款", "入库", "实缴", "退金"]}},
}

ROAD_BUS = {
    "schema_id": "road-bus-ticket", "name": "公路汽车客票", "variants": ["road-bus-ticket"],
    "match_rules": {"required_all": ["公路汽车客票"], "required_any": ["始发地", "票价", "目的地", "乘车日期"],
                    "min_required_any": 2},
    "fields": receipt_fields(
        (["发票代码"], True), (["发票号码"], True), (["乘车日期"], True), ((), False), ((), False), (["承运人"], True),
        ((), False), (["公路汽车客票"], True), (["票价"], True), ((), True), (["票价"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "layout_rules": {
        "seller_tax_id": {"min_y": 250, "max_y": 310, "min_x": 520, "max_x": 800},
        "seller_stamp": {"min_y": 245, "max_y": 335, "min_x": 560, "max_x": 760, "stamp_terms": ["发票专用章"],
                         "origin_company_suffix": "市公路客运有限公司"},
        "origin": {"min_y": 390, "max_y": 470, "min_x": 220, "max_x": 380},
        "destination": {"min_y": 390, "max_y": 470, "min_x": 1000}},
}

RAILWAY = {
    "schema_id": "railway-ticket", "name": "铁路电子客票", "variants": ["railway-electronic-ticket"],
    "match_rules": {"required_all": ["铁路电子客票"], "required_any": ["电子客票号", "发票号码", "退票费", "票价", "乘车"],
                    "min_required_any": 1},
    "fields": receipt_fields(
        ((), False), (["发票号码"], True), (["开票日期"], True), (["购买方名称"], False), (["统一社会信用代码"], False),
        ((), True), ((), False), (["电子发票（铁路电子客票）", "铁路电子客票"], True), (["票价", "退票费"], True),
        ((), True), (["票价", "退票费"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
    "output_defaults": {"seller_name": "中国铁路"},
}

WATER_PASSENGER = {
    "schema_id": "water-passenger-ticket", "name": "水路旅客运输客票", "variants": ["water-passenger-ticket"],
    "match_rules": {"required_all": [], "required_any": ["水路旅客运输客票", "水路客运", "水路旅客", "船票", "乘船日期", "票价"],
                    "min_required_any": 2},
    "fields": receipt_fields(
        (["发票代码"], False), (["发票号码"], True), (["开票日期", "乘船日期"], True), ((), False), ((), False),
        (["承运人", "收款单位", "开票单位"], True), (["统一社会信用代码", "纳税人识别号"], False),
        (["水路旅客运输客票", "水路客运", "船票"], True), (["票价", "金额"], True), ((), True), (["票价", "金额"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
}

TAXI = {
    "schema_id": "taxi-machine-invoice", "name": "出租车机打发票", "variants": ["taxi-machine-invoice"],
    "output_defaults": {"invoice_type": "出租车机打发票"},
    "seller_name_completion": {"plate_city_prefixes": {"皖C": "蚌埠市"}},
    "match_rules": {"required_all": ["机打发票"], "required_any": ["出租", "车号", "里程", "等候"], "min_required_any": 1},
    "fields": receipt_fields(
        (["发票代码"], True), (["发票号码"], True), (["日期"], True), ((), False), ((), False), (["单位"], True),
        ((), False), (["机打发票"], True), (["金额"], True), ((), True), (["金额"], True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
}

METRO_QUOTA = {
    "schema_id": "metro-quota-invoice", "name": "地铁定额发票", "variants": ["metro-quota-invoice"],
    "match_rules": {"required_all": ["地铁", "定额发票"], "required_any": ["发票代码", "发票号码", "伍元"], "min_required_any": 2},
    "fields": receipt_fields(
        (["发票代码"], True), (["发票号码"], True), ((), False), ((), False), ((), False), ((), True),
        (["统一社会信用代码"], False), (["定额发票"], True), ((), True), ((), True), ((), True)),
    "amount_checks": RECEIPT_CHECKS, "line_table": {"required": True},
}

STANDARD = {
    "schema_id": "standard-invoice", "name": "标准发票类", "variants": ["traditional-vat-form", "digital-invoice-form"],
    "validation": {"require_field_evidence": True},
    "match_rules": {"unsupported_current": [], "required_any": ["发票号码", "开票日期", "价税合计", "纳税人识别号"]},
    "variant_rules": {
        "digital-invoice-form": {"keywords": ["电子发票（普通发票）", "电子发票（增值税专用发票）"]},
        "traditional-vat-form": {"keywords": ["发票代码", "机器编号", "校验码"]}},
    "variant_required_fields": {"digital-invoice-form": ["buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id"]},
    "fields": {
        "invoice_code": field(["发票代码"]),
        "invoice_no": field(["发票号码", "发票号码：", "发票号码 :"], True),
        "invoice_date": field(["开票日期"], True),
        "buyer_name": field(["购买方名称", "购买方信息", "购 买 方 信 息", "名称"]),
        "buyer_tax_id": field(["购买方税号", "统一社会信用代码", "纳税人识别号"]),
        "seller_name": field(["销售方名称", "销售方信息", "销 售 方 信 息", "名称"]),
        "seller_tax_id": field(["销售方税号", "统一社会信用代码", "纳税人识别号"]),
        "invoice_type": field(["电子发票", "增值税电子普通发票", "铁路电子客票"]),
        "amount_total": field(["合计", "金额合计", "金额"]),
        "tax_total": field(["税额合计", "税额"]),
        "total_with_tax": field(["价税合计", "小写"], True),
        "item_name": field(["项目名称", "货物或应税劳务、服务名称"]),
        "spec_model": field(["规格型号"]),
        "unit": field(["单位", "单 位"]),
        "quantity": field(["数量", "数 量"]),
        "unit_price": field(["单价", "单 价"]),
        "line_amount": field(["金额"]),
        "tax_rate": field(["税率", "征收率"]),
        "line_tax_amount": field(["税额"]),
        "service_location": field(["服务发生地", "项目地点"]),
        "project_name": field(["建筑项目名称", "工程名称"]),
    },
    "amount_checks": [
        "amount_completeness_check", "amount_total_plus_tax_total_equals_total_with_tax",
        "line_amount_plus_line_tax_amount_equals_line_total_with_tax", "quantity_times_unit_price_equals_line_amount",
        "sum_line_amount_equals_amount_total", "sum_line_tax_amount_equals_tax_total"],
    "line_table": {"required": True, "header_aliases": {
        "item_name": ["项目名称", "货物或应税劳务、服务名称"], "spec_model": ["规格型号"], "unit": ["单位", "单 位"],
        "quantity": ["数量", "数 量"], "unit_price": ["单价", "单 价"], "line_amount": ["金额"],
        "tax_rate": ["税率", "税率/征收率"], "line_tax_amount": ["税额"]}},
    "freight_subtable": {
        "trigger_keywords": ["运输工具种类", "起运地", "到达地"],
        "header_aliases": {
            "transport_vehicle_type": ["运输工具种类"], "transport_vehicle_no": ["运输工具牌号"], "origin_place": ["起运地"],
            "destination_place": ["到达地"], "transport_goods_name": ["运输货物名称"]}},
    "ocr_table": {
        "item_start_max_x": 470, "end_marker_min_x": 1500, "end_marker_min_y_delta": 250, "last_column": "line_tax_amount",
        "column_right_edges": {"item_name": 470, "spec_model": 760, "unit": 1000, "quantity": 1260, "unit_price": 1560,
                               "line_amount": 1850, "tax_rate": 2150}},
    "item_parse_rules": {
        "unit_tokens": ["个", "间", "天", "次", "升", "根", "条", "张", "件", "套", "份", "台", "元", "立方米", "立方米（方）", "立方米(方)"],
        "textual_spec_tokens": ["间", "货车", "客车", "一型货车", "二型货车", "三型货车", "四型货车", "小型车", "大型车"]},
    "traditional_vat_layout": {
        "header": {
            "invoice_code": {"min_x": 180, "max_x": 540, "min_y": 10, "max_y": 40, "pattern": r"(?<!\d)\d{10,12}(?!\d)"},
            "invoice_no": {"min_x": 450, "max_x": 540, "min_y": 33, "max_y": 55, "pattern": r"(?<!\d)\d{8,20}(?!\d)"},
            "invoice_date": {"min_x": 450, "max_x": 560, "min_y": 40, "max_y": 75}},
        "parties": {
            "buyer_name": {"min_x": 90, "max_x": 340, "min_y": 80, "max_y": 115},
            "buyer_tax_id": {"min_x": 90, "max_x": 340, "min_y": 95, "max_y": 125},
            "seller_name": {"min_x": 90, "max_x": 340, "min_y": 290, "max_y": 335},
            "seller_tax_id": {"min_x": 90, "max_x": 340, "min_y": 300, "max_y": 330}},
        "totals": {
            "amount_tax": {"min_x": 390, "max_x": 600, "min_y": 250, "max_y": 275},
            "total_with_tax": {"min_x": 160, "max_x": 600, "min_y": 270, "max_y": 295}},
        "item_area": {"min_y": 158, "max_y": 255}},
    "party_geometry": {"variant_rules": {"digital-invoice-form": {
        "enabled": True, "split_x_ratio": 0.50,
        "name_band": {"min_y": 70, "max_y": 145, "exclude_terms": [
            "纳税人识别号", "电子发票", "发票", "购买方信息", "销售方信息", "购买方", "销售方"]},
        "tax_band": {"min_y": 105, "max_y": 145}}}},
    "text_labels": {
        "buyer_name_labels": ["购买方名称"], "seller_name_labels": ["销售方名称"], "generic_name_label": "名称",
        "ignore_near_name_terms": ["统一社会信用代码", "纳税人识别号", "购", "买", "方", "销", "售", "信", "息", "名称", "密码区",
                                   "购买方", "销售方"],
        "total_line": {"include_all": ["合", "计"], "exclude_any": ["价税合计"]}},
    "invoice_type_context": {
        "title_rules": [
            {"include_all": ["普通发票"], "value": "电子发票（普通发票）", "confidence": 0.98},
            {"include_any": ["增值税专用发票", "专用发票"], "value": "电子发票（增值税专用发票）", "confidence": 0.98}],
        "variant_rules": {"digital-invoice-form": {
            "tax_rate_rules": [{"rate": "13%", "value": "电子发票（增值税专用发票）", "confidence": 0.96}],
            "default": "电子发票（普通发票）", "confidence": 0.96}},
        "tax_rate_rules": [
            {"rate": "13%", "value": "电子发票（增值税专用发票）", "confidence": 0.95},
            {"rate": "1%", "value": "电子发票（普通发票）", "confidence": 0.95},
            {"rate": "6%", "value": "电子发票（普通发票）", "confidence": 0.95}]},
}

BUILDING = {
    "schema_id": "building-service", "name": "建筑服务", "extends": "standard-invoice", "special_invoice_type_value": "建筑服务",
    "match_rules": {"required_exact_lines": ["建筑服务"], "exclude_any": ["建筑材料"]},
    "fields": {"special_invoice_type": {"required": True}, "service_location": {"required": True},
               "project_name": {"required": True}},
}

REFINED_OIL = {
    "schema_id": "refined-oil", "name": "成品油", "extends": "standard-invoice", "special_invoice_type_value": "成品油",
    "match_rules": {"required_exact_lines": ["成品油"]},
    "fields": {"special_invoice_type": {"required": True}, "item_name": {"required": True}, "unit": {"required": True},
               "quantity": {"required": True}},
}

FREIGHT = {
    "schema_id": "freight-transport-service", "name": "货物运输服务", "extends": "standard-invoice",
    "special_invoice_type_value": "货物运输服务",
    "match_rules": {"required_all": ["货物运输服务", "运输工具种类", "起运地", "到达地"], "exclude_any": ["收派服务"]},
    "fields": {name: {"required": True} for name in (
        "transport_vehicle_type", "transport_vehicle_no", "origin_place", "destination_place", "transport_goods_name")},
}

REAL_ESTATE = {
    "schema_id": "real-estate-operating-lease", "name": "不动产经营租赁服务", "extends": "standard-invoice",
    "special_invoice_type_value": "不动产经营租赁服务",
    "match_rules": {"required_exact_lines": ["不动产经营租赁服务"]},
    "fields": {name: {"required": True} for name in (
        "property_certificate_no", "area_unit", "real_estate_address", "lease_start_date", "lease_end_date", "cross_city_flag")},
    "line_table": {"header_aliases": {
        "property_certificate_no": ["产权证书/不动产权证号", "不动产权证号"], "area_unit": ["面积单位"]}},
    "item_context_patterns": {
        "property_certificate_no": {"patterns": [r"\*[^*\n]+\*[^\n]*\n\s*([^\s;；]+)"]},
        "area_unit": {"patterns": [r"\*[^*\n]+\*[^\n]*\n\s*[^\s;；]+\n\s*([^\s;；]+)"]},
        "real_estate_address": {"patterns": [r"不动产地址\s*[:：]\s*([^;；\n]+)"]},
        "lease_start_date": {"patterns": [r"租赁期起止\s*[:：]\s*(\d{4}-\d{1,2}-\d{1,2})"]},
        "lease_end_date": {"patterns": [r"租赁期起止\s*[:：]\s*\d{4}-\d{1,2}-\d{1,2}.*?(\d{4}-\d{1,2}-\d{1,2})"]},
        "cross_city_flag": {"patterns": [r"跨地（市）标志\s*[:：]\s*([^;；\s]+)"]}},
}

PASSENGER = {
    "schema_id": "passenger-transport-service", "name": "旅客运输服务", "extends": "standard-invoice",
    "special_invoice_type_value": "旅客运输服务",
    "match_rules": {"required_exact_lines": ["旅客运输服务"]},
    "fields": {name: {"required": False} for name in (
        "traveler_name", "traveler_id", "travel_date", "departure_place", "arrival_place", "travel_class", "transport_type")},
    "line_table": {"header_aliases": {
        "traveler_name": ["出行人"], "traveler_id": ["有效身份证件号"], "travel_date": ["出行日期"], "departure_place": ["出发地"],
        "arrival_place": ["到达地"], "travel_class": ["等级"], "transport_type": ["交通工具类型"]}},
}

PLATE = r"[一-鿿][A-Z]·?[A-Z0-9]{5,6}"

TOLL = {
    "schema_id": "toll-invoice", "name": "通行费", "extends": "standard-invoice", "special_invoice_type_value": "通行费",
    "variants": ["征税通行费", "不征税通行费"], "default_variant": "征税通行费",
    "variant_rules": {"不征税通行费": {"keywords": ["不征税"]}},
    "variant_required_fields": {"征税通行费": ["toll_variant", "vehicle_plate_no", "toll_entrance", "toll_exit", "passage_time"]},
    "match_rules": {"required_all": ["通行费", "站入", "站出"]},
    "fields": {name: {"required": False} for name in (
        "toll_variant", "vehicle_plate_no", "toll_entrance", "toll_exit", "passage_time")},
    "item_context_patterns": {
        "toll_variant": {"patterns": [{"pattern": r"\d+(?:\.\d+)?%", "value": "征税"}, {"pattern": "不征税", "value": "不征税通行费"}]},
        "vehicle_plate_no": {"patterns": [rf"(?:车牌号码|车牌号)[：:]?\s*({PLATE})", rf"({PLATE})\s+.+?站入"]},
        "toll_entrance": {"patterns": [r"(?:入口站?|驶入站)[：:]?\s*([^\s]+)", rf"{PLATE}\s+(.+?站)入"]},
        "toll_exit": {"patterns": [r"(?:出口站?|驶出站)[：:]?\s*([^\s]+)", r"站入\s+(.+?站)出"]},
        "passage_time": {"patterns": [
            r"(?:通行时间|通行日期)[：:]?\s*(\d{4}(?:年\d{1,2}月\d{1,2}日?|[-/]\d{1,2}[-/]\d{1,2})(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?)",
            r"站出\s+(\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}:\d{2})"]}},
    "unverified_variants": [],
}

# Catalogue order decides ties; the standard document is the fallback and comes last.
CATALOG = [
    MOTOR_VEHICLE, MEDICAL_RECEIPT, AIR_TICKET, MACHINE_INVOICE, TAX_CERTIFICATE, ROAD_BUS, RAILWAY, WATER_PASSENGER,
    TAXI, METRO_QUOTA, BUILDING, REFINED_OIL, FREIGHT, REAL_ESTATE, PASSENGER, TOLL, STANDARD,
]

BASE_VARIANTS = ("digital-invoice-form", "traditional-vat-form")

VAT_RULES = [
    {"rule_id": "legacy_air_ticket_itinerary_9pct", "schema_ids": ["air-ticket-itinerary"],
     "variant_ids": ["legacy-air-itinerary"], "method": "split_tax_inclusive_components", "rate": "9%",
     "taxable_item_names": ["票价", "燃油附加费"], "non_taxable_item_names": ["机场建设费", "保险费"]},
    {"rule_id": "road_water_passenger_ticket_3pct", "schema_ids": ["road-bus-ticket", "water-passenger-ticket"],
     "method": "split_tax_inclusive_total", "rate": "3%"},
    {"rule_id": "railway_passenger_ticket_9pct", "schema_ids": ["railway-ticket"],
     "method": "split_tax_inclusive_total", "rate": "9%"},
]
