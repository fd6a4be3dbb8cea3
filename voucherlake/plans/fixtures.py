"""How the TPC-H-like test tables become invoices, lines, spans and texts.

Every mapping covers its whole table. Doubles become decimals once, here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.functions.money import MONEY, QUANTITY

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money_of(name: str):
    return F.col(name).cast(MONEY)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: amount net of discount, tax on it; the printed line number may repeat."""
    item = table(spark, sf_dir, "lineitem")
    amount = F.round(money_of("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY)
    tax = F.round(F.col("line_amount") * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY)
    return (
        item.withColumn("line_amount", amount)
        .withColumn("line_tax_amount", tax)
        .select(
            F.concat(F.lit("unit_"), F.col("l_orderkey")).alias("unit_id"),
            F.col("l_linenumber").alias("line_no"),
            F.concat(F.lit("*商品*"), F.col("l_partkey")).alias("item_name"),
            F.col("l_quantity").cast(QUANTITY).alias("quantity"),
            F.lit(None).cast(QUANTITY).alias("unit_price"),
            "line_amount",
            F.concat((F.col("l_tax").cast("decimal(4,2)") * 100).cast("int").cast("string"), F.lit("%")).alias("tax_rate"),
            "line_tax_amount",
            (F.col("line_amount") + F.col("line_tax_amount")).cast(MONEY).alias("line_total_with_tax"),
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
            "l_shipdate",
        )
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers: total is the order total; net and tax are its 13% split."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    total = money_of("o_totalprice")
    net = F.round(total * 100 / 113, 2).cast(MONEY)
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.concat(F.lit("unit_"), F.col("o_orderkey")).alias("unit_id"),
        F.concat(F.lit("/in/"), F.col("o_orderpriority"), F.lit("/order_"), F.col("o_orderkey"), F.lit(".xml")).alias("source_file"),
        F.lit("standard-invoice").alias("schema_id"),
        F.lit("digital-invoice-form").alias("variant_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("invoice_no"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.col("c_name").alias("buyer_name"),
        F.concat(F.lit("91B"), F.lpad(F.col("o_custkey").cast("string"), 15, "0")).alias("buyer_tax_id"),
        F.concat(F.lit("Seller "), F.col("o_orderpriority")).alias("seller_name"),
        F.concat(F.lit("91S"), F.lpad(F.substring("o_orderpriority", 1, 1), 15, "0")).alias("seller_tax_id"),
        F.lit("电子发票（普通发票）").alias("invoice_type"),
        net.alias("amount_total"),
        (total - net).cast(MONEY).alias("tax_total"),
        total.alias("total_with_tax"),
        F.when(F.col("o_orderstatus") == "P", F.lit("review_required")).otherwise(F.lit("ready")).alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.lit("missing buyer_tax_id; conflict seller_name"))
        .otherwise(F.lit("通过当前字段校验。")).alias("remark"),
        F.lit(0.95).alias("confidence"),
        "o_orderkey", "o_orderstatus", "o_orderpriority",
    )
