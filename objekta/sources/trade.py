"""The object schema over the trade, event and text tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from objekta.model import ClassDef, Schema, collection, inverse, link, literal, reference, scalar
from objekta.sources.catalog import Catalog

EVENT_KINDS = ("view", "signup", "purchase", "error", "click")

SCHEMA = Schema.of(
    ClassDef("Region", (scalar("regionkey", "r_regionkey", unique=True), scalar("name", "r_name"), inverse("nations", "Nation", "region")), "region", "regionkey"),
    ClassDef(
        "Nation",
        (scalar("nationkey", "n_nationkey", unique=True), scalar("name", "n_name"), reference("region", "Region", "n_regionkey"), inverse("customers", "Customer", "nation"), inverse("suppliers", "Supplier", "nation")),
        "nation", "nationkey",
    ),
    ClassDef(
        "Customer",
        (scalar("custkey", "c_custkey", unique=True), scalar("name", "c_name", not_null=True), scalar("acctbal", "c_acctbal"), scalar("mktsegment", "c_mktsegment"), reference("nation", "Nation", "c_nationkey"), inverse("orders", "Order", "customer", least=1)),
        "customer", "custkey",
    ),
    ClassDef("Supplier", (scalar("suppkey", "s_suppkey", unique=True), scalar("name", "s_name"), scalar("acctbal", "s_acctbal"), reference("nation", "Nation", "s_nationkey"), inverse("lines", "Lineitem", "supplier")), "supplier", "suppkey"),
    ClassDef(
        "Part",
        (scalar("partkey", "p_partkey", unique=True), scalar("name", "p_name"), scalar("brand", "p_brand"), scalar("type", "p_type"), scalar("size", "p_size"), scalar("retailprice", "p_retailprice"), inverse("lines", "Lineitem", "part"), link("suppliers", "Supplier", "Lineitem", "part", "supplier")),
        "part", "partkey",
    ),
    ClassDef(
        "Order",
        (scalar("orderkey", "o_orderkey", unique=True), scalar("orderstatus", "o_orderstatus"), scalar("totalprice", "o_totalprice"), scalar("orderdate", "o_orderdate"), scalar("orderpriority", "o_orderpriority"), reference("customer", "Customer", "o_custkey"), inverse("lines", "Lineitem", "order")),
        "orders", "orderkey",
    ),
    ClassDef(
        "Lineitem",
        (
            scalar("linenumber", "l_linenumber"), scalar("quantity", "l_quantity"), scalar("extendedprice", "l_extendedprice"), scalar("discount", "l_discount"), scalar("tax", "l_tax"), scalar("returnflag", "l_returnflag"),
            scalar("linestatus", "l_linestatus"), scalar("shipdate", "l_shipdate"), reference("order", "Order", "l_orderkey"), reference("part", "Part", "l_partkey"), reference("supplier", "Supplier", "l_suppkey"),
        ),
        "lineitem", "",
    ),
    ClassDef("Event", (scalar("event_id", unique=True), scalar("ts"), scalar("user_id"), scalar("event_type"), literal("props", "props")), "events", "event_id"),
    *[ClassDef(k.capitalize(), (scalar("value"),), extends="Event", where=f"event_type = '{k}'") for k in EVENT_KINDS],
    ClassDef("Document", (scalar("doc_id", unique=True), scalar("text"), scalar("lang"), scalar("source"), scalar("n_chars"), inverse("labels", "Label", "document", most=1)), "documents", "doc_id"),
    ClassDef("Label", (reference("document", "Document", "doc_id"), scalar("quality"), scalar("toxic")), "labels", "document"),
    ClassDef("Turn", (scalar("conv_id"), scalar("turn"), scalar("role"), scalar("text")), "conversations", ""),
    ClassDef("Embedding", (scalar("vec_id", unique=True), collection("array", "embedding"), scalar("label")), "embeddings", "vec_id"),
    enums={"EventKind": {k.upper(): i for i, k in enumerate(EVENT_KINDS)}},
)


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """props, JSON text in the files, is an embedded struct here."""

    def read(table: str):
        rows = spark.read.parquet(f"{folder}/{table}.parquet")
        return rows.withColumn("props", F.from_json("props", "k long")) if table == "events" else rows

    return Catalog(spark, SCHEMA, read)
