"""Scans, query blocks, joins, changes and checks over the trade schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from objekta.model import Schema
from objekta.operators import changes, integrity, ordering, sets
from objekta.operators import predicates as P
from objekta.operators.query import From, column, matching
from objekta.plans.registry import query
from objekta.sources.catalog import Catalog, across, scratch_path
from objekta.sources.trade import SCHEMA, catalog

# Scans and sources


@query("SELECT c_custkey AS id, c_name AS n FROM customer")
def extent_scan(spark, d):
    return From(catalog(spark, d), c="Customer").select(id="c.custkey", n="c.name")


@query("SELECT event_id, event_type, value FROM events")
def deep_extent(spark, d):
    return From(catalog(spark, d), e="Event").select("e.event_id", "e.event_type", "e.value")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def subclass_extent(spark, d):
    return From(catalog(spark, d), e="Purchase").select("e.event_id", "e.value")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'signup', 'purchase', 'error', 'click')")
def shallow_extent(spark, d):
    return From(catalog(spark, d), ("e",), e="Event").select("e.event_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'error')")
def shallow_extent_of_some(spark, d):
    """Of a schema in which only two kinds of events are classes of their own."""
    cat = catalog(spark, d)
    some = Schema.of(SCHEMA["Event"], SCHEMA["Purchase"], SCHEMA["Error"])
    return From(Catalog(spark, some, cat.read), ("e",), e="Event").select("e.event_id")


@query("SELECT upper(event_type[1]) || event_type[2:] AS class, count(*) AS n FROM events GROUP BY ALL")
def class_of_objects(spark, d):
    cat = catalog(spark, d)
    return cat.read("events").groupBy(cat.class_of("Event").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS name FROM nation")
def attribute_scan(spark, d):
    return From(catalog(spark, d), n="Nation").select("n.name")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderkey IN (1, 7, 32)")
def object_by_key(spark, d):
    return catalog(spark, d).objects("Order", [1, 7, 32]).select("orderkey", "totalprice")


@query("SELECT r_regionkey AS regionkey, r_name AS name, 'first' AS database FROM region UNION ALL SELECT r_regionkey, r_name, 'second' FROM region")
def several_databases(spark, d):
    return across({"first": catalog(spark, d), "second": catalog(spark, d)}, "Region")


@query("SELECT r_regionkey AS regionkey, r_name AS name FROM region")
def cursor(spark, d):
    """Objects that a cursor brings to the driver, a partition at a time."""
    return spark.createDataFrame([(r.regionkey, r.name) for r in catalog(spark, d).iterate("Region")], "regionkey int, name string")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def implicit_select(spark, d):
    return matching(catalog(spark, d), "Customer", lambda p: P.equal(p("x.mktsegment"), F.lit("BUILDING")))


@query("SELECT * FROM (VALUES ('Click', 'Event'), ('Error', 'Event'), ('Purchase', 'Event'), ('Signup', 'Event'), ('View', 'Event')) t(name, parent)")
def schema_query(spark, d):
    return SCHEMA.class_frame(spark).where("parent = 'Event'").select("name", "parent")


@query("SELECT * FROM (VALUES ('Customer', 'orders', 'Order'), ('Nation', 'customers', 'Customer'), ('Nation', 'suppliers', 'Supplier'), ('Region', 'nations', 'Nation')) t(class, attribute, target)")
def schema_inverses(spark, d):
    return SCHEMA.frame(spark).where("kind = 'inverse' and class in ('Customer', 'Nation', 'Region')").select("class", "attribute", "target")


# Query blocks


@query("SELECT c_name AS name, o_totalprice AS totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000 AND n_name = 'NATION_3'")
def dependent_from(spark, d):
    q = From(catalog(spark, d), c="Customer").unnest("o", "c.orders")
    return q.where(lambda p: (p("o.totalprice") > 200000) & (p("c.nation.name") == "NATION_3")).select(name="c.name", totalprice="o.totalprice")


@query("SELECT o_orderkey AS orderkey, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_join(spark, d):
    return From(catalog(spark, d), o="Order").select("o.orderkey", region="o.customer.nation.region.name")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_quantity AS quantity, c_name AS name, n_name AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT'")
def shared_path_prefix(spark, d):
    q = From(catalog(spark, d), l="Lineitem").where(lambda p: (p("l.order.customer.mktsegment") == "MACHINERY") & (p("l.order.orderpriority") == "1-URGENT"))
    return q.select("l.linenumber", "l.quantity", orderkey="l.order", name="l.order.customer.name", nation="l.order.customer.nation.name")


@query("SELECT r_name AS region, n_name AS nation FROM region, nation")
def cartesian(spark, d):
    return From(catalog(spark, d), r="Region", n="Nation").select(region="r.name", nation="n.name")


@query("SELECT s_suppkey AS suppkey, c_custkey AS custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > c_acctbal AND c_acctbal > 9000")
def theta_join(spark, d):
    q = From(catalog(spark, d), s="Supplier").join("c", "Customer", lambda p: (p("s.nation") == p("c.nation")) & (p("s.acctbal") > p("c.acctbal")) & (p("c.acctbal") > 9000))
    return q.select("s.suppkey", "c.custkey")


@query("SELECT o_orderkey AS orderkey, p_partkey AS partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 300000 AND p_size = 15")
def equi_join(spark, d):
    q = From(catalog(spark, d), l="Lineitem").join("o", "Order", lambda p: p("l.order") == p("o.orderkey")).join("p", "Part", lambda p: p("l.part") == p("p.partkey"))
    return q.where(lambda p: (p("o.totalprice") > 300000) & (p("p.size") == 15)).select("o.orderkey", "p.partkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exists_in_collection(spark, d):
    return From(catalog(spark, d), c="Customer").any_of("c.orders", lambda p: p("e.totalprice") > 250000).select("c.custkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 10000)")
def for_all_in_collection(spark, d):
    return From(catalog(spark, d), c="Customer").all_of("c.orders", lambda p: p("e.totalprice") > 10000).select("c.custkey")


@query("SELECT n_nationkey AS nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN nation m ON c_nationkey = m.n_nationkey JOIN region ON m.n_regionkey = r_regionkey WHERE c_nationkey = nation.n_nationkey AND r_name = 'ASIA')")
def exists_over_path(spark, d):
    return From(catalog(spark, d), n="Nation").any_of("n.customers", lambda p: p("e.nation.region.name") == "ASIA").select("n.nationkey")


@query("SELECT c_custkey AS custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 200000) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) BETWEEN 2 AND 4")
def cardinality_in_collection(spark, d):
    q = From(catalog(spark, d), c="Customer").collect("c.orders", n=(lambda p: p("e.totalprice") > 200000, F.count_if))
    return q.where(lambda p: F.coalesce(column("n"), F.lit(0)).between(2, 4)).select("c.custkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_subquery(spark, d):
    cat = catalog(spark, d)
    urgent = From(cat, o="Order").where(lambda p: p("o.orderpriority") == "1-URGENT").select("o.customer")
    return From(cat, c="Customer").within("c.custkey", urgent).select("c.custkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_in_subquery(spark, d):
    cat = catalog(spark, d)
    urgent = From(cat, o="Order").where(lambda p: p("o.orderpriority") == "1-URGENT").select("o.customer")
    return From(cat, c="Customer").within("c.custkey", urgent, negate=True).select("c.custkey")


@query("SELECT n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def inverse_count(spark, d):
    return From(catalog(spark, d), n="Nation").count_of("n.customers", "n_customers").select("n.name", n=lambda p: column("n_customers"))


@query("SELECT c_custkey AS custkey, list(o_orderkey ORDER BY o_orderkey)::VARCHAR AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def inverse_collection(spark, d):
    q = From(catalog(spark, d), c="Customer").collect("c.orders", orders=(lambda p: p("e.orderkey"), F.collect_list))
    rows = q.where(lambda p: column("orders").isNotNull()).select("c.custkey", orders=lambda p: F.sort_array(column("orders")))
    return rows.select("custkey", F.concat(F.lit("["), F.array_join(F.col("orders").cast("array<string>"), ", "), F.lit("]")).alias("orders"))


@query("SELECT n_name AS name, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def nested_collections(spark, d):
    rows = From(catalog(spark, d), n="Nation").unnest("c", "n.customers").unnest("o", "c.orders").select("n.name", "o.totalprice")
    return rows.groupBy("name").agg(F.round(F.sum("totalprice"), 2).alias("total"), F.max("totalprice").alias("most"))


@query("SELECT DISTINCT c_mktsegment AS mktsegment FROM customer")
def distinct_select(spark, d):
    return From(catalog(spark, d), c="Customer").select("c.mktsegment", distinct=True)


@query("SELECT o_orderkey AS orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def one_element(spark, d):
    rows = From(catalog(spark, d), o="Order").select("o.orderkey", "o.totalprice")
    return ordering.one(rows, F.desc("totalprice"), F.asc("orderkey")).select("orderkey")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def top_k(spark, d):
    return ordering.top(From(catalog(spark, d), o="Order").select("o.orderkey", "o.totalprice"), 10, "totalprice", "orderkey", descending=True)


@query("SELECT o_orderkey AS orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
def get_range(spark, d):
    return ordering.top(From(catalog(spark, d), o="Order").select("o.orderkey"), 7, "orderkey", offset=5)


@query("SELECT c_mktsegment AS mktsegment, c_name AS name FROM customer ORDER BY c_mktsegment DESC, c_name DESC")
def order_by_several(spark, d):
    return ordering.order_by(From(catalog(spark, d), c="Customer").select("c.mktsegment", "c.name"), "mktsegment", "name", descending=True)


@query("SELECT c_mktsegment AS mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal FROM customer GROUP BY 1 HAVING count(*) > 100")
def group_by_having(spark, d):
    mean = lambda x: F.round(F.avg(x), 4)
    return From(catalog(spark, d), c="Customer").group_by("c.mktsegment", having=lambda p: p("n") > 100, n=(lambda p: F.lit(1), F.count), avg_bal=(lambda p: p("c.acctbal"), mean))


@query("SELECT r_name AS name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 2")
def group_collection(spark, d):
    q = From(catalog(spark, d), n="Nation")
    rows = q.group_by("n.region.name", having=lambda p: F.size(p("partition")) > 2, partition=(lambda p: F.struct(p("n.name").alias("nation")), F.collect_list))
    return rows.select("name", F.size("partition").cast("long").alias("n"), F.array_join(F.sort_array(F.transform("partition", lambda e: e["nation"])), ",").alias("members"))


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def operators_by_result_kind(spark, d):
    """Two distinct results are sets, so that their intersection is one without the caller saying so."""
    q = From(catalog(spark, d), o="Order")
    a = q.where(lambda p: p("o.orderstatus") == "F").select(custkey="o.customer", distinct=True)
    b = q.where(lambda p: p("o.totalprice") > 300000).select(custkey="o.customer", distinct=True)
    return sets.intersect_rows(a, b, sets.own_kinds(a, b))


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def contents_of_collection(spark, d):
    rows = From(catalog(spark, d), c="Customer").where(lambda p: p("c.mktsegment") == "BUILDING").contents("c.orders")
    return rows.select("orderkey", "totalprice")


@query("SELECT c_mktsegment AS mktsegment, c_custkey AS custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(spark, d):
    rows = From(catalog(spark, d), c="Customer").select("c.mktsegment", "c.acctbal", "c.custkey")
    return ordering.top_per_group(rows, 3, ["mktsegment"], F.desc("acctbal"), F.asc("custkey")).select("mktsegment", "custkey")


@query("SELECT s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR n_name = 'NATION_7'")
def or_of_paths(spark, d):
    return From(catalog(spark, d), s="Supplier").where(lambda p: (p("s.nation.name") == "NATION_3") | (p("s.nation.name") == "NATION_7")).select("s.name")


@query("SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 320000")
def path_over_nested_select(spark, d):
    return From(catalog(spark, d), o="Order").where(lambda p: p("o.totalprice") > 320000).select("o.customer.name", distinct=True)


@query("SELECT r_regionkey AS regionkey, r_name AS name FROM region")
def select_everything(spark, d):
    return From(catalog(spark, d), r="Region").everything("r")


@query("SELECT DISTINCT p_partkey AS partkey, s_suppkey AS suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 7")
def many_to_many(spark, d):
    return From(catalog(spark, d), p="Part").where(lambda p: p("p.size") == 7).unnest("s", "p.suppliers").select("p.partkey", "s.suppkey")


@query("SELECT p_partkey AS partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0)")
def many_to_many_for_all(spark, d):
    return From(catalog(spark, d), p="Part").all_of("p.suppliers", lambda p: p("e.acctbal") >= 0).select("p.partkey")


@query("SELECT p_partkey AS partkey, coalesce(n, 0) AS n, most FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT s_suppkey) AS n, max(s_acctbal) AS most FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_partkey = p_partkey")
def many_to_many_aggregate(spark, d):
    q = From(catalog(spark, d), p="Part").collect("p.suppliers", n=(lambda p: F.lit(1), F.count), most=(lambda p: p("e.acctbal"), F.max))
    return q.select("p.partkey", n=lambda p: F.coalesce(column("n"), F.lit(0)), most=lambda p: column("most"))


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 5")
def class_cast(spark, d):
    cat = catalog(spark, d)
    return cat.read("events").where((cat.class_of("Event") == "Error") & (F.col("value") > 5)).select("event_id", "value")


@query("SELECT c_custkey AS custkey, n_name AS nation, s.n AS n_suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey WHERE c_acctbal > 5000")
def aggregate_at_path_end(spark, d):
    q = From(catalog(spark, d), c="Customer").where(lambda p: p("c.acctbal") > 5000).count_of("c.nation.suppliers", "n_suppliers")
    return q.where(lambda p: column("n_suppliers") > 0).select("c.custkey", nation="c.nation.name", n_suppliers=lambda p: column("n_suppliers"))


# Aggregates over queries


@query("SELECT sum(l_quantity) AS total, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem WHERE l_returnflag = 'R'")
def aggregates(spark, d):
    rows = From(catalog(spark, d), l="Lineitem").where(lambda p: p("l.returnflag") == "R").select("l.quantity", "l.extendedprice", "l.shipdate")
    return rows.agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"), F.round(F.avg("extendedprice"), 4).alias("mean"), F.min("shipdate").alias("first_day"), F.max("shipdate").alias("last_day"))


@query("SELECT 0.0::DOUBLE AS total, 0::BIGINT AS n, 9223372036854775807::DOUBLE AS least FROM (SELECT 1)")
def aggregates_of_nothing(spark, d):
    rows = From(catalog(spark, d), l="Lineitem").where(lambda p: p("l.quantity") < 0).select("l.quantity")
    return rows.agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min("quantity"), F.lit(9223372036854775807).cast("double")).alias("least"))


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = From(catalog(spark, d), l="Lineitem").where(lambda p: p("l.shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    rows = rows.select("l.returnflag", "l.linestatus", "l.quantity", "l.extendedprice", "l.discount")
    discounted = F.col("extendedprice") * (1 - F.col("discount"))
    return rows.groupBy("returnflag", "linestatus").agg(F.sum("quantity").alias("sum_qty"), F.round(F.sum("extendedprice"), 2).alias("sum_base"), F.round(F.sum(discounted), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL")
def revenue_by_nation(spark, d):
    q = From(catalog(spark, d), l="Lineitem").where(lambda p: p("l.order.customer.nation.region.name") == "ASIA")
    rows = q.select(nation="l.order.customer.nation.name", value=lambda p: p("l.extendedprice") * (1 - p("l.discount")))
    return rows.groupBy("nation").agg(F.round(F.sum("value"), 2).alias("revenue"))


@query("SELECT 'Customer' AS class, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Purchase', count(*) FROM events WHERE event_type = 'purchase'")
def object_counts(spark, d):
    cat = catalog(spark, d)
    parts = [cat.extent(c).agg(F.lit(c).alias("class"), F.count(F.lit(1)).alias("n")) for c in ("Customer", "Order", "Purchase")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# Set operators over rows


def _keys(spark, d):
    cat = catalog(spark, d)
    a = From(cat, o="Order").where(lambda p: p("o.orderstatus") == "F").select(custkey="o.customer")
    b = From(cat, o="Order").where(lambda p: p("o.totalprice") > 300000).select(custkey="o.customer")
    return a, b


_A, _B = "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 300000"


@query(f"{_A} UNION ALL {_B}")
def union_bag(spark, d):
    return sets.union_rows(*_keys(spark, d), ("bag", "bag"))


@query(f"{_A} UNION {_B}")
def union_set(spark, d):
    return sets.union_rows(*_keys(spark, d))


@query(f"SELECT * FROM ({_A}) WHERE custkey IN ({_B})")
def intersect_bag(spark, d):
    return sets.intersect_rows(*_keys(spark, d), ("bag", "bag"))


@query(f"{_A} INTERSECT {_B}")
def intersect_set(spark, d):
    return sets.intersect_rows(*_keys(spark, d))


@query(f"SELECT * FROM ({_A}) WHERE custkey NOT IN ({_B})")
def except_bag(spark, d):
    return sets.except_rows(*_keys(spark, d), ("bag", "bag"))


@query(f"{_A} EXCEPT {_B}")
def except_set(spark, d):
    return sets.except_rows(*_keys(spark, d))


@query(f"SELECT m = 0 AS included, m = 0 AND nb < na AS properly_included FROM (SELECT count(*) AS m FROM ({_B} EXCEPT {_A})), (SELECT count(DISTINCT custkey) AS na FROM ({_A})), (SELECT count(DISTINCT custkey) AS nb FROM ({_B}))")
def inclusion(spark, d):
    a, b = _keys(spark, d)
    return sets.included_rows(b.distinct(), a.distinct())


@query(f"SELECT true AS included, na < nc AS properly_included FROM (SELECT count(DISTINCT custkey) AS na FROM ({_A})), (SELECT count(*) AS nc FROM customer)")
def proper_inclusion(spark, d):
    a, _ = _keys(spark, d)
    return sets.included_rows(a.distinct(), From(catalog(spark, d), c="Customer").select("c.custkey"))


# Checks


@query("SELECT l_orderkey AS \"order\", l_linenumber AS linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark, d):
    return integrity.not_unique(catalog(spark, d).extent("Lineitem"), "order", "linenumber")


@query("SELECT p_partkey AS partkey FROM part WHERE p_name IS NULL OR p_brand IS NULL")
def not_null_check(spark, d):
    return integrity.missing(catalog(spark, d).extent("Part"), "name", "brand").select("partkey")


@query("SELECT p_partkey AS partkey FROM part WHERE p_size % 7 = 0 OR p_brand = 'Brand#1'")
def not_null_check_of_gaps(spark, d):
    cat = catalog(spark, d)
    gaps = cat.read("part").withColumns({"p_name": F.when(F.col("p_size") % 7 != 0, F.col("p_name")), "p_brand": F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))})
    return integrity.missing(cat.replacing("part", gaps).extent("Part"), "name", "brand").select("partkey")


@query("SELECT * FROM (SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE n < 5 OR n > 15")
def cardinality_check(spark, d):
    return integrity.out_of_cardinality(catalog(spark, d), "Customer", "orders", 5, 15)


@query("SELECT l_orderkey AS \"order\" FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dangling_check(spark, d):
    cat = catalog(spark, d)
    cat = cat.replacing("orders", cat.read("orders").where("o_orderstatus <> 'P'"))
    return integrity.dangling(cat, "Lineitem", "order").select("order")


@query("SELECT o_custkey AS owner, o_orderkey AS element, 'one' AS side FROM orders WHERE o_orderkey % 97 = 0")
def inverse_check(spark, d):
    rows = catalog(spark, d).extent("Order").select("customer", "orderkey")
    return integrity.inverse_differs(rows, rows.where("orderkey % 97 <> 0"))


@query("SELECT entries, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS entries FROM orders GROUP BY 1) GROUP BY 1")
def index_statistics(spark, d):
    return integrity.key_histogram(catalog(spark, d).extent("Order"), "customer")


@query("SELECT 'unique custkey' AS name, 0::BIGINT AS n UNION ALL SELECT 'not null name', 0 UNION ALL SELECT 'dangling nation', 0 UNION ALL SELECT 'cardinality orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def schema_checks(spark, d):
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in integrity.check(catalog(spark, d), "Customer").items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# Changes


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def create_objects(spark, d):
    return changes.create(catalog(spark, d).read("region"), spark.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"))


@query("SELECT DISTINCT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_partkey NOT IN (2, 3) UNION SELECT 1, 999999")
def link_objects(spark, d):
    """The stored N-N collection of a part's suppliers with a new link, one that exists already, and without two parts' links."""
    links = catalog(spark, d).extent("Lineitem").select(F.col("part").alias("partkey"), F.col("supplier").alias("suppkey")).distinct()
    new = spark.createDataFrame([(1, 999999), (1, 999999), (None, 1)], links.schema)
    more = changes.link(links, new.unionByName(links.where("partkey = 1")))
    return changes.unlink(more, links.where("partkey in (2, 3)"))


@query("SELECT r_regionkey, r_name, false AS dated FROM region UNION ALL SELECT 99, 'ATLANTIS', true")
def creation_time(spark, d):
    rows = changes.create(catalog(spark, d).read("region"), spark.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"), created="made")
    return rows.select("r_regionkey", "r_name", (F.col("made") <= F.current_timestamp()).eqNullSafe(F.lit(True)).alias("dated"))


@query("SELECT n_nationkey AS nationkey, true AS dated FROM nation")
def modification_time(spark, d):
    return catalog(spark, d).modified("Nation").select("nationkey", (F.col("modified") <= F.current_timestamp()).alias("dated"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE NOT o_totalprice < 50000")
def delete_objects(spark, d):
    rows = catalog(spark, d).extent("Order")
    return changes.delete(rows, "orderkey", rows.where("totalprice < 50000").select("orderkey")).select("orderkey")


@query("SELECT n_nationkey AS nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS region FROM nation")
def clear_references(spark, d):
    cat = catalog(spark, d)
    return changes.clear_references(cat.extent("Nation"), "region", cat.extent("Region").where("regionkey = 2").select("regionkey")).select("nationkey", "region")


@query("SELECT c_custkey AS custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS acctbal FROM customer")
def update_objects(spark, d):
    rows = catalog(spark, d).extent("Customer")
    return changes.update(rows, F.col("mktsegment") == "BUILDING", acctbal=F.col("acctbal") + 100).select("custkey", "acctbal")


@query("SELECT p_partkey AS id, p_name AS name, p_size::VARCHAR AS size, upper(p_brand) AS brand, 0 AS stock FROM part")
def evolve_schema(spark, d):
    rows = catalog(spark, d).extent("Part").select("partkey", "name", "size", "brand", "type")
    return changes.evolve(rows, removed=("type",), renamed={"partkey": "id"}, converted={"size": "string"}, extended={"stock": F.lit(0)}, migrated={"brand": F.upper})


@query("SELECT r_name AS name FROM region")
def export_and_import(spark, d):
    path = scratch_path(spark, "export")
    catalog(spark, d).export(path, ["region"])
    return Catalog.parquet(spark, SCHEMA, path).extent("Region").select("name")
