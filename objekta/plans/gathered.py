"""Collections in rows, functions of the user, and extensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from objekta.functions.registry import Aggregate, Functions, Methods
from objekta.operators import collections as C
from objekta.operators import predicates as P
from objekta.operators import sets
from objekta.operators.query import From, column
from objekta.plans.registry import query
from objekta.sources.trade import catalog
from objekta.streaming import events as stream

#: A list of small integers for each part, with repeats and a null.
_PART_LISTS = "SELECT p_partkey AS partkey, [p_size % 5, p_size % 3, CASE WHEN p_size % 4 > 0 THEN p_size % 7 END, p_size % 3] AS a, [p_size % 3, 1, 2, 0] AS b FROM part"


def _lists(spark, d):
    s = F.col("size")
    a = C.make_list(s % 5, s % 3, F.when(s % 4 > 0, s % 7), s % 3)
    return catalog(spark, d).extent("Part").select("partkey", a.alias("a"), C.make_list(s % 3, F.lit(1), F.lit(2), F.lit(0)).alias("b"))


def _text(c):
    """A list as text, so that results compare alike everywhere."""
    return F.array_join(c.cast("array<string>"), ",", "null")


def _sql(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda v: coalesce(v::VARCHAR, 'null')), ','), '')"


@query("SELECT vec_id, embedding[1] AS first_value, embedding[64] AS last_value, round(embedding[2]::DOUBLE + embedding[3]::DOUBLE, 6) AS pair, len(embedding) AS n FROM embeddings")
def array_access(spark, d):
    v = F.col("embedding")
    part = C.part(v, 1, 2)
    return catalog(spark, d).extent("Embedding").select("vec_id", C.at(v, 0).alias("first_value"), C.last(v).alias("last_value"), F.round(C.total(part.cast("array<double>")), 6).alias("pair"), C.cardinality(v).cast("long").alias("n"))


@query("SELECT vec_id, i - 1 AS i, embedding[i] AS x FROM embeddings, range(1, 65) r(i)")
def array_unnest(spark, d):
    q = From(catalog(spark, d), v="Embedding").unnest("x", "v.embedding", index="i")
    return q.select("v.vec_id", i=lambda p: column("i").cast("long"), x="x")


@query("SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum').round(6) AS squares FROM embeddings")
def comprehension(spark, d):
    squares = C.each(F.col("embedding").cast("array<double>"), lambda x: x * x)
    return catalog(spark, d).extent("Embedding").select("vec_id", F.round(C.fold(squares, F.lit(0.0), lambda acc, x: acc + x), 6).alias("squares"))


@query(f"SELECT partkey, {_sql('list_sort(a, ' + chr(39) + 'ASC' + chr(39) + ', ' + chr(39) + 'NULLS FIRST' + chr(39) + ')')} AS up, {_sql('list_sort(a, ' + chr(39) + 'DESC' + chr(39) + ', ' + chr(39) + 'NULLS LAST' + chr(39) + ')')} AS down FROM ({_PART_LISTS})")
def sort_collection(spark, d):
    return _lists(spark, d).select("partkey", _text(C.sort(F.col("a"))).alias("up"), _text(C.reverse_sort(F.col("a"))).alias("down"))


@query("SELECT partkey, least(b[1] * 10 + 1, b[2] * 10 + 2)::INT AS least_pair FROM (" + _PART_LISTS + ")")
def sort_by_place(spark, d):
    ten = lambda x, k: F.array(x * 10 + k, F.lit(k))
    pairs = F.array(ten(F.get("b", F.lit(0)), 1), ten(F.get("b", F.lit(1)), 2))
    return _lists(spark, d).select("partkey", F.get(F.get(C.sort_by_place(pairs, 0), F.lit(0)), F.lit(0)).alias("least_pair"))


@query(f"SELECT partkey, len(a) AS n, list_sum(a)::DOUBLE AS s, list_min(a) AS lo, list_max(a) AS hi, round(list_avg(a), 6) AS mean, a[1] AS first_one, a[4] AS last_one FROM ({_PART_LISTS})")
def collection_aggregates(spark, d):
    a = F.col("a")
    return _lists(spark, d).select("partkey", C.count(a).cast("long").alias("n"), C.total(a).alias("s"), C.least(a).alias("lo"), C.greatest(a).alias("hi"), F.round(C.average(a), 6).alias("mean"), C.first(a).alias("first_one"), C.last(a).alias("last_one"))


@query(f"SELECT partkey, {_sql('a[2:]')} AS tail, {_sql('a[:2]')} AS head, {_sql('a[2:3]')} AS mid, {_sql('a[3:]')} AS to_end FROM ({_PART_LISTS})")
def collection_parts(spark, d):
    a = F.col("a")
    return _lists(spark, d).select("partkey", _text(C.rest(a)).alias("tail"), _text(C.first_n(a, 2)).alias("head"), _text(C.part(a, 1, 2)).alias("mid"), _text(C.part(a, 2)).alias("to_end"))


@query(f"SELECT partkey, {_sql('list_filter(a, lambda x, i: list_position(a, x) = i OR (x IS NULL))')} AS once, list_contains(a, 2) AS has_two, {_sql('list_concat(a, b)')} AS both FROM ({_PART_LISTS})")
def collection_distinct(spark, d):
    a = F.col("a")
    return _lists(spark, d).select("partkey", _text(C.distinct(a)).alias("once"), C.contains(a, F.lit(2)).alias("has_two"), _text(C.flatten(F.array("a", "b"))).alias("both"))


@query(f"SELECT partkey, len(list_filter(b, lambda x: x > 0)) = 4 AS all_positive, len(list_filter(a, lambda x: x = 1)) > 0 AS one_is_one, len(list_filter(b, lambda x: x >= 1)) BETWEEN 2 AND 3 AS two_or_three FROM ({_PART_LISTS})")
def quantifiers(spark, d):
    a, b = F.col("a"), F.col("b")
    return _lists(spark, d).select("partkey", P.for_all(b, lambda x: x > 0).alias("all_positive"), P.there_is(a, lambda x: x == 1).alias("one_is_one"), P.for_some(b, 2, 3, lambda x: x >= 1).alias("two_or_three"))


@query(f"SELECT partkey, {_sql('list_concat(a, b)')} AS u, {_sql('list_filter(b, lambda x: list_contains(a, x))')} AS i, {_sql('list_filter(b, lambda x: NOT coalesce(list_contains(a, x), false))')} AS e FROM ({_PART_LISTS})")
def bag_operators(spark, d):
    a, b, bags = F.col("a"), F.col("b"), ("bag", "bag")
    return _lists(spark, d).select("partkey", _text(sets.union(a, b, bags)).alias("u"), _text(sets.intersect(b, a, bags)).alias("i"), _text(sets.except_(b, a, bags)).alias("e"))


@query("SELECT partkey, " + ", ".join(f"{_sql(f'list_sort(list_distinct({x}))')} AS {n}" for x, n in (("list_concat(b, [7, 1])", "u"), ("list_filter(b, lambda x: x IN (0, 2))", "i"), ("list_filter(b, lambda x: x NOT IN (0, 2))", "e"))) + f" FROM ({_PART_LISTS})")
def set_operators(spark, d):
    s = lambda c: _text(F.sort_array(c))
    b = C.to_set(F.col("b"))
    return _lists(spark, d).select("partkey", s(sets.union(b, C.make_set(F.lit(7), F.lit(1)))).alias("u"), s(sets.intersect(b, C.make_set(F.lit(0), F.lit(2)))).alias("i"), s(sets.except_(b, C.make_set(F.lit(0), F.lit(2)))).alias("e"))


@query(f"SELECT partkey, len(list_filter([b[1], 2], lambda x: x NOT IN (0, 2))) = 0 AS within, b[1] IN (0, 2) AND len(list_distinct([b[1], 2])) < 2 AS proper, len(list_distinct([b[1], 2])) = 2 AND b[1] IN (0, 2) AS equal FROM ({_PART_LISTS})")
def set_inclusion(spark, d):
    x, y = C.make_set(F.get("b", F.lit(0)), F.lit(2)), C.make_set(F.lit(0), F.lit(2))
    return _lists(spark, d).select("partkey", sets.included(x, y).alias("within"), sets.properly_included(x, y).alias("proper"), sets.same(x, y).alias("equal"))


@query(f"SELECT partkey, b[1] < 1 AND b[2] < 2 AS below, b[1] <= 1 AND b[2] <= 1 AS not_above FROM ({_PART_LISTS})")
def list_comparison(spark, d):
    b = C.first_n(F.col("b"), 2)
    return _lists(spark, d).select("partkey", P.lists_ordered(b, "<", C.make_list(F.lit(1), F.lit(2))).alias("below"), P.lists_ordered(b, "<=", C.make_list(F.lit(1), F.lit(1))).alias("not_above"))


@query(f"SELECT partkey, {_sql('list_append(b, 9)')} AS added, {_sql('list_filter(b, lambda x: x <> 1)')} AS without, {_sql('[b[1], 8, b[2], b[3], b[4]]')} AS inserted, {_sql('[b[1], 8, b[3], b[4]]')} AS changed, {_sql('[b[1], b[3], b[4]]')} AS removed, 0 AS n_emptied FROM ({_PART_LISTS})")
def collection_changes(spark, d):
    b = F.col("b")
    return _lists(spark, d).select(
        "partkey", _text(C.insert(b, F.lit(9))).alias("added"), _text(C.remove(b, F.lit(1))).alias("without"), _text(C.insert_at(b, 1, F.lit(8))).alias("inserted"), _text(C.put_at(b, 1, F.lit(8))).alias("changed"), _text(C.remove_at(b, 1)).alias("removed"),
        F.size(C.emptied(b)).alias("n_emptied"),
    )


@query(f"SELECT partkey, array_to_string(list_transform(list_filter(range(1, 5), lambda i: a[i] IS NOT NULL), lambda i: (i - 1) || ':' || a[i]), ',') AS pairs FROM ({_PART_LISTS})")
def sparse_array(spark, d):
    pairs = F.transform(C.indexed(F.col("a")), lambda p: F.concat_ws(":", p["index"], p["value"]))
    return _lists(spark, d).select("partkey", F.array_join(pairs, ",").alias("pairs"))


@query("SELECT p_partkey AS partkey, array_to_string(range(p_size, p_size + 4), ',') AS span, array_to_string(list_transform(range(1, 4), lambda i: substr(p_name, i, 1)), '') AS chars FROM part")
def interval_and_chars(spark, d):
    rows = catalog(spark, d).extent("Part")
    s = F.col("size").cast("long")
    return rows.select("partkey", _text(C.interval(s, s + 3)).alias("span"), F.array_join(C.char_part(F.col("name"), 0, 2), "").alias("chars"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_collection(spark, d):
    rows = catalog(spark, d).extent("Turn").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return rows.select("conv_id", C.cardinality(F.col("turns")).cast("long").alias("n"), F.array_join(C.each(F.col("turns"), lambda t: t["role"]), ">").alias("roles"))


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1")
def one_to_one(spark, d):
    return From(catalog(spark, d), l="Label").where(lambda p: p("l.toxic") == 1).select("l.document.doc_id", "l.document.n_chars", "l.quality")


@query("SELECT vec_id, '64' AS flat, '8,8' AS dims, round(list_sum(list_transform(range(1, 9), lambda i: embedding[(i - 1) * 8 + i]::DOUBLE)), 6) AS trace FROM embeddings")
def array_of_arrays(spark, d):
    rows = catalog(spark, d).extent("Embedding").select("vec_id", C.split_every(F.col("embedding").cast("array<double>"), 8).alias("m"))
    diagonal = C.fold(F.transform("m", lambda row, i: F.get(row, i)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("vec_id", _text(C.dimensions(C.flatten(F.col("m")), 1)).alias("flat"), _text(C.dimensions(F.col("m"), 2)).alias("dims"), F.round(diagonal, 6).alias("trace"))


@query("SELECT o_orderkey AS orderkey, o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS same FROM orders")
def struct_equality(spark, d):
    rows = catalog(spark, d).extent("Order").select("orderkey", C.struct_of(a=F.col("orderstatus"), b=F.col("orderpriority")).alias("x"), C.struct_of(status=F.lit("F"), priority=F.lit("1-URGENT")).alias("y"))
    return rows.select("orderkey", C.equal_by_place(rows, "x", "y").alias("same"))


@query(f"SELECT partkey, least(b[1] * 10 + 1, b[2] * 10 + 2)::INT AS last_pair, greatest(b[1] * 10 + 1, b[2] * 10 + 2)::INT AS first_pair FROM ({_PART_LISTS})")
def sort_by_place_down(spark, d):
    ten = lambda x, k: F.array(x * 10 + k, F.lit(k))
    down = C.sort_by_place(F.array(ten(F.get("b", F.lit(0)), 1), ten(F.get("b", F.lit(1)), 2)), 0, descending=True)
    return _lists(spark, d).select("partkey", C.at(C.at(down, 1), 0).alias("last_pair"), C.at(C.at(down, 0), 0).alias("first_pair"))


@query(f"SELECT partkey, {_sql('list_sort(list_distinct(b))')} AS as_set, {_sql('b')} AS as_list, {_sql('list_sort(list_distinct(b))')} AS contents FROM ({_PART_LISTS})")
def collection_conversions(spark, d):
    rows = _lists(spark, d)
    b = {kind: C.convert(rows, "b", kind) for kind in ("set", "bag", "list", "array")}
    return rows.select("partkey", _text(F.sort_array(b["set"])).alias("as_set"), _text(C.convert(rows, "b", "list")).alias("as_list"), _text(F.sort_array(C.contents(b["array"], "array"))).alias("contents"))


@query(f"SELECT partkey, CASE WHEN len(e) = 0 THEN '9' ELSE array_to_string(e, ',') END AS or_other, len(e) = 0 AS none, e[1] AS one, b[1] AS nested FROM (SELECT *, list_filter(b, lambda x: x > 2) AS e FROM ({_PART_LISTS}))")
def empty_collections(spark, d):
    e = C.each(F.col("b"), lambda x: x, lambda x: x > 2)
    other = C.make_list(F.lit(9))
    return _lists(spark, d).select("partkey", _text(C.if_empty(e, other)).alias("or_other"), C.null_if_empty(e).isNull().alias("none"), C.get_one(e).alias("one"), C.get_one(F.array(C.emptied(F.col("b")), F.col("b")), nested=True).alias("nested"))


# Functions of the user


@query("SELECT p_partkey AS partkey, round(p_retailprice * 1.2, 4) AS gross, round(p_retailprice * 1.05, 4) AS reduced FROM part")
def defined_function(spark, d):
    f = Functions()
    f.define(lambda price, rate=0.2: price * (1 + rate), "gross")
    rows = catalog(spark, d).extent("Part")
    return rows.select("partkey", F.round(f("gross", F.col("retailprice")), 4).alias("gross"), F.round(f("gross", F.col("retailprice"), 0.05), 4).alias("reduced"))


@query(f"SELECT partkey, {_sql('list_transform(b, lambda x: x * 10)')} AS tens, {_sql('list_transform(b, lambda x: x + 1)')} AS next FROM ({_PART_LISTS})")
def function_values(spark, d):
    f = Functions()
    f.define(lambda values, fn: C.each(values, fn), "map")
    f.define(lambda x, n=10: x * n, "times")
    return _lists(spark, d).select("partkey", _text(f("map", F.col("b"), lambda x: f("times", x))).alias("tens"), _text(f("map", F.col("b"), lambda x: x + 1)).alias("next"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN value * 2 WHEN 'error' THEN 0 ELSE value END AS weight FROM events")
def method_dispatch(spark, d):
    cat = catalog(spark, d)
    m = Methods(cat.schema)
    m.define("Event", "weight", lambda v: v)
    m.define("Purchase", "weight", lambda v: v * 2)
    m.define("Error", "weight", lambda v: F.lit(0.0))
    return cat.extent("Event").select("event_id", m.dispatch("Event", cat.class_of("Event"), "weight", F.col("value")).alias("weight"))


@query("SELECT c_mktsegment AS mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1")
def user_aggregate(spark, d):
    return catalog(spark, d).extent("Customer").groupBy("mktsegment").agg(F.median("acctbal").alias("m"))


@query("SELECT c_mktsegment AS mktsegment, round(sqrt(avg(c_acctbal * c_acctbal)), 4) AS rms, round((max(c_acctbal) - min(c_acctbal)) / count(*), 6) AS spread FROM customer GROUP BY 1")
def user_aggregate_of_parts(spark, d):
    rms = Aggregate(lambda squares, n: F.sqrt(squares / n), squares=lambda x: F.sum(x * x), n=F.count)
    spread = Aggregate(lambda low, high, n: (high - low) / n, low=F.min, high=F.max, n=F.count)
    x = F.col("acctbal")
    return catalog(spark, d).extent("Customer").groupBy("mktsegment").agg(F.round(rms(x), 4).alias("rms"), F.round(spread(x), 6).alias("spread"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def function_in_from(spark, d):
    words = F.explode(F.split("name", " ")).alias("word")
    return catalog(spark, d).extent("Part").select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS partkey, list_sum(list_transform(range(1, p_size + 1), lambda i: i * i))::BIGINT AS squares FROM part")
def loop_as_fold(spark, d):
    squares = C.fold(C.interval(F.lit(1).cast("long"), F.col("size").cast("long")), F.lit(0).cast("long"), lambda acc, i: acc + i * i)
    return catalog(spark, d).extent("Part").select("partkey", squares.alias("squares"))


# Extensions


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    rows = stream.windowed(spark.read.parquet(f"{d}/events.parquet"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, d):
    return stream.sessions(spark.read.parquet(f"{d}/events.parquet")).select("user_id", "start", "n")


@query("SELECT o_custkey AS customer, o_orderkey AS orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def running_total(spark, d):
    w = Window.partitionBy("customer").orderBy("orderdate", "orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return catalog(spark, d).extent("Order").select("customer", "orderkey", F.round(F.sum("totalprice").over(w), 2).alias("running"))
