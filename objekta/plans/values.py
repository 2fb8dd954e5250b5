"""Predicates, arithmetic and scalar functions over attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from objekta.functions import conversion, maths, strings, temporal
from objekta.operators import arithmetic as A
from objekta.operators import predicates as P
from objekta.operators.query import From
from objekta.plans.registry import query
from objekta.sources.trade import catalog


def _rows(spark, d, cls: str):
    return catalog(spark, d).extent(cls)


# Predicates


@query("SELECT p_partkey AS partkey FROM part WHERE regexp_matches(p_name, '^small')")
def regex_match(spark, d):
    return From(catalog(spark, d), p="Part").where(lambda p: P.matches(p("p.name"), "^small")).select("p.partkey")


@query("SELECT p_partkey AS partkey FROM part WHERE regexp_matches(p_type, 'eCoN', 'i')")
def regex_match_any_case(spark, d):
    return From(catalog(spark, d), p="Part").where(lambda p: P.matches(p("p.type"), "eCoN", ignore_case=True)).select("p.partkey")


@query("SELECT p_partkey AS partkey FROM part WHERE NOT regexp_matches(p_name, 'ring$')")
def regex_differs(spark, d):
    return From(catalog(spark, d), p="Part").where(lambda p: P.differs(p("p.name"), "ring$")).select("p.partkey")


@query("SELECT p_partkey AS partkey FROM part WHERE NOT regexp_matches(p_name, 'RING', 'i')")
def regex_differs_any_case(spark, d):
    return From(catalog(spark, d), p="Part").where(lambda p: P.differs(p("p.name"), "RING", ignore_case=True)).select("p.partkey")


@query("SELECT p_partkey AS partkey, p_size BETWEEN 5 AND 10 AS both_in, p_size >= 5 AND p_size < 10 AS low_in, p_size > 5 AND p_size < 10 AS none_in, p_size > 5 AND p_size <= 10 AS high_in FROM part")
def between_brackets(spark, d):
    s, a, b = F.col("size"), F.lit(5), F.lit(10)
    return _rows(spark, d, "Part").select("partkey", P.between(s, a, b).alias("both_in"), P.between(s, a, b, "[[").alias("low_in"), P.between(s, a, b, "][").alias("none_in"), P.between(s, a, b, "]]").alias("high_in"))


@query("SELECT event_id, value IS NOT DISTINCT FROM NULL AS is_null, value IS DISTINCT FROM 5.0 AS not_five, coalesce(value < 5.0, false) AS below FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)")
def null_comparison(spark, d):
    rows = _rows(spark, d, "Event").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    v = F.col("value")
    return rows.select("event_id", P.equal(v, F.lit(None)).alias("is_null"), P.different(v, F.lit(5.0)).alias("not_five"), P.compare(v, "<", F.lit(5.0)).alias("below"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN true ELSE value < 5.0 END AS below FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)")
def null_is_below(spark, d):
    rows = _rows(spark, d, "Event").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rows.select("event_id", P.compare(F.col("value"), "<", F.lit(5.0), null_is_true=True).alias("below"))


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS class FROM orders")
def conditional(spark, d):
    t = F.col("totalprice")
    return _rows(spark, d, "Order").select("orderkey", P.choose(t > 250000, F.lit("large"), P.choose(t > 100000, F.lit("medium"), F.lit("small"))).alias("class"))


@query("SELECT c_custkey AS custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_nationkey = 3")
def logic(spark, d):
    return From(catalog(spark, d), c="Customer").where(lambda p: ((p("c.mktsegment") == "BUILDING") | (p("c.acctbal") < 0)) & ~(p("c.nation") == 3)).select("c.custkey")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, d):
    return From(catalog(spark, d), c="Customer").where(lambda p: P.is_in(p("c.mktsegment"), ["BUILDING", "MACHINERY"])).select("c.custkey")


@query("SELECT event_id, list_position(['view', 'signup', 'purchase', 'error', 'click'], event_type) - 1 AS kind FROM events")
def enum_values(spark, d):
    cat = catalog(spark, d)
    kinds = cat.schema.enums["EventKind"]
    number = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    return cat.extent("Event").select("event_id", number[F.upper("event_type")].alias("kind"))


# Arithmetic


@query("SELECT o_orderkey AS orderkey, (o_orderkey - 5000) // 7 + CASE WHEN o_orderkey < 5000 AND (o_orderkey - 5000) % 7 <> 0 AND (o_orderkey - 5000) // 7 * 7 <> (o_orderkey - 5000) AND (o_orderkey - 5000) // 7 * 7 < o_orderkey - 5000 THEN 1 ELSE 0 END AS q, (o_orderkey - 5000) % 7 AS r, round((o_orderkey - 5000) / 7, 6) AS x FROM orders")
def division(spark, d):
    n = F.col("orderkey") - 5000
    return _rows(spark, d, "Order").select("orderkey", A.int_divide(n, F.lit(7)).alias("q"), A.modulo(n, F.lit(7)).alias("r"), F.round(A.divide(n, F.lit(7)), 6).alias("x"))


@query("SELECT o_orderkey AS orderkey, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, o_orderkey & 255 AS a, o_orderkey | 4096 AS o, xor(o_orderkey, o_custkey) AS x, ~o_orderkey AS n FROM orders")
def bit_operators(spark, d):
    k = F.col("orderkey")
    return _rows(spark, d, "Order").select(
        "orderkey", A.shift_left(k, 3).alias("l"), A.shift_right(k, 2).alias("r"), A.bit_and(k, F.lit(255).cast("long")).alias("a"), A.bit_or(k, F.lit(4096).cast("long")).alias("o"), A.bit_xor(k, F.col("customer")).alias("x"), A.bit_not(k).alias("n")
    )


@query("SELECT l_orderkey AS \"order\", l_linenumber AS linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity / 2, 6) AS v, -l_linenumber AS m, abs(l_quantity - 25) AS a FROM lineitem")
def arithmetic(spark, d):
    v = F.col("extendedprice") * (1 - F.col("discount")) * (1 + F.col("tax")) - A.divide(F.col("quantity"), F.lit(2))
    return _rows(spark, d, "Lineitem").select("order", "linenumber", F.round(v, 6).alias("v"), A.negate(F.col("linenumber")).alias("m"), A.absolute(F.col("quantity") - 25).alias("a"))


# Strings


@query("SELECT p_partkey AS partkey, length(p_name)::INT AS n, substr(p_name, 3, 4) AS mid, CASE WHEN 6 < length(p_name) THEN substr(p_name, 7, 3) END AS late, upper(p_name) AS u, lower(p_brand) AS l FROM part")
def string_parts(spark, d):
    s = F.col("name")
    return _rows(spark, d, "Part").select("partkey", strings.length(s).alias("n"), strings.substring(s, 2, 4).alias("mid"), strings.substr_or_null(s, 6, 3).alias("late"), strings.upper(s).alias("u"), strings.lower(F.col("brand")).alias("l"))


@query("SELECT p_partkey AS partkey, ltrim(x, E' \\n\\t') AS a, rtrim(x, E' \\n\\t') AS b FROM (SELECT p_partkey, E' \\t' || p_name || E'\\n ' AS x FROM part)")
def string_trim(spark, d):
    rows = _rows(spark, d, "Part").select("partkey", F.concat(F.lit(" \t"), "name", F.lit("\n ")).alias("x"))
    return rows.select("partkey", strings.trim_left(F.col("x")).alias("a"), strings.trim_right(F.col("x")).alias("b"))


@query("SELECT p_partkey AS partkey, strpos(p_name, 'in') - 1 AS f, CASE WHEN strpos(substr(p_name, 4), 'l') = 0 THEN -1 ELSE strpos(substr(p_name, 4), 'l') + 2 END AS later, CASE WHEN p_name < 'medium' THEN -1 WHEN p_name > 'medium' THEN 1 ELSE 0 END AS c FROM part")
def string_search(spark, d):
    s = F.col("name")
    rows = _rows(spark, d, "Part").select("partkey", strings.find(s, "in").cast("long").alias("f"), strings.find(s, "l", 3).cast("long").alias("later"), strings.compare(s, F.lit("medium")).alias("c"))
    return rows


@query("SELECT p_partkey AS partkey, p_name || '!' AS a, '>' || p_name AS p, substr(p_name, 1, 2) || '--' || substr(p_name, 3) AS i, substr(p_name, 1, 1) || substr(p_name, 5) AS e, '#' || substr(p_name, 3) AS o, replace(p_name, 'l', 'LL') AS r FROM part")
def string_edit(spark, d):
    s = F.col("name")
    return _rows(spark, d, "Part").select(
        "partkey", strings.append(s, "!").alias("a"), strings.prepend(s, ">").alias("p"), strings.insert(s, 2, "--").alias("i"), strings.erase(s, 1, 3).alias("e"), strings.overwrite(s, 0, 2, "#").alias("o"), strings.replace(s, "l", "LL").alias("r")
    )


@query("SELECT p_partkey AS partkey, regexp_full_match(p_brand, 'Brand#[0-9]') AS one_digit, CASE WHEN regexp_matches(p_name, '[aeiou]+') THEN regexp_extract(p_name, '[aeiou]+') END AS vowels FROM part")
def string_regex(spark, d):
    return _rows(spark, d, "Part").select("partkey", strings.matches_whole(F.col("brand"), "Brand#[0-9]").alias("one_digit"), strings.match_from(F.col("name"), "[aeiou]+").alias("vowels"))


@query("SELECT p_partkey AS partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS first_word, len(string_split_regex(p_brand, '[#a-n]+')) AS m FROM part")
def string_split(spark, d):
    words = strings.split(F.col("name"), " ")
    return _rows(spark, d, "Part").select("partkey", F.size(words).cast("long").alias("n"), F.get(words, F.lit(0)).alias("first_word"), F.size(strings.split_by(F.col("brand"), "[#a-n]+")).cast("long").alias("m"))


@query("SELECT p_partkey AS partkey, list_aggregate(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS c FROM part")
def string_capitalise(spark, d):
    return _rows(spark, d, "Part").select("partkey", strings.capitalise_words(F.replace(F.col("name"), F.lit(" "), F.lit("_"))).alias("c"))


@query("SELECT p_partkey AS partkey, len(p_name) - strpos(reverse(p_name), 'l') AS last_l, p_name[3] AS third, p_name[1] || 'X' || p_name[3:] AS changed FROM part WHERE contains(p_name, 'l')")
def string_chars(spark, d):
    s = F.col("name")
    rows = _rows(spark, d, "Part").where(F.contains(s, F.lit("l")))
    return rows.select("partkey", strings.find_last(s, "l").cast("long").alias("last_l"), strings.char_at(s, 2).alias("third"), strings.put_char(s, 1, "X").alias("changed"))


# Math


@query("SELECT p_partkey AS partkey, round(tan(x), 9) AS t, round(atan(x), 9) AS at, round(acosh(x + 1), 9) AS ach, round(atanh(x / 60), 9) AS ath, round(exp(x / 50) - 1, 9) AS em, round(ln(1 + x), 9) AS l1 FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)")
def more_math_functions(spark, d):
    x = F.col("size").cast("double")
    r = lambda name, n, c: F.round(maths.builtin(name, c), 9).alias(n)
    return _rows(spark, d, "Part").select("partkey", r("tan", "t", x), r("atan", "at", x), r("acosh", "ach", x + 1), r("atanh", "ath", x / 60), r("expm1", "em", x / 50), r("log1p", "l1", x))


@query("SELECT p_partkey AS partkey, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(atan2(x, 2.0), 9) AS a, round(ln(x), 9) AS l, round(log10(x), 9) AS l10, round(sqrt(x), 9) AS q, round(cbrt(x), 9) AS cb, round(exp(x / 50), 9) AS e, round(pow(x, 1.5), 6) AS p FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)")
def math_functions(spark, d):
    x = F.col("size").cast("double")
    r = lambda c, n, k=9: F.round(c, k).alias(n)
    return _rows(spark, d, "Part").select(
        "partkey", r(maths.builtin("sin", x), "s"), r(maths.builtin("cos", x), "c"), r(maths.builtin("atan2", x, F.lit(2.0)), "a"), r(maths.log(x), "l"), r(maths.builtin("log10", x), "l10"), r(maths.builtin("sqrt", x), "q"),
        r(maths.builtin("cbrt", x), "cb"), r(maths.builtin("exp", x / 50), "e"), r(maths.builtin("pow", x, F.lit(1.5)), "p", 6),
    )


@query("SELECT p_partkey AS partkey, round(sinh(x), 9) AS sh, round(cosh(x), 9) AS ch, round(tanh(x), 9) AS th, round(asinh(x), 9) AS ash, round(asin(x / 60), 9) AS asn, round(acos(x / 60), 9) AS acs, round(sqrt(x * x + 9), 9) AS h FROM (SELECT p_partkey, p_size::DOUBLE / 10 AS x FROM part)")
def hyperbolic_functions(spark, d):
    x = F.col("size").cast("double") / 10
    r = lambda name, n, *c: F.round(maths.builtin(name, *(c or (x,))), 9).alias(n)
    return _rows(spark, d, "Part").select("partkey", r("sinh", "sh"), r("cosh", "ch"), r("tanh", "th"), r("asinh", "ash"), r("asin", "asn", x / 60), r("acos", "acs", x / 60), r("hypot", "h", x, F.lit(3.0)))


@query("SELECT c_custkey AS custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, abs(c_acctbal) AS a, round(c_acctbal % 7.5, 6) AS m, 0 AS n FROM customer")
def rounding(spark, d):
    x = F.col("acctbal")
    return _rows(spark, d, "Customer").select("custkey", maths.ceil(x).alias("c"), maths.floor(x).alias("f"), maths.fabs(x).alias("a"), F.round(maths.fmod(x, F.lit(7.5)), 6).alias("m"), maths.isnan(x).alias("n"))


@query()
def special_functions(spark, d):
    x = (F.col("size") / 10).alias("x")
    rows = _rows(spark, d, "Part").select("size").distinct().select("size", x)
    x = F.col("x")
    return rows.select(
        "size", maths.erf(x).alias("erf"), maths.erfc(x).alias("erfc"), maths.lgamma(x).alias("lgamma"), maths.ilogb(x).alias("ilogb"), maths.nextafter(x, F.lit(9.0)).alias("nextafter"), maths.remainder(x, F.lit(0.7)).alias("remainder"),
        maths.scalb(x, F.lit(3)).alias("scalb"), maths.j0(x).alias("j0"), maths.j1(x).alias("j1"), maths.y0(x).alias("y0"), maths.y1(x).alias("y1"),
    )


@query("""
WITH s AS (SELECT DISTINCT p_size, p_size::DOUBLE / 10 AS x FROM part),
j AS (SELECT p_size, x, list_transform(range(0, 62), lambda n: list_avg(list_transform(range(0, 100), lambda k: cos(n * ((k + 0.5) * pi() / 100) - x * sin((k + 0.5) * pi() / 100))))) AS j FROM s),
f AS (SELECT p_size, round(exp(-x * x) * list_sum(list_transform(range(0, 90), lambda n: pow(x, 2 * n + 1) / gamma(n + 1.5))), 9) AS erf, round(lgamma(x), 9) AS lgamma, floor(log2(x) + 1e-12)::INT AS ilogb, nextafter(x, 9.0::DOUBLE) AS next_up,
  round(x - round_even(x / 0.7, 0) * 0.7, 9) AS remainder, x * 8 AS scaled, round(j[1], 9) AS j0, round(j[2], 9) AS j1, round(j[3], 9) AS j2,
  round(2 / pi() * (ln(x / 2) + 0.57721566490153286) * j[1] - 4 / pi() * list_sum(list_transform(range(1, 30), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * j[2 * k + 1] / k)), 9) AS y0 FROM j)
SELECT p_partkey AS partkey, f.* EXCLUDE (p_size) FROM part JOIN f ON part.p_size = f.p_size
""")
def special_functions_by_definition(spark, d):
    x, r = (F.col("size") / 10).cast("double"), lambda c, n: F.round(c, 9).alias(n)
    return _rows(spark, d, "Part").select(
        "partkey", r(maths.erf(x), "erf"), r(maths.lgamma(x), "lgamma"), maths.ilogb(x).alias("ilogb"), maths.nextafter(x, F.lit(9.0)).alias("next_up"), r(maths.remainder(x, F.lit(0.7)), "remainder"), maths.scalb(x, F.lit(3)).alias("scaled"),
        r(maths.j0(x), "j0"), r(maths.j1(x), "j1"), r(maths.jn(F.lit(2), x), "j2"), r(maths.y0(x), "y0"),
    )


# Dates and times


@query("SELECT o_orderkey AS orderkey, year(t)::INT AS y, month(t)::INT AS m, day(t)::INT AS dd, dayofyear(t)::INT AS doy, dayofweek(t)::INT AS dow, (year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0)) AS leap, (t::DATE - DATE '1970-01-01')::INT + 2440588 AS julian FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)")
def date_parts(spark, d):
    t = F.to_date("orderdate")
    return _rows(spark, d, "Order").select("orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("dd"), F.dayofyear(t).alias("doy"), temporal.weekday(t).alias("dow"), temporal.is_leap_year(t).alias("leap"), temporal.julian(t).alias("julian"))


@query("SELECT o_orderkey AS orderkey, (t + (1 - dayofweek(t) + 7)::INT % 7)::DATE AS next_monday, (t - (dayofweek(t) - 1 + 7)::INT % 7)::DATE AS previous_monday, (t + 30)::DATE AS later, (t - 30)::DATE AS earlier, (t - DATE '1995-06-17')::INT AS days, t > DATE '1994-01-01' AND t < DATE '1996-01-01' AS inside FROM (SELECT o_orderkey, o_orderdate::DATE AS t FROM orders)")
def date_arithmetic(spark, d):
    t, day = F.to_date("orderdate"), lambda s: F.lit(s).cast("date")
    return _rows(spark, d, "Order").select(
        "orderkey", temporal.next_weekday(t, 1).alias("next_monday"), temporal.previous_weekday(t, 1).alias("previous_monday"), temporal.add_days(t, 30).alias("later"), temporal.subtract_days(t, 30).alias("earlier"),
        temporal.days_between(t, day("1995-06-17")).alias("days"), temporal.is_between(t, day("1996-01-01"), day("1994-01-01")).alias("inside"),
    )


@query("SELECT event_id, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS m, second(ts)::BIGINT AS s, epoch_us(ts) % 1000000 AS us, (epoch_us(ts) % 86400000000 + 7200000000) % 86400000000 AS later FROM events")
def time_of_day(spark, d):
    t = temporal.time_of(F.col("ts"))
    return _rows(spark, d, "Event").select("event_id", temporal.hour_of(t).alias("h"), temporal.minute_of(t).alias("m"), temporal.second_of(t).alias("s"), temporal.microsecond_of(t).alias("us"), temporal.add_to_time(t, temporal.interval(hours=2)).alias("later"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS p, ts - INTERVAL 1 DAY AS m, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS hours FROM events")
def time_stamps(spark, d):
    ts = F.col("ts")
    i = temporal.interval_between(ts, F.lit("2024-01-01").cast("timestamp"))
    return _rows(spark, d, "Event").select("event_id", temporal.plus(ts, temporal.interval(minutes=90)).alias("p"), temporal.minus(ts, temporal.interval(days=1)).alias("m"), i.alias("i"), temporal.quotient(i, temporal.HOUR).alias("hours"))


@query("SELECT event_id, ts + INTERVAL 330 MINUTE AS india, ts - INTERVAL 330 MINUTE AS gmt FROM events")
def time_zones(spark, d):
    return _rows(spark, d, "Event").select("event_id", temporal.zoned(F.col("ts"), 330).alias("india"), temporal.to_gmt(F.col("ts"), 330).alias("gmt"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS t FROM events")
def time_format(spark, d):
    return _rows(spark, d, "Event").select("event_id", temporal.time_format(temporal.micros(F.col("ts")) / 1000000, "%Y/%m/%d %H:%M:%S").alias("t"))


# Conversions


@query("SELECT c_custkey AS custkey, printf('%.6f', c_acctbal) AS s, trunc(c_acctbal)::BIGINT AS i, coalesce(try_cast(regexp_extract(substr(c_name, 15), '^\\s*([+-]?[0-9]+)', 1) AS INT), 0)::BIGINT AS n, coalesce(try_cast(regexp_extract(c_name, '^\\s*([+-]?[0-9]+)', 1) AS INT), 0)::BIGINT AS none, ascii(c_mktsegment) AS code, chr(ascii(c_mktsegment)) AS ch FROM customer")
def conversions(spark, d):
    x, name = F.col("acctbal"), F.col("name")
    return _rows(spark, d, "Customer").select(
        "custkey", conversion.to_string(x, is_float=True).alias("s"), conversion.to_int(x).alias("i"), conversion.to_int(F.substring(name, 15, 99), is_string=True).alias("n"), conversion.to_int(name, is_string=True).alias("none"),
        conversion.code_of(F.col("mktsegment")).alias("code"), conversion.to_char(conversion.code_of(F.col("mktsegment"))).alias("ch"),
    )


@query("SELECT c_custkey AS custkey, coalesce(try_cast(regexp_extract(substr(c_name, 15), '^\\s*([+-]?[0-9]+)', 1) AS DOUBLE), 0) AS x, 0.0::DOUBLE AS none, 'string' AS name_type, 'double' AS balance_type FROM customer")
def float_of_text(spark, d):
    name = F.col("name")
    return _rows(spark, d, "Customer").select(
        "custkey", conversion.to_float(F.substring(name, 15, 99), is_string=True).alias("x"), conversion.to_float(name, is_string=True).alias("none"), conversion.type_of(name).alias("name_type"), conversion.type_of(F.col("acctbal")).alias("balance_type")
    )


@query("SELECT * FROM (VALUES ('Customer', 'orders', 'set'), ('Customer', 'nation', 'object'), ('Embedding', 'embedding', 'array'), ('Part', 'suppliers', 'set')) t(class, attribute, kind)")
def kinds_of_attributes(spark, d):
    """is_set, is_bag, is_list, is_array and is_object over all attributes of four classes' kinds."""
    schema = catalog(spark, d).schema
    some = (("Customer", "orders"), ("Customer", "nation"), ("Customer", "name"), ("Embedding", "embedding"), ("Part", "suppliers"))
    rows = [(c, a, k) for c, a in some for k in ("bag", "set", "list", "array", "object") if conversion.is_kind_of_attribute(schema, c, a, k)]
    return spark.createDataFrame(rows, "class string, attribute string, kind string")


@query("SELECT * FROM (VALUES ('acctbal', 'float'), ('acctbal', 'num'), ('custkey', 'int'), ('custkey', 'num'), ('name', 'string')) t(attribute, kind)")
def kinds_of_columns(spark, d):
    rows = _rows(spark, d, "Customer")
    return spark.createDataFrame([(c, k) for c in ("acctbal", "custkey", "name") for k in conversion.KINDS if conversion.is_kind(rows, c, k)], "attribute string, kind string")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def literal_attribute(spark, d):
    return From(catalog(spark, d), e="Event").select("e.event_id", k="e.props.k")
