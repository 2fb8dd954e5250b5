"""Functions and operators on literals: the results that the manual of such systems prints, and the edges."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from objekta.functions import conversion, maths, strings, temporal
from objekta.operators import arithmetic as A
from objekta.operators import collections as C
from objekta.operators import predicates as P
from objekta.operators import sets
from objekta.streaming import events

L = F.lit


def ints(*x):
    return F.array(*[L(v).cast("int") for v in x])


@pytest.fixture(scope="module")
def value(spark):
    row = spark.range(1)

    def compute(*columns):
        out = tuple(row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())
        return out[0] if len(out) == 1 else out

    return compute


def test_arithmetic(value):
    assert value(A.int_divide(L(1), L(2)), A.int_divide(L(-7), L(2)), A.modulo(L(-7), L(2)), A.shift_right(L(100), 2), A.modulo(L(100), L(13))) == (0, -3, -1, 25, 9)
    assert value(A.bit_and(L(0xF12), L(0xF)), A.bit_or(L(0xF12), L(0xF)), A.bit_xor(L(5), L(1)), A.bit_not(L(0)), A.negate(L(3)), A.absolute(L(-3))) == (2, 3871, 4, -1, -3, 3)
    assert value(A.modulo(conversion.code_of(L("b")), conversion.code_of(L("9")))) == 98 % 57
    assert value(A.join_strings(L("hello"), L("world"))) == "helloworld"


def test_nulls(value):
    n = L(None).cast("int")
    assert value(P.equal(n, n), P.equal(n, L(1)), P.different(n, L(1)), P.compare(n, "<", L(1)), P.compare(n, "<", L(1), True), P.compare(n, "<", n, True), P.between(n, L(1), L(2))) == (True, False, True, False, True, False, False)


def test_predicates(value):
    assert value(P.matches(L("hello"), "LL", ignore_case=True), P.matches(L("hello"), "LL"), P.differs(L("hello"), "^h"), P.is_in(L(2), ints(1, 2))) == (True, False, False, True)
    assert [value(P.between(L(x), L(1), L(3), ends)) for ends in ("[]", "[[", "][", "]]") for x in (1, 2, 3)] == [True, True, True, True, True, False, False, True, False, False, True, True]
    assert value(P.lists_ordered(ints(1, 2), "<", ints(0, 3, 2)), P.lists_ordered(ints(1, 2), "<", ints(2, 3, 3)), P.lists_ordered(ints(1, 2), "<=", ints(0, 2))) == (False, True, False)
    some = ints(1, 2, 3, None)
    assert value(P.for_all(some, lambda x: x > 0), P.there_is(some, lambda x: x > 2), P.for_some(some, 2, 2, lambda x: x > 1), P.for_some(some, 2, None, lambda x: x > 1), P.for_all(F.array().cast("array<int>"), lambda x: x > 0)) == (False, True, True, True, True)


def test_sets(value):
    assert sorted(value(sets.add(ints(1, 2, 3), ints(2, 3, 4), "set"))) == [1, 2, 3, 4]
    assert value(sets.union(ints(1, 2), ints(2, 3), ("set", "bag"))) == [1, 2, 2, 3]
    assert value(sets.intersect(ints(1, 2, 2, 3), ints(2, 3, 2), ("bag", "bag"))) == [2, 2, 3]
    assert value(sets.except_(ints(1, 2, 10), ints(12), ("set", "bag"))) == [1, 2, 10]
    assert value(sets.properly_included(ints(1, 2), ints(2, 1, 44)), sets.properly_included(ints(1, 2), ints(2, 1)), sets.included(ints(1, 2), ints(2, 1)), sets.same(ints(1, 2), ints(2, 1)), sets.same(ints(1, 2), ints(2, 1), ("set", "bag"))) == (True, False, True, True, False)
    assert value(sets.intersect(ints(1, None, None), ints(None), ("bag", "bag"))) == [None, None]
    with pytest.raises(TypeError):
        sets.union(ints(1), ints(2), ("list", "bag"))


def test_rows_with_nulls(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert got(sets.intersect_rows(a, b, ("bag", "bag"))) == [1, 1, None] and got(sets.except_rows(a, b, ("bag", "bag"))) == [2]
    assert got(sets.union_rows(a, b)) == [1, 2, None] and got(sets.union_rows(a, b, ("bag", "set"))) == [1, 1, 1, 1, 2, None, None]
    assert got(sets.intersect_rows(a, b)) == [1, None] and got(sets.except_rows(a, b)) == [2]
    assert tuple(sets.included_rows(b, a).first()) == (True, True) and tuple(sets.included_rows(a, b).first()) == (False, False)


def test_collections(value):
    v = ints(3, None, 1, 1)
    assert value(C.sort(v)) == [None, 1, 1, 3] and value(C.reverse_sort(v)) == [3, 1, 1, None] and value(C.distinct(v)) == [3, None, 1]
    assert value(C.part(ints(1, 2, 9, 4), 2, 3)) == [9, 4] and value(C.part(ints(1, 2, 3), 1)) == [2, 3] and value(C.char_part(L("hello"), 0, 2)) == ["h", "e", "l"]
    assert value(C.total(v), C.average(v), C.least(v), C.greatest(v), C.cardinality(v), C.first(v), C.last(v)) == (5.0, 5 / 3, 1, 3, 4, 3, 1)
    none = F.array().cast("array<int>")
    assert value(C.total(none), C.average(none), C.least(none), C.least(none, L(C.MAXINT)), C.first(none), C.cardinality(L(None).cast("array<int>"))) == (0.0, None, None, C.MAXINT, None, 0)
    assert value(C.rest(ints(1))) == [] and value(C.rest(none)) == [] and value(C.n_from(ints(1, 2, 3, 4), 1, 2)) == [2, 3] and value(C.first_n(ints(1, 2), 5)) == [1, 2]
    assert value(C.at_or_null(ints(1), 5)) is None and value(C.at(ints(5, 6), 1)) == 6 and value(C.char_at(L("abc"), 1)) == "b"
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        value(C.at(ints(1), 5))
    with pytest.raises(Exception, match="sum of a null"):
        value(C.total(v, nulls_raise=True))
    assert [tuple(p) for p in value(C.indexed(v))] == [(0, 3), (2, 1), (3, 1)]
    assert value(C.flatten(F.array(F.array(ints(1), ints(2)), F.array(ints(3))), 2)) == [1, 2, 3]
    assert value(C.interval(L(3), L(5))) == [3, 4, 5] and value(C.interval(L(5), L(3))) == []
    assert value(C.each(ints(1, 2, 3), lambda x: x * x, lambda x: x > 1)) == [4, 9] and value(C.fold(ints(1, 2, 3), L(0), lambda a, x: a + x)) == 6
    assert value(C.insert(ints(1), L(1), "set")) == [1] and value(C.insert(ints(1), L(1))) == [1, 1] and value(C.remove(ints(1, 2, 1), L(1))) == [2]
    assert value(C.insert_at(ints(1, 2), 1, L(9))) == [1, 9, 2] and value(C.put_at(ints(1, 2), 1, L(9))) == [1, 9] and value(C.remove_at(ints(1, 2), 0)) == [2] and value(C.emptied(ints(1))) == []
    assert value(C.sort_by_place(F.array(ints(2, 1), ints(1, 5)), 0)) == [[1, 5], [2, 1]] and value(C.sort_by_place(F.array(ints(2, 1), ints(1, 5)), 1, descending=True)) == [[1, 5], [2, 1]]
    assert value(C.make_set(L(1), L(1), L(2))) == [1, 2] and value(C.contains(v, L(None).cast("int"))) and value(C.if_empty(none, ints(7))) == [7] and value(C.to_set(ints(1, 1))) == [1]


def test_strings(value):
    s = L("hello world")
    assert value(strings.length(L("é")), strings.substring(s, 6, 99), strings.substr_or_null(s, 11, 1), strings.substr_or_null(s, -1, 1), strings.substr_or_null(s, 0, 4)) == (1, "world", None, None, "hell")
    assert value(strings.capitalise_words(L("hello_wide_world")), strings.trim_left(L(" \t\x0b\n x ")), strings.trim_right(L(" x \r\n"))) == ("HelloWideWorld", "x ", " x")
    assert value(strings.find(s, "o"), strings.find(s, "o", 5), strings.find(s, "z"), strings.find_last(s, "o"), strings.find_last(s, "z"), strings.compare(L("a"), L("b")), strings.compare(L("b"), L("b"))) == (4, 7, -1, 7, -1, -1, 0)
    assert value(strings.insert(L("abc"), 1, "XY"), strings.erase(L("abcdef"), 1, 3), strings.overwrite(L("abcdef"), 1, 2, "-"), strings.replace(L("aXbX"), "X", ""), strings.put_char(L("abc"), 1, "Z"), strings.char_at(L("abc"), 2)) == ("aXYbc", "aef", "a-def", "ab", "aZc", "c")
    assert value(strings.split(L("a.b.c"), ".")) == ["a", "b", "c"] and value(strings.split_by(L("a1b22c"), r"\d+")) == ["a", "b", "c"]
    assert value(strings.matches_whole(L("abc"), "a.c"), strings.matches_whole(L("abcd"), "a.c"), strings.match_from(L("aXbbXb"), "X?b+", 2), strings.match_from(L("abc"), "z")) == (True, False, "bb", None)
    assert value(strings.append(L("a"), "b"), strings.prepend(L("a"), "b"), strings.upper(L("aé")), strings.lower(L("AÉ"))) == ("ab", "ba", "AÉ", "aé")


def test_maths(value):
    x = L(0.7)
    assert value(maths.erf(x), maths.erfc(x), maths.lgamma(x), maths.ilogb(L(12.0)), maths.logb(L(0.3)), maths.remainder(L(5.0), L(3.0)), maths.scalb(L(3.0), L(2)), maths.nextafter(x, L(1.0))) == (math.erf(0.7), math.erfc(0.7), math.lgamma(0.7), 3, -2.0, -1.0, 12.0, math.nextafter(0.7, 1))
    assert value(maths.erf(L(None).cast("double"))) is None and value(maths.ceil(L(1.2)), maths.floor(L(-1.2)), maths.fmod(L(-7.0), L(2.0)), maths.isnan(L(float("nan"))), maths.log(L(1.0)), maths.fabs(L(-2.0))) == (2.0, -2.0, -1.0, 1, 0.0, 2.0)
    # Values from tables of Bessel functions.
    known = [(maths.j0(L(1.0)), 0.7651976865579666), (maths.j1(L(1.0)), 0.44005058574493355), (maths.jn(L(2), L(10.0)), 0.2546303136851206), (maths.y0(L(1.0)), 0.08825696421567698), (maths.y1(L(1.0)), -0.7812128213002887), (maths.yn(L(2), L(3.0)), -0.16040039348492373)]
    for c, want in known:
        assert value(c) == pytest.approx(want, abs=1e-10)
    j0, j1, y0, y1 = value(maths.j0(L(2.4)), maths.j1(L(2.4)), maths.y0(L(2.4)), maths.y1(L(2.4)))
    assert j1 * y0 - j0 * y1 == pytest.approx(2 / (math.pi * 2.4), abs=1e-9)
    with pytest.raises(KeyError):
        maths.builtin("sinus", x)


def test_temporal(value):
    d = temporal.date(2000, 1, 1)
    assert value(temporal.julian(d), temporal.from_julian(L(2451545)), temporal.weekday(d), temporal.is_leap_year(d), temporal.is_leap_year(temporal.date(1900, 1, 1))) == (2451545, date(2000, 1, 1), 6, True, False)
    assert value(temporal.next_weekday(d, 6), temporal.next_weekday(d, 0), temporal.previous_weekday(d, 6), temporal.previous_weekday(d, 0)) == (date(2000, 1, 1), date(2000, 1, 2), date(2000, 1, 1), date(1999, 12, 26))
    assert value(temporal.is_between(d, temporal.date(2000, 1, 2), temporal.date(1999, 1, 1)), temporal.is_between(d, d, temporal.date(2001, 1, 1)), temporal.days_between(temporal.add_days(d, 3), temporal.subtract_days(d, 2))) == (True, False, 5)
    t = temporal.time(23, 30, 15, 7)
    assert value(temporal.hour_of(t), temporal.minute_of(t), temporal.second_of(t), temporal.microsecond_of(t), temporal.hour_of(temporal.add_to_time(t, temporal.HOUR))) == (23, 30, 15, 7, 0)
    i = temporal.interval(1, 2, 3, 4)
    assert tuple(value(temporal.interval_parts(i))) == (1, 2, 3, 4) and value(temporal.quotient(temporal.product(i, 2), 2) == i, temporal.is_zero(i - i)) == (True, True)
    ts = temporal.stamp(L(1_700_000_000_000_000))
    assert value(temporal.interval_between(temporal.plus(ts, 5), temporal.minus(ts, 5))) == 10
    assert value(temporal.time_format(L(0), "%Y-%m-%d at %H:%M")) == "1970-01-01 at 00:00" and value(temporal.date_of(L("2024-02-29"))) == date(2024, 2, 29)
    with pytest.raises(ValueError):
        temporal.time_format(L(0), "%Q")


def test_conversion(value, spark):
    assert value(conversion.to_int(L(" -12abc"), True), conversion.to_int(L("junk"), True), conversion.to_int(L("99999999999"), True), conversion.to_int(L(3.9)), conversion.to_float(L("hello"), True), conversion.to_float(L("1.5e2x"), True)) == (-12, 0, 0, 3, 0.0, 150.0)
    assert value(conversion.to_string(L(1.5), True), conversion.to_string(L(3)), conversion.to_char(L(97)), conversion.to_char(L("ab"), True), conversion.code_of(L("a")), conversion.type_of(L(1))) == ("1.500000", "3", "a", "\0", 97, "int")
    df = spark.createDataFrame([(1, "x", [1], 1.0)], "i int, s string, a array<int>, f double")
    assert conversion.is_kind(df, "i", "num") and conversion.is_kind(df, "a", "coll") and not conversion.is_kind(df, "s", "num") and value(conversion.is_empty(L(None)))


def test_stream(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i // 4, 15 * (i % 4)), i % 2, "view", 1.0, "{}") for i in range(40)]
    frame = spark.createDataFrame([*rows, rows[3]], events.SCHEMA)
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.distinct_events(events.read(spark, str(tmp_path / "in"))), late=None)
    events.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert out.where("n != 4").count() == 0
    assert events.sessions(frame, "20 minutes").count() == 40 and events.sessions(frame, "40 minutes").count() == 2
