"""Paths, inheritance, changes and checks on hand-made objects with null references, empty and sparse collections."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from objekta.functions import conversion
from objekta.functions.registry import Functions, Methods
from objekta.model import ClassDef, Schema, collection, inverse, link, literal, reference, scalar
from objekta.operators import changes, integrity, ordering, sets
from objekta.operators import collections as C
from objekta.operators.query import From, column, matching
from objekta.sources.catalog import Catalog, across, scratch_path

SCHEMA = Schema.of(
    ClassDef(
        "Person",
        (link("brands", "Car", "Ride", "rider", "car"), scalar("id", unique=True), scalar("name", not_null=True), scalar("age"), literal("addr"), collection("array", "nicknames"), reference("spouse", "Person"), inverse("cars", "Car", "owner", most=2), inverse("admirers", "Person", "spouse")),
        "people", "id",
    ),
    ClassDef("Employee", (scalar("salary"),), extends="Person", where="kind in ('e', 'm')"),
    ClassDef("Manager", (scalar("bonus"),), extends="Employee", where="kind = 'm'"),
    ClassDef("Car", (scalar("num", unique=True), scalar("brand"), reference("owner", "Person")), "cars", "num"),
    ClassDef("Ride", (reference("rider", "Person"), reference("car", "Car")), "rides", ""),
    enums={"CivilState": {"LADY": 16, "SIR": 32}},
)

PEOPLE = [
    (1, "john", 40, ("Main", "Paris"), ["j", None, "jo"], 2, None, None, None),
    (2, "mary", 38, ("Main", "Rome"), [], 1, "e", 100, None),
    (3, None, None, None, None, None, "m", 200, 7),
    (4, "zoe", 5, ("Low", None), ["z"], 1, None, None, None),
    (5, "far", 9, None, ["z", "z"], 99, "e", None, None),
]
CARS = [(10, "fiat", 1), (11, "vw", 1), (12, "fiat", 2), (13, None, None), (14, "saab", 77), (15, "fiat", 1)]


@pytest.fixture(scope="module")
def cat(spark):
    people = spark.createDataFrame(PEOPLE, "id long, name string, age int, addr struct<street:string,town:string>, nicknames array<string>, spouse long, kind string, salary long, bonus long")
    cars = spark.createDataFrame(CARS, "num long, brand string, owner long")
    return Catalog.frames(spark, SCHEMA, {"people": people, "cars": cars, "rides": spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 12), (None, 12), (4, None)], "rider long, car long")})


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_extents(cat):
    assert cat.extent("Person").count() == 5 and cat.extent("Employee").count() == 3 and cat.extent("Manager").count() == 1
    assert cat.extent("Person", deep=False).count() == 2 and cat.extent("Employee", deep=False).count() == 2
    assert "bonus" in cat.extent("Person").columns
    assert got(cat.read("people").select("id", cat.class_of("Person"))) == [(1, "Person"), (2, "Employee"), (3, "Manager"), (4, "Person"), (5, "Employee")]
    assert got(across({"a": cat, "b": cat}, "Manager").select("id", "database")) == [(3, "a"), (3, "b")]
    assert SCHEMA.subclasses("Employee") == ["Employee", "Manager"] and SCHEMA.enum_value("SIR") == 32
    with pytest.raises(KeyError):
        SCHEMA.attribute("Car", "wings")
    with pytest.raises(ValueError):
        Schema.of(ClassDef("A", (reference("b", "B"),)))


def test_paths(cat):
    q = From(cat, p="Person")
    assert got(q.select("p.id", town="p.addr.town")) == [(1, "Paris"), (2, "Rome"), (3, None), (4, None), (5, None)]
    assert got(q.select("p.id", spouse="p.spouse.name")) == [(1, "mary"), (2, "john"), (4, "john")]  # null and dangling references give no row
    assert got(q.select("p.id", keep_null_paths=True, spouse="p.spouse.name")) == [(1, "mary"), (2, "john"), (3, None), (4, "john"), (5, None)]
    assert got(q.where(lambda p: p("p.spouse.spouse.name") == "mary").select("p.id")) == [(2,), (4,)]
    assert got(matching(cat, "Person", lambda p: p("x.spouse.age") > 39)) == [(2,), (4,)]
    plan = q.where(lambda p: p("p.spouse.age") > 1).select("p.id", a="p.spouse.name", b="p.spouse.addr.town")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    with pytest.raises(KeyError):
        q.select("x.name")
    with pytest.raises(ValueError):
        q.select("p.cars.brand")


def test_collections(cat):
    q = From(cat, p="Person")
    assert got(q.unnest("c", "p.cars").select("p.id", "c.brand")) == [(1, "fiat"), (1, "fiat"), (1, "vw"), (2, "fiat")]
    assert got(q.unnest("n", "p.nicknames", index="i").select("p.id", i="i", n="n")) == [(1, 0, "j"), (1, 1, None), (1, 2, "jo"), (4, 0, "z"), (5, 0, "z"), (5, 1, "z")]
    assert got(q.any_of("p.cars", lambda p: p("e.brand") == "fiat").select("p.id")) == [(1,), (2,)]
    assert got(q.any_of("p.cars", negate=True).select("p.id")) == [(3,), (4,), (5,)]
    assert got(q.all_of("p.cars", lambda p: p("e.brand") == "fiat").select("p.id")) == [(2,), (3,), (4,), (5,)]
    assert got(q.count_of("p.cars", "n").select("p.id", n=lambda p: column("n"))) == [(1, 3), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert got(q.any_of("p.spouse.cars", lambda p: p("e.brand") == "vw").select("p.id")) == [(2,), (4,)]
    assert got(q.within("p.id", cat.extent("Car").select("owner")).select("p.id")) == [(1,), (2,)]
    assert got(q.within("p.id", cat.extent("Car").select("owner"), negate=True).select("p.id")) == [(3,), (4,), (5,)]
    assert got(q.unnest("c", "p.brands").select("p.id", "c.num")) == [(1, 10), (1, 12), (2, 12)]
    assert got(q.any_of("p.brands", negate=True).select("p.id")) == [(3,), (4,), (5,)]
    assert got(q.count_of("p.brands", "n").where(lambda p: column("n") > 0).select("p.id", n=lambda p: column("n"))) == [(1, 2), (2, 1)]
    assert q.where(lambda p: p("p.id") == 1).everything("p").columns == ["id", "name", "age", "addr", "nicknames", "spouse", "salary", "bonus"]
    assert [r.num for r in cat.iterate("Car")] == [10, 11, 12, 13, 14, 15]
    assert got(q.unnest("c", "p.cars").select("c.brand", distinct=True)) == [("fiat",), ("vw",)]
    with pytest.raises(ValueError):
        q.count_of("p.cars", "p")
    pairs = From(cat, a="Person", b="Person").where(lambda p: p("a.age") > p("b.age")).select(a="a.id", b="b.id")
    assert pairs.count() == 6
    assert got(q.join("o", "Car", lambda p: p("o.owner") == p("p.id")).where(lambda p: p("p.age") > 39).select("o.num")) == [(10,), (11,), (15,)]


def test_joins_have_keys_and_scans_have_filters(spark):
    """Without broadcasts: a nested loop would take hours where a hash or merge join takes seconds."""
    from objekta.plans.catalogue import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, joins, filters in (("equi_join", 2, ("GreaterThan(o_totalprice,300000.0)", "EqualTo(p_size,15)")), ("theta_join", 1, ("GreaterThan(c_acctbal,9000.0)",)), ("dependent_from", 2, ("GreaterThan(o_totalprice,200000.0)", "EqualTo(n_name,NATION_3)")), ("in_list", 0, ("In(c_mktsegment, [BUILDING,MACHINERY])",))):
            plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
            assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") >= joins, name
            pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
            assert all(any(f in line for line in pushed) for f in filters), (name, pushed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_results_know_their_kind(cat):
    q = From(cat, c="Car")
    assert [sets.kind_of(x) for x in (q.select("c.num"), q.select("c.brand", distinct=True), ordering.order_by(q.select("c.num"), "num"), cat.extent("Car"))] == ["bag", "set", "list", "bag"]
    brands, all_brands = q.select("c.brand", distinct=True), q.select("c.brand")
    assert sets.union_rows(brands, brands, sets.own_kinds(brands, brands)).count() == 4 and sets.union_rows(brands, all_brands, sets.own_kinds(brands, all_brands)).count() == 10
    with pytest.raises(TypeError):
        sets.union_rows(brands, brands, sets.own_kinds(ordering.order_by(brands, "brand"), brands))


def test_groups_contents_and_links(cat, spark):
    q = From(cat, c="Car")
    assert got(q.group_by("c.owner.name", having=lambda p: p("n") > 1, n=(lambda p: F.lit(1), F.count), most=(lambda p: p("c.num"), F.max))) == [("john", 3, 15)]
    groups = q.group_by("c.brand", partition=(lambda p: F.struct(p("c.num").alias("num"), p("c.owner.name").alias("name")), F.collect_list))
    assert {r.brand: sorted(x.num for x in r.partition) for r in groups.collect()} == {"fiat": [10, 12, 15], "vw": [11], None: [13], "saab": [14]}
    assert got(From(cat, p="Person").where(lambda p: p("p.id") == 1).contents("p.cars").select("num")) == [(10,), (11,), (15,)]
    assert got(From(cat, p="Person").where(lambda p: p("p.id") == 1).contents("p.nicknames")) == [("j",), ("jo",), (None,)]
    links = spark.createDataFrame([(1, 10), (2, 12)], "rider long, car long")
    more = spark.createDataFrame([(1, 10), (3, 11), (3, 11), (None, 2)], "rider long, car long")
    assert got(changes.link(links, more)) == [(1, 10), (2, 12), (3, 11)]
    assert got(changes.unlink(changes.link(links, more), more)) == [(2, 12)]
    assert changes.create(links, more, created="made").where("made is not null").count() == 4
    rows = cat.extent("Person")
    assert C.convert(rows, "nicknames", "set") is not None and got(rows.where("id = 5").select(C.convert(rows, "nicknames", "set"))) == [(["z"],)]
    with pytest.raises(TypeError):
        C.convert(rows, "name", "set")
    with pytest.raises(ValueError):
        C.convert(rows, "nicknames", "heap")
    assert conversion.is_kind_of_attribute(SCHEMA, "Person", "cars", "set") and conversion.is_kind_of_attribute(SCHEMA, "Person", "nicknames", "array") and conversion.is_kind_of_attribute(SCHEMA, "Person", "spouse", "object") and conversion.is_kind_of_attribute(SCHEMA, "Person", "cars", "coll") and not conversion.is_kind_of_attribute(SCHEMA, "Person", "name", "coll")


def test_changes(cat, spark):
    people = cat.read("people")
    assert changes.create(people, spark.createDataFrame([(6, "new")], "id long, name string")).where("age is null and id = 6").count() == 1
    assert changes.delete(people, "id", people.where("age < 10").select("id")).count() == 3
    assert got(changes.clear_references(people, "spouse", people.where("id = 1").select("id")).select("id", "spouse")) == [(1, 2), (2, None), (3, None), (4, None), (5, 99)]
    updated = changes.update(people, F.col("age") > 30, age=F.col("age") + 1, name=F.lit("x"))
    assert got(updated.select("id", "name", "age")) == [(1, "x", 41), (2, "x", 39), (3, None, None), (4, "zoe", 5), (5, "far", 9)]
    assert updated.schema["age"].dataType == people.schema["age"].dataType
    evolved = changes.evolve(people.select("id", "name", "age"), removed=("age",), renamed={"name": "label"}, converted={"label": "int"}, extended={"z": F.lit(1)})
    assert evolved.columns == ["id", "label", "z"] and evolved.where("label is not null").count() == 0


def test_checks(cat):
    found = {k: df.count() for k, df in integrity.check(cat, "Person").items()}
    assert found == {"unique id": 0, "not null name": 1, "dangling spouse": 1, "cardinality cars": 1}
    assert got(integrity.dangling(cat, "Car", "owner").select("num")) == [(14,)]
    assert got(integrity.not_unique(cat.extent("Car"), "brand")) == [("fiat", 3)]
    assert got(integrity.key_histogram(cat.extent("Car").where("owner is not null"), "owner")) == [(1, 2), (3, 1)]
    a = cat.extent("Car").select("owner", "num")
    assert got(integrity.inverse_differs(a, a.where("num <> 12"))) == [(2, 12, "one")]


def test_scratch_tables_go_to_the_shared_folder():
    session = lambda folder, master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master))
    assert scratch_path(session("/shared", "spark://host:7077"), "x").startswith("/shared/x-")
    assert scratch_path(session(None, "local[4]"), "x") != scratch_path(session(None, "local[4]"), "x")
    with pytest.raises(RuntimeError):
        scratch_path(session(None, "spark://host:7077"), "x")


def test_export(cat, tmp_path, spark):
    cat.export(str(tmp_path), ["cars"])
    back = Catalog.parquet(spark, SCHEMA, str(tmp_path))
    assert got(back.extent("Car")) == got(cat.extent("Car"))
    assert back.modified("Car").where("modified is not null").count() == 6


def test_functions_and_methods(cat):
    f = Functions()
    f.define(lambda x, n=2: x * n, "times")
    f.define(lambda values, fn: F.transform(values, fn), "map")
    assert got(cat.extent("Car").select(f("times", F.col("num")), f("times", F.col("num"), 3)).limit(1)) == [(20, 30)]
    assert cat.spark.range(1).select(f("map", F.array(F.lit(1), F.lit(2)), lambda x: x + 1)).first()[0] == [2, 3]
    m = Methods(SCHEMA)
    m.define("Person", "pay", lambda: F.lit(0))
    m.define("Employee", "pay", lambda: F.col("salary"))
    m.define("Manager", "pay", lambda: F.col("salary") + F.col("bonus"))
    rows = cat.read("people").select("id", m.dispatch("Person", cat.class_of("Person"), "pay").alias("pay"))
    assert got(rows) == [(1, 0), (2, 100), (3, 207), (4, 0), (5, None)]
    with pytest.raises(KeyError):
        m.resolve("Car", "pay")
