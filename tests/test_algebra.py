"""Acceptance pipelines, edge cases of the operators, files, catalog and scripts, on small inline data."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plankit.functions.registry import FUNCTIONS, Kind, Partial
from plankit.operators import nested
from plankit.operators.relation import Relation
from plankit.plans import explain
from plankit.plans.scripts import Script, ScriptError
from plankit.sources import files
from plankit.sources.catalog import Catalog

col = F.col


@pytest.fixture
def numbers(spark):
    return Relation(spark.createDataFrame([(x,) for x in (0, 2, 4, 6, 8, 10, 12)], "x int"))


@pytest.fixture
def people(spark):
    rows = [(1, "a", 3, 10.0), (2, "b", 3, 20.0), (3, "c", None, 30.0), (4, None, 5, None), (5, "e", 5, 50.0)]
    return Relation(spark.createDataFrame(rows, "id int, name string, nation int, balance double"))


@pytest.fixture
def nations(spark):
    return Relation(spark.createDataFrame([(3, "N3"), (5, "N5"), (7, "N7"), (None, "none")], "key int, label string"))


def rows(relation):
    return [tuple(r) for r in relation.df.collect()]


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


# acceptance pipelines


def test_constants_are_written(spark, tmp_path):
    files.write_text(Relation.empty_tuple(spark).assign(a=400, b=3), str(tmp_path / "out"))
    assert lines(tmp_path / "out") == ["400; 3"]


def test_select(numbers):
    assert rows(numbers.select(F.lit(2) > col("x"))) == [(0,)]


def test_project_second_constant(spark):
    assert rows(Relation.empty_tuple(spark).assign(a=400, b=3).project("b")) == [(3,)]


def test_limit_skips_then_takes(people):
    assert rows(people.order("id").limit(2, offset=1).project("id")) == [(2,), (3,)]
    assert rows(people.order("id").limit(0)) == []
    assert rows(people.order("id").limit(5, offset=9)) == []


def test_unnest_constants_and_running_count(spark):
    unnested = Relation.empty_tuple(spark).unnest("x", F.array(F.lit(100), F.lit(200), F.lit(300)))
    assert rows(unnested) == [(100,), (200,), (300,)]
    assert rows(unnested.running(["x"], n=("running-count",)).project("n")) == [(1,), (2,), (3,)]


def test_count_and_group(people):
    assert rows(people.aggregate(n=F.count("*"))) == [(5,)]
    grouped = people.group(["nation"], n=F.count("*"))
    assert sorted(rows(grouped), key=repr) == [(3, 2), (5, 2), (None, 1)]
    assert rows(grouped.select(col("nation") == 3).project("n")) == [(2,)]


def test_script_passes_rows_through_a_program(spark):
    assert rows(Relation.empty_tuple(spark).assign(a=400, b=3).script("cat", [("a", "int"), ("b", "int")], "|")) == [(400, 3)]


def test_script_status_fails_the_query(numbers):
    with pytest.raises(Exception, match="status|exit|TRANSFORM|fail"):
        numbers.script("cat >/dev/null; exit 3", [("x", "int")]).df.collect()


def test_same_rows_to_two_sinks(spark, people, tmp_path):
    files.write_to_all(people, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [spark.read.parquet(str(tmp_path / d)).count() for d in "ab"] == [5, 5]


def test_sorted_rows_are_printed_with_quotes(spark, tmp_path):
    table = Relation(spark.createDataFrame([(1, 'B"\\x', 1.5), (0, "A; ü", None)], "k int, s string, f float"))
    files.write_text(table.order("s"), str(tmp_path / "out"), single=True)
    assert lines(tmp_path / "out") == ['0; "A; ü"; null', '1; "B\\"\\\\x"; 1.5']


def test_subplan_adds_constants(spark):
    assert rows(Relation.empty_tuple(spark).assign(a=400, b=3).assign(s=col("a") + col("b")).project("s")) == [(403,)]


@pytest.mark.parametrize("value", [-(2**31), 0, 2**31 - 1, -(2**63), 2**63 - 1])
def test_extreme_integers_print(spark, value):
    made = Relation(spark.createDataFrame([(value,)], "x long"))
    assert made.df.select(files.printed_row(made.df)).first()[0] == str(value)


# meanings


def test_assign_sees_the_input_only(numbers):
    assert rows(numbers.assign(x=col("x") + 1, y=col("x")).limit(1)) == [(1, 0)]


def test_outer_join_keeps_its_residual_in_the_condition(people, nations):
    on = (col("key") == col("nation")) & (col("balance") > 15)
    found = rows(nations.left_outer(people, on).project("key", "id"))
    assert sorted(found, key=repr) == [(3, 2), (5, 5), (7, None), (None, None)]


def test_filter_above_outer_join_filters(people, nations):
    found = nations.left_outer(people, col("key") == col("nation")).select(col("balance") > 15)
    assert sorted(rows(found.project("key", "id"))) == [(3, 2), (5, 5)]


def test_theta_outer_join(nations, numbers):
    found = nations.left_outer(numbers, col("x") > col("key") + 5)
    assert sorted(rows(found.project("key", "x")), key=repr) == [(3, 10), (3, 12), (5, 12), (7, None), (None, None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_few_keys_of_many_rows_are_made_by_all_tasks(spark, monkeypatch, how):
    """One file of a key that repeats on both sides: each task makes a like part of the product; no match, null keys and a right that is too large too."""
    from plankit.operators import relation

    left = Relation(spark.sql("SELECT id AS a, IF(id % 4 = 0, null, IF(id = 1, 9, 1)) AS k FROM range(0, 400, 1, 1)"))
    right = Relation(spark.sql("SELECT id AS b, IF(id % 5 = 0, null, 1) AS k FROM range(50)"))
    plain = left.join(right, ["k"], how).project("a", "b")
    made = left.join(right, ["k"], how, "many").project("a", "b")
    assert sorted(rows(made), key=repr) == sorted(rows(plain), key=repr)
    sizes = [len(part) for part in made.df.rdd.glom().collect()]
    assert len(sizes) >= 16 and max(sizes) < 0.2 * sum(sizes)
    monkeypatch.setattr(relation, "BROADCAST_BYTES", 0)
    assert sorted(rows(left.join(right, ["k"], how, "many").project("a", "b")), key=repr) == sorted(rows(plain), key=repr)


def test_select_above_limit_stays_there(people):
    assert rows(people.order("id").limit(2).select(col("id") > 1).project("id")) == [(2,)]


def test_limits_and_running_values_start_anew_in_each_group(people):
    assert sorted(rows(people.limit_per(["nation"], ["-id"], 1).project("nation", "id")), key=repr) == [(3, 2), (5, 5), (None, 3)]
    found = people.running(["id"], ["nation"], n=("running-count",)).project("id", "n")
    assert sorted(rows(found)) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 2)]


@pytest.mark.parametrize("order", [["k", "id"], ["-k", "id"], ["v", "id"], ["name", "-id"], ["-name", "k", "id"], ["-id"]])
def test_running_values_over_ranges_equal_those_of_one_task(spark, monkeypatch, order):
    made = Relation(spark.sql("SELECT id, IF(id % 11 = 0, null, id * 7 % 40) AS k, IF(id % 5 = 0, null, id % 13 - 6.5D) AS v, IF(id % 9 = 0, null, concat('n', id % 6)) AS name FROM range(200)"))
    functions = {"n": ("running-count",), "s": ("running-sum", "v"), "lo": ("running-min", "v"), "hi": ("running-max", "v"), "c": ("running-count", "v"), "mean": ("running-avg", "k")}
    one = made.running(order, **functions)
    from plankit.operators import relation

    monkeypatch.setattr(relation, "ONE_TASK_BYTES", 0)
    many = made.running(order, **functions)
    assert many.df.columns == one.df.columns and many.df.dtypes == one.df.dtypes
    assert "orderBy" not in explain.physical(many) and "_range" in explain.physical(many)
    assert sorted(rows(many), key=repr) == sorted(rows(one), key=repr)
    assert rows(made.select(F.lit(False)).running(order, n=("running-count",))) == []


def test_ranges_are_as_many_as_the_rows_need(spark, monkeypatch):
    """A relation of a few MB by its files can be millions of rows: ranges hold a bounded number, whatever the partitions."""
    from plankit.operators import relation

    assert relation.ONE_TASK_BYTES <= 8 << 20
    monkeypatch.setattr(relation, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(relation, "RANGE_ROWS", 1000)
    made = Relation(spark.sql("SELECT id, id * 7919 % 20011 AS k FROM range(20000)"))
    for order, column in ((["k"], "k"), (["-k", "id"], "k"), (["id"], "id")):
        dealt, count = made._ranged(order)
        sizes = [r[1] for r in dealt.groupBy("_range").count().collect()]
        assert 15 <= count <= 20 and len(sizes) == count and max(sizes) < 2500
        found = rows(made.running(order, n=("running-count",), top=("running-max", column)).project(column, "n", "top"))
        keys = sorted((r[0] for r in found), reverse=order[0].startswith("-"))
        assert sorted(found, key=lambda r: r[1]) == [(k, i + 1, max(k, keys[0])) for i, k in enumerate(keys)]
    tasks = made.running(["id"], n=("running-count",)).df.rdd.glom().map(len).collect()
    assert sum(tasks) == 20000 and max(tasks) < 8000


def test_registered_running_functions_over_ranges(spark, monkeypatch):
    from plankit.operators import relation

    monkeypatch.setattr(relation, "ONE_TASK_BYTES", 0)
    made = Relation(spark.sql("SELECT id, CAST(id AS DOUBLE) AS v FROM range(100)"))
    FUNCTIONS.register("running-half", Kind.STATEFUL, lambda v: F.avg(v) / 2, 1, Partial(((F.sum, "sum"), (F.count, "sum")), lambda s, n: s / n / 2))
    FUNCTIONS.register("running-last", Kind.STATEFUL, F.last, 1)  # no Partial: one task
    found = rows(made.running(["id"], h=("running-half", "v")).project("id", "h"))
    assert sorted(found) == [(i, i / 4) for i in range(100)]
    assert sorted(rows(made.running(["id"], h=("running-half", "v"), x=("running-last", "id")).project("id", "x"))) == [(i, i) for i in range(100)]
    assert "SinglePartition" not in explain.physical(made.running(["id"], h=("running-half", "v"))).split("BroadcastExchange")[0]


def test_aggregates_of_nothing(people):
    none = people.select(F.lit(False))
    assert rows(none.aggregate(n=F.count("*"), s=F.sum("balance"))) == [(0, None)]
    assert rows(none.group(["nation"], n=F.count("*"))) == []


def test_distinct_has_a_defined_survivor(people):
    assert sorted(rows(people.distinct(["nation"], ["-id"]).project("nation", "id")), key=repr) == [(3, 2), (5, 5), (None, 3)]
    assert sorted(rows(people.distinct(["nation"]).project("nation", "id")), key=repr) == [(3, 1), (5, 4), (None, 3)]


def test_decor_follows_its_key(people, nations):
    joined = people.join(nations, col("nation") == col("key"))
    assert sorted(rows(joined.group(["key"], ["label"], n=F.count("*")))) == [(3, "N3", 2), (5, "N5", 2)]


def test_group_apply(people):
    found = people.select(col("nation").isNotNull()).group_apply(["nation"], lambda p: p[["nation", "id"]].tail(1), "nation int, id int")
    assert sorted(rows(found)) == [(3, 2), (5, 5)]


def test_die_passes_then_fails(people):
    assert len(rows(people.die(5))) == 5
    with pytest.raises(Exception, match="injected failure"):
        people.die(2).df.collect()


def test_split_takes_the_first_true_condition(numbers):
    split = numbers.split(col("x") < 4, col("x") < 9)
    assert [sorted(x for (x,) in rows(b)) for b in split.branches(3)] == [[0, 2], [4, 6, 8], [10, 12]]
    assert numbers.split(col("x") < 4, default=False).df.count() == 2


def test_union_maps_columns(people, nations):
    made = people.union_all(nations, [("nation", "key", "k"), ("name", "label", "v")])
    assert made.df.columns == ["k", "v"] and made.df.count() == 9


def test_unnest_of_nothing(spark):
    made = Relation(spark.createDataFrame([(1, [7, 8]), (2, []), (3, None)], "id int, a array<int>"))
    assert rows(made.unnest("x", "a", "pos").project("id", "pos", "x")) == [(1, 0, 7), (1, 1, 8)]
    assert sorted(rows(made.unnest("x", "a", outer=True).project("id", "x")), key=repr) == [(1, 7), (1, 8), (2, None), (3, None)]
    assert rows(made.unnest_call("y", "range", 1, col("id")).project("id", "y"))[:2] == [(1, 1), (2, 1)]


def test_subplans(people, nations):
    counted = nested.subplan_aggregate(nations, people, {"key": "nation"}, {"n": 0}, n=F.count("*"), s=F.sum("balance"))
    assert sorted(rows(counted.project("key", "n", "s")), key=repr) == [(3, 2, 30.0), (5, 2, 50.0), (7, 0, None), (None, 0, None)]
    first = nested.subplan(nations, people, {"key": "nation"}, limit=1, order=["-id"])
    assert sorted(rows(first.project("key", "id")), key=repr) == [(3, 2), (5, 5), (7, None), (None, None)]
    assert rows(nested.exists(nations, people, {"key": "nation"}, negated=True).project("label")).__len__() == 2


def test_registered_functions(people):
    FUNCTIONS.register("twice", Kind.SCALAR, lambda c: c * 2, 1)

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return v.max() - v.min()

    FUNCTIONS.register("spread", Kind.AGGREGATE, spread, 1)
    assert rows(people.assign(t=FUNCTIONS.call("twice", col("id"))).project("t"))[:1] == [(2,)]
    assert rows(people.select(col("nation") == 3).group(["nation"], s=FUNCTIONS.call("spread", col("balance")))) == [(3, 10.0)]
    with pytest.raises(TypeError):
        FUNCTIONS.call("twice")
    with pytest.raises(KeyError):
        FUNCTIONS.call("missing")


def test_table_functions_and_lateral_bodies(people, nations):
    @F.udtf(returnType="y int")
    class Countdown:
        def eval(self, x: int):
            for y in range(x, 3):
                yield (y,)

    assert sorted(rows(people.unnest_table(Countdown, "id").project("id", "y"))) == [(1, 1), (1, 2), (2, 2)]
    body = people.select((col("nation") == col("key").outer()) & (col("balance") > 15)).project("id")
    assert sorted(rows(nested.lateral(nations, body).project("key", "id")), key=repr) == [(3, 2), (5, 5), (7, None), (None, None)]
    assert sorted(rows(nested.lateral(nations, body, keep_unmatched=False).project("key", "id"))) == [(3, 2), (5, 5)]


# plans


def test_filters_and_columns_reach_the_scan(spark, people, tmp_path):
    files.write_parquet(people, str(tmp_path / "p"))
    plan = explain.physical(files.read_parquet(spark, str(tmp_path / "p")).select(col("id") == 3).project("name"))
    assert "EqualTo(id,3)" in plan and "balance" not in plan
    grouped = files.read_parquet(spark, str(tmp_path / "p")).group(["nation"], n=F.count("*"))
    assert explain.shuffles(grouped) == 1


def test_broadcast_hint_needs_a_checked_size(spark, people, monkeypatch):
    nations, on = Relation(spark.range(9).withColumnRenamed("id", "key")), col("nation") == col("key")
    assert "BroadcastHashJoin" in explain.operators(people.join(nations, on, hint="broadcast_right"))
    from plankit.operators import relation

    monkeypatch.setattr(relation, "BROADCAST_BYTES", 0)
    assert "ResolvedHint" not in explain.logical(people.join(nations, on, hint="broadcast_right"))


# files, catalog, scripts


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1|x y|2.5|\n2|\"q|3.5|\n")
    (tmp_path / "b.tbl").write_text("3|z|4.5|\n")
    splits = f"n1:{tmp_path}/a.tbl,n2:{tmp_path}/b.tbl"
    assert files.paths("n1:d/a.txt, n2:/e/b.txt,c.txt,file:///x/y") == ["d/a.txt", "/e/b.txt", "c.txt", "file:///x/y"]
    made = files.read_delimited(spark, splits, [("id", "int"), ("name", "chararray"), ("v", "float")], "|", trailing=True)
    assert sorted(rows(made)) == [(1, "x y", 2.5), (2, '"q', 3.5), (3, "z", 4.5)]
    (tmp_path / "bad.tbl").write_text("x|y|z|\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, [str(tmp_path / "bad.tbl")], [("id", "int"), ("name", "chararray"), ("v", "float")], "|", True).df.collect()
    assert len(rows(files.read_lines(spark, splits))) == 3


def test_every_delimited_row_is_checked(spark, tmp_path):
    fields = [("id", "int"), ("name", "chararray")]

    def read(text):
        (tmp_path / "x.txt").write_text(text)
        return files.read_delimited(spark, [str(tmp_path / "x.txt")], fields)

    assert rows(read("1,\n2,b\n")) == [(1, ""), (2, "b")]
    for bad in ("x,a\n1,b\n", "1,a\n\n2,b\n", "1,a,z\n", "1\n", ",a\n", "99999999999,a\n"):
        for use in (lambda r: r.df.collect(), lambda r: r.project("name").df.collect(), lambda r: r.df.count()):
            with pytest.raises(Exception, match="malformed row"):
                use(read(bad))
    assert files.read_delimited(spark, [str(tmp_path / "x.txt")], []).df.count() == 1
    with pytest.raises(TypeError):
        files.read_delimited(spark, [str(tmp_path / "x.txt")], [("b", "bag")])


def test_nations_sorted_by_name_as_one_file(spark, tmp_path):
    table = tmp_path / "nation.tbl"
    table.write_text("3|CANADA|1|eas hang ironic, silent packages|\n2|BRAZIL|1|y alongside of the pending deposits|\n0|ALGERIA|0| haggle. carefully final deposits detect slyly agai|\n")
    fields = [("n_nationkey", "int"), ("n_name", "chararray"), ("n_regionkey", "int"), ("n_comment", "chararray")]
    files.write_text(files.read_delimited(spark, [str(table)], fields, "|", trailing=True).order("n_name"), str(tmp_path / "out"), single=True)
    assert [p.name for p in (tmp_path / "out").glob("part-*")] == ["part-00000.txt"]
    assert lines(tmp_path / "out") == [
        '0; "ALGERIA"; 0; " haggle. carefully final deposits detect slyly agai"',
        '2; "BRAZIL"; 1; "y alongside of the pending deposits"',
        '3; "CANADA"; 1; "eas hang ironic, silent packages"',
    ]


def test_catalog_changes_that_fail_leave_the_state(spark, people, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path))
    stored = catalog.declare("people", ["id"]).stored
    catalog.write_result("people", people)
    catalog.insert("people", people.select(col("id") == 1).assign(id=9))
    held = catalog.scan("people")
    with pytest.raises(Exception, match="exists"):
        stored.publish(stored.number(), [])  # a change that was published meanwhile
    monkeypatch.setattr(type(stored), "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.delete("people", people)
    monkeypatch.undo()
    assert sorted(r[0] for r in rows(catalog.scan("people").project("id"))) == [1, 2, 3, 4, 5, 9]
    before = set(stored.folders())
    catalog.delete("people", people.select(col("id") == 1))
    assert len(before & set(stored.folders())) == 1  # the folder with 9 stays as it is
    assert held.df.count() == 6 and catalog.scan("people").df.count() == 5
    catalog.vacuum("people")
    assert catalog.scan("people").df.count() == 5 and len(list((tmp_path / "people").glob("rows-*"))) == 2


def test_catalog_over_given_files_and_partitions(spark, people, tmp_path):
    people.df.write.parquet(str(tmp_path / "given"))
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.declare("people", ["id"], path=str(tmp_path / "given"))
    catalog.update("people", people.select(col("id") == 2).assign(name=F.lit("new")))
    assert sorted(rows(catalog.scan("people").select(col("id") == 2).project("id", "name"))) == [(2, "new")]
    assert spark.read.parquet(str(tmp_path / "given")).count() == catalog.scan("people").df.count() == 5
    catalog.declare("parts", ["id"], partition_by=["nation"])
    catalog.write_result("parts", people)
    catalog.insert("parts", people.select(col("id") == 5).assign(id=6))
    assert sorted(rows(catalog.scan("parts").select(col("nation") == 5).project("id"))) == [(4,), (5,), (6,)]


def test_catalog_changes_keep_indexes(spark, people, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.declare("people", ["id"])
    catalog.write_result("people", people)
    catalog.create_index("people", "by_nation", ["nation"])
    catalog.insert("people", people.select(col("id") == 1).assign(id=9))
    catalog.delete("people", people.select(col("id") < 3))
    catalog.update("people", people.select(col("id") == 3).assign(nation=8))
    assert sorted(r[0] for r in rows(catalog.scan("people").project("id"))) == [3, 4, 5, 9]
    assert rows(catalog.search("people", "by_nation", col("nation") == 8)) == [(3,)]
    extra = Relation(spark.createDataFrame([(8, 77)], "nation int, id int"))
    catalog.insert_into_index("people", "by_nation", extra)
    assert sorted(rows(catalog.search("people", "by_nation", col("nation") == 8))) == [(3,), (77,)]
    catalog.delete_from_index("people", "by_nation", extra)
    assert rows(catalog.search("people", "by_nation", col("nation") == 8)) == [(3,)]
    with pytest.raises(KeyError):
        catalog.scan("missing")


def test_scripts(spark, tmp_path):
    (tmp_path / "1.txt").write_text("5,five\n6,six\n")
    (tmp_path / "2.txt").write_text("5,again\n12,twelve\n")
    text = f"""R = LOAD "nc1:{tmp_path}/1.txt,nc2:{tmp_path}/2.txt" AS (id : int, name : chararray);
               S = filter R by id == 5;  T = filter R by R.id - 1 > 4 + 1 * 2 or name == 'six' and id % 2 < 1;
               dump S into "nc1:{tmp_path}/out"; dump T into "{tmp_path}/t";"""
    dumps = Script(spark).run(text)
    assert sorted(lines(tmp_path / "out")) == ['5; "again"', '5; "five"']
    assert sorted(rows(dumps[1].relation)) == [(6, "six"), (12, "twelve")]
    text = f"""Ünï = load "file://{tmp_path}/1.txt" as (größe : int, name : chararray); U = filter Ünï by größe * 1.0 < 5.5e0 and name != "--//";
               V = load "{tmp_path}/2.txt" as (); dump U into "u"; dump V into "v"; W = filter Ünï by $1 == 'six'; dump W into "w";"""
    found = Script(spark).run(text, write=False)
    assert rows(found[0].relation) == [(5, "five")] and rows(found[1].relation) == [(), ()] and rows(found[2].relation) == [(6, "six")]
    for bad, what in (("S = filter R by $2 == 1;", "no field"), ("R = load 'x' as (,);", "expected"), ("-- x", "cannot read|expected"), ("dump X into 'y';", "no relation"), ("S = filter R by zip == 1;", "no field"), ("S = sort R;", "statement"), ("R = load", "expected")):
        script = Script(spark)
        script.relations["R"] = dumps[0].relation
        with pytest.raises(ScriptError, match=what):
            script.run(bad)


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    from plankit.streaming.events import read_events, windowed_counts

    made = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 600) AS ts, id % 3 AS user_id, 'e' AS event_type, 1.5D AS value, '{}' AS props FROM range(30)")
    made.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("update").start()
    stream.processAllAvailable()
    stream.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_counts(made).collect()))
