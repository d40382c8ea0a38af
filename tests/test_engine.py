"""Document semantics on small collections, above all where tables and documents differ."""

from __future__ import annotations

import json

import pytest

from pipeloom import Catalog, Engine, UnsupportedOperatorError, ValidationError
from pipeloom.cli import main
from pipeloom.sources.sinks import MergeConflictError

SALES = [
    {"_id": "a", "amount": 10.0, "qty": 2, "tags": ["x", "y"], "meta": {"src": "web", "code": None}, "when": "2024-12-30T10:20:30.000Z", "discount": 1},
    {"_id": "b", "amount": -3.5, "qty": 0, "tags": [], "meta": {"src": "shop", "code": "q"}, "when": "2024-01-06T00:00:00.000Z", "discount": None},
    {"_id": "c", "amount": 2.5, "qty": 7, "tags": ["y"], "meta": None, "when": "2023-06-15T23:59:59.000Z"},
]
STAFF = [{"_id": 1, "name": "A", "boss": None}, {"_id": 2, "name": "B", "boss": 1}, {"_id": 3, "name": "C", "boss": 2}, {"_id": 4, "name": "D", "boss": 2}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    catalog = Catalog(spark)
    for name, docs in (("sales", SALES), ("staff", STAFF)):
        (path / f"{name}.json").write_text("\n".join(map(json.dumps, docs)))
        catalog.load(name, str(path / f"{name}.json"), "documents")
    return Engine(spark, catalog)


def rows(engine, coll, *stages):
    return [r.asDict(True) for r in engine.aggregate(coll, list(stages)).collect()]


def value(engine, expression, _id="a"):
    (r,) = rows(engine, "sales", {"$match": {"_id": _id}}, {"$project": {"_id": 0, "v": expression}})
    return r["v"]


def ids(engine, query, coll="sales"):
    return sorted(r["_id"] for r in rows(engine, coll, {"$match": query}))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"discount": None}, ["b", "c"]), ({"discount": {"$exists": True}}, ["a", "b"]), ({"discount": {"$exists": False}}, ["c"]),
        ({"discount": {"$ne": 1}}, ["b", "c"]), ({"discount": {"$nin": [1]}}, ["b", "c"]), ({"tags": "y"}, ["a", "c"]), ({"tags": []}, ["b"]),
        ({"tags": {"$in": ["x"]}}, ["a"]), ({"amount": {"$gt": "5"}}, []), ({"meta.src": "web"}, ["a"]), ({"tags": {"$size": 2}}, ["a"]),
        ({"amount": {"$not": {"$gt": 0}}}, ["b"]), ({"$nor": [{"qty": 0}, {"qty": 7}]}, ["a"]), ({"tags": {"$all": ["x", "y"]}}, ["a"]), ({"_id": {"$regex": "^[AB]", "$options": "i"}}, ["a", "b"]),
    ],
)
def test_predicates(engine, query, want):
    assert ids(engine, query) == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ({"$divide": ["$qty", 0]}, None), ({"$round": [2.5]}, 2.0), ({"$round": [3.5]}, 4.0), ({"$mod": [-7, 3]}, -1), ({"$log10": 1000}, 3.0), ({"$trunc": [-2.7]}, -2.0),
        ({"$max": ["$qty", None, 5]}, 5), ({"$concat": ["a", None]}, None), ({"$toUpper": None}, ""), ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
        ({"$ltrim": {"input": "  x "}}, "x "), ({"$replaceOne": {"input": "a.b.c", "find": ".", "replacement": "-"}}, "a-b.c"), ({"$replaceAll": {"input": "a.b.c", "find": ".", "replacement": "-"}}, "a-b-c"),
        ({"$regexFind": {"input": "xxab1", "regex": "a(b)(\\d)"}}, {"match": "ab1", "idx": 2, "captures": ["b", "1"]}), ({"$regexFind": {"input": "xx", "regex": "a"}}, None),
        ({"$indexOfCP": ["banana", "a", 2]}, 3), ({"$indexOfCP": ["banana", "x"]}, -1), ({"$week": "$when"}, 52), ({"$isoWeek": "$when"}, 1), ({"$isoWeekYear": "$when"}, 2025), ({"$dayOfWeek": "$when"}, 2),
        ({"$isArray": {"$literal": []}}, True), ({"$isArray": "$tags"}, True), ({"$anyElementTrue": [[0, 0, 1]]}, True), ({"$allElementsTrue": [[1, 0]]}, False), ({"$setEquals": [[1, 2], [2, 1], [1, 1, 2]]}, True),
        ({"$cond": [{"$gt": ["$qty", 1]}, None, "x"]}, None), ({"$slice": [[1, 2, 3], -2]}, [2, 3]), ({"$arrayElemAt": [[1, 2], 9]}, None), ({"$arrayElemAt": [[1, 2], -1]}, 2),
        ({"$mergeObjects": [{"p": 1, "q": 2}, {"q": None}]}, {"p": 1, "q": None}), ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1), ({"$toBool": None}, None), ({"$toBool": "false"}, True), ({"$toString": 120.0}, "120"),
        ({"$not": [True]}, False), ({"$map": {"input": "$tags", "as": "t", "in": {"$map": {"input": "$tags", "as": "u", "in": {"$concat": ["$$t", "$$u"]}}}}}, [["xx", "xy"], ["yx", "yy"]]),
        ({"$objectToArray": {"k": "v"}}, [{"k": "k", "v": "v"}]), (["$_id", "z"], ["a", "z"]), ({"$lt": [None, 1]}, True), ({"$eq": ["1", 1]}, False), ({"$type": "$qty"}, "long"),
        ({"$filter": {"input": [1, 5, 9], "as": "n", "cond": {"$gt": ["$$n", "$qty"]}}}, [5, 9]), ({"$sortArray": {"input": [{"a": 2}, {"a": 1}], "sortBy": {"a": 1}}}, [{"a": 1}, {"a": 2}]),
    ],
)
def test_expressions(engine, expression, want):
    assert value(engine, expression) == want


def test_exclusion_keeps_the_rest(engine):
    (r,) = rows(engine, "sales", {"$match": {"_id": "a"}}, {"$project": {"tags": 0, "meta.code": 0}})
    assert "tags" not in r and r["meta"] == {"src": "web"} and r["amount"] == 10.0


def test_stages_run_in_order(engine):
    assert rows(engine, "sales", {"$sort": {"amount": 1}}, {"$limit": 2}, {"$match": {"amount": {"$gt": 0}}}, {"$project": {"_id": 1}}) == [{"_id": "c"}]
    assert rows(engine, "sales", {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 5}}}) == []


def test_first_follows_the_sort_through_a_projection(engine):
    got = rows(engine, "sales", {"$sort": {"amount": -1}}, {"$project": {"qty": 1}}, {"$group": {"_id": None, "f": {"$first": "$qty"}, "p": {"$push": "$qty"}}})
    assert got == [{"_id": None, "f": 2, "p": [2, 7, 0]}]


def test_unwind_keeps_and_counts(engine):
    got = rows(engine, "sales", {"$unwind": {"path": "$tags", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}}, {"$project": {"tags": 1, "i": 1}})
    assert sorted((r["_id"], r["tags"], r["i"]) for r in got if r["tags"]) == [("a", "x", 0), ("a", "y", 1), ("c", "y", 0)]
    assert [r for r in got if r["_id"] == "b"] == [{"_id": "b", "tags": None, "i": None}]


def test_add_fields_sees_the_input(engine):
    (r,) = rows(engine, "sales", {"$match": {"_id": "a"}}, {"$addFields": {"qty": {"$add": ["$qty", 1]}, "old": "$qty", "meta.new": 5}}, {"$project": {"qty": 1, "old": 1, "meta": 1}})
    assert (r["qty"], r["old"], r["meta"]) == (3, 2, {"code": None, "src": "web", "new": 5})


def test_graph_lookup_levels_and_cycles(engine):
    got = rows(engine, "staff", {"$match": {"_id": 1}}, {"$graphLookup": {"from": "staff", "startWith": "$_id", "connectFromField": "_id", "connectToField": "boss", "as": "below", "depthField": "d"}})
    assert sorted((b["_id"], b["d"]) for b in got[0]["below"]) == [(2, 0), (3, 1), (4, 1)]
    got = rows(engine, "staff", {"$match": {"_id": 1}}, {"$graphLookup": {"from": "staff", "startWith": "$_id", "connectFromField": "_id", "connectToField": "boss", "as": "below", "maxDepth": 0}})
    assert [b["_id"] for b in got[0]["below"]] == [2]


def test_lookup_by_array_keeps_repeated_rows(spark):
    catalog = Catalog(spark)
    catalog.register("l", spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "_id int, k array<string>"))
    catalog.register("f", spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "k string, v int"))
    catalog.register("g", spark.createDataFrame([(["x", "y"], 1), (["x", "y"], 1), (["q"], 2)], "k array<string>, v int"))
    for other, want in (("f", [1, 1, 2]), ("g", [1, 1])):
        got = rows(Engine(spark, catalog), "l", {"$lookup": {"from": other, "localField": "k", "foreignField": "k", "as": "m"}})
        assert {r["_id"]: sorted(m["v"] for m in r["m"]) for r in got} == {1: want, 2: []}


def test_group_merges_the_fields_of_all_documents(spark, tmp_path):
    docs = [{"g": 1, "n": 1, "d": {"a": 1, "b": 2}}, {"g": 1, "n": 2, "d": {"b": 3, "e": {"x": 1}}}, {"g": 1, "n": 3, "d": None}, {"g": 1, "n": 4, "d": {"c": 4, "e": None}}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, docs)))
    catalog = Catalog(spark)
    catalog.load("m", str(tmp_path / "m.json"), "documents")
    catalog.register("t", spark.read.json(str(tmp_path / "m.json")))
    merge = {"$group": {"_id": "$g", "o": {"$mergeObjects": "$d"}}}
    for coll, up, want in (("m", 1, (1, 3, 4, None)), ("m", -1, (1, 2, 4, {"x": 1})), ("t", 1, (1, 3, 4, {"x": 1})), ("t", -1, (1, 2, 4, {"x": 1}))):
        (r,) = rows(Engine(spark, catalog), coll, {"$sort": {"n": up}}, merge)
        assert tuple(r["o"][k] for k in "abce") == want
    (r,) = rows(Engine(spark, catalog), "t", merge)
    assert r["o"]["a"] == 1 and r["o"]["c"] == 4
    with pytest.raises(UnsupportedOperatorError):
        rows(Engine(spark, catalog), "t", {"$group": {"_id": "$g", "o": {"$mergeObjects": "$n"}}})


def test_lookup_of_arrays_and_nulls(engine):
    got = rows(engine, "staff", {"$lookup": {"from": "staff", "localField": "boss", "foreignField": "_id", "as": "b"}}, {"$project": {"n": {"$size": "$b"}}})
    assert {r["_id"]: r["n"] for r in got} == {1: 0, 2: 1, 3: 1, 4: 1}


def test_merge_modes(engine, spark):
    spark.sql("DROP TABLE IF EXISTS target")
    rows(engine, "staff", {"$match": {"_id": {"$lte": 2}}}, {"$out": "target"})
    assert spark.table("target").count() == 2
    new = [{"$project": {"name": {"$concat": ["$name", "!"]}, "extra": {"$literal": 1}}}]
    rows(engine, "staff", *new, {"$merge": {"into": "target", "whenMatched": "merge", "whenNotMatched": "insert"}})
    got = {r["_id"]: (r["name"], r["boss"], r["extra"]) for r in spark.table("target").collect()}
    assert got == {1: ("A!", None, 1), 2: ("B!", 1, 1), 3: ("C!", None, 1), 4: ("D!", None, 1)}
    rows(engine, "staff", {"$merge": {"into": "target", "whenMatched": "keepExisting"}})
    assert {r["_id"]: r["name"] for r in spark.table("target").collect()}[1] == "A!"
    with pytest.raises(MergeConflictError):
        rows(engine, "staff", {"$merge": {"into": "target", "whenMatched": "fail"}})


def test_malformed_pipelines(engine):
    for stages in ([{"$match": {}}], [{"$limit": 0}], [{"$limit": 1, "$skip": 1}], [{"$group": {"n": {"$sum": 1}}}], [{"$count": "$x"}], [{"$sort": {"a": 0}}], [{"$bucket": {"groupBy": "$a", "boundaries": [1]}}], [{"$project": {"a": 1, "b": 0}}]):
        with pytest.raises(ValidationError):
            engine.aggregate("sales", stages)
    for stages in ([{"$nope": 1}], [{"$project": {"a": {"$nope": 1}}}], [{"$match": {"a": {"$nope": 1}}}]):
        with pytest.raises(UnsupportedOperatorError):
            engine.aggregate("sales", stages)


def test_own_stage(engine):
    engine.register_stage("$firstOnly", lambda df, spec, ctx: (df.limit(spec), ctx))
    assert len(rows(engine, "sales", {"$firstOnly": 1})) == 1


def test_stream_and_command_line(engine, spark, tmp_path, capsys):
    from pipeloom.streaming.pipelines import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1}\n{"a": 5}\n')
    out = stream(engine, spark.readStream.schema("a long").json(str(tmp_path / "in")), [{"$match": {"a": {"$gt": 2}}}, {"$addFields": {"b": {"$add": ["$a", 1]}}}])
    q = out.writeStream.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["a"], r["b"]) for r in spark.table("out").collect()] == [(5, 6)]
    (tmp_path / "p.json").write_text('{"pipelines": [{"name": "n", "collection": "t", "pipeline": [{"$match": {"a": 5}}]}]}')
    assert main(["-t", f"t={tmp_path}/in/a.json", str(tmp_path / "p.json")]) == 0
    assert '{"a":5}' in capsys.readouterr().out
    table = ["-t", f"t={tmp_path}/in/a.json", "-c", "t"]
    assert main([*table, "-i", "-p", "--verbose", "--pipeline", '{"pipeline": [{"$match": {"a": 5}}, {"$setWindowFields": {"output": {"n": {"$count": {}}}}}]}']) == 0
    said = capsys.readouterr()
    assert '"a": 5' in said.out and "one task" in said.err
    assert main(["-v"]) == 0 and "pipeloom" in capsys.readouterr().out and main(["--help"]) == 0 and main(["--nope"]) == 1
    assert main([*table, "--pipeline", '[{"$match": {"a": {"$gte": 1}}}, {"$project": {"x": {"$convert": {"input": "$a", "to": "int"}}}}]', "-o", str(tmp_path / "o.json")]) == 0 and len((tmp_path / "o.json").read_text().splitlines()) == 2
    assert main([*table, "--strict", "--pipeline", '[{"$bucket": {"groupBy": "$a", "boundaries": [0, 2]}}]']) == 3
    assert main([*table, "--pipeline", '[{"$bucket": {"groupBy": "$a", "boundaries": [0, 2]}}]']) == 0
    assert main([]) == 1 and main(["-t", f"t={tmp_path}/in/a.json", "-c", "t", "--pipeline", '[{"$nope": 1}]']) == 2


def plan(engine, coll, *stages, mode="executedPlan"):
    return getattr(engine.aggregate(coll, list(stages))._jdf.queryExecution(), mode)().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    spark.range(1000).selectExpr("id as _id", "id % 7 as g", "cast(id as double) as x", "concat('s', id) as s", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as at", "if(id % 5 = 0, null, id) as n").write.parquet(path)
    catalog = Catalog(spark)
    catalog.load("t", path)
    return Engine(spark, catalog)


@pytest.mark.parametrize(
    ("query", "pushed"),
    [
        ({"g": 3}, "EqualTo(g,3)"), ({"x": {"$gt": 5}}, "GreaterThan(x,5.0)"), ({"x": {"$gte": 5, "$lt": 9}}, "LessThan(x,9.0)"), ({"s": {"$in": ["s1", "s2"]}}, "In(s, [s1,s2])"),
        ({"$and": [{"g": 1}, {"x": {"$lte": 2}}]}, "LessThanOrEqual(x,2.0)"), ({"$or": [{"g": 1}, {"x": {"$gt": 900}}]}, "Or(EqualTo(g,1),GreaterThan(x,900.0))"), ({"g": {"$ne": 3}}, "Not(EqualNullSafe(g,3))"),
        ({"n": {"$nin": [3, 4]}}, "Or(Not(In(n, [3,4])),IsNull(n))"), ({"n": None}, "IsNull(n)"), ({"at": {"$gte": {"$date": "2024-02-01T00:00:00Z"}}}, "GreaterThanOrEqual(at,2024-02-01"), ({"at": {"$lt": "2024-02-01"}}, "LessThan(at,2024-02-01"),
        ({"$expr": {"$and": [{"$gt": ["$x", 5]}, {"$lt": [3, "$g"]}]}}, "GreaterThan(x,5.0)"), ({"$expr": {"$lt": ["$n", 9]}}, "Or(LessThan(n,9),IsNull(n))"),
    ],
)
def test_filters_reach_the_scan(stored, query, pushed):
    text = plan(stored, "t", {"$match": query})
    assert pushed in text.replace("PushedFilters", "").split("ReadSchema")[0] or pushed in text


def test_filters_and_null(stored):
    n = lambda q: rows(stored, "t", {"$match": q}, {"$count": "n"})[0]["n"]
    assert n({"n": {"$ne": 1}}) == 999 and n({"n": {"$nin": [1, 2]}}) == 998 and n({"n": {"$nin": [1, None]}}) == 799 and n({"n": {"$in": [1, None]}}) == 201
    assert n({"n": {"$not": {"$gt": 10}}}) == 208 and n({"$nor": [{"n": {"$gt": 10}}]}) == 208 and n({"$nor": [{"$and": [{"n": {"$gt": 10}}, {"g": {"$gte": 0}}]}]}) == 208
    assert n({"$expr": {"$lt": ["$n", 10]}}) == 208 and n({"$expr": {"$not": [{"$lt": ["$n", 10]}]}}) == 792 and n({"n": {"$type": ["long", "null"]}}) == 1000


def test_no_sort_below_a_group(stored):
    for acc in ("$first", "$last", "$push"):
        assert "rangepartitioning" not in plan(stored, "t", {"$sort": {"x": -1}}, {"$group": {"_id": "$g", "v": {acc: "$s"}}})
    assert "TakeOrderedAndProject" in plan(stored, "t", {"$sort": {"x": -1}}, {"$limit": 3})
    assert [r["_id"] for r in rows(stored, "t", {"$sort": {"x": -1}}, {"$project": {"g": 1, "_id": 1}}, {"$match": {"_id": {"$lt": 4}}})] == [3, 2, 1, 0]


def test_order_outlives_a_lookup(stored):
    got = rows(stored, "t", {"$match": {"_id": {"$lt": 9}}}, {"$sort": {"x": -1}}, {"$lookup": {"from": "t", "localField": "g", "foreignField": "_id", "as": "m"}}, {"$project": {"_id": 1}})
    assert [r["_id"] for r in got] == [*range(8, -1, -1)]


def test_bucket_auto_is_dealt_by_range(stored):
    text = plan(stored, "t", {"$bucketAuto": {"groupBy": "$s", "buckets": 4}}, mode="optimizedPlan")
    assert "Window [sum" not in text or "__range" in text
    got = rows(stored, "t", {"$bucketAuto": {"groupBy": "$n", "buckets": 4}})
    assert [r["count"] for r in got] == [250, 250, 250, 250] and got[0]["_id"]["min"] is None and sum(r["count"] for r in got) == 1000


def test_graph_lookup_of_depth_0_is_a_join(stored):
    text = plan(stored, "t", {"$graphLookup": {"from": "t", "startWith": "$g", "connectFromField": "g", "connectToField": "_id", "as": "m", "maxDepth": 0}})
    assert "Scan ExistingRDD" not in text and "checkpoint" not in text.lower()


def test_array_lookups_by_join_and_count(spark):
    catalog = Catalog(spark)
    catalog.register("l", spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["z"]), (3, None), (4, [])], "_id int, k array<string>"))
    catalog.register("f", spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 9)], "k string, v int"))
    e, look = Engine(spark, catalog), {"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "m"}}
    joined = rows(e, "l", look, {"$unwind": "$m"})
    assert sorted((r["_id"], r["m"]["v"]) for r in joined) == [(1, 1), (1, 1), (1, 2), (3, 9)]
    kept = rows(e, "l", look, {"$unwind": {"path": "$m", "preserveNullAndEmptyArrays": True}})
    assert sorted((r["_id"], r["m"] and r["m"]["v"]) for r in kept if r["_id"] in (2, 3)) == [(2, None), (3, 9)] and len(kept) == 6
    assert {r["_id"]: r["n"] for r in rows(e, "l", look, {"$project": {"n": {"$size": "$m"}}})} == {1: 3, 2: 0, 3: 1, 4: 0}
    (r,) = rows(e, "l", {"$match": {"_id": 1}}, {"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "a.b"}})
    assert len(r["a"]["b"]) == 3


def test_frames_of_the_calendar(spark):
    t = spark.sql("select * from values (1, timestamp'2024-01-31 00:00:00', 1), (1, timestamp'2024-02-29 00:00:00', 2), (1, timestamp'2024-03-30 12:00:00', null), (1, timestamp'2024-03-30 12:00:00.5', 8) as t(g, at, v)")
    e = Engine(spark, {"w": t})

    def over(how, window, sort=1):
        got = rows(e, "w", {"$setWindowFields": {"partitionBy": "$g", "sortBy": {"at": sort}, "output": {"o": how | {"window": window}}}})
        return [r["o"] for r in sorted(got, key=lambda r: r["at"])]

    assert over({"$sum": "$v"}, {"range": [-1, "current"], "unit": "month"}) == [1, 3, 0, 8] and over({"$count": {}}, {"range": [-1, 0], "unit": "quarter"}) == [1, 2, 3, 4]
    assert over({"$push": "$v"}, {"range": ["unbounded", "current"], "unit": "year"})[3] == [1, 2, None, 8] and over({"$sum": "$v"}, {"range": [0, 1], "unit": "month"}) == [3, 2, 8, 8]
    assert over({"$sum": "$v"}, {"range": [-1, "current"], "unit": "month"}, -1)[0] == 3
    assert over({"$count": {}}, {"range": [-500, "current"], "unit": "millisecond"}) == [1, 1, 1, 2] and over({"$count": {}}, {"range": [-499, "current"], "unit": "millisecond"}) == [1, 1, 1, 1]
    with pytest.raises(ValidationError):
        over({"$count": {}}, {"range": [-1, 0], "unit": "moon"})


def test_null_in_sets_and_windows(spark):
    e = Engine(spark, {"w": spark.createDataFrame([(1, None), (1, 2), (1, None), (2, 3)], "g int, v int")})
    assert {r["_id"]: r["s"] for r in rows(e, "w", {"$group": {"_id": "$g", "s": {"$addToSet": "$v"}}})} == {1: [None, 2], 2: [3]}
    got = rows(e, "w", {"$setWindowFields": {"partitionBy": "$g", "output": {"p": {"$push": "$v"}, "s": {"$addToSet": "$v"}}}})
    assert all(sorted(r["p"], key=str) == ([2, None, None] if r["g"] == 1 else [3]) and r["s"] == ([None, 2] if r["g"] == 1 else [3]) for r in got)


def test_bytes_and_characters(engine):
    assert value(engine, {"$substrBytes": ["éab", 2, 2]}) == "ab" and value(engine, {"$substrCP": ["éab", 1, 2]}) == "ab"
    assert value(engine, {"$indexOfBytes": ["éab", "b"]}) == 3 and value(engine, {"$indexOfCP": ["éab", "b"]}) == 2
    assert value(engine, {"$indexOfBytes": ["éabéa", "é", 1]}) == 4 and value(engine, {"$indexOfBytes": ["abc", "x"]}) == -1 and value(engine, {"$indexOfBytes": ["abcb", "b", 2, 3]}) == -1


def test_a_crash_between_renames_loses_nothing(spark):
    from pipeloom.sources import sinks

    for t in ("kept", "kept__old", "kept__new"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.range(3).write.saveAsTable("kept__old")  # as after a crash before the new table got its name
    e = Engine(spark, {"src": spark.range(5)})
    rows(e, "src", {"$merge": {"into": "kept", "on": "id"}})
    assert spark.table("kept").count() == 5 and not spark.catalog.tableExists("kept__old")
    spark.range(9).write.saveAsTable("kept__old")  # as after a crash before the old one was dropped
    sinks.recover(spark, "kept")
    assert spark.table("kept").count() == 5 and not spark.catalog.tableExists("kept__old")


def test_warnings(stored):
    got = stored.compile("t", [{"$facet": {"a": [{"$limit": 1}]}}])
    assert any("facet" in w for w in got.warnings) and stored.compile("t", [{"$limit": 1}]).warnings == []
    assert stored.compile("t", [{"$setWindowFields": {"output": {"n": {"$count": {}}}}}]).warnings
    assert stored.compile("t", [{"$lookup": {"from": "t", "let": {"k": "$g"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$_id", "$$k"]}}}], "as": "m"}}]).warnings


def test_file_formats(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for form in ("parquet", "orc", "json", "csv"):
        t.write.format(form).option("header", True).save(str(tmp_path / f"t.{form}"))
        catalog = Catalog(spark)
        catalog.load("t", str(tmp_path / f"t.{form}"), **({"inferSchema": True} if form == "csv" else {}))
        assert rows(Engine(spark, catalog), "t", {"$match": {"k": 2}}, {"$project": {"_id": 0, "v": 1}}) == [{"v": "b"}]


def test_groups_of_a_stream(spark, tmp_path):
    from pipeloom.streaming.pipelines import windowed_group

    (tmp_path / "a.json").write_text("\n".join(f'{{"at": "2024-01-01T00:0{m}:00Z", "k": "{k}"}}' for m, k in ((0, "x"), (1, "x"), (6, "y"), (9, "x"))))
    frame = spark.readStream.schema("at timestamp, k string").json(str(tmp_path))
    q = windowed_group(frame, "at", "5 minutes", {"_id": "$k", "n": {"$sum": 1}}).writeStream.format("memory").outputMode("complete").queryName("groups").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["_id"], r["start"].minute, r["n"]) for r in spark.table("groups").collect()) == [("x", 0, 2), ("x", 5, 1), ("y", 5, 1)]


def test_ranges_of_fractions(spark):
    e = Engine(spark, Catalog(spark, {"t": spark.createDataFrame([(1, 1.0), (2, 1.4), (3, 2.0), (4, None)], "k int, x double")}))

    def counts(by, bounds):
        w = {"sortBy": by, "output": {"n": {"$count": {}, "window": {"range": bounds}}, "s": {"$sum": "$k", "window": {"range": bounds}}}}
        return [(r["k"], r["n"], r["s"]) for r in sorted(e.aggregate("t", [{"$setWindowFields": w}]).collect(), key=lambda r: r["k"])]

    assert counts({"x": 1}, [-0.5, 0]) == [(1, 1, 1), (2, 2, 3), (3, 1, 3), (4, 1, 4)]
    assert counts({"x": -1}, [-0.7, "current"]) == [(1, 2, 3), (2, 2, 5), (3, 1, 3), (4, 1, 4)]
    assert counts({"k": 1}, [0.5, 1.5]) == [(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 0, 0)]
    assert counts({"k": 1}, ["unbounded", 0.5]) == [(1, 1, 1), (2, 2, 3), (3, 3, 6), (4, 4, 10)]


@pytest.mark.parametrize("by, window", [
    ({"k": 1}, {"documents": [-1.5, 0]}), ({"k": 1}, {"documents": [2, -2]}), ({"k": 1}, {"range": ["current", -0.5]}), ({"k": 1}, {"documents": ["first", 0]}),
    ({}, {"range": [-2, 0]}), ({"k": 1, "x": 1}, {"range": [-2, 0]}), ({"k": 1}, {"range": [0]}), ({"k": 1}, {"documents": [-1, 0], "unit": "month"}),
])
def test_frames_that_are_refused(spark, by, window):
    e = Engine(spark, Catalog(spark, {"t": spark.createDataFrame([(1, 1.0)], "k int, x double")}))
    with pytest.raises(ValidationError, match="BAD_WINDOW"):
        e.aggregate("t", [{"$setWindowFields": {"sortBy": by, "output": {"n": {"$count": {}, "window": window}}}}])


def test_range_over_several_keys_without_numbers(spark):
    e = Engine(spark, Catalog(spark, {"t": spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0)], "k int, x double")}))
    w = {"sortBy": {"k": 1, "x": 1}, "output": {"n": {"$count": {}, "window": {"range": ["unbounded", "current"]}}}}
    assert sorted(r["n"] for r in e.aggregate("t", [{"$setWindowFields": w}]).collect()) == [2, 2, 3]


def test_empty_arrays_take_the_type_they_meet(engine):
    assert value(engine, {"$setUnion": [[2, 1], []]}) == [1, 2]
    assert value(engine, {"$setUnion": [[], [2, 1]]}) == [1, 2]
    assert value(engine, {"$setUnion": [[1], [2.5]]}) == [1.0, 2.5]
    assert value(engine, {"$sum": {"$setUnion": [[1], [2.5]]}}) == 3.5
    assert value(engine, {"$setDifference": [[1, 2], []]}) == [1, 2]
    assert value(engine, {"$concatArrays": [[], ["$qty"], []]}) == [2]
    assert value(engine, {"$reduce": {"input": [1, 2], "initialValue": [], "in": {"$concatArrays": ["$$value", ["$$this"]]}}}) == [1, 2]
    kept = {"$cond": [{"$gt": ["$$this.n", 1]}, {"$concatArrays": ["$$value", ["$$this"]]}, "$$value"]}
    assert value(engine, {"$reduce": {"input": [{"n": 1}, {"n": 2}], "initialValue": [], "in": kept}}) == [{"n": 2}]
    assert value(engine, {"$ifNull": [{"$cond": [True, None, ["$qty"]]}, []]}) == []
    assert value(engine, {"$sum": {"$ifNull": [["$qty", 3], []]}}) == 5
    assert value(engine, {"$cond": [True, ["$qty"], []]}) == [2]
    assert value(engine, {"$switch": {"branches": [{"case": False, "then": []}], "default": [1.5]}}) == [1.5]
    assert value(engine, [[1], []]) == [[1], []]
    assert value(engine, []) == []


def test_formats_of_dates(engine):
    at = {"$toDate": "2024-12-30T03:04:05.678Z"}
    assert value(engine, {"$dateToString": {"date": at, "format": "%d.%m.%Y o'clock [%H]%%%j#%z"}}) == "30.12.2024 o'clock [03]%365#+0000"
    assert value(engine, {"$dateToString": {"date": at}}) == "2024-12-30T03:04:05.678Z"
    assert value(engine, {"$dateToString": {"date": at, "format": "day"}}) == "day"
    with pytest.raises(UnsupportedOperatorError, match="%V"):
        value(engine, {"$dateToString": {"date": at, "format": "%Y-%V"}})
