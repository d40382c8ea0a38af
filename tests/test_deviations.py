"""The survey's list of places where documented and actual behaviour differ (its §0.2, D1 to D39): one test for each, of the documented one."""

from __future__ import annotations

import json

import pytest

from pipeloom import Catalog, Engine, UnsupportedOperatorError, ValidationError
from pipeloom.sources.sinks import MergeConflictError

SALES = [
    {"_id": 1, "g": "a", "x": 10, "when": "2024-01-06T10:00:00Z", "tags": ["p", "q"], "sub": {"u": 1, "v": {"w": 2}}},
    {"_id": 2, "g": "a", "x": 30, "when": "2024-01-07T10:00:00Z", "tags": [], "sub": {"u": 2, "v": None}},
    {"_id": 3, "g": "b", "x": 20, "when": "2024-12-30T10:00:00Z", "tags": ["q"], "sub": None},
]
STAFF = [{"_id": "E1", "boss": None, "pay": 5}, {"_id": "E2", "boss": "E1", "pay": 4}, {"_id": "E3", "boss": "E2", "pay": 3}, {"_id": "E4", "boss": "E2", "pay": 2}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path, catalog = tmp_path_factory.mktemp("deviations"), Catalog(spark)
    for name, docs in (("sales", SALES), ("staff", STAFF)):
        (path / f"{name}.json").write_text("\n".join(map(json.dumps, docs)))
        catalog.load(name, str(path / f"{name}.json"))
    return Engine(spark, catalog)


@pytest.fixture
def run(engine):
    return lambda coll, *stages: [r.asDict(True) for r in engine.aggregate(coll, list(stages)).collect()]


@pytest.fixture
def value(run):
    return lambda x, _id=1: run("sales", {"$match": {"_id": _id}}, {"$project": {"_id": 0, "v": x}})[0]["v"]


def test_D1_pipelines_are_optimised(engine):
    plan = engine.aggregate("sales", [{"$project": {"x": 1}}, {"$match": {"x": {"$gt": 15}}}])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("Filter")  # the filter went below the projection


def test_D2_strict_is_read(engine):
    strict = Engine(engine.spark, engine.catalog, strict=True)
    stage = [{"$bucket": {"groupBy": "$x", "boundaries": [0, 15]}}]
    assert {r["_id"] for r in engine.aggregate("sales", stage).collect()} == {0, None}
    with pytest.raises(Exception, match="outside the boundaries"):
        strict.aggregate("sales", stage).collect()


def test_D3_unset_drops(run):
    assert set(run("sales", {"$unset": ["tags", "sub", "when"]})[0]) == {"_id", "g", "x"}


def test_D4_stages_run_in_order(run):
    assert run("sales", {"$sort": {"x": -1}}, {"$limit": 2}, {"$sort": {"x": 1}}, {"$limit": 1}, {"$project": {"_id": 1}}) == [{"_id": 3}]


def test_D5_match_after_group_filters_groups(run):
    assert run("sales", {"$group": {"_id": "$g", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 1}}}) == [{"_id": "a", "n": 2}]


def test_D6_graph_lookup_goes_deep(run):
    (r,) = run("staff", {"$match": {"_id": "E1"}}, {"$graphLookup": {"from": "staff", "startWith": "$_id", "connectFromField": "_id", "connectToField": "boss", "as": "below"}})
    assert sorted(b["_id"] for b in r["below"]) == ["E2", "E3", "E4"]


def test_D7_exclusion_keeps_the_rest(run):
    assert set(run("sales", {"$project": {"x": 0, "sub": 0}})[0]) == {"_id", "g", "when", "tags"}


def test_D8_upper_bound_unbounded_is_following(run):
    got = run("sales", {"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"s": {"$sum": "$x", "window": {"documents": ["current", "unbounded"]}}}}})
    assert {r["_id"]: r["s"] for r in got} == {1: 60, 2: 50, 3: 20}


def test_D9_shift_by_and_default(run):
    got = run("sales", {"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"s": {"$shift": {"output": "$x", "by": 2, "default": -1}}}}})
    assert {r["_id"]: r["s"] for r in got} == {1: 20, 2: -1, 3: -1}


def test_D10_bucket_auto_outputs_have_their_own_arguments(run):
    got = run("sales", {"$bucketAuto": {"groupBy": "$x", "buckets": 1, "output": {"ids": {"$sum": "$_id"}, "all": {"$push": "$g"}}}})
    assert got[0]["ids"] == 6 and sorted(got[0]["all"]) == ["a", "a", "b"]


def test_D11_convert_to_and_on_error(value):
    assert value({"$convert": {"input": "12", "to": "int"}}) == 12 and value({"$convert": {"input": "x", "to": "int", "onError": -1}}) == -1 and value({"$convert": {"input": None, "to": "int", "onNull": 0}}) == 0


def test_D12_log10(value):
    assert value({"$log10": 1000}) == pytest.approx(3)


def test_D13_regex_find_gives_a_document(value):
    assert value({"$regexFind": {"input": "xAB1", "regex": "a(b)", "options": "i"}}) == {"match": "AB", "idx": 1, "captures": ["B"]}


def test_D14_replace_finds_literally(value):
    assert value({"$replaceOne": {"input": "a.b.c", "find": ".", "replacement": {"$literal": "$1"}}}) == "a$1b.c" and value({"$replaceAll": {"input": "a.b.c", "find": ".", "replacement": "-"}}) == "a-b-c"


def test_D15_trims_one_side(value):
    assert value({"$ltrim": {"input": "  x "}}) == "x " and value({"$rtrim": {"input": "  x "}}) == "  x"


def test_D16_weeks_begin_on_sunday(value):
    assert value({"$week": "$when"}) == 0 and value({"$week": "$when"}, 2) == 1 and value({"$isoWeek": "$when"}, 3) == 1


def test_D17_empty_arrays_are_arrays(value):
    assert value({"$isArray": "$tags"}, 2) is True and value({"$isArray": "$x"}) is False


def test_D18_first_and_last_follow_the_sort(run):
    (r,) = run("sales", {"$sort": {"x": -1}}, {"$group": {"_id": None, "f": {"$first": "$_id"}, "l": {"$last": "$_id"}}})
    assert (r["f"], r["l"]) == (2, 1)


def test_D19_add_to_set_keeps_types(run):
    assert run("sales", {"$group": {"_id": None, "s": {"$addToSet": "$x"}}})[0]["s"] == [10, 20, 30]


def test_D20_merge_objects_is_shallow(value):
    assert value({"$mergeObjects": [{"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": None}]}) == {"a": {"d": 2}, "c": None}


def test_D21_any_and_all_elements(value):
    assert value({"$anyElementTrue": [[0, 1]]}) is True and value({"$allElementsTrue": [[0, 1]]}) is False


def test_D22_set_equals_of_several(value):
    assert value({"$setEquals": [[1, 2], [2, 1], [1, 2, 3]]}) is False


def test_D23_merge_fails_when_told(run, spark):
    spark.sql("DROP TABLE IF EXISTS d23")
    run("staff", {"$match": {"_id": "E1"}}, {"$out": "d23"})
    for how in ({"whenMatched": "fail"}, {"whenNotMatched": "fail"}):
        with pytest.raises(MergeConflictError):
            run("staff", {"$merge": {"into": "d23", **how}})
    assert spark.table("d23").count() == 1


def test_D24_out_replaces(run, spark):
    spark.sql("DROP TABLE IF EXISTS d24")
    for _ in range(2):
        run("staff", {"$out": "d24"})
    assert spark.table("d24").count() == 4


def test_D25_restrict_by_any_query(run):
    (r,) = run("staff", {"$match": {"_id": "E1"}}, {"$graphLookup": {"from": "staff", "startWith": "$_id", "connectFromField": "_id", "connectToField": "boss", "as": "b", "restrictSearchWithMatch": {"pay": {"$gte": 3}}}})
    assert sorted(b["_id"] for b in r["b"]) == ["E2", "E3"]


def test_D26_array_index_begins_at_0(run):
    assert [r["i"] for r in run("sales", {"$match": {"_id": 1}}, {"$unwind": {"path": "$tags", "includeArrayIndex": "i"}})] == [0, 1]


def test_D27_not_takes_a_list(value):
    assert value({"$not": [{"$gt": ["$x", 5]}]}) is False


def test_D28_match_stays_behind_limit_and_renaming(run):
    assert run("sales", {"$sort": {"_id": 1}}, {"$limit": 1}, {"$match": {"x": 30}}) == []
    assert [r["x"] for r in run("sales", {"$project": {"x": {"$multiply": ["$x", 2]}}}, {"$match": {"x": 20}})] == [20]


def test_D29_lookup_gives_an_array(run):
    got = run("staff", {"$lookup": {"from": "staff", "localField": "_id", "foreignField": "boss", "as": "below"}})
    assert {r["_id"]: len(r["below"]) for r in got} == {"E1": 1, "E2": 2, "E3": 0, "E4": 0}


def test_D30_lookup_pipelines_take_any_stage(run):
    got = run("staff", {"$lookup": {"from": "staff", "let": {"k": "$_id"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$boss", "$$k"]}}}, {"$sort": {"pay": 1}}, {"$limit": 1}, {"$project": {"_id": 0, "twice": {"$multiply": ["$pay", 2]}}}], "as": "m"}})
    assert {r["_id"]: r["m"] for r in got} == {"E1": [{"twice": 8}], "E2": [{"twice": 4}], "E3": [], "E4": []}


def test_D31_cond_gives_null(value):
    assert value({"$cond": [True, None, 1]}) is None and value({"$switch": {"branches": [{"case": True, "then": None}], "default": 1}}) is None


def test_D32_replace_with_an_expression(run):
    assert run("sales", {"$match": {"_id": 1}}, {"$replaceWith": {"$mergeObjects": [{"k": "$_id"}, {"z": 1}]}}) == [{"k": 1, "z": 1}]


def test_D33_lists_hold_expressions(value):
    assert value(["$g", {"$toUpper": "$g"}, "lit"]) == ["a", "A", "lit"]


def test_D34_elements_keep_their_types(value):
    assert value({"$concatArrays": [["$x"], [5]]}) == [10, 5] and value({"$map": {"input": [1, 2], "as": "n", "in": {"$add": ["$$n", "$x"]}}}) == [11, 12]


def test_D35_unknown_names_are_errors(engine):
    with pytest.raises(UnsupportedOperatorError):
        engine.aggregate("sales", [{"$project": {"v": {"$noSuch": 1}}}])
    with pytest.raises(UnsupportedOperatorError):
        engine.aggregate("sales", [{"$setWindowFields": {"output": {"v": {"$noSuch": 1}}}}])


def test_D36_any_column_is_a_field(run):
    assert run("sales", {"$match": {"sub.v.w": 2}}, {"$project": {"_id": 0, "u": "$sub.u"}}) == [{"u": 1}]


def test_D37_lookups_meet_on_their_own_types(run):
    (r,) = run("staff", {"$match": {"_id": "E2"}}, {"$lookup": {"from": "staff", "localField": "boss", "foreignField": "_id", "as": "b"}})
    assert [b["_id"] for b in r["b"]] == ["E1"] and run("staff", {"$match": {"_id": 1}}) == []


def test_D38_facets_take_any_stages_in_order(run):
    (r,) = run("sales", {"$match": {"x": {"$gte": 10}}}, {"$facet": {"a": [{"$match": {"x": {"$gt": 10}}}, {"$group": {"_id": "$g", "n": {"$sum": 1}}}, {"$sort": {"_id": -1}}, {"$limit": 1}], "b": [{"$sort": {"_id": 1}}, {"$skip": 1}, {"$project": {"_id": 1}}], "c": [{"$unwind": "$tags"}, {"$count": "n"}]}})
    assert r["a"] == [{"_id": "b", "n": 1}] and r["b"] == [{"_id": 2}, {"_id": 3}] and r["c"] == [{"n": 3}]


def test_D39_fields_of_facet_elements_and_compound_ids(run):
    (r,) = run("sales", {"$facet": {"f": [{"$group": {"_id": {"g": "$g", "big": {"$gt": ["$x", 15]}}, "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}]}}, {"$project": {"first": {"$arrayElemAt": ["$f._id.g", 0]}, "all": "$f._id.big"}})
    assert r["first"] == "a" and r["all"] == [False, True, True]


def test_names_are_checked(engine):
    with pytest.raises(ValidationError):
        engine.aggregate("sales", [{"$project": {"v": "$a..b"}}])
