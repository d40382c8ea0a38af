"""Named pipelines over the driver's tables, each with its equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.catalog import Catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: name -> (collection, pipeline, SQL or None)
DEFINED: dict[str, tuple[str, list, str | None]] = {}


def define(name: str, collection: str, pipeline: list, sql: str | None = None) -> None:
    assert name not in DEFINED, name
    DEFINED[name] = (collection, pipeline, sql)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, _Lazy(spark, sf_dir))


_SCHEMAS: dict[str, object] = {}


class _Lazy(Catalog):
    """The tables of a folder, opened when they are asked for. The tables don't change, so their schemas are read once."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path

    def get(self, name: str) -> DataFrame:
        if name not in self.frames and name in TABLES:
            path = f"{self.path}/{name}.parquet"
            if path not in _SCHEMAS:
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            self.register(name, self.spark.read.schema(_SCHEMAS[path]).parquet(path))
        return super().get(name)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    collection, pipeline, _ = DEFINED[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).aggregate(collection, pipeline)


#: Queries that aren't one pipeline over a table: name -> (function, SQL)
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def other(sql: str):
    def put(f):
        OTHER[f.__name__] = f, sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(n) for n in DEFINED} | {n: f for n, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in DEFINED.items() if sql} | {n: sql for n, (_, sql) in OTHER.items()}


# --- predicates


def _match(name: str, query: dict, where: str, table: str = "orders", keys: str = "o_orderkey") -> None:
    define(f"match_{name}", table, [{"$match": query}, {"$project": {"_id": 0, keys: 1}}], f"SELECT {keys} FROM {table} WHERE {where}")


_match("eq", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_match("eq_operator", {"o_orderstatus": {"$eq": "O"}}, "o_orderstatus = 'O'")
_match("ne", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'")
_match("gt", {"o_totalprice": {"$gt": 300000}}, "o_totalprice > 300000")
_match("gte_lt", {"o_totalprice": {"$gte": 100000, "$lt": 150000}}, "o_totalprice >= 100000 AND o_totalprice < 150000")
_match("lte", {"o_custkey": {"$lte": 50}}, "o_custkey <= 50")
_match("date_range", {"o_orderdate": {"$gte": {"$date": "1997-01-01T00:00:00Z"}, "$lt": {"$date": "1998-01-01T00:00:00Z"}}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_match("in", {"o_orderstatus": {"$in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P')")
_match("nin", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'P')")
_match("and", {"$and": [{"o_orderstatus": "F"}, {"o_custkey": {"$gt": 700}}]}, "o_orderstatus = 'F' AND o_custkey > 700")
_match("or", {"$or": [{"o_orderstatus": "F"}, {"o_custkey": {"$gt": 700}}]}, "o_orderstatus = 'F' OR o_custkey > 700")
_match("nor", {"$nor": [{"o_orderstatus": "F"}, {"o_custkey": {"$gt": 700}}]}, "NOT (o_orderstatus = 'F' OR o_custkey > 700)")
_match("not_field", {"o_totalprice": {"$not": {"$gt": 200000}}}, "NOT coalesce(o_totalprice > 200000, false)")
_match("not_top", {"$not": {"o_orderstatus": "F"}}, "o_orderstatus <> 'F'")
_match("exists", {"o_orderstatus": {"$exists": True}}, "true")
_match("exists_not", {"nothing": {"$exists": False}}, "true")
_match("null", {"o_orderstatus": None}, "o_orderstatus IS NULL")
_match("ne_null", {"o_orderstatus": {"$ne": None}}, "o_orderstatus IS NOT NULL")
_match("missing_is_null", {"nothing": None}, "true")
_match("expr", {"$expr": {"$gt": ["$o_totalprice", {"$multiply": ["$o_custkey", 500]}]}}, "o_totalprice > o_custkey * 500")
_match("expr_and", {"$expr": {"$and": [{"$eq": ["$o_orderstatus", "F"]}, {"$lt": [{"$year": "$o_orderdate"}, 1996]}]}}, "o_orderstatus = 'F' AND year(o_orderdate) < 1996")
_match("several_fields", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_match("unlike_types", {"o_totalprice": {"$gt": "100"}}, "false")
_match("regex", {"c_name": {"$regex": "7$"}}, "c_name LIKE '%7'", "customer", "c_custkey")
_match("mod", {"c_custkey": {"$mod": [7, 3]}}, "c_custkey % 7 = 3", "customer", "c_custkey")
_match("type", {"o_totalprice": {"$type": "double"}}, "true")

# --- stages

define(
    "pricing_summary", "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": {"$date": "1998-09-02T00:00:00Z"}}}},
        {"$group": {"_id": {"returnflag": "$l_returnflag", "linestatus": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_base_price": {"$sum": "$l_extendedprice"},
                    "sum_disc_price": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_disc": {"$avg": "$l_discount"}, "count_order": {"$sum": 1}}},
        {"$project": {"_id": 0, "returnflag": "$_id.returnflag", "linestatus": "$_id.linestatus", "sum_qty": {"$round": ["$sum_qty", 2]}, "sum_base_price": {"$round": ["$sum_base_price", 2]}, "sum_disc_price": {"$round": ["$sum_disc_price", 2]}, "avg_disc": {"$round": ["$avg_disc", 4]}, "count_order": 1}},
        {"$sort": {"returnflag": 1, "linestatus": 1}},
    ],
    """SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
define("project_include", "part", [{"$project": {"_id": 0, "p_partkey": 1, "p_brand": 1}}], "SELECT p_partkey, p_brand FROM part")
define("project_exclude", "part", [{"$project": {"p_name": 0, "p_retailprice": 0}}], "SELECT p_partkey, p_brand, p_type, p_size FROM part")
define("project_rename", "part", [{"$project": {"_id": 0, "key": "$p_partkey", "size": "$p_size"}}], "SELECT p_partkey AS key, p_size AS size FROM part")
define("project_nested", "customer", [{"$project": {"_id": 0, "c_custkey": 1, "who.name": "$c_name", "who.seg": "$c_mktsegment"}}, {"$project": {"c_custkey": 1, "seg": "$who.seg"}}], "SELECT c_custkey, c_mktsegment AS seg FROM customer")
define("add_fields", "lineitem", [{"$addFields": {"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}}, {"$project": {"_id": 0, "l_orderkey": 1, "l_linenumber": 1, "net": 1}}], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
define("set_alias", "customer", [{"$set": {"rich": {"$gt": ["$c_acctbal", 5000]}}}, {"$project": {"_id": 0, "c_custkey": 1, "rich": 1}}], "SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer")
define("unset", "customer", [{"$unset": ["c_name", "c_acctbal"]}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
define("sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 10}, {"$project": {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
define("sort_skip_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 20}, {"$limit": 5}, {"$project": {"_id": 0, "o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20")
define("match_after_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$limit": 50}, {"$match": {"o_orderstatus": "F"}}, {"$project": {"_id": 0, "o_orderkey": 1}}], "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderstatus = 'F'")
define("count", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
define("count_empty", "orders", [{"$match": {"o_orderkey": -5}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderkey = -5 HAVING count(*) > 0")
define("sample", "orders", [{"$sample": {"size": 25}}, {"$count": "n"}], "SELECT 25::BIGINT AS n")
define("replace_root", "customer", [{"$replaceRoot": {"newRoot": {"k": "$c_custkey", "seg": {"$toLower": "$c_mktsegment"}}}}], "SELECT c_custkey AS k, lower(c_mktsegment) AS seg FROM customer")
define("replace_with", "customer", [{"$replaceWith": {"k": "$c_custkey", "doc": {"n": "$c_name"}}}, {"$replaceWith": "$doc"}], "SELECT c_name AS n FROM customer")
define("union_with", "nation", [{"$project": {"_id": 0, "name": "$n_name"}}, {"$unionWith": {"coll": "region", "pipeline": [{"$project": {"_id": 0, "name": "$r_name"}}]}}], "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
define("union_group", "customer", [{"$project": {"_id": 0, "k": "$c_nationkey", "bal": "$c_acctbal"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"_id": 0, "k": "$s_nationkey", "bal": "$s_acctbal"}}]}}, {"$group": {"_id": "$k", "n": {"$sum": 1}, "most": {"$max": "$bal"}}}], "SELECT k AS _id, count(*) AS n, max(bal) AS most FROM (SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY k")
define("union_missing_fields", "nation", [{"$unionWith": "region"}, {"$match": {"r_name": {"$ne": None}}}, {"$project": {"_id": 0, "r_name": 1, "n_name": 1}}], "SELECT r_name, NULL::VARCHAR AS n_name FROM region")
define("unwind", "part", [{"$project": {"_id": 0, "p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}], "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
define("unwind_index", "part", [{"$project": {"_id": 0, "p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}], "SELECT p_partkey, w, i::BIGINT AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)")
define("unwind_preserve", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$addFields": {"big": {"$filter": {"input": "$o", "as": "x", "cond": {"$gt": ["$$x.o_totalprice", 400000]}}}}}, {"$unwind": {"path": "$big", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 0, "c_custkey": 1, "o": "$big.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey")
define("redact", "customer", [{"$redact": {"$cond": [{"$gt": ["$c_acctbal", 0]}, "$$KEEP", "$$PRUNE"]}}, {"$project": {"_id": 0, "c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
define("redact_descend", "customer", [{"$project": {"_id": 0, "level": {"$literal": 1}, "c_custkey": 1, "inner": {"level": {"$mod": ["$c_custkey", 3]}, "name": "$c_name"}}}, {"$redact": {"$cond": [{"$lte": ["$level", 1]}, "$$DESCEND", "$$PRUNE"]}}, {"$project": {"c_custkey": 1, "name": "$inner.name"}}], "SELECT c_custkey, CASE WHEN c_custkey % 3 <= 1 THEN c_name END AS name FROM customer")
define("bucket", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [1, 10, 25, 40], "default": -1, "output": {"n": {"$sum": 1}, "price": {"$max": "$p_retailprice"}}}}], "SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN 1 WHEN p_size >= 10 AND p_size < 25 THEN 10 WHEN p_size >= 25 AND p_size < 40 THEN 25 ELSE -1 END AS _id, count(*) AS n, max(p_retailprice) AS price FROM part GROUP BY 1")
define("bucket_default_output", "part", [{"$bucket": {"groupBy": "$p_retailprice", "boundaries": [0, 1000, 1500, 3000]}}], "SELECT CASE WHEN p_retailprice >= 0 AND p_retailprice < 1000 THEN 0 WHEN p_retailprice < 1500 THEN 1000 WHEN p_retailprice < 3000 THEN 1500 END AS _id, count(*) AS count FROM part GROUP BY 1")
define("bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_orderkey", "buckets": 5, "output": {"n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}}, {"$project": {"_id": 0, "lo": "$_id.min", "hi": "$_id.max", "n": 1, "total": {"$round": ["$total", 2]}}}], "SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo), top) AS hi, n, total FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS top, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, ntile(5) OVER (ORDER BY o_orderkey) AS b FROM orders) GROUP BY b)")
define("sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "SELECT o_orderpriority AS _id, count(*) AS count FROM orders GROUP BY 1")
define("facet", "orders", [{"$facet": {"status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}], "total": [{"$count": "n"}], "top": [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 3}, {"$project": {"_id": 0, "o_orderkey": 1}}]}}, {"$project": {"first_status": {"$arrayElemAt": ["$status._id", 0]}, "statuses": {"$size": "$status"}, "total": {"$arrayElemAt": ["$total.n", 0]}, "best": {"$arrayElemAt": ["$top.o_orderkey", 0]}}}], "SELECT min(o_orderstatus) AS first_status, count(DISTINCT o_orderstatus)::INT AS statuses, count(*) AS total, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM orders")
define("facet_skip", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$facet": {"page": [{"$sort": {"o_orderkey": 1}}, {"$skip": 10}, {"$limit": 5}, {"$project": {"_id": 0, "o_orderkey": 1}}], "meta": [{"$group": {"_id": None, "n": {"$sum": 1}}}]}}, {"$unwind": "$page"}, {"$project": {"k": "$page.o_orderkey", "n": {"$arrayElemAt": ["$meta.n", 0]}}}], "SELECT o_orderkey AS k, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5 OFFSET 10")

# --- groups and accumulators


def _acc(name: str, acc: dict, sql: str, table: str = "orders", by: str = "o_orderstatus", before: list | None = None, after: list | None = None) -> None:
    define(f"acc_{name}", table, [*(before or []), {"$group": {"_id": f"${by}", "v": acc}}, *(after or [])], sql if sql.startswith(("SELECT", "WITH")) else f"SELECT {by} AS _id, {sql} AS v FROM {table} GROUP BY 1")


_ROUND = [{"$project": {"v": {"$round": ["$v", 2]}}}]
_acc("sum", {"$sum": "$o_totalprice"}, "round(sum(o_totalprice), 2)", after=_ROUND)
_acc("sum_int", {"$sum": "$o_custkey"}, "sum(o_custkey)::BIGINT")
_acc("sum_of_no_numbers", {"$sum": "$o_orderpriority"}, "0::DOUBLE")
_acc("avg", {"$avg": "$o_totalprice"}, "round(avg(o_totalprice), 2)", after=_ROUND)
_acc("count", {"$count": {}}, "count(*)")
_acc("min", {"$min": "$o_totalprice"}, "min(o_totalprice)")
_acc("max_text", {"$max": "$o_orderpriority"}, "max(o_orderpriority)")
_acc("first", {"$first": "$o_orderkey"}, "arg_min(o_orderkey, (o_totalprice, o_orderkey))", before=[{"$sort": {"o_totalprice": 1, "o_orderkey": 1}}])
_acc("last", {"$last": "$o_orderkey"}, "arg_min(o_orderkey, (-o_totalprice, -o_orderkey))", before=[{"$sort": {"o_totalprice": 1, "o_orderkey": 1}}])
_acc("first_mixed", {"$first": "$o_orderkey"}, "arg_min(o_orderkey, (o_orderpriority, -o_orderkey))", before=[{"$sort": {"o_orderpriority": 1, "o_orderkey": -1}}])
_acc("push", {"$push": "$o_orderkey"}, "list(o_orderkey ORDER BY o_orderkey DESC)", by="o_custkey", before=[{"$sort": {"o_orderkey": -1}}])
_acc("push_document", {"$push": {"k": "$o_orderkey", "s": "$o_orderstatus"}}, "list(o_orderkey || o_orderstatus ORDER BY o_orderkey)", by="o_custkey", before=[{"$sort": {"o_orderkey": 1}}], after=[{"$project": {"v": {"$map": {"input": "$v", "as": "e", "in": {"$concat": [{"$toString": "$$e.k"}, "$$e.s"]}}}}}])
_acc("add_to_set", {"$addToSet": "$o_orderpriority"}, "list_sort(list(DISTINCT o_orderpriority))")
_acc("std_dev", {"$stdDevPop": "$o_totalprice"}, "round(stddev_pop(o_totalprice), 2)", after=_ROUND)
define("group_all", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "best": {"$max": "$o_totalprice"}}}, {"$project": {"_id": 0, "n": 1, "best": 1}}], "SELECT count(*) AS n, max(o_totalprice) AS best FROM orders")
define("group_all_of_nothing", "orders", [{"$match": {"o_orderkey": -1}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT count(*) AS n FROM orders WHERE o_orderkey = -1 HAVING count(*) > 0")
define("group_expression_key", "orders", [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}], "SELECT year(o_orderdate)::INT AS _id, count(*) AS n FROM orders GROUP BY 1")
define("group_having", "orders", [{"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}, {"$match": {"n": {"$gte": 15}}}], "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
define("group_add_fields", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "m": {"$max": "$o_custkey"}}}, {"$addFields": {"both": {"$add": ["$n", "$m"]}}}], "SELECT o_orderstatus AS _id, count(*) AS n, max(o_custkey) AS m, count(*) + max(o_custkey) AS both FROM orders GROUP BY 1")
define("group_conditional", "orders", [{"$group": {"_id": "$o_orderpriority", "open": {"$sum": {"$cond": [{"$eq": ["$o_orderstatus", "O"]}, 1, 0]}}}}], "SELECT o_orderpriority AS _id, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open FROM orders GROUP BY 1")

# --- joins

define("lookup", "nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$project": {"_id": 0, "n_nationkey": 1, "keys": {"$sortArray": {"input": "$c.c_custkey", "sortBy": 1}}}}], "SELECT n_nationkey, coalesce(list_sort(list(c_custkey) FILTER (WHERE c_custkey IS NOT NULL)), []) AS keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
define("lookup_unwind", "orders", [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "n": {"$sum": 1}}}], "SELECT c_mktsegment AS _id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
define("lookup_unwind_preserve", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 0, "c_custkey": 1, "k": "$o.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
define("lookup_size", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"_id": 0, "c_custkey": 1, "n": {"$size": "$o"}}}], "SELECT c_custkey, count(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
define("lookup_several", "customer", [{"$lookup": {"from": "nation", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"}, {"$lookup": {"from": "region", "localField": "n.n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$group": {"_id": "$r.r_name", "n": {"$sum": 1}}}], "SELECT r_name AS _id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
define("lookup_self", "nation", [{"$lookup": {"from": "nation", "localField": "n_regionkey", "foreignField": "n_regionkey", "as": "peers"}}, {"$project": {"_id": 0, "n_nationkey": 1, "n": {"$size": "$peers"}}}], "SELECT a.n_nationkey, count(*)::INT AS n FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1")
define("lookup_pipeline", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", 100000]}]}}}, {"$sort": {"o_totalprice": -1}}, {"$limit": 2}, {"$project": {"_id": 0, "o_orderkey": 1}}], "as": "top"}}, {"$project": {"_id": 0, "c_custkey": 1, "top": "$top.o_orderkey"}}], "SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_totalprice DESC) FILTER (WHERE o_orderkey IS NOT NULL), []) AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS p FROM orders WHERE o_totalprice > 100000) ON o_custkey = c_custkey AND p <= 2 GROUP BY 1")
define("lookup_pipeline_group", "nation", [{"$lookup": {"from": "customer", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$k"]}}}, {"$group": {"_id": None, "n": {"$sum": 1}, "best": {"$max": "$c_acctbal"}}}], "as": "s"}}, {"$project": {"_id": 0, "n_nationkey": 1, "n": {"$first": "$s.n"}, "best": {"$first": "$s.best"}}}], "SELECT n_nationkey, nullif(count(c_custkey), 0) AS n, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
define("lookup_pipeline_self", "nation", [{"$lookup": {"from": "nation", "let": {"r": "$n_regionkey", "k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$n_regionkey", "$$r"]}, {"$lt": ["$n_nationkey", "$$k"]}]}}}], "as": "before"}}, {"$project": {"_id": 0, "n_nationkey": 1, "n": {"$size": "$before"}}}], "SELECT a.n_nationkey, count(b.n_nationkey)::INT AS n FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY 1")
define("lookup_uncorrelated", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_regionkey": 1}}], "as": "n"}}, {"$project": {"_id": 0, "r_regionkey": 1, "n": {"$size": "$n"}}}], "SELECT r_regionkey, (SELECT count(*)::INT FROM nation WHERE n_regionkey = 1) AS n FROM region")
define("graph_lookup_depth0", "nation", [{"$graphLookup": {"from": "region", "startWith": "$n_regionkey", "connectFromField": "r_regionkey", "connectToField": "r_regionkey", "as": "r", "maxDepth": 0}}, {"$project": {"_id": 0, "n_nationkey": 1, "name": {"$first": "$r.r_name"}}}], "SELECT n_nationkey, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
define("graph_lookup_chain", "region", [{"$graphLookup": {"from": "nation", "startWith": "$r_regionkey", "connectFromField": "n_nationkey", "connectToField": "n_regionkey", "as": "below", "depthField": "d"}}, {"$project": {"_id": 0, "r_regionkey": 1, "n": {"$size": "$below"}, "deepest": {"$max": "$below.d"}}}], "WITH RECURSIVE w(start, node, next, d) AS (SELECT r_regionkey, n_nationkey, n_nationkey, 0::BIGINT FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT start, n.n_nationkey, n.n_nationkey, d + 1 FROM w JOIN nation n ON n.n_regionkey = w.next WHERE d < 30), best AS (SELECT start, node, min(d) AS d FROM w GROUP BY 1, 2) SELECT start AS r_regionkey, count(*)::INT AS n, max(d) AS deepest FROM best GROUP BY 1")
define("graph_lookup_restricted", "region", [{"$graphLookup": {"from": "nation", "startWith": "$r_regionkey", "connectFromField": "n_nationkey", "connectToField": "n_regionkey", "as": "below", "maxDepth": 1, "restrictSearchWithMatch": {"n_nationkey": {"$gte": 5}}}}, {"$project": {"_id": 0, "r_regionkey": 1, "keys": {"$sortArray": {"input": "$below.n_nationkey", "sortBy": 1}}}}], "WITH e AS (SELECT * FROM nation WHERE n_nationkey >= 5), a AS (SELECT r_regionkey, n_nationkey FROM region JOIN e ON n_regionkey = r_regionkey), b AS (SELECT r_regionkey, e.n_nationkey FROM a JOIN e ON e.n_regionkey = a.n_nationkey) SELECT r_regionkey, list_sort(list(DISTINCT n_nationkey)) AS keys FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")

# --- windows


def _window(name: str, how: dict, sql: str, by: str | None = "o_custkey", sort: dict | None = None, rounded: bool = False) -> None:
    spec = {"output": {"v": how}} | ({"partitionBy": f"${by}"} if by else {}) | ({"sortBy": sort} if sort else {})
    v = {"$round": ["$v", 2]} if rounded else "$v"
    define(f"window_{name}", "orders", [{"$setWindowFields": spec}, {"$project": {"_id": 0, "o_orderkey": 1, "v": v}}], f"SELECT o_orderkey, {sql} AS v FROM orders")


_K = {"o_orderkey": 1}
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
_window("sum_partition", {"$sum": "$o_totalprice"}, "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)", rounded=True)
_window("sum_default_frame", {"$sum": "$o_totalprice"}, "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)", sort=_K, rounded=True)
_window("sum_running", {"$sum": "$o_custkey", "window": {"documents": ["unbounded", "current"]}}, f"(sum(o_custkey) {_OVER} ROWS UNBOUNDED PRECEDING))::BIGINT", sort=_K)
_window("sum_rest", {"$sum": "$o_orderkey", "window": {"documents": ["current", "unbounded"]}}, f"(sum(o_orderkey) {_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT", sort=_K)
_window("avg_moving", {"$avg": "$o_orderkey", "window": {"documents": [-1, 1]}}, f"round(avg(o_orderkey) {_OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2)", sort=_K, rounded=True)
_window("min_range", {"$min": "$o_totalprice", "window": {"range": [-100, 100]}}, f"min(o_totalprice) {_OVER} RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)", sort=_K)
_window("max_range_days", {"$max": "$o_totalprice", "window": {"range": [-90, 0], "unit": "day"}}, "max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)", sort={"o_orderdate": 1})
_window("count", {"$count": {}}, "count(*) OVER (PARTITION BY o_custkey)", sort=_K)
_window("rank", {"$rank": {}}, "(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus))::INT", sort={"o_orderstatus": 1})
_window("dense_rank", {"$denseRank": {}}, "(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC))::INT", sort={"o_orderstatus": -1})
_window("document_number", {"$documentNumber": {}}, f"(row_number() {_OVER}))::INT", sort=_K)
_window("first", {"$first": "$o_totalprice"}, f"first_value(o_totalprice) {_OVER})", sort=_K)
_window("last", {"$last": "$o_totalprice"}, f"last_value(o_totalprice) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", sort=_K)
_window("shift_back", {"$shift": {"output": "$o_orderkey", "by": -1, "default": -1}}, f"lag(o_orderkey, 1, -1) {_OVER})", sort=_K)
_window("shift_ahead", {"$shift": {"output": "$o_orderkey", "by": 2}}, f"lead(o_orderkey, 2) {_OVER})", sort=_K)
_window("std_dev_pop", {"$stdDevPop": "$o_totalprice"}, "round(stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey), 2)", rounded=True)
_window("std_dev_samp", {"$stdDevSamp": "$o_totalprice"}, "round(stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey), 2)", rounded=True)
define("window_top_per_group", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_totalprice": -1}, "output": {"r": {"$rank": {}}}}}, {"$match": {"r": {"$lte": 2}}}, {"$project": {"_id": 0, "o_orderkey": 1, "r": 1}}], "SELECT o_orderkey, r FROM (SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INT AS r FROM orders) WHERE r <= 2")

# --- expressions


def _expr(name: str, table: str, key: str, expression, sql: str, before: list | None = None) -> None:
    define(f"expr_{name}", table, [*(before or []), {"$project": {"_id": 0, key: 1, "v": expression}}], f"SELECT {key}, {sql} AS v FROM {table}")


def _line(name: str, expression, sql: str) -> None:
    define(f"expr_{name}", "lineitem", [{"$project": {"_id": 0, "l_orderkey": 1, "l_linenumber": 1, "v": expression}}], f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM lineitem")


def _part(name: str, expression, sql: str) -> None:
    _expr(name, "part", "p_partkey", expression, sql)


def _order(name: str, expression, sql: str) -> None:
    _expr(name, "orders", "o_orderkey", expression, sql)


_part("add", {"$add": ["$p_size", "$p_partkey", 5]}, "(p_size + p_partkey + 5)::BIGINT")
_part("subtract", {"$subtract": ["$p_partkey", "$p_size"]}, "(p_partkey - p_size)::BIGINT")
_line("multiply", {"$multiply": ["$l_quantity", "$l_linenumber", 2]}, "l_quantity * l_linenumber * 2")
_part("divide", {"$divide": ["$p_partkey", "$p_size"]}, "p_partkey::DOUBLE / nullif(p_size, 0)")
_part("divide_by_zero", {"$divide": ["$p_partkey", 0]}, "NULL::DOUBLE")
_part("mod", {"$mod": [{"$subtract": ["$p_size", 25]}, 7]}, "((p_size - 25) % 7)::BIGINT")
_part("abs", {"$abs": {"$subtract": ["$p_size", 25]}}, "abs(p_size - 25)::BIGINT")
_part("ceil", {"$ceil": "$p_retailprice"}, "ceil(p_retailprice)")
_part("floor", {"$floor": "$p_retailprice"}, "floor(p_retailprice)")
_part("round_half_even", {"$round": [{"$divide": ["$p_size", 2]}, 0]}, "round_even(p_size / 2.0::DOUBLE, 0)")
_part("trunc", {"$trunc": [{"$divide": ["$p_partkey", -7]}, 0]}, "trunc(p_partkey / -7.0::DOUBLE)")
_part("sqrt", {"$round": [{"$sqrt": "$p_size"}, 6]}, "round_even(sqrt(p_size), 6)")
_part("pow", {"$pow": ["$p_size", 2]}, "pow(p_size, 2)")
_part("exp", {"$round": [{"$exp": {"$divide": ["$p_size", 50]}}, 6]}, "round_even(exp(p_size / 50.0::DOUBLE), 6)")
_part("ln", {"$round": [{"$ln": "$p_retailprice"}, 6]}, "round_even(ln(p_retailprice), 6)")
_part("log10", {"$round": [{"$log10": "$p_retailprice"}, 6]}, "round_even(log10(p_retailprice), 6)")
_part("max", {"$max": ["$p_size", 30, "$p_partkey"]}, "greatest(p_size, 30, p_partkey)")
_part("min", {"$min": ["$p_size", 30, None]}, "least(p_size, 30)")
_part("cond", {"$cond": [{"$gt": ["$p_size", 25]}, "big", "small"]}, "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END")
_part("cond_null", {"$cond": {"if": {"$gt": ["$p_size", 25]}, "then": None, "else": "small"}}, "CASE WHEN p_size > 25 THEN NULL ELSE 'small' END")
_part("cond_truth", {"$cond": [{"$mod": ["$p_size", 2]}, "odd", "even"]}, "CASE WHEN p_size % 2 <> 0 THEN 'odd' ELSE 'even' END")
_part("if_null", {"$ifNull": ["$nothing", "$p_brand"]}, "p_brand")
_part("switch", {"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": "s"}, {"case": {"$lt": ["$p_size", 30]}, "then": "m"}], "default": "l"}}, "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END")
_part("switch_no_default", {"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": 1}]}}, "CASE WHEN p_size < 10 THEN 1 END")
for _o, _s in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
    _part(_o, {f"${_o}": ["$p_size", 25]}, f"p_size {_s} 25")
_part("cmp", {"$cmp": ["$p_size", 25]}, "sign(p_size - 25)::INT")
_part("null_first", {"$lt": ["$nothing", "$p_size"]}, "true")
_part("and", {"$and": [{"$gt": ["$p_size", 10]}, {"$lt": ["$p_size", 20]}]}, "p_size > 10 AND p_size < 20")
_part("or", {"$or": [{"$lt": ["$p_size", 10]}, {"$gt": ["$p_size", 20]}]}, "p_size < 10 OR p_size > 20")
_part("nor", {"$nor": [{"$lt": ["$p_size", 10]}, {"$gt": ["$p_size", 20]}]}, "NOT (p_size < 10 OR p_size > 20)")
_part("not", {"$not": [{"$gt": ["$p_size", 10]}]}, "NOT p_size > 10")
_part("literal", {"$literal": "$p_size"}, "'$p_size'")
_part("object", {"$getField": {"field": "b", "input": {"a": "$p_size", "b": "$p_brand"}}}, "p_brand")
_part("concat", {"$concat": ["$p_brand", "-", "$p_type"]}, "p_brand || '-' || p_type")
_part("concat_null", {"$concat": ["$p_brand", "$nothing"]}, "NULL::VARCHAR")
_part("to_lower", {"$toLower": "$p_brand"}, "lower(p_brand)")
_part("to_upper", {"$toUpper": "$p_name"}, "upper(p_name)")
_part("to_upper_null", {"$toUpper": "$nothing"}, "''")
_part("substr", {"$substr": ["$p_name", 2, 4]}, "substr(p_name, 3, 4)")
_part("substr_rest", {"$substrCP": ["$p_name", 3, -1]}, "substr(p_name, 4)")
_part("trim", {"$trim": {"input": {"$concat": ["  ", "$p_name", " "]}}}, "p_name")
_part("ltrim", {"$ltrim": {"input": {"$concat": ["  ", "$p_name", " "]}}}, "p_name || ' '")
_part("rtrim_chars", {"$rtrim": {"input": "$p_name", "chars": "dt"}}, "rtrim(p_name, 'dt')")
_part("str_len", {"$strLenCP": "$p_name"}, "length(p_name)::INT")
_expr("str_len_text", "documents", "doc_id", {"$strLenCP": "$text"}, "length(text)::INT")
_part("split", {"$split": ["$p_name", " "]}, "string_split(p_name, ' ')")
_part("split_dot", {"$size": {"$split": [{"$concat": ["$p_name", ".x"]}, "."]}}, "len(string_split(p_name || '.x', '.'))::INT")
_part("split_elem", {"$arrayElemAt": [{"$split": ["$p_name", " "]}, -1]}, "string_split(p_name, ' ')[-1]")
_part("index_of", {"$indexOfCP": ["$p_name", "e"]}, "(instr(p_name, 'e') - 1)::INT")
_part("index_of_from", {"$indexOfCP": ["$p_name", "e", 4]}, "CASE WHEN instr(substr(p_name, 5), 'e') > 0 THEN instr(substr(p_name, 5), 'e') + 3 ELSE -1 END::INT")
_part("regex_match", {"$regexMatch": {"input": "$p_name", "regex": "^[A-M].*t$", "options": "i"}}, "regexp_matches(p_name, '^[A-M].*t$', 'i')")
_part("regex_find", {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$p_name", "regex": "o[a-z]"}}}}, "nullif(regexp_extract(p_name, 'o[a-z]'), '')")
_part("replace_one", {"$replaceOne": {"input": "$p_name", "find": "e", "replacement": "E."}}, "CASE WHEN instr(p_name, 'e') > 0 THEN substr(p_name, 1, instr(p_name, 'e') - 1) || 'E.' || substr(p_name, instr(p_name, 'e') + 1) ELSE p_name END")
_part("replace_all", {"$replaceAll": {"input": "$p_name", "find": "e", "replacement": "."}}, "replace(p_name, 'e', '.')")
_part("strcasecmp", {"$strcasecmp": ["$p_name", "MEDIUM"]}, "CASE WHEN upper(p_name) < 'MEDIUM' THEN -1 WHEN upper(p_name) > 'MEDIUM' THEN 1 ELSE 0 END")
for _o, _s in {"year": "year({})", "month": "month({})", "dayOfMonth": "day({})", "hour": "hour({})", "minute": "minute({})", "second": "second({})", "dayOfWeek": "dayofweek({}) + 1", "dayOfYear": "dayofyear({})", "week": "strftime({}, '%U')", "isoWeek": "weekofyear({})", "isoWeekYear": "isoyear({})", "isoDayOfWeek": "isodow({})"}.items():
    _expr(f"date_{_o}", "events", "event_id", {f"${_o}": "$ts"}, f"({_s.format('ts')})::INT")
_order("date_text", {"$month": {"$dateToString": {"date": "$o_orderdate"}}}, "month(o_orderdate)::INT")
_order("date_to_string", {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d"}}, "strftime(o_orderdate, '%Y/%m/%d')")
_order("date_difference", {"$divide": [{"$subtract": ["$o_orderdate", {"$date": "1995-01-01T00:00:00Z"}]}, 86400000]}, "(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) / 86400000.0::DOUBLE")

_W = {"$split": ["$p_name", " "]}
_L = "string_split(p_name, ' ')"
_part("array_elem", {"$arrayElemAt": [_W, 1]}, f"{_L}[2]")
_part("array_elem_outside", {"$arrayElemAt": [_W, 20]}, "NULL::VARCHAR")
_part("size", {"$size": _W}, f"len({_L})::INT")
_part("first", {"$first": [_W]}, f"{_L}[1]")
_part("last", {"$last": _W}, f"{_L}[-1]")
_part("filter", {"$filter": {"input": _W, "as": "w", "cond": {"$gt": [{"$strLenCP": "$$w"}, 4]}}}, f"list_filter({_L}, lambda w: length(w) > 4)")
_part("map", {"$map": {"input": _W, "as": "w", "in": {"$toUpper": "$$w"}}}, f"list_transform({_L}, lambda w: upper(w))")
_part("map_outer_field", {"$map": {"input": _W, "as": "w", "in": {"$concat": ["$$w", ":", "$p_brand"]}}}, f"list_transform({_L}, lambda w: w || ':' || p_brand)")
_part("reduce_sum", {"$reduce": {"input": _W, "initialValue": 0, "in": {"$add": ["$$value", {"$strLenCP": "$$this"}]}}}, f"list_sum(list_transform({_L}, lambda w: length(w)))::BIGINT")
_part("reduce_array", {"$reduce": {"input": _W, "initialValue": [], "in": {"$concatArrays": ["$$value", [{"$strLenCP": "$$this"}]]}}}, f"list_transform({_L}, lambda w: length(w)::INT)")
_part("set_union_empty", {"$setUnion": [{"$map": {"input": _W, "as": "w", "in": {"$strLenCP": "$$w"}}}, []]}, f"list_sort(list_distinct(list_transform({_L}, lambda w: length(w)::INT)))")
_part("reduce_concat", {"$reduce": {"input": _W, "initialValue": "", "in": {"$concat": ["$$value", "$$this"]}}}, "replace(p_name, ' ', '')")
_part("concat_arrays", {"$concatArrays": [_W, ["x"]]}, f"list_concat({_L}, ['x'])")
_part("slice", {"$slice": [_W, 1]}, f"{_L}[1:1]")
_part("slice_last", {"$slice": [_W, -1]}, f"{_L}[-1:]")
_part("slice_middle", {"$slice": [["a", "$p_brand", "c", "d"], 1, 2]}, "[p_brand, 'c']")
_part("reverse_array", {"$reverseArray": _W}, f"list_reverse({_L})")
_part("sort_array", {"$sortArray": {"input": _W, "sortBy": -1}}, f"list_reverse_sort({_L})")
_part("in", {"$in": ["$p_size", [1, 5, 10, 15]]}, "p_size IN (1, 5, 10, 15)")
_part("nin", {"$nin": ["$p_size", [1, 5, 10, 15]]}, "p_size NOT IN (1, 5, 10, 15)")
_part("is_array", {"$isArray": [_W]}, "true")
_part("is_array_empty", {"$isArray": [{"$literal": []}]}, "true")
_part("is_array_no", {"$isArray": "$p_name"}, "false")
_part("index_of_array", {"$indexOfArray": [_W, {"$last": _W}]}, f"(list_position({_L}, {_L}[-1]) - 1)::INT")
_part("index_of_array_from", {"$indexOfArray": [["a", "b", "a", "$p_brand"], "a", 1]}, "2::INT")
_part("set_union", {"$setUnion": [_W, ["zz", "aa"]]}, f"list_sort(list_distinct(list_concat({_L}, ['zz', 'aa'])))")
_part("set_intersection", {"$setIntersection": [_W, ["widget", "bolt", "gear"]]}, f"list_sort(list_intersect(list_distinct({_L}), ['widget', 'bolt', 'gear']))")
_part("set_difference", {"$setDifference": [_W, ["widget"]]}, f"list_sort(list_filter(list_distinct({_L}), lambda w: w <> 'widget'))")
_part("set_equals", {"$setEquals": [[1, 2, "$p_size"], ["$p_size", 2, 1, 1]]}, "true")
_part("set_is_subset", {"$setIsSubset": [["widget"], _W]}, f"list_contains({_L}, 'widget')")
_part("any_element_true", {"$anyElementTrue": [[False, {"$gt": ["$p_size", 10]}]]}, "p_size > 10")
_part("all_elements_true", {"$allElementsTrue": [[True, {"$gt": ["$p_size", 10]}]]}, "p_size > 10")
_part("range", {"$range": [0, 6, 2]}, "[0, 2, 4]::BIGINT[]")
_part("object_to_array", {"$map": {"input": {"$objectToArray": {"a": "$p_brand", "b": "$p_type"}}, "as": "e", "in": {"$concat": ["$$e.k", "=", "$$e.v"]}}}, "['a=' || p_brand, 'b=' || p_type]")
_part("array_to_object", {"$getField": {"field": "x", "input": {"$arrayToObject": [[{"k": "x", "v": "$p_brand"}]]}}}, "p_brand")
_part("merge_objects", {"$getField": {"field": "a", "input": {"$mergeObjects": [{"a": "$p_brand", "b": 1}, {"a": "$p_type"}]}}}, "p_type")
_part("type", {"$type": "$p_retailprice"}, "'double'")
_part("type_text", {"$type": "$p_name"}, "'string'")
_part("type_missing", {"$type": "$nothing"}, "'missing'")
_part("to_int", {"$toInt": "$p_retailprice"}, "trunc(p_retailprice)::INT")
_part("to_long", {"$toLong": "$p_size"}, "p_size::BIGINT")
_part("to_double", {"$toDouble": "$p_size"}, "p_size::DOUBLE")
_part("to_decimal", {"$toDecimal": "$p_size"}, "p_size::DECIMAL(38, 10)")
_part("to_string", {"$toString": "$p_size"}, "p_size::VARCHAR")
_part("to_string_whole_double", {"$toString": {"$toDouble": "$p_size"}}, "p_size::VARCHAR")
_part("to_bool", {"$toBool": {"$mod": ["$p_size", 2]}}, "p_size % 2 <> 0")
_part("to_date", {"$year": {"$toDate": "2021-03-04T05:06:07.000Z"}}, "2021::INT")
_part("to_object_id", {"$toObjectId": "$p_brand"}, "p_brand")
_part("is_number", {"$isNumber": "$p_size"}, "true")
_part("is_string", {"$isString": "$p_size"}, "false")
_part("convert", {"$convert": {"input": "$p_name", "to": "int", "onError": -1}}, "-1::INT")
_part("convert_null", {"$convert": {"input": "$nothing", "to": "int", "onNull": 7}}, "7::INT")
_expr("json_number", "events", "event_id", {"$toInt": {"$arrayElemAt": [{"$split": [{"$rtrim": {"input": "$props", "chars": "}"}}, ": "]}, 1]}}, "try_cast(string_split(rtrim(props, '}'), ': ')[2] AS INT)")
_part("let", {"$let": {"vars": {"a": "$p_size"}, "in": {"$add": ["$$a", 1]}}}, "(p_size + 1)::BIGINT")
_part("root", "$$ROOT.p_brand", "p_brand")
_expr("vector_size", "embeddings", "vec_id", {"$size": "$embedding"}, "len(embedding)::INT")

# --- longer pipelines


define("pipe_revenue_by_region", "lineitem", [
    {"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}}, {"$unwind": "$o"},
    {"$lookup": {"from": "customer", "localField": "o.o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"},
    {"$lookup": {"from": "nation", "localField": "c.c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"},
    {"$group": {"_id": "$n.n_regionkey", "revenue": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "lines": {"$sum": 1}}},
    {"$project": {"revenue": {"$round": ["$revenue", 0]}, "lines": 1}},
], "SELECT n_regionkey AS _id, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
define("pipe_monthly_revenue", "orders", [
    {"$match": {"o_orderstatus": {"$in": ["F", "O"]}}},
    {"$group": {"_id": {"y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}}, "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "best": {"$max": "$o_totalprice"}}},
    {"$addFields": {"mean": {"$divide": ["$total", "$n"]}}},
    {"$project": {"_id": 0, "y": "$_id.y", "m": "$_id.m", "n": 1, "best": 1, "mean": {"$round": ["$mean", 2]}}},
], "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n, max(o_totalprice) AS best, round(sum(o_totalprice) / count(*), 2) AS mean FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
define("pipe_customer_tiers", "customer", [
    {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
    {"$addFields": {"spent": {"$reduce": {"input": "$o.o_totalprice", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}}},
    {"$addFields": {"tier": {"$switch": {"branches": [{"case": {"$gte": ["$spent", 3000000]}, "then": "gold"}, {"case": {"$gte": ["$spent", 1000000]}, "then": "silver"}], "default": "bronze"}}}},
    {"$group": {"_id": "$tier", "n": {"$sum": 1}}},
], "SELECT CASE WHEN s >= 3000000 THEN 'gold' WHEN s >= 1000000 THEN 'silver' ELSE 'bronze' END AS _id, count(*) AS n FROM (SELECT c_custkey, coalesce(sum(o_totalprice), 0) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
define("pipe_event_funnel", "events", [
    {"$group": {"_id": "$user_id", "types": {"$addToSet": "$event_type"}, "n": {"$sum": 1}}},
    {"$match": {"types": "purchase"}}, {"$unwind": "$types"},
    {"$group": {"_id": "$types", "users": {"$sum": 1}}},
], "SELECT event_type AS _id, count(DISTINCT user_id) AS users FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
define("pipe_top_parts", "lineitem", [
    {"$group": {"_id": "$l_partkey", "qty": {"$sum": "$l_quantity"}}}, {"$sort": {"qty": -1, "_id": 1}}, {"$limit": 20},
    {"$lookup": {"from": "part", "localField": "_id", "foreignField": "p_partkey", "as": "p"}}, {"$unwind": "$p"},
    {"$project": {"qty": 1, "name": "$p.p_name"}},
], "SELECT l_partkey AS _id, qty, p_name AS name FROM (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 20) JOIN part ON p_partkey = l_partkey")
define("pipe_event_deltas", "events", [
    {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1, "event_id": 1}, "output": {"before": {"$shift": {"output": "$value", "by": -1}}}}},
    {"$match": {"$expr": {"$gt": ["$value", {"$multiply": ["$before", 2]}]}, "before": {"$ne": None}}},
    {"$group": {"_id": "$event_type", "jumps": {"$sum": 1}}},
], "SELECT event_type AS _id, count(*) AS jumps FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS b FROM events) WHERE b IS NOT NULL AND value > b * 2 GROUP BY 1")
define("pipe_returned_share", "lineitem", [
    {"$group": {"_id": "$l_suppkey", "n": {"$sum": 1}, "back": {"$sum": {"$cond": [{"$eq": ["$l_returnflag", "R"]}, 1, 0]}}}},
    {"$project": {"share": {"$round": [{"$divide": ["$back", "$n"]}, 4]}, "n": 1}},
    {"$match": {"n": {"$gte": 10}}},
], "SELECT l_suppkey AS _id, round_even(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS share, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
define("pipe_source_profile", "documents", [
    {"$addFields": {"band": {"$switch": {"branches": [{"case": {"$lt": ["$n_chars", 1000]}, "then": "short"}, {"case": {"$lt": ["$n_chars", 5000]}, "then": "middle"}], "default": "long"}}}},
    {"$group": {"_id": {"lang": "$lang", "band": "$band"}, "n": {"$sum": 1}, "chars": {"$sum": "$n_chars"}}},
    {"$project": {"_id": 0, "lang": "$_id.lang", "band": "$_id.band", "n": 1, "chars": 1}},
], "SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS band, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
define("pipe_conversations", "conversations", [
    {"$sort": {"conv_id": 1, "turn": 1}},
    {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "first": {"$first": "$role"}, "turns": {"$sum": 1}}},
    {"$project": {"turns": 1, "first": 1, "users": {"$size": {"$filter": {"input": "$roles", "as": "r", "cond": {"$eq": ["$$r", "user"]}}}}}},
], "SELECT conv_id AS _id, count(*) AS turns, arg_min(role, turn) AS first, count(*) FILTER (WHERE role = 'user')::INT AS users FROM conversations GROUP BY 1")
define("pipe_supplier_quartiles", "supplier", [
    {"$setWindowFields": {"sortBy": {"s_acctbal": -1, "s_suppkey": 1}, "output": {"place": {"$documentNumber": {}}, "all": {"$count": {}}}}},
    {"$project": {"_id": 0, "s_suppkey": 1, "quarter": {"$ceil": {"$divide": [{"$multiply": ["$place", 4]}, "$all"]}}}},
], "SELECT s_suppkey, ceil(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) * 4::DOUBLE / count(*) OVER ()) AS quarter FROM supplier")

# --- arrays as fields of queries and lookups

_WORDS = [{"$project": {"_id": 0, "p_partkey": 1, "w": {"$split": ["$p_name", " "]}}}]
_SOME = [{"$addFields": {"some": {"$filter": {"input": "$w", "as": "x", "cond": {"$eq": ["$$x", "hot"]}}}}}]


def _array(name: str, query: dict, sql: str, before: list | None = None) -> None:
    define(f"match_{name}", "part", [*_WORDS, *(before or []), {"$match": query}, {"$project": {"p_partkey": 1}}], f"SELECT p_partkey FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) WHERE {sql}")


_array("empty_array", {"some": []}, "NOT list_contains(w, 'hot')", _SOME)
_array("ne_empty_array", {"some": {"$ne": []}}, "list_contains(w, 'hot')", _SOME)
_array("array_has", {"w": "hot"}, "list_contains(w, 'hot')")
_array("array_has_not", {"w": {"$ne": "hot"}}, "NOT list_contains(w, 'hot')")
_array("array_in", {"w": {"$in": ["hot", "small"]}}, "list_has_any(w, ['hot', 'small'])")
_array("array_all", {"w": {"$all": ["hot"]}}, "list_has_all(w, ['hot'])")
_array("array_size", {"w": {"$size": 2}}, "len(w) = 2")
_array("elem_match", {"w": {"$elemMatch": {"$regex": "^s", "$ne": "small"}}}, "len(list_filter(w, lambda x: starts_with(x, 's') AND x <> 'small')) > 0")
_array("array_order", {"w": {"$gt": "s"}}, "len(list_filter(w, lambda x: x > 's')) > 0")
_KEYS = [{"$match": {"c_custkey": {"$lte": 200}}}, {"$project": {"_id": 0, "c_custkey": 1, "ks": ["$c_nationkey", {"$add": ["$c_nationkey", 1]}, "$c_nationkey"]}}, {"$lookup": {"from": "supplier", "localField": "ks", "foreignField": "s_nationkey", "as": "m"}}]
_MET = "customer LEFT JOIN supplier ON s_nationkey IN (c_nationkey, c_nationkey + 1) WHERE c_custkey <= 200"
define("lookup_array", "customer", [*_KEYS, {"$project": {"c_custkey": 1, "keys": {"$sortArray": {"input": "$m.s_suppkey", "sortBy": 1}}}}], f"SELECT c_custkey, coalesce(list_sort(list(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)), []) AS keys FROM {_MET} GROUP BY 1")
define("lookup_array_unwind", "customer", [*_KEYS, {"$unwind": "$m"}, {"$group": {"_id": "$m.s_suppkey", "n": {"$sum": 1}}}], f"SELECT s_suppkey AS _id, count(*) AS n FROM {_MET} AND s_suppkey IS NOT NULL GROUP BY 1")
define("lookup_array_unwind_preserve", "customer", [*_KEYS, {"$unwind": {"path": "$m", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "k": "$m.s_suppkey"}}], f"SELECT c_custkey, s_suppkey AS k FROM {_MET}")
define("lookup_array_size", "customer", [*_KEYS, {"$project": {"c_custkey": 1, "n": {"$size": "$m"}}}], f"SELECT c_custkey, count(s_suppkey)::INT AS n FROM {_MET} GROUP BY 1")
define("lookup_nested_name", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "found.region"}}, {"$project": {"_id": 0, "n_nationkey": 1, "name": {"$first": "$found.region.r_name"}}}], "SELECT n_nationkey, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")

# --- frames of time and of the calendar, and nulls in arrays

_DATE = {"o_orderdate": 1}
for _unit, _n in (("month", 3), ("quarter", 2), ("year", 1)):
    _window(f"max_range_{_unit}s", {"$max": "$o_totalprice", "window": {"range": [-_n, "current"], "unit": _unit}}, f"max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL {_n * {'month': 1, 'quarter': 3, 'year': 12}[_unit]} MONTH PRECEDING AND CURRENT ROW)", sort=_DATE)
_window("sum_range_months_ahead", {"$sum": "$o_totalprice", "window": {"range": [0, 6], "unit": "month"}}, "round_even(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 6 MONTH FOLLOWING), 2)", sort=_DATE, rounded=True)
_window("count_range_fractions", {"$count": {}, "window": {"range": [-2500.5, 0.75]}}, "count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 2500.5::DOUBLE PRECEDING AND 0.75::DOUBLE FOLLOWING)", sort={"o_totalprice": 1})
_window("count_range_weeks", {"$count": {}, "window": {"range": [-8, 8], "unit": "week"}}, "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 56 DAY PRECEDING AND INTERVAL 56 DAY FOLLOWING)", sort=_DATE)
for _unit, _n, _sql in (("millisecond", 90_000_000, "90000 SECOND"), ("hour", 30, "30 HOUR")):
    define(f"window_range_{_unit}s", "events", [{"$match": {"ts": {"$ne": None}}}, {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"n": {"$count": {}, "window": {"range": [-_n, "current"], "unit": _unit}}}}}, {"$project": {"_id": 0, "event_id": 1, "n": 1}}], f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {_sql} PRECEDING AND CURRENT ROW) AS n FROM events WHERE ts IS NOT NULL")
_NULLED = [{"$project": {"_id": 0, "o_orderkey": 1, "o_custkey": 1, "o_orderdate": 1, "v": {"$cond": [{"$gt": ["$o_totalprice", 200000]}, "$o_orderstatus", None]}}}]
_NULLED_SQL = "(SELECT *, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS v FROM orders)"
define("acc_add_to_set_null", "orders", [*_NULLED, {"$group": {"_id": "$o_custkey", "set": {"$addToSet": "$v"}}}, {"$project": {"n": {"$size": "$set"}}}], f"SELECT o_custkey AS _id, (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))::INT AS n FROM {_NULLED_SQL} GROUP BY 1")
define("acc_push_null", "orders", [*_NULLED, {"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "all": {"$push": "$v"}}}], f"SELECT o_custkey AS _id, list(v ORDER BY o_orderkey) AS \"all\" FROM {_NULLED_SQL} GROUP BY 1")
define("window_push_null", "orders", [*_NULLED, {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"seen": {"$push": "$v", "window": {"documents": [-2, "current"]}}, "set": {"$addToSet": "$v"}}}}, {"$project": {"o_orderkey": 1, "seen": 1, "n": {"$size": "$set"}}}], f"SELECT o_orderkey, list(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS seen, (SELECT (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))::INT FROM {_NULLED_SQL} i WHERE i.o_custkey = o.o_custkey) AS n FROM {_NULLED_SQL} o")
define("match_type_or_null", "events", [{"$match": {"value": {"$type": ["string", "null"]}}}, {"$count": "n"}], "SELECT count(*) AS n FROM events WHERE value IS NULL HAVING count(*) > 0")
define("expr_substr_bytes", "part", [{"$project": {"_id": 0, "p_partkey": 1, "v": {"$substrBytes": [{"$concat": ["é", "$p_name"]}, 2, 4]}, "at": {"$indexOfBytes": [{"$concat": ["é", "$p_name"]}, " "]}}}], "SELECT p_partkey, substr(p_name, 1, 4) AS v, (CASE WHEN contains(p_name, ' ') THEN strpos(p_name, ' ') + 1 ELSE -1 END)::INT AS at FROM part")
define("facet_mixed_order", "orders", [{"$facet": {"top": [{"$sort": {"o_orderpriority": 1, "o_orderdate": -1, "o_orderkey": 1}}, {"$limit": 4}, {"$project": {"_id": 0, "o_orderkey": 1}}]}}, {"$project": {"keys": "$top.o_orderkey"}}], "SELECT list(o_orderkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS keys FROM (SELECT * FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 4)")
define("bucket_auto_ties", "lineitem", [{"$bucketAuto": {"groupBy": "$l_quantity", "buckets": 4}}, {"$project": {"_id": 0, "lo": "$_id.min", "count": 1}}], "WITH v AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT q, n, sum(n) OVER (ORDER BY q) - n AS before, sum(n) OVER () AS total FROM v) SELECT min(q) AS lo, sum(n)::BIGINT AS count FROM r GROUP BY least(floor(before / round(total / 4.0)), 3)")
define("match_expr_literal_first", "orders", [{"$match": {"$expr": {"$lt": [300000, "$o_totalprice"]}}}, {"$project": {"_id": 0, "o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")

# --- sinks, streams, stages of one's own


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


_SMALL = [{"$match": {"c_custkey": {"$lte": 40}}}, {"$project": {"_id": 0, "c_custkey": 1, "c_name": 1}}]
_NEWER = [{"$match": {"c_custkey": {"$gt": 20, "$lte": 60}}}, {"$project": {"_id": 0, "c_custkey": 1, "c_name": {"$toLower": "$c_name"}}}]


def _merged(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    e, name = engine(spark, sf_dir), _name("merged")
    e.aggregate("customer", [*_SMALL, {"$out": name}])
    e.aggregate("customer", [*_NEWER, {"$merge": {"into": name, "on": "c_custkey", **how}}])
    return spark.table(name)


@other("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 40")
def out_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$out, and the table that it wrote; written twice, since it replaces."""
    name = _name("out")
    for _ in range(2):
        engine(spark, sf_dir).aggregate("customer", [*_SMALL, {"$out": name}])
    return spark.table(name)


@other("SELECT c_custkey, CASE WHEN c_custkey <= 20 THEN c_name ELSE lower(c_name) END AS c_name FROM customer WHERE c_custkey <= 60")
def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@other("SELECT c_custkey, CASE WHEN c_custkey <= 20 THEN c_name ELSE lower(c_name) END AS c_name FROM customer WHERE c_custkey <= 40")
def merge_replace_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, whenMatched="replace", whenNotMatched="discard")


@other("SELECT c_custkey, CASE WHEN c_custkey <= 40 THEN c_name ELSE lower(c_name) END AS c_name FROM customer WHERE c_custkey <= 60")
def merge_keep_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, whenMatched="keepExisting")


@other("SELECT event_type AS _id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups over windows of event time, as a stream has them; here over a table."""
    from .streaming.pipelines import windowed_group as grouped

    events = engine(spark, sf_dir).catalog.get("events").where("ts is not null")
    return grouped(events.withColumn("ts", events["ts"].cast("timestamp")), "ts", "1 day", {"_id": "$event_type", "n": {"$sum": 1}}).selectExpr("_id", "cast(start as timestamp_ntz) as start", "n")


@other("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000")
def stream_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless stages over a stream of files, into a table."""
    from .sources.catalog import stream_files
    from .streaming.pipelines import run_once, stream

    e = engine(spark, sf_dir)
    frame = stream_files(spark, f"{sf_dir}/orders.parquet", e.catalog.get("orders").schema)
    return run_once(stream(e, frame, [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$project": {"_id": 0, "o_orderkey": 1, "twice": {"$multiply": ["$o_totalprice", 2]}}}]), _name("stream"))


@other("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def own_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage of one's own, made of others."""
    e = engine(spark, sf_dir)
    e.register_stage("$dearest", lambda df, n, ctx: ctx.run(df, [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": n}], ctx))
    return e.aggregate("orders", [{"$dearest": 7}, {"$project": {"_id": 0, "o_orderkey": 1}}])
