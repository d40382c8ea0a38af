"""Joining stages: $lookup and $graphLookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.accumulators import sort_key
from ..functions.expressions import compiled
from ..functions.predicates import condition
from ..functions.values import Scope, Value, quoted, rank, text
from ..names import segments
from .context import Context, visible
from .shape import add_fields


def _document(df: DataFrame):
    return F.struct(*[F.col(quoted(c)) for c in visible(df)])


def _put(df: DataFrame, name: str, column: str, ctx: Context) -> DataFrame:
    """The hidden column under the name that $lookup gives it, which may be that of a nested field."""
    if "." in name:
        return add_fields(df, {name: f"${column}"}, ctx)[0].drop(column)
    order = [c for c in df.columns if c not in (name, column)]
    return df.select(*[F.col(quoted(c)) for c in order], F.col(column).alias(name))


def _empty_for(kind: T.DataType):
    return F.array().cast(kind)


def _by_element(left: DataFrame, rows: DataFrame, several: bool) -> DataFrame:
    """(__v, __d): for each distinct array __v of left's column __l the documents that have one of its elements as key, each row of the other collection
    once; a null array looks for null. several: a document may have several keys."""
    values = left.select(F.col("__l").alias("__v")).distinct()
    one_null = F.array(F.lit(None).cast(values.schema["__v"].dataType.elementType))
    elements = values.select("__v", F.explode(F.array_distinct(F.coalesce("__v", one_null))).alias("__e"))
    if not several:
        return elements.join(rows, F.col("__e").eqNullSafe(F.col("__f"))).select("__v", "__d")
    # rows are known by their content and how often it stands there
    known = rows.groupBy("__d").agg(F.count(F.lit(1)).alias("__n"), F.first("__f").alias("__f"))
    keys = known.select("__d", "__n", F.explode(F.array_distinct(F.when(F.size("__f") > 0, F.col("__f")).otherwise(F.array(F.lit(None))))).alias("__f"))
    met = elements.join(keys, F.col("__e").eqNullSafe(F.col("__f"))).select("__v", "__d", "__n").distinct()
    return met.select("__v", F.explode(F.array_repeat("__d", F.col("__n").cast("int"))).alias("__d"))


def lookup(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or not isinstance(spec.get("from"), str) or not isinstance(spec.get("as"), str):
        raise ValidationError("MISSING_ARGUMENT", "$lookup needs from and as")
    if "pipeline" in spec:
        return _pipeline(df, spec, ctx)
    if "localField" not in spec or "foreignField" not in spec:
        raise ValidationError("MISSING_ARGUMENT", "$lookup needs localField and foreignField, or a pipeline")
    name = spec["as"]
    segments(name)
    right = ctx.catalog.get(spec["from"]).drop("__raw")
    local, foreign = ctx.scope(df).field(spec["localField"]), Scope(right).field(spec["foreignField"])
    by_element, several = isinstance(local.type, T.ArrayType), isinstance(foreign.type, T.ArrayType)
    rows = right.select(foreign.col.alias("__f"), _document(right).alias("__d"))
    match_type = foreign.type.elementType if several else foreign.type
    local_type = local.type.elementType if by_element else local.type
    if rank(local_type) != rank(match_type) and -1 not in (rank(local_type), rank(match_type)):  # unlike types never meet
        rows, several = rows.limit(0).select(F.lit(None).cast(local_type).alias("__f"), "__d"), False
    left = df.withColumn("__l", local.col)
    if by_element:
        rows = _by_element(left, rows, several).select(F.col("__v").alias("__f"), "__d")
    elif several:
        rows = rows.select(F.explode(F.array_distinct(F.when(F.size("__f") > 0, F.col("__f")).otherwise(F.array(F.lit(None))))).alias("__f"), "__d")
    on = F.col("__l").eqNullSafe(F.col("__f"))
    if mode := spec.get("__unwind"):  # a plain join: no arrays are made
        joined = left.join(rows, on, mode).withColumnRenamed("__d", "__as")
    elif spec.get("__count"):
        counts = rows.groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
        joined = left.join(counts, on, "left").withColumn("__as", F.coalesce("__n", F.lit(0)).cast("int")).drop("__n")
    else:
        groups = rows.groupBy("__f").agg(F.collect_list("__d").alias("__a"))
        joined = left.join(groups, on, "left").withColumn("__as", F.coalesce("__a", _empty_for(groups.schema["__a"].dataType))).drop("__a")
    return _put(joined.drop("__l", "__f"), name, "__as", ctx), ctx.moved()


def _conjuncts(x) -> list:
    return [c for p in x["$and"] for c in _conjuncts(p)] if isinstance(x, dict) and set(x) == {"$and"} and isinstance(x["$and"], list) else [x]


def _pipeline(df: DataFrame, spec: dict, ctx: Context):
    """The correlated form, without correlation: the distinct values of the variables are joined to the other collection by the
    conditions of a leading $match; further stages work within the rows of each value; the results go back by a join."""
    name, let = spec["as"], spec.get("let") or {}
    if not isinstance(spec["pipeline"], list):
        raise ValidationError("NOT_A_LIST", "$lookup's pipeline is a list of stages")
    s = ctx.scope(df)
    taken = sum(c.startswith("__let_") for c in df.columns)
    columns = {}
    for i, (var, x) in enumerate(let.items()):
        if not isinstance(x, str) or not x.startswith("$"):
            raise ValidationError("BAD_LET", "the variables of $lookup are paths")
        columns[var] = f"__let_{taken + i}"
    if "localField" in spec:
        columns["__local"] = f"__let_{taken + len(columns)}"
    left = df.withColumns({columns[v]: compiled(x, s).col for v, x in let.items()} | ({columns["__local"]: s.field(spec["localField"]).col} if "localField" in spec else {}))
    right = ctx.catalog.get(spec["from"]).drop("__raw")
    inner = Context(ctx.catalog, ctx.run, ctx.strict, carry=tuple(columns.values()), variables={v: c for v, c in columns.items() if v != "__local"}, warnings=ctx.warnings)
    stages = list(spec["pipeline"])
    if columns:
        values = left.select(*columns.values()).distinct()
        equal, other = [], []
        if "__local" in columns:
            equal.append(F.col(columns["__local"]).eqNullSafe(Scope(right).field(spec["foreignField"]).col))
        if stages and set(stages[0]) == {"$match"} and isinstance(stages[0]["$match"], dict):
            query = dict(stages.pop(0)["$match"])
            expr = query.pop("$expr", None)
            rs = Scope(right)
            for c in _conjuncts(expr) if expr is not None else []:
                pair = c.get("$eq") if isinstance(c, dict) and len(c) == 1 else None
                var = next((i for i, p in enumerate(pair) if isinstance(p, str) and p.startswith("$$") and p[2:] in let), None) if isinstance(pair, list) and len(pair) == 2 else None
                if var is not None and isinstance(pair[1 - var], str) and pair[1 - var].startswith("$") and not pair[1 - var].startswith("$$"):
                    a = Value(F.col(columns[pair[var][2:]]), values, kind=values.schema[columns[pair[var][2:]]].dataType)
                    b = rs.field(pair[1 - var][1:])
                    if rank(a.type) == rank(b.type):
                        equal.append(a.col.eqNullSafe(b.col))
                        continue
                other.append(c)
            if query:
                right = right.where(condition(query, rs))
            if other:
                stages.insert(0, {"$match": {"$expr": {"$and": other}}})
        if not equal:
            ctx.warn(f"$lookup into {name} has no equality: its distinct variables are joined with all of {spec['from']}")
        on = equal[0] if equal else F.lit(True)
        for e in equal[1:]:
            on = on & e
        rows = values.join(right, on)
    else:
        rows = right
    rows, after = ctx.run(rows, stages, inner)
    doc = _document(rows)
    key = sort_key(after.order, after.scope(rows)) if after.order else None
    if key is None:
        array = F.collect_list(doc)
    else:
        array = F.transform(F.sort_array(F.collect_list(F.struct(key[0].alias("k"), doc.alias("d"))), key[1]), lambda e: e["d"])
    found = rows.groupBy(*after.kept()).agg(array.alias("__a")) if columns else rows.agg(array.alias("__a"))
    found = found.withColumnsRenamed({c: f"{c}_r" for c in columns.values()})
    kind = found.schema["__a"].dataType
    if not columns:
        joined = left.crossJoin(found)  # one row
    else:
        on = F.lit(True)
        for c in columns.values():
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_r"))
        joined = left.join(found, on, "left")
    return _put(joined.select(*[F.col(quoted(c)) for c in df.columns], F.coalesce("__a", _empty_for(kind)).alias("__as")), name, "__as", ctx), ctx.moved()


def graph_lookup(df: DataFrame, spec, ctx: Context):
    """Breadth first over distinct starting values: each step joins the frontier to the collection and drops what has been
    seen; it ends when the frontier is empty. Each level is written to the checkpoint folder. A depth of 0 is one join by equality."""
    for k in ("from", "startWith", "connectFromField", "connectToField", "as"):
        if not isinstance(spec, dict) or k not in spec:
            raise ValidationError("MISSING_ARGUMENT", f"$graphLookup needs {k}")
    deepest = spec.get("maxDepth")
    if deepest is not None and (not isinstance(deepest, int) or deepest < 0):
        raise ValidationError("BAD_NUMBER", "maxDepth takes a whole number of 0 or more")
    from ..plans.durable import cut

    name, depth = spec["as"], spec.get("depthField")
    right = ctx.catalog.get(spec["from"]).drop("__raw")
    if "restrictSearchWithMatch" in spec:
        right = right.where(condition(spec["restrictSearchWithMatch"], Scope(right)))
    rs = Scope(right)
    to, back = rs.field(spec["connectToField"]), rs.field(spec["connectFromField"])
    start = compiled(spec["startWith"], ctx.scope(df))
    as_text = rank(to.type) != rank(back.type) or rank(to.type) != rank(start.type if not isinstance(start.type, T.ArrayType) else start.type.elementType)
    form = (lambda v: text(v).col) if as_text else (lambda v: v.col)
    left = df.withColumn("__start", start.col if isinstance(start.type, T.ArrayType) else form(start))
    if deepest == 0 and not isinstance(start.type, T.ArrayType):
        doc = F.struct(*[F.col(quoted(c)) for c in visible(right)], *([F.lit(0).cast("long").alias(depth)] if depth else []))
        groups = right.select(form(to).alias("__to"), doc.alias("__doc")).where("__to is not null").groupBy("__to").agg(F.collect_list("__doc").alias("__a"))
        joined = left.join(groups, F.col("__start") == F.col("__to"), "left").withColumn("__as", F.coalesce("__a", _empty_for(groups.schema["__a"].dataType)))
        return _put(joined.drop("__start", "__to", "__a"), name, "__as", ctx), ctx.moved()
    nodes = right.select(form(to).alias("__to"), (back.col if isinstance(back.type, T.ArrayType) else F.array(form(back))).alias("__next"), _document(right).alias("__doc"))
    nodes = cut(nodes.where(F.col("__to").isNotNull()).withColumn("__node", F.monotonically_increasing_id()))
    values = left.select("__start").where("__start is not null").distinct()
    frontier = values.select("__start", (F.explode("__start") if isinstance(start.type, T.ArrayType) else F.col("__start")).alias("__at"))
    seen, level = None, 0
    while True:
        step = frontier.join(nodes, F.col("__at") == F.col("__to")).select("__start", "__node", "__next").dropDuplicates(["__start", "__node"])
        if seen is not None:
            step = step.join(seen.select("__start", "__node"), ["__start", "__node"], "left_anti")
        step = cut(step.withColumn("__depth", F.lit(level).cast("long")))
        new = step.select("__start", "__node", "__depth")
        seen = new if seen is None else seen.union(new)
        if level == deepest or step.isEmpty():
            break
        frontier = step.select("__start", F.explode("__next").alias("__at")).where("__at is not null").distinct()
        level += 1
    doc = F.struct("__doc.*", F.col("__depth").alias(depth)) if depth else F.col("__doc")
    found = seen.join(nodes.select("__node", "__doc"), "__node").groupBy("__start").agg(F.collect_list(F.struct("__depth", "__node", doc.alias("d"))).alias("__a"))
    found = found.select(F.col("__start").alias("__s"), F.transform(F.array_sort("__a", lambda a, b: F.when(a["__depth"] != b["__depth"], F.signum(a["__depth"] - b["__depth"]).cast("int")).otherwise(F.signum(a["__node"] - b["__node"]).cast("int"))), lambda e: e["d"]).alias("__a"))
    kind = found.schema["__a"].dataType
    joined = left.join(found, F.col("__start") == F.col("__s"), "left")
    return _put(joined.select(*[F.col(quoted(c)) for c in df.columns], F.coalesce("__a", _empty_for(kind)).alias("__as")), name, "__as", ctx), ctx.moved()

