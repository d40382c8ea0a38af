"""Stages that work on each document alone, or on the order and number of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.expressions import compiled
from ..functions.predicates import condition
from ..functions.values import Scope, Value, is_null, quoted, rank, step, text
from ..names import segments
from .context import Context, bare, beside, visible


def match(df: DataFrame, spec, ctx: Context):
    return df.where(condition(spec, ctx.scope(df))), ctx


# --- projections


def _tree(spec: dict, name: str) -> dict:
    """Dotted names as nested documents; values are leaves."""
    out: dict = {}
    for path, x in spec.items():
        *above, last = segments(path)
        at = out
        for p in above:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValidationError("PATH_COLLISION", f"{name}: {path} meets another field")
        nested = isinstance(x, dict) and x and not any(k.startswith("$") for k in x)
        if last in at:
            raise ValidationError("PATH_COLLISION", f"{name}: {path} stands twice")
        at[last] = _tree(x, name) if nested else _Leaf(x)
    return out


class _Leaf:
    def __init__(self, spec):
        self.spec = spec

    @property
    def flag(self) -> bool | None:
        return bool(self.spec) if isinstance(self.spec, (bool, int, float)) else None


def _leaves(tree: dict):
    for v in tree.values():
        yield from _leaves(v) if isinstance(v, dict) else (v,)


def _include(value: Value, tree: dict, s: Scope) -> Value | None:
    """The parts of a nested value that a projection names; None where it has none."""
    kind = value.type
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        first = value.then(lambda c: F.get(c, F.lit(0)), kind=kind.elementType)
        return value.then(lambda c: F.transform(c, lambda e: _include(Value(e, value.frame, first.probe, first.type), tree, s).col))
    own = kind.fieldNames() if isinstance(kind, T.StructType) else []
    parts: dict[str, Value] = {}
    for n in own:
        if n in tree and (isinstance(tree[n], dict) or tree[n].flag):
            got = step(value, [n])
            parts[n] = _include(got, tree[n], s) if isinstance(tree[n], dict) else got
    for n, t in tree.items():
        if n not in parts and (isinstance(t, dict) or t.flag is None):
            got = _include(s.missing(), t, s) if isinstance(t, dict) else compiled(t.spec, s)
            if got is not None:
                parts[n] = got
    parts = {n: v for n, v in parts.items() if v is not None}
    if not parts:
        return None
    names, values = list(parts), list(parts.values())
    made = values[0].then(lambda *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)]), *values[1:])
    computed = any(lf.flag is None for lf in _leaves(tree))
    return made if computed or not own else made.then(lambda m, c: F.when(c.isNotNull(), m), value)


def _exclude(value: Value, tree: dict) -> Value:
    kind = value.type
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        first = value.then(lambda c: F.get(c, F.lit(0)), kind=kind.elementType)
        return value.then(lambda c: F.transform(c, lambda e: _exclude(Value(e, value.frame, first.probe, first.type), tree).col))
    if not isinstance(kind, T.StructType):
        return value
    keep = {n: step(value, [n]) for n in kind.fieldNames() if not (n in tree and not isinstance(tree[n], dict))}
    keep = {n: _exclude(v, tree[n]) if n in tree else v for n, v in keep.items()}
    if not keep:
        return value.then(lambda c: F.lit(None).cast("struct<>"))
    names, values = list(keep), list(keep.values())
    return values[0].then(lambda *c: F.when(c[-1].isNotNull(), F.struct(*[a.alias(n) for a, n in zip(c[:-1], names, strict=True)])), *values[1:], value)


def project(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or not spec:
        raise ValidationError("EMPTY_PROJECT", "$project takes a document of fields")
    s, tree = ctx.scope(df), _tree(spec, "$project")
    flags = [lf.flag for n, t in tree.items() if n != "_id" for lf in (_leaves(t) if isinstance(t, dict) else (t,))]
    id_flag = tree["_id"].flag if "_id" in tree and not isinstance(tree["_id"], dict) else None
    if any(f is False for f in flags) and any(f is not False for f in flags):
        raise ValidationError("MIXED_PROJECT", "$project can't both keep and drop fields")
    if (flags and all(f is False for f in flags)) or (not flags and id_flag is False):
        out = [_exclude(s.field(n), tree[n]).col.alias(n) if isinstance(tree.get(n), dict) else F.col(quoted(n)) for n in visible(df) if n not in tree or isinstance(tree[n], dict) or tree[n].flag]
        return df.select(*out, *beside(df)), ctx
    out: dict[str, Column] = {}
    if "_id" in df.columns and "_id" not in tree:
        out["_id"] = F.col("_id")
    kept = [n for n in visible(df) if n in tree and (isinstance(tree[n], dict) or tree[n].flag)]
    for n in [*kept, *[n for n in tree if n not in kept]]:
        t = tree[n]
        if isinstance(t, dict):
            got = _include(s.field(n), t, s)
            if got is not None:
                out[n] = got.col
        elif t.flag:
            if n in df.columns:
                out[n] = F.col(quoted(n))
        elif t.flag is None:
            out[n] = compiled(t.spec, s).col
    return df.select(*[c.alias(n) for n, c in out.items()], *beside(df)), ctx


def _set(value: Value | None, tree: dict, s: Scope) -> Value:
    """value with the fields of tree set."""
    kind = value.type if value is not None else T.NullType()
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        first = value.then(lambda c: F.get(c, F.lit(0)), kind=kind.elementType)
        return value.then(lambda c: F.transform(c, lambda e: _set(Value(e, value.frame, first.probe, first.type), tree, s).col))
    parts = {n: step(value, [n]) for n in kind.fieldNames()} if isinstance(kind, T.StructType) else {}
    for n, t in tree.items():
        parts[n] = _set(parts.get(n), t, s) if isinstance(t, dict) else compiled(t.spec, s)
    names, values = list(parts), list(parts.values())
    return values[0].then(lambda *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)]), *values[1:])


def add_fields(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or not spec:
        raise ValidationError("EMPTY_FIELDS", "$addFields takes a document of fields")
    s = ctx.scope(df)
    tree = _tree({k: v if not isinstance(v, (bool, int, float)) else {"$literal": v} for k, v in spec.items()}, "$addFields")
    new = {}
    for n, t in tree.items():
        if isinstance(t, dict):
            new[n] = _set(s.field(n) if n in df.columns else None, t, s).col
        else:
            new[n] = compiled(t.spec, s).col
    return df.withColumns(new), ctx


def unset(df: DataFrame, spec, ctx: Context):
    names = spec if isinstance(spec, list) else [spec]
    if not names or not all(isinstance(n, str) and n for n in names):
        raise ValidationError("EMPTY_FIELDS", "$unset takes a name or a list of names")
    return project(df, dict.fromkeys(names, 0), ctx)


def replace_root(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or "newRoot" not in spec:
        raise ValidationError("MISSING_ARGUMENT", "$replaceRoot needs newRoot")
    v = compiled(spec["newRoot"], ctx.scope(df))
    if isinstance(v.type, T.MapType):
        raise ValidationError("NOT_A_DOCUMENT", "a new root with fields known only at run time can't be a table")
    if not isinstance(v.type, T.StructType):
        raise ValidationError("NOT_A_DOCUMENT", "newRoot must be a document")
    rows = df.select(v.col.alias("__new"), *beside(df))
    return rows.select("__new.*", *beside(df)), ctx


# --- order and number


def sort(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or not spec:
        raise ValidationError("EMPTY_SORT", "$sort takes a document of fields")
    df = df.drop(*[c for c in df.columns if c.startswith("__sort_")])
    s, order, copies = ctx.scope(df), [], {}
    for path, way in spec.items():
        if isinstance(way, bool) or not isinstance(way, (int, float)) or not -1 >= way and not way >= 1:
            raise ValidationError("BAD_DIRECTION", f"{path}: 1 or -1")
        c = s.field(path)
        if not is_null(c.type):
            order.append((f"__sort_{len(order)}", way > 0))
            copies[order[-1][0]] = c.col
    # copies of the keys outlive projections; rows are brought into order only where it shows, not for groups that follow it by its keys
    return df.withColumns(copies), ctx.sorted(order)


def ordered(df: DataFrame, ctx: Context, keys: list[tuple[Column, bool]]) -> tuple[DataFrame, Context]:
    """The rows with copies of the keys that they are to be in order by."""
    order = [(f"__sort_{i}", up) for i, (_, up) in enumerate(keys)]
    return df.withColumns({name: c for (name, _), (c, _) in zip(order, keys, strict=True)}), ctx.sorted(order)


def ordering(df: DataFrame, ctx: Context) -> list[Column]:
    s = ctx.scope(df)
    keys = [s.field(p).col for p, _ in ctx.order]
    return [k.asc() if up else k.desc() for k, (_, up) in zip(keys, ctx.order, strict=True)]


def _whole(x, name: str, least: int) -> int:
    if isinstance(x, dict) and set(x) <= {"$numberLong", "$numberInt"}:
        x = int(next(iter(x.values())))
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x) or x < least:
        raise ValidationError("BAD_NUMBER", f"{name} takes a whole number of {least} or more")
    return int(x)


def _within(df: DataFrame, ctx: Context, keep) -> DataFrame:
    """Rows whose place among those of equal carry fits."""
    keys = ordering(df, ctx) or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*ctx.kept()).orderBy(*keys))
    return df.withColumn("__place", place).where(keep(F.col("__place"))).drop("__place")


def limit(df: DataFrame, spec, ctx: Context):
    n = _whole(spec, "$limit", 1)
    df, ctx = ctx.arranged(df)
    return (_within(df, ctx, lambda p: p <= n) if ctx.carry else df.limit(n)), ctx


def skip(df: DataFrame, spec, ctx: Context):
    n = _whole(spec, "$skip", 0)
    df, ctx = ctx.arranged(df)
    return (_within(df, ctx, lambda p: p > n) if ctx.carry else df.offset(n)), ctx


def sample(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or "size" not in spec:
        raise ValidationError("MISSING_ARGUMENT", "$sample needs size")
    n = _whole(spec["size"], "$sample", 1)
    if ctx.carry:
        dealt = df.withColumn("__sort_dice", F.rand())
        return _within(dealt, ctx.sorted([("__sort_dice", True)]), lambda p: p <= n).drop("__sort_dice"), ctx.unsorted()
    return df.orderBy(F.rand()).limit(n), ctx.unsorted()


def unwind(df: DataFrame, spec, ctx: Context):
    spec = spec if isinstance(spec, dict) else {"path": spec}
    path = spec.get("path")
    if not isinstance(path, str) or not path.startswith("$"):
        raise ValidationError("BAD_PATH", "$unwind takes a path that begins with $")
    parts, keep, index = segments(path[1:]), bool(spec.get("preserveNullAndEmptyArrays")), spec.get("includeArrayIndex")
    if index is not None and (not isinstance(index, str) or index.startswith("$")):
        raise ValidationError("BAD_INDEX", "includeArrayIndex takes a name")
    value = ctx.scope(df).field(path[1:])
    if not isinstance(value.type, T.ArrayType):  # a single value counts as its own element
        out = df if keep else df.where(value.col.isNotNull())
        return (out.withColumn(index, F.lit(None).cast("long")) if index else out), ctx
    names = df.columns
    made = df.select(*[F.col(quoted(c)) for c in names], (F.posexplode_outer if keep else F.posexplode)(value.col).alias("__at", "__element"))
    new = F.col("__element")
    if len(parts) > 1:
        new = F.col(quoted(parts[0])).withField(".".join(quoted(p) for p in parts[1:]), new)
    made = made.withColumn(parts[0], new)
    if index:
        made = made.withColumn(index, F.col("__at").cast("long"))
    return made.drop("__at", "__element"), ctx


# --- $redact


def redact(df: DataFrame, spec, ctx: Context):
    s = ctx.scope(df)

    def judged(doc: Value, inner: Scope) -> Value:
        verdict = compiled(spec, inner)
        below = _descended(doc, s, lambda v: judged(v, s.inside(v)))
        return doc.then(lambda d, v, b: F.when(v == "$$KEEP", d).when(v == "$$DESCEND", b), verdict, below, kind=doc.type)

    out = df.select(judged(s.root(), s).col.alias("__doc"), *beside(df)).where("__doc is not null")
    return out.select("__doc.*", *beside(df)), ctx


def _descended(doc: Value, s: Scope, judge) -> Value:
    """The document with its subdocuments judged; those in arrays that are pruned leave their array."""
    parts = []
    for f in doc.type.fields:
        v = step(doc, [f.name])
        if isinstance(f.dataType, T.StructType):
            v = judge(v)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            first = v.then(lambda c: F.get(c, F.lit(0)), kind=f.dataType.elementType)
            v = v.then(lambda c, first=first: F.filter(F.transform(c, lambda e: judge(Value(e, doc.frame, first.probe, first.type)).col), lambda e: e.isNotNull()), kind=f.dataType)
        parts.append(v)
    names = doc.type.fieldNames()
    return parts[0].then(lambda *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)]), *parts[1:], kind=doc.type)


def union_with(df: DataFrame, spec, ctx: Context):
    spec = {"coll": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or "coll" not in spec:
        raise ValidationError("MISSING_ARGUMENT", "$unionWith needs coll")
    if ctx.carry:
        raise ValidationError("NOT_HERE", "$unionWith can't stand in the pipeline of a $lookup")
    other, _ = ctx.run(ctx.catalog.get(spec["coll"]), spec.get("pipeline", []), ctx.unsorted())
    a, b = bare(df), bare(other)
    b = b.toDF(*b.columns)
    both = set(a.columns) & set(b.columns)
    sa, sb = Scope(a), Scope(b)
    for n in both:  # unlike types meet as text
        if rank(a.schema[n].dataType) != rank(b.schema[n].dataType) and not is_null(a.schema[n].dataType) and not is_null(b.schema[n].dataType):
            a, b = a.withColumn(n, text(sa.field(n)).col), b.withColumn(n, text(sb.field(n)).col)
    return a.unionByName(b, allowMissingColumns=True), ctx.unsorted()
