"""Accumulators of groups and functions over windows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedOperatorError, ValidationError
from .expressions import compiled
from .values import Scope, Value, is_null, is_number, number, quoted

#: (column of the sort key, ascending)
Order = list[tuple[str, bool]]


def _single(spec, name: str):
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ValidationError("ONE_ACCUMULATOR", f"{name} takes one accumulator")
    return next(iter(spec.items()))


def sort_key(order: Order, s: Scope) -> tuple[Column, bool] | None:
    """One sortable column for an order whose keys all have one direction (or are numbers), and whether it ascends."""
    if not order:
        return None
    ways = {w for _, w in order}
    parts = []
    for name, up in order:
        v = s.field(name)
        if len(ways) > 1 and not up:
            if not is_number(v.type):
                return None
            # descending has null last: a flag before the negated number
            parts += [v.col.isNull().alias(f"f{len(parts)}"), (-v.col).alias(f"k{len(parts)}")]
        else:
            parts.append(v.col.alias(f"k{len(parts)}"))
    return F.struct(*parts), len(ways) > 1 or ways == {True}


def accumulator(name: str, spec, s: Scope, order: Order | None = None, ranked: Column | None = None) -> Column:
    """The aggregate of {op: argument}. order: that of the $sort before, for $first, $last and $push. ranked: the row's place in that
    order within its group, where order can't be one sortable column."""
    op, x = _single(spec, name)
    if op == "$count":
        return F.count(F.lit(1))
    if isinstance(x, (list, bool)) and op not in ("$push", "$addToSet"):
        raise ValidationError("BAD_ARGUMENT", f"{op} doesn't take a list or a boolean")
    v = compiled(x, s) if x is not None and x != {} else s.missing()
    if op == "$sum":
        n = number(v)
        zero = F.lit(0.0) if isinstance(n.type, (T.DoubleType, T.FloatType)) and not is_null(v.type) else F.lit(0)
        return F.coalesce(F.sum(n.col), zero)
    if op == "$avg":
        return F.avg(number(v).col)
    if op in ("$stdDevPop", "$stdDevSamp"):
        return (F.stddev_pop if op == "$stdDevPop" else F.stddev_samp)(number(v).col.cast("double"))
    if op in ("$min", "$max"):
        return (F.min if op == "$min" else F.max)(v.col)
    key, up = (ranked, True) if ranked is not None else sort_key(order or [], s) or (None, True)
    if op in ("$first", "$last"):
        if key is None:
            return (F.first if op == "$first" else F.last)(v.col)
        return (F.min_by if up == (op == "$first") else F.max_by)(v.col, key)
    if op == "$push":
        if key is None:
            return F.transform(F.collect_list(F.struct(v.col.alias("x"))), lambda e: e["x"])
        return F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), v.col.alias("x"))), up), lambda e: e["x"])
    if op == "$addToSet":  # in a box, null isn't left out
        return F.transform(F.sort_array(F.collect_set(F.struct(v.col.alias("x")))), lambda e: e["x"])
    if op == "$mergeObjects":
        return _merged(x, v, s, key, up)
    raise UnsupportedOperatorError(op)


def _merged(x, v: Value, s: Scope, key: Column | None, up: bool) -> Column:
    """The merge of all documents, field by field: of each the value in the last document that has it. Where the raw documents
    are known, a null that is there is a value; else null counts as absent."""
    from .predicates import exists

    if is_null(v.type):
        return F.last(v.col)
    if not isinstance(v.type, T.StructType):
        raise UnsupportedOperatorError("$mergeObjects of values that aren't documents of known fields")
    raw = isinstance(x, str) and x.startswith("$") and not x.startswith("$$") and "__raw" in s.frame.columns and not s.document
    out = []
    for n in v.type.fieldNames():
        value = v.col.getField(n)
        there = exists(f"{x[1:]}.{n}", s) if raw else value.isNotNull()
        boxed = F.when(there, F.struct(value.alias("x")))  # a null in a box is not left out
        pick = F.last(boxed, ignorenulls=True) if key is None else (F.max_by if up else F.min_by)(boxed, F.when(there, key))
        out.append(pick["x"].alias(n))
    return F.struct(*out)


def needs_order(spec) -> bool:
    return isinstance(spec, dict) and any(k in spec for k in ("$first", "$last", "$push", "$mergeObjects"))


def windowed(name: str, op: str, x, s: Scope, w: WindowSpec, framed: WindowSpec) -> Column:
    """The window function {op: x}; framed: the window with the rows that aggregates see."""
    if op in ("$rank", "$denseRank", "$documentNumber", "$rowNumber"):
        return {"$rank": F.rank, "$denseRank": F.dense_rank}.get(op, F.row_number)().over(w)
    if op == "$shift":
        if isinstance(x, dict) and "output" in x:
            v, by, default = compiled(x["output"], s), x.get("by", 1), x.get("default")
        else:
            v, by, default = compiled(x, s), -1, None
        return (F.lag(v.col, -by, default) if by < 0 else F.lead(v.col, by, default)).over(w)
    if op == "$count":
        return F.count(F.lit(1)).over(framed)
    v = compiled(x, s)
    if op == "$sum":
        n = number(v)
        return F.coalesce(F.sum(n.col).over(framed), F.lit(0.0) if isinstance(n.type, T.DoubleType) else F.lit(0))
    if op in ("$push", "$addToSet"):
        boxed = (F.collect_list if op == "$push" else F.collect_set)(F.struct(v.col.alias("x"))).over(framed)
        return F.transform(boxed if op == "$push" else F.sort_array(boxed), lambda e: e["x"])
    if op not in _SIMPLE:
        raise UnsupportedOperatorError(op)
    return _SIMPLE[op](number(v).col if op in _NUMERIC else v.col).over(framed)


_SIMPLE = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
_NUMERIC = ("$avg", "$stdDevPop", "$stdDevSamp")
_CALENDAR = {"$sum": "sum", "$avg": "avg", "$min": "min", "$max": "max", "$first": "first", "$last": "last", "$count": "count", "$stdDevPop": "stddev_pop", "$stdDevSamp": "stddev_samp", "$push": "collect_list", "$addToSet": "collect_set"}


def calendar_argument(op: str, x, s: Scope) -> Column:
    """What the function of a calendar frame is computed from, as a column."""
    if op not in _CALENDAR:
        raise UnsupportedOperatorError(op)
    if op == "$count":
        return F.lit(1)
    v = compiled(x, s)
    return F.struct(v.col.alias("x")) if op in ("$push", "$addToSet") else number(v).col if op in ("$sum", *_NUMERIC) else v.col


def calendar(op: str, column: str, over: str, rows) -> Column:
    """The function over a frame that is written as SQL."""
    out = F.expr(f"{_CALENDAR[op]}(`{column}`) {over}")
    if op == "$sum":
        return F.coalesce(out, F.lit(0).cast(rows.schema[column].dataType))
    if op in ("$push", "$addToSet"):
        return F.transform(out if op == "$push" else F.sort_array(out), lambda e: e["x"])
    return out


__all__ = ["Order", "Value", "accumulator", "needs_order", "quoted", "sort_key", "windowed"]
