"""Query predicates ({field: value}, $and, $expr, ...), compiled to conditions.

A condition that doesn't hold is false or null; a filter drops both. Only below negations null is made false (_sure): bare comparisons are what
scans can push down."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedOperatorError, ValidationError
from .expressions import compiled, contains, plain, type_name
from .values import Scope, Value, date, is_date, is_null, is_number, rank, step, truth

EXTENDED = ("$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$oid")


def condition(query: dict, s: Scope) -> Column:
    """The condition of a whole query document; several fields are joined by and."""
    if not isinstance(query, dict) or not query:
        raise ValidationError("EMPTY_QUERY", "a query needs at least one condition")
    return _all([_entry(k, v, s) for k, v in query.items()])


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _entry(name: str, x, s: Scope) -> Column:
    if name in ("$and", "$or", "$nor"):
        if not isinstance(x, list) or not x:
            raise ValidationError("EMPTY_LIST", f"{name} takes a list of conditions")
        parts = [condition(q, s) for q in x]
        return _all(parts) if name == "$and" else _any(parts) if name == "$or" else ~_sure(_any(parts))
    if name == "$not":
        return ~_sure(condition(x, s))
    if name == "$expr":
        return _expression(x, s)
    if name == "$comment":
        return F.lit(True)
    if name.startswith("$"):
        raise UnsupportedOperatorError(name)
    value = s.field(name)
    if isinstance(x, dict) and x and all(k.startswith("$") for k in x) and not set(x) <= set(EXTENDED):
        return _all([_operator(k, v, value, x, name, s) for k, v in x.items() if k != "$options"])
    return equals(value, x)


#: The other way round.
_MIRROR = {"$gt": "$lt", "$gte": "$lte", "$lt": "$gt", "$lte": "$gte", "$eq": "$eq"}


def _expression(x, s: Scope) -> Column:
    """The condition of $expr. Comparisons of a path with a literal become bare comparisons; null comes before all literals."""
    if isinstance(x, dict) and len(x) == 1:
        (op, args), *_ = x.items()
        if op in ("$and", "$or") and isinstance(args, list) and args:
            return (_all if op == "$and" else _any)([_expression(a, s) for a in args])
        if op in _MIRROR and isinstance(args, list) and len(args) == 2:
            a, b = args
            if _is_literal(a) and not _is_literal(b):
                op, a, b = _MIRROR[op], b, a
            if isinstance(a, str) and a.startswith("$") and _is_literal(b):
                value = compiled(a, s)
                literal = _literal(b, value.type, s.frame)
                if not isinstance(value.type, (T.ArrayType, T.StructType, T.MapType)) and rank(value.type) == rank(literal.type) != -1:
                    p, q = value.col, literal.col
                    bare = {"$gt": p > q, "$gte": p >= q, "$lt": p < q, "$lte": p <= q, "$eq": p == q}[op]
                    return bare | p.isNull() if op in ("$lt", "$lte") else bare
    return truth(compiled(x, s)).col


def _is_literal(x) -> bool:
    x = plain(x)
    return x is not None and not isinstance(x, (dict, list, tuple)) and not (isinstance(x, str) and x.startswith("$"))


def _literal(x, like: T.DataType, frame) -> Value:
    """The literal in the type of what it is compared with, where that changes no value, so that the column needs no cast."""
    x = plain(x)
    if is_date(like) and isinstance(x, str):
        try:
            x = datetime.datetime.fromisoformat(x.replace("Z", "+00:00"))
            x = x if x.tzinfo else x.replace(tzinfo=datetime.UTC)
        except ValueError:
            return date(Value(F.lit(x), frame))
    if isinstance(x, datetime.datetime):
        at = x.astimezone(datetime.UTC) if x.tzinfo else x
        if isinstance(like, T.DateType) and at.time() == datetime.time():
            return Value(F.lit(at.date()), frame, kind=like)
        if isinstance(like, T.TimestampNTZType):
            return Value(F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast(like), frame, kind=like)
    return Value(F.lit(x), frame)


def equals(value: Value, x) -> Column:
    """field = x; for arrays also: an element is x. Null fits null and missing fields."""
    x = plain(x)
    if x is None:
        out = value.col.isNull()
        if isinstance(value.type, T.ArrayType):
            out = out | _sure(F.exists(value.col, lambda e: e.isNull()))
        return out
    if isinstance(x, list):
        if not isinstance(value.type, T.ArrayType):
            return F.lit(False)
        if not x:
            return F.size(value.col) == 0
        return value.col == F.array(*map(F.lit, x)).cast(value.type)
    if isinstance(x, dict):
        if not isinstance(value.type, T.StructType):
            return F.lit(False)
        return _all([equals(step(value, [k]), v) for k, v in x.items()] + [step(value, [n]).col.isNull() for n in value.type.fieldNames() if n not in x])
    like = value.type.elementType if isinstance(value.type, T.ArrayType) else value.type
    literal = _literal(x, like, value.frame)
    if isinstance(value.type, T.ArrayType):
        return contains(value, literal).col
    if is_null(value.type) or rank(value.type) != rank(literal.type):
        return F.lit(False)
    return value.col == literal.col


def _differs(value: Value, x) -> Column:
    """The contrary of equals, which null and missing fields fulfil."""
    plain_type = not isinstance(value.type, (T.ArrayType, T.StructType, T.MapType, T.NullType))
    if plain_type and _is_literal(x):
        literal = _literal(x, value.type, value.frame)
        if rank(value.type) == rank(literal.type):
            return ~value.col.eqNullSafe(literal.col)
    return ~_sure(equals(value, x))


def _order(op: str, value: Value, x) -> Column:
    """Only values of the same kind compare; an array fits if an element does."""
    if isinstance(value.type, T.ArrayType):
        first = value.then(lambda c: F.get(c, F.lit(0)), kind=value.type.elementType)
        return F.exists(value.col, lambda e: _sure(_order(op, Value(e, value.frame, first.probe, first.type), x)))
    if plain(x) is None:
        return value.col.isNull() if op in ("$gte", "$lte") else F.lit(False)
    literal = _literal(x, value.type, value.frame)
    if rank(value.type) != rank(literal.type):
        return F.lit(False)
    a, b = value.col, literal.col
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def exists(name: str, s: Scope) -> Column:
    """Whether the field is there. Tables have their columns in every row; a collection that was read with its raw documents
    knows it row by row, so that a null that is there exists; below documents and in other collections a null counts as absent."""
    if "__raw" in s.frame.columns and not s.document:
        return F.expr(f"variant_get(__raw, '$.{name}') is not null")
    value = s.field(name)
    if is_null(value.type) and "." not in name and name not in s.frame.columns:
        return F.lit(False)
    if "." not in name and not s.document:
        return F.lit(True)
    head, _, last = name.rpartition(".")
    parent = s.field(head) if head else s.root()
    return parent.col.isNotNull() if isinstance(parent.type, T.StructType) and last in parent.type.fieldNames() else value.col.isNotNull()


def _operator(op: str, x, value: Value, whole: dict, name: str, s: Scope) -> Column:
    if op == "$eq":
        return equals(value, x)
    if op == "$ne":
        return _differs(value, x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _order(op, value, x)
    if op in ("$in", "$nin"):
        if not isinstance(x, list) or not x:
            raise ValidationError("EMPTY_LIST", f"{op} takes a list of values")
        items = [plain(i) for i in x]
        simple = not isinstance(value.type, (T.ArrayType, T.StructType, T.NullType)) and not is_date(value.type)
        own = [i for i in items if i is not None and not isinstance(i, (list, dict)) and rank(Value(F.lit(i), s.frame).type) == rank(value.type)] if simple else []
        if simple:
            found = value.col.isin(*own) if own else F.lit(False)
            if op == "$in":
                return found | value.col.isNull() if None in items else found
            return ~found if None in items else ~found | value.col.isNull()
        found = _any([equals(value, i) for i in items])
        return found if op == "$in" else ~_sure(found)
    if op == "$exists":
        if not isinstance(x, (bool, int)):
            raise ValidationError("NOT_BOOLEAN", "$exists takes true or false")
        return exists(name, s) if x else ~exists(name, s)
    if op == "$not":
        if not isinstance(x, dict) or not x:
            raise ValidationError("NOT_A_CONDITION", "$not takes operators")
        return ~_sure(_all([_operator(k, v, value, x, name, s) for k, v in x.items()]))
    if op == "$regex":
        flags = "".join(f for f in whole.get("$options", "") if f in "imsx")
        pattern = (f"(?{flags})" if flags else "") + x
        if isinstance(value.type, T.ArrayType):
            return F.exists(value.col, lambda e: _sure(e.rlike(pattern)))
        return value.col.rlike(pattern) if isinstance(value.type, T.StringType) else F.lit(False)
    if op == "$size":
        return F.size(value.col) == x if isinstance(value.type, T.ArrayType) else F.lit(False)
    if op == "$all":
        return _all([equals(value, i) for i in x]) if x else F.lit(False)
    if op == "$mod":
        return F.try_mod(value.col.cast("long"), F.lit(x[0])) == x[1] if is_number(value.type) else F.lit(False)
    if op == "$type":
        names = x if isinstance(x, list) else [x]
        own = type_name(value.type)
        there = value.col.isNotNull() if own in names or "number" in names and is_number(value.type) else F.lit(False)
        return there | value.col.isNull() if "null" in names else there
    if op == "$elemMatch":
        if not isinstance(value.type, T.ArrayType):
            return F.lit(False)
        first = value.then(lambda c: F.get(c, F.lit(0)), kind=value.type.elementType)

        def fits(e: Column) -> Column:
            v = Value(e, s.frame, first.probe, first.type)
            if all(k.startswith("$") for k in x):
                return _sure(_all([_operator(k, q, v, x, name, s) for k, q in x.items()]))
            return _sure(condition(x, s.inside(v)))

        return F.exists(value.col, fits)
    raise UnsupportedOperatorError(op)
