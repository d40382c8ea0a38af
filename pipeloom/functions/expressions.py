"""Expressions of the pipeline language, compiled to columns."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedOperatorError, ValidationError
from .values import Scope, Value, date, is_date, is_null, is_number, number, rank, text, truth

BOOL, LONG, INT, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
OPERATORS: dict[str, Callable[[object, Scope], Value]] = {}


def compiled(x, s: Scope) -> Value:
    """Compiles a path ("$a.b"), a variable ("$$v"), an operator document, a document, an array or a literal."""
    if isinstance(x, str):
        if x.startswith("$$"):
            found = s.variable(x[2:])
            if found is not None:
                return found
            if x[2:].isupper():
                return s.literal(x)  # $$KEEP and the like stand for themselves
            raise ValidationError("UNKNOWN_VARIABLE", f"no variable {x}")
        return s.field(x[1:]) if x.startswith("$") else s.literal(x)
    if isinstance(x, dict):
        if len(x) == 1 and next(iter(x)).startswith("$"):
            name, arg = next(iter(x.items()))
            if name in ("$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$oid"):
                return s.literal(plain(x))
            if name not in OPERATORS:
                raise UnsupportedOperatorError(name)
            return OPERATORS[name](arg, s)
        if any(k.startswith("$") for k in x):
            raise ValidationError("MIXED_OPERATORS", f"operators can't stand beside other keys: {sorted(x)}")
        parts = {k: compiled(v, s) for k, v in x.items()}
        if not parts:
            return Value(F.struct(), s.frame)
        names, values = list(parts), list(parts.values())
        return values[0].then(lambda *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)]), *values[1:])
    if isinstance(x, (list, tuple)):
        return array_of([compiled(v, s) for v in x], s)
    return s.literal(x)


def plain(x):
    """A literal of extended JSON as a Python value."""
    if isinstance(x, dict) and len(x) == 1:
        (name, v), *_ = x.items()
        if name == "$date":
            if isinstance(v, dict):
                v = int(v["$numberLong"])
            if isinstance(v, (int, float)):
                return datetime.datetime.fromtimestamp(v / 1000, datetime.UTC)
            at = datetime.datetime.fromisoformat(v.replace("Z", "+00:00"))
            return at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
        if name in ("$numberLong", "$numberInt"):
            return int(v)
        if name == "$numberDouble":
            return float(v)
        if name == "$numberDecimal":
            return Decimal(v)
        if name == "$oid":
            return v
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


class Empty(Value):
    """The array literal without elements: of texts, unless it meets arrays of another type."""

    __slots__ = ()

    def as_type(self, kind: T.DataType) -> Value:
        kind = _nullable(kind)
        return Value(F.array().cast(kind), self.frame, kind=kind)


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    return kind


def met(values: list[Value]) -> list[Value]:
    """The values, of which empty array literals take the type of the first other array."""
    kind = next((v.type for v in values if not isinstance(v, Empty) and isinstance(v.type, T.ArrayType)), None)
    return values if kind is None else [v.as_type(kind) if isinstance(v, Empty) else v for v in values]


def array_of(values: list[Value], s: Scope) -> Value:
    if not values:
        return Empty(F.array().cast("array<string>"), s.frame, kind=T.ArrayType(STRING))
    values = met(values)
    if len({rank(v.type) for v in values if not is_null(v.type)}) > 1:
        values = [text(v) for v in values]
    return values[0].then(lambda *c: F.array(*c), *values[1:])


def operator(*names: str):
    def put(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return put


def arguments(x, s: Scope, name: str, low: int, high: int | None = None) -> list[Value]:
    """The operands: a list of low to high of them; where one will do, it may stand without a list."""
    items = list(x) if isinstance(x, (list, tuple)) else [x]
    if len(items) < low or (high is not None and len(items) > high):
        raise ValidationError("ARGUMENT_COUNT", f"{name} takes {low}{'' if high == low else ' or more' if high is None else f' to {high}'} arguments, not {len(items)}")
    return [compiled(i, s) for i in items]


def options(x, name: str, needed: tuple[str, ...], other: tuple[str, ...] = ()) -> dict:
    if not isinstance(x, dict) or any(k not in x for k in needed):
        raise ValidationError("MISSING_ARGUMENT", f"{name} needs {', '.join(needed)}")
    if extra := set(x) - {*needed, *other}:
        raise ValidationError("UNKNOWN_ARGUMENT", f"{name} doesn't take {', '.join(sorted(extra))}")
    return x


# --- comparison and logic


def compare(op: str, a: Value, b: Value) -> Value:
    """Compares by the order of types first, null before all; unlike types are never equal."""
    x, y = a.type, b.type
    if is_date(x) and isinstance(y, T.StringType):
        b = date(b)
    elif is_date(y) and isinstance(x, T.StringType):
        a = date(a)
    x, y = a.type, b.type
    if not is_null(x) and not is_null(y) and rank(x) != rank(y):  # unlike types: constant unless null
        before = rank(x) < rank(y)

        def unlike(p: Column, q: Column) -> Column:
            less = F.when(p.isNull() & q.isNull(), F.lit(False)).when(p.isNull(), F.lit(True)).when(q.isNull(), F.lit(False)).otherwise(F.lit(before))
            same = p.isNull() & q.isNull()
            return {"$eq": same, "$ne": ~same, "$lt": less, "$lte": less | same, "$gt": ~less & ~same, "$gte": ~less}[op]

        return a.then(unlike, b, kind=BOOL)

    def alike_(p: Column, q: Column) -> Column:
        if op == "$eq":
            return p.eqNullSafe(q)
        if op == "$ne":
            return ~p.eqNullSafe(q)
        if op in ("$gt", "$lt"):
            p, q = (p, q) if op == "$gt" else (q, p)
            return F.when(q.isNull(), p.isNotNull()).when(p.isNull(), F.lit(False)).otherwise(p > q)
        p, q = (p, q) if op == "$gte" else (q, p)
        return F.when(q.isNull(), F.lit(True)).when(p.isNull(), F.lit(False)).otherwise(p >= q)

    return a.then(alike_, b, kind=BOOL)


for _op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
    OPERATORS[_op] = lambda x, s, op=_op: compare(op, *arguments(x, s, op, 2, 2))


@operator("$cmp")
def _cmp(x, s):
    a, b = arguments(x, s, "$cmp", 2, 2)
    return compare("$lt", a, b).then(lambda lt, gt: F.when(lt, -1).when(gt, 1).otherwise(0), compare("$gt", a, b), kind=INT)


def _logical(name: str):
    def f(x, s):
        values = [truth(v) for v in arguments(x, s, name, 0)]
        if not values:
            return s.literal(name != "$or")

        def fold(*c: Column) -> Column:
            out = c[0]
            for d in c[1:]:
                out = out & d if name == "$and" else out | d
            return ~out if name == "$nor" else out

        return values[0].then(fold, *values[1:], kind=BOOL)

    return f


for _op in ("$and", "$or", "$nor"):
    OPERATORS[_op] = _logical(_op)


@operator("$not")
def _not(x, s):
    (v,) = arguments(x, s, "$not", 1, 1)
    return truth(v).then(lambda c: ~c, kind=BOOL)


@operator("$literal")
def _literal(x, s):
    x = plain(x)
    if isinstance(x, list):
        return array_of([_literal(v, s) for v in x], s)
    if isinstance(x, dict):
        return Value(F.struct(*[_literal(v, s).col.alias(k) for k, v in x.items()]), s.frame)
    return s.literal(x)


# --- arithmetic


def _fold(name: str, f: Callable[[Column, Column], Column]):
    def op(x, s):
        values = [number(v) for v in arguments(x, s, name, 1)]

        def run(*c: Column) -> Column:
            out = c[0]
            for d in c[1:]:
                out = f(out, d)
            return out

        return values[0].then(run, *values[1:])

    return op


@operator("$add")
def _add(x, s):
    values = arguments(x, s, "$add", 1)
    if any(is_date(v.type) for v in values):
        day = next(v for v in values if is_date(v.type))
        rest = [number(v) for v in values if v is not day]
        return day.then(lambda d, *n: F.timestamp_millis(F.unix_millis(d.cast("timestamp")) + sum(n, F.lit(0)).cast("long")), *rest, kind=T.TimestampType())
    return _fold("$add", F.try_add)(x, s)


@operator("$subtract")
def _subtract(x, s):
    a, b = arguments(x, s, "$subtract", 2, 2)
    if is_date(a.type):
        millis = lambda c: F.unix_millis(c.cast("timestamp"))
        if is_date(b.type):
            return a.then(lambda p, q: millis(p) - millis(q), b, kind=LONG)
        return a.then(lambda p, q: F.timestamp_millis(millis(p) - q.cast("long")), number(b), kind=T.TimestampType())
    return number(a).then(lambda p, q: F.try_subtract(p, q), number(b))


OPERATORS["$multiply"] = _fold("$multiply", F.try_multiply)


@operator("$divide")
def _divide(x, s):
    a, b = (number(v).then(lambda c: c.cast("double"), kind=DOUBLE) for v in arguments(x, s, "$divide", 2, 2))
    return a.then(lambda p, q: F.try_divide(p, q), b, kind=DOUBLE)


@operator("$mod")
def _mod(x, s):
    a, b = (number(v) for v in arguments(x, s, "$mod", 2, 2))
    return a.then(lambda p, q: F.try_mod(p, q), b)


def _single(name: str, f: Callable[[Column], Column], double: bool = False):
    def op(x, s):
        (v,) = arguments(x, s, name, 1, 1)
        v = number(v)
        return v.then(lambda c: f(c.cast("double") if double else c), kind=DOUBLE if double else None)

    return op


OPERATORS |= {
    "$abs": _single("$abs", F.abs), "$sqrt": _single("$sqrt", F.sqrt, True), "$exp": _single("$exp", F.exp, True),
    "$ln": _single("$ln", F.ln, True), "$log10": _single("$log10", F.log10, True),
    "$sin": _single("$sin", F.sin, True), "$cos": _single("$cos", F.cos, True), "$tan": _single("$tan", F.tan, True),
}


def _whole(name: str, f):
    def op(x, s):
        (v,) = arguments(x, s, name, 1, 1)
        v = number(v)
        if isinstance(v.type, (T.DoubleType, T.FloatType)):
            return v.then(lambda c: f(c).cast("double"), kind=DOUBLE)
        return v.then(f)

    return op


OPERATORS["$ceil"], OPERATORS["$floor"] = _whole("$ceil", F.ceil), _whole("$floor", F.floor)


@operator("$pow")
def _pow(x, s):
    a, b = (number(v) for v in arguments(x, s, "$pow", 2, 2))
    return a.then(lambda p, q: F.pow(p.cast("double"), q.cast("double")), b, kind=DOUBLE)


@operator("$log")
def _log(x, s):
    a, b = (number(v) for v in arguments(x, s, "$log", 2, 2))
    return a.then(lambda p, q: F.ln(p.cast("double")) / F.ln(q.cast("double")), b, kind=DOUBLE)


def _places(x, name: str) -> int:
    n = x[1] if isinstance(x, (list, tuple)) and len(x) > 1 else 0
    if not isinstance(n, int):
        raise ValidationError("LITERAL_NEEDED", f"{name} takes a literal number of places")
    return n


@operator("$round")
def _round(x, s):
    v, n = number(arguments(x, s, "$round", 1, 2)[0]), _places(x, "$round")
    return v.then(lambda c: F.bround(c, n))  # halves go to the even neighbour


@operator("$trunc")
def _trunc(x, s):
    v, n = number(arguments(x, s, "$trunc", 1, 2)[0]), _places(x, "$trunc")
    if not isinstance(v.type, (T.DoubleType, T.FloatType)) and n >= 0 and not isinstance(v.type, T.DecimalType):
        return v
    scale = 10.0**n
    return v.then(lambda c: F.signum(c.cast("double")) * F.floor(F.abs(c.cast("double")) * scale) / scale, kind=DOUBLE)


def _extreme(name: str, many, over_array):
    def op(x, s):
        values = arguments(x, s, name, 1)
        if len(values) == 1:
            v = values[0]
            return v.then(over_array, kind=v.type.elementType) if isinstance(v.type, T.ArrayType) else v
        same = len({rank(v.type) for v in values if not is_null(v.type)}) <= 1
        values = values if same else [text(v) for v in values]
        return values[0].then(lambda *c: many(*c), *values[1:])

    return op


OPERATORS["$max"], OPERATORS["$min"] = _extreme("$max", F.greatest, F.array_max), _extreme("$min", F.least, F.array_min)


def _over_values(name: str, average: bool):
    def op(x, s):
        values = arguments(x, s, name, 1)
        if len(values) == 1 and isinstance(values[0].type, T.ArrayType):
            total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + F.coalesce(e.cast("double"), F.lit(0.0)))
            count = lambda c: F.size(F.filter(c, lambda e: e.isNotNull()))
            return values[0].then(lambda c: F.try_divide(total(c), count(c)) if average else total(c), kind=DOUBLE)
        values = [number(v) for v in values]
        add = lambda c: sum((F.coalesce(d, F.lit(0)) for d in c[1:]), F.coalesce(c[0], F.lit(0)))
        return values[0].then(lambda *c: F.try_divide(add(c).cast("double"), sum((d.isNotNull().cast("int") for d in c), F.lit(0))) if average else add(c), *values[1:])

    return op


OPERATORS["$sum"], OPERATORS["$avg"] = _over_values("$sum", False), _over_values("$avg", True)

# --- conditions


def _choose(s: Scope, branches: list[tuple[Value, Value]], other: Value | None) -> Value:
    results = met([r for _, r in branches] + ([other] if other is not None else []))
    branches, other = [(c, r) for (c, _), r in zip(branches, results)], results[-1] if other is not None else None
    if len({rank(v.type) for v in results if not is_null(v.type)}) > 1:
        branches, other = [(c, text(r)) for c, r in branches], text(other) if other is not None else None
    flat = [v for pair in branches for v in pair] + ([other] if other is not None else [])

    def build(*c: Column) -> Column:
        out = F
        for i in range(0, 2 * len(branches), 2):
            out = out.when(c[i], c[i + 1])
        return out.otherwise(c[-1]) if other is not None else out

    return flat[0].then(build, *flat[1:])


@operator("$cond")
def _cond(x, s):
    if isinstance(x, dict):
        x = options(x, "$cond", ("if", "then", "else"))
        x = [x["if"], x["then"], x["else"]]
    c, a, b = arguments(x, s, "$cond", 3, 3)
    return _choose(s, [(truth(c), a)], b)


@operator("$ifNull")
def _if_null(x, s):
    values = met(arguments(x, s, "$ifNull", 2))
    same = len({rank(v.type) for v in values if not is_null(v.type)}) <= 1
    values = values if same else [text(v) for v in values]
    return values[0].then(lambda *c: F.coalesce(*c), *values[1:])


@operator("$switch")
def _switch(x, s):
    options(x, "$switch", ("branches",), ("default",))
    if not x["branches"]:
        raise ValidationError("EMPTY_BRANCHES", "$switch needs a branch")
    branches = [(truth(compiled(options(b, "$switch branch", ("case", "then"))["case"], s)), compiled(b["then"], s)) for b in x["branches"]]
    return _choose(s, branches, compiled(x["default"], s) if "default" in x else None)


# --- text


@operator("$concat")
def _concat(x, s):
    values = [text(v) for v in arguments(x, s, "$concat", 1)]
    return values[0].then(lambda *c: F.concat(*c), *values[1:], kind=STRING)


def _of_text(name: str, f: Callable[[Column], Column], kind=STRING):
    def op(x, s):
        (v,) = arguments(x, s, name, 1, 1)
        return text(v).then(f, kind=kind)

    return op


OPERATORS |= {
    "$toLower": _of_text("$toLower", lambda c: F.coalesce(F.lower(c), F.lit(""))),
    "$toUpper": _of_text("$toUpper", lambda c: F.coalesce(F.upper(c), F.lit(""))),
    "$strLenCP": _of_text("$strLenCP", F.char_length, INT),
    "$strLenBytes": _of_text("$strLenBytes", F.octet_length, INT),
}


@operator("$substrBytes")
def _substr_bytes(x, s):
    v, a, n = arguments(x, s, "$substrBytes", 3, 3)

    def cut(c, i, m):
        raw = F.encode(c, "UTF-8")
        part = F.when(i < 0, F.lit(b"")).when(m < 0, F.substring(raw, (i + 1).cast("int"), F.octet_length(c))).otherwise(F.substring(raw, (i + 1).cast("int"), m.cast("int")))
        return F.coalesce(F.decode(part, "UTF-8"), F.lit(""))

    return text(v).then(cut, number(a), number(n), kind=STRING)


@operator("$indexOfBytes")
def _index_of_bytes(x, s):
    v, sub, *rest = arguments(x, s, "$indexOfBytes", 2, 4)
    start = number(rest[0]) if rest else s.literal(0)
    end = number(rest[1]) if len(rest) > 1 else None

    def find(c, d, i, *e):
        # bytes are told apart by their hexadecimal digits; an odd place is the middle of a byte, so digits are parted
        pairs = lambda t: F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "$1 ")
        part = F.substring(pairs(c), F.lit(1), (e[0] * 3).cast("int")) if e else pairs(c)
        at = F.position(pairs(d), F.substring(part, (i * 3 + 1).cast("int"), F.char_length(part)))
        return F.when(c.isNotNull() & d.isNotNull(), F.when((i <= F.octet_length(c)) & (at > 0), i + F.floor(at / 3)).otherwise(-1)).cast("int")

    return text(v).then(find, text(sub), start, *([end] if end else []), kind=INT)


@operator("$substr", "$substrCP")
def _substr(x, s):
    v, a, n = arguments(x, s, "$substr", 3, 3)
    cut = lambda c, i, m: F.when(i < 0, F.lit("")).when(m < 0, c.substr((i + 1).cast("int"), F.char_length(c))).otherwise(c.substr((i + 1).cast("int"), m.cast("int")))
    return text(v).then(lambda c, i, m: F.coalesce(cut(c, i, m), F.lit("")), number(a), number(n), kind=STRING)


def _trim(name: str, f):
    def op(x, s):
        if isinstance(x, dict) and "input" in x:
            options(x, name, ("input",), ("chars",))
            v = text(compiled(x["input"], s))
            if "chars" in x:
                return v.then(lambda c, t: f(c, t), text(compiled(x["chars"], s)), kind=STRING)
        else:
            v = text(compiled(x[0] if isinstance(x, (list, tuple)) else x, s))
        return v.then(lambda c: f(c, F.lit(" \t\n\r\x0b\x0c\0")), kind=STRING)

    return op


OPERATORS |= {"$trim": _trim("$trim", F.btrim), "$ltrim": _trim("$ltrim", F.ltrim), "$rtrim": _trim("$rtrim", F.rtrim)}


def _quoted(c: Column) -> Column:
    """A pattern that stands for the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


@operator("$split")
def _split(x, s):
    a, b = (text(v) for v in arguments(x, s, "$split", 2, 2))
    return a.then(lambda c, d: F.split(c, _quoted(d)), b, kind=T.ArrayType(STRING))


@operator("$indexOfCP")
def _index_of(x, s):
    v, sub, *rest = arguments(x, s, "$indexOfCP", 2, 4)
    start = number(rest[0]) if rest else s.literal(0)
    end = number(rest[1]) if len(rest) > 1 else None

    def find(c, d, i, *e):
        part = F.substring(c, F.lit(1), e[0].cast("int")) if e else c
        at = F.position(d, part) if not rest else F.when(i > F.char_length(part), F.lit(0)).otherwise(_locate_from(part, d, i))
        return (at - 1).cast("int")

    return text(v).then(find, text(sub), start, *([end] if end else []), kind=INT)


def _locate_from(c: Column, d: Column, i: Column) -> Column:
    at = F.position(d, c.substr((i + 1).cast("int"), F.char_length(c)))
    return F.when(at > 0, at + i).otherwise(F.lit(0))


def _pattern(x, s, name: str) -> tuple[Value, Value]:
    options(x, name, ("input", "regex"), ("options",))
    flags = _flags(x)
    v, r = text(compiled(x["input"], s)), text(compiled(x["regex"], s))
    return v, r.then(lambda c: F.concat(F.lit(flags), c), kind=STRING) if flags else r


def _flags(x: dict) -> str:
    """The options of a regular expression, as its beginning."""
    flags = "".join(f for f in x.get("options", "") if f in "imsx")
    return f"(?{flags})" if flags else ""


@operator("$regexMatch")
def _regex_match(x, s):
    v, r = _pattern(x, s, "$regexMatch")
    return v.then(lambda c, p: F.coalesce(F.regexp_like(c, p), F.lit(False)), r, kind=BOOL)


@operator("$regexFind")
def _regex_find(x, s):
    v, r = _pattern(x, s, "$regexFind")
    groups = re.compile(x["regex"]).groups if isinstance(x["regex"], str) else 0

    def find(c, p):
        captures = F.array(*[F.regexp_extract(c, _flags(x) + x["regex"], i + 1) for i in range(groups)]).cast("array<string>")
        whole = F.regexp_substr(c, p)
        # a match begins where the text before it ends: the first place of its text from where the pattern holds
        return F.when(F.regexp_like(c, p), F.struct(whole.alias("match"), (F.regexp_instr(c, p) - 1).cast("int").alias("idx"), captures.alias("captures")))

    return v.then(find, r)


@operator("$regexFindAll")
def _regex_find_all(x, s):
    v, r = _pattern(x, s, "$regexFindAll")
    return v.then(lambda c, p: F.transform(F.regexp_extract_all(c, p, F.lit(0)), lambda m: F.struct(m.alias("match"))), r)


@operator("$replaceAll")
def _replace_all(x, s):
    options(x, "$replaceAll", ("input", "find", "replacement"))
    v, a, b = (text(compiled(x[k], s)) for k in ("input", "find", "replacement"))
    return v.then(lambda c, p, q: F.replace(c, p, q), a, b, kind=STRING)


@operator("$replaceOne")
def _replace_one(x, s):
    options(x, "$replaceOne", ("input", "find", "replacement"))
    v, a, b = (text(compiled(x[k], s)) for k in ("input", "find", "replacement"))

    def once(c, p, q):
        at = F.position(p, c)
        return F.when(p.isNull() | q.isNull(), F.lit(None).cast("string")).when(at > 0, F.concat(c.substr(F.lit(1), at - 1), q, c.substr(at + F.char_length(p), F.char_length(c)))).otherwise(c)

    return v.then(once, a, b, kind=STRING)


@operator("$strcasecmp")
def _strcasecmp(x, s):
    a, b = (text(v).then(lambda c: F.upper(F.coalesce(c, F.lit(""))), kind=STRING) for v in arguments(x, s, "$strcasecmp", 2, 2))
    return a.then(lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0), b, kind=INT)


# --- dates


def _of_date(name: str, f):
    def op(x, s):
        v = compiled(x["date"] if isinstance(x, dict) and "date" in x else x[0] if isinstance(x, (list, tuple)) else x, s)
        return date(v).then(lambda c: f(c).cast("int"), kind=INT)

    return op


OPERATORS |= {
    "$year": _of_date("$year", F.year), "$month": _of_date("$month", F.month), "$dayOfMonth": _of_date("$dayOfMonth", F.dayofmonth),
    "$hour": _of_date("$hour", F.hour), "$minute": _of_date("$minute", F.minute), "$second": _of_date("$second", F.second),
    "$millisecond": _of_date("$millisecond", lambda c: F.pmod(F.unix_millis(c.cast("timestamp")), F.lit(1000))),
    "$dayOfWeek": _of_date("$dayOfWeek", F.dayofweek), "$dayOfYear": _of_date("$dayOfYear", F.dayofyear),
    "$week": _of_date("$week", lambda c: F.floor((F.dayofyear(c) - F.dayofweek(c) + 7) / 7)),  # weeks begin on Sunday
    "$isoWeek": _of_date("$isoWeek", F.weekofyear), "$isoDayOfWeek": _of_date("$isoDayOfWeek", lambda c: F.weekday(c) + 1),
    "$isoWeekYear": _of_date("$isoWeekYear", lambda c: F.extract(F.lit("YEAROFWEEK"), c)),
}

#: Parts of a date format, as Spark's formatter has them (fixed values).
_DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "xx"}


def _date_pattern(form: str) -> str:
    """The format as a pattern of Spark's, its other text in quotes."""
    out, other = "", ""
    for part in [*re.findall(r"%.?|[^%]+", form, re.S), ""]:
        if part == "%%" or part and part[0] != "%":
            other += part[-1] if part == "%%" else part
            continue
        if part and part not in _DATE_PARTS:
            raise UnsupportedOperatorError(f"$dateToString with {part}")
        out += ("'" + other.replace("'", "''") + "'" if other else "") + _DATE_PARTS.get(part, "")
        other = ""
    return out


@operator("$dateToString")
def _date_to_string(x, s):
    options(x, "$dateToString", ("date",), ("format", "onNull"))
    form = _date_pattern(x.get("format", "%Y-%m-%dT%H:%M:%S.%LZ"))
    v = date(compiled(x["date"], s)).then(lambda c: F.date_format(c, form), kind=STRING)
    return v.then(lambda c, d: F.coalesce(c, d), text(compiled(x["onNull"], s)), kind=STRING) if "onNull" in x else v


# --- arrays


def elements(v: Value) -> T.DataType:
    return v.type.elementType if isinstance(v.type, T.ArrayType) else T.NullType()


def sample(v: Value) -> Value:
    """An element of the array, for finding types."""
    return v.then(lambda c: F.get(c, F.lit(0)), kind=elements(v))


def an_array(v: Value) -> Value:
    """The value if it is an array, else null."""
    return v if isinstance(v.type, T.ArrayType) else Value(F.lit(None).cast("array<string>"), v.frame, kind=T.ArrayType(STRING))


def _same_elements(values: list[Value]) -> list[Value]:
    values = met([an_array(v) for v in values])
    if len({rank(elements(v)) for v in values if not is_null(elements(v))}) > 1:
        return [each(v, lambda e: text(e)) for v in values]
    return values


def each(v: Value, f: Callable[[Value], Value], probe: Value | None = None) -> Value:
    """The array of f of each element."""
    first = probe or sample(v)
    return v.then(lambda c: F.transform(c, lambda e: f(Value(e, v.frame, first.probe, first.type)).col))


@operator("$arrayElemAt")
def _array_elem_at(x, s):
    v, i = arguments(x, s, "$arrayElemAt", 2, 2)
    v = an_array(v)
    return v.then(lambda c, k: F.when(k >= 0, F.get(c, k.cast("int"))).otherwise(F.try_element_at(c, F.when(k < 0, k.cast("int")))), number(i), kind=elements(v))


@operator("$first")
def _first(x, s):
    v = an_array(compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s))
    return v.then(lambda c: F.get(c, F.lit(0)), kind=elements(v))


@operator("$last")
def _last(x, s):
    v = an_array(compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s))
    return v.then(lambda c: F.try_element_at(c, F.lit(-1)), kind=elements(v))


@operator("$size")
def _size(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    return an_array(v).then(lambda c: F.when(c.isNotNull(), F.size(c)), kind=INT)


def _with(s: Scope, v: Value, name: str, body, use: Callable[[Column, Callable], Column]) -> Value:
    """use(array, f), where f is body as a function of an element called name."""
    first = sample(v)

    def run(array: Column) -> Column:
        return use(array, lambda e: body(s.bind(**{name: Value(e, s.frame, first.probe, first.type)})).col)

    outer = any(w._probe for w in s.variables.values())
    return Value(run(v.col), s.frame, lambda: use(v.probe(), lambda e: body(_outside(s).bind(**{name: Value(e, s.frame, first.probe, first.type)})).col)) if outer or v._probe else Value(run(v.col), s.frame)


def _outside(s: Scope) -> Scope:
    """The scope with variables as columns of the frame."""
    return s.bind(**{k: Value(w.probe(), s.frame, kind=w.type) for k, w in s.variables.items()})


@operator("$filter")
def _filter(x, s):
    options(x, "$filter", ("input", "cond"), ("as", "limit"))
    v = an_array(compiled(x["input"], s))
    out = _with(s, v, x.get("as", "this"), lambda t: truth(compiled(x["cond"], t)), F.filter)
    out._type = v.type
    return out.then(lambda c, n: F.slice(c, 1, n.cast("int")), number(compiled(x["limit"], s)), kind=v.type) if "limit" in x else out


@operator("$map")
def _map(x, s):
    options(x, "$map", ("input", "in"), ("as",))
    return _with(s, an_array(compiled(x["input"], s)), x.get("as", "this"), lambda t: compiled(x["in"], t), F.transform)


@operator("$reduce")
def _reduce(x, s):
    options(x, "$reduce", ("input", "initialValue", "in"))
    v, start = an_array(compiled(x["input"], s)), compiled(x["initialValue"], s)
    first = sample(v)
    if isinstance(start, Empty):  # it is what the first step makes of it
        body = compiled(x["in"], _outside(s).bind(value=start, this=Value(first.probe(), s.frame, kind=first.type)))
        start = start.as_type(body.type) if isinstance(body.type, T.ArrayType) else start
    if is_number(start.type):  # sums may leave the type of their start
        start = number(start)
        body = compiled(x["in"], _outside(s).bind(value=Value(start.probe(), s.frame, kind=start.type), this=Value(first.probe(), s.frame, kind=first.type)))
        if isinstance(body.type, (T.DoubleType, T.FloatType)):
            start = start.then(lambda c: c.cast("double"), kind=DOUBLE)

    def run(array: Column, begin: Column, t: Scope) -> Column:
        return F.aggregate(array, begin, lambda acc, e: compiled(x["in"], t.bind(value=Value(acc, s.frame, start.probe, start.type), this=Value(e, s.frame, first.probe, first.type))).col.cast(start.type))

    local = v._probe or start._probe or any(w._probe for w in s.variables.values())
    return Value(run(v.col, start.col, s), s.frame, (lambda: run(v.probe(), start.probe(), _outside(s))) if local else None, start.type)


@operator("$concatArrays")
def _concat_arrays(x, s):
    values = _same_elements(arguments(x, s, "$concatArrays", 1))
    return values[0].then(lambda *c: F.concat(*c), *values[1:])


@operator("$slice")
def _slice(x, s):
    v, *n = arguments(x, s, "$slice", 2, 3)
    v, n = an_array(v), [number(k) for k in n]

    def one(c, k):
        k = k.cast("int")
        size = F.size(c)
        return F.when(c.isNull() | k.isNull(), F.lit(None)).when(k >= 0, F.slice(c, F.lit(1), F.greatest(k, F.lit(0)))).otherwise(F.slice(c, F.greatest(size + k, F.lit(0)) + 1, F.greatest(-k, F.lit(0))))

    def two(c, skip, k):
        skip, size = skip.cast("int"), F.size(c)
        at = F.when(skip >= 0, F.least(skip, size)).otherwise(F.greatest(size + skip, F.lit(0)))
        return F.when(c.isNotNull(), F.slice(c, at + 1, F.greatest(k.cast("int"), F.lit(0))))

    return v.then(one if len(n) == 1 else two, *n, kind=v.type)


@operator("$reverseArray")
def _reverse(x, s):
    v = an_array(compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s))
    return v.then(F.reverse, kind=v.type)


@operator("$sortArray")
def _sort_array(x, s):
    options(x, "$sortArray", ("input", "sortBy"))
    v, by = an_array(compiled(x["input"], s)), x["sortBy"]
    if not isinstance(by, dict):
        return v.then(lambda c: F.sort_array(c, by > 0), kind=v.type)
    from .values import step

    first = sample(v)

    def order(p: Column, q: Column) -> Column:
        out = None
        for name, way in reversed(by.items()):
            a, b = (step(Value(c, v.frame, first.probe, first.type), name.split(".")).col for c in (p, q))
            less = F.when(a.isNull() & b.isNotNull(), F.lit(True)).otherwise(F.coalesce(a < b, F.lit(False)))
            more = F.when(b.isNull() & a.isNotNull(), F.lit(True)).otherwise(F.coalesce(a > b, F.lit(False)))
            out = F.when(less, -1 if way > 0 else 1).when(more, 1 if way > 0 else -1).otherwise(F.lit(0) if out is None else out)
        return out

    return v.then(lambda c: F.array_sort(c, order), kind=v.type)


def contains(array: Value, item: Value) -> Value:
    if not isinstance(array.type, T.ArrayType):
        return array.then(lambda c: F.lit(False), kind=BOOL)
    if is_null(item.type):
        return array.then(lambda c: F.coalesce(F.exists(c, lambda e: e.isNull()), F.lit(False)), kind=BOOL)
    if rank(elements(array)) != rank(item.type):
        return array.then(lambda c: F.lit(False), kind=BOOL)
    return array.then(lambda c, i: F.coalesce(F.exists(c, lambda e: e.eqNullSafe(i)), F.lit(False)), item, kind=BOOL)


@operator("$in")
def _in(x, s):
    item, array = arguments(x, s, "$in", 2, 2)
    return contains(array, item)


@operator("$nin")
def _nin(x, s):
    return _in(x, s).then(lambda c: ~c, kind=BOOL)


@operator("$isArray")
def _is_array(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    return v.then(lambda c: c.isNotNull() if isinstance(v.type, T.ArrayType) else F.lit(False), kind=BOOL)


@operator("$indexOfArray")
def _index_of_array(x, s):
    v, item, *rest = arguments(x, s, "$indexOfArray", 2, 4)
    if not isinstance(v.type, T.ArrayType) or rank(elements(v)) != rank(item.type):
        return an_array(v).then(lambda c: F.when(c.isNotNull(), F.lit(-1)), kind=INT)
    rest = [number(r) for r in rest]

    def find(c, i, *r):
        if not r:
            return F.when(c.isNotNull(), F.coalesce(F.array_position(c, i), F.lit(0)).cast("int") - 1)
        start = r[0].cast("int")
        part = F.slice(c, start + 1, F.greatest((r[1].cast("int") if len(r) > 1 else F.size(c)) - start, F.lit(0)))
        at = F.coalesce(F.array_position(part, i), F.lit(0)).cast("int")
        return F.when(c.isNotNull(), F.when(at > 0, at - 1 + start).otherwise(-1))

    return v.then(find, item, *rest, kind=INT)


def _set(name: str, f, low: int, high: int | None, kind=None):
    def op(x, s):
        values = _same_elements(arguments(x, s, name, low, high))
        same = values[0].type if all(v.type == values[0].type for v in values) else None
        return values[0].then(lambda *c: f(*c), *values[1:], kind=kind or same)

    return op


def _many(f):
    def run(*c: Column) -> Column:
        out = F.array_distinct(c[0])
        for d in c[1:]:
            out = f(out, d)
        return F.sort_array(out)

    return run


def _equal(*c: Column) -> Column:
    out = F.lit(True)
    for d in c[1:]:
        out = out & (F.size(F.array_except(c[0], d)) == 0) & (F.size(F.array_except(d, c[0])) == 0)
    return out


OPERATORS |= {
    "$setUnion": _set("$setUnion", _many(F.array_union), 1, None),
    "$setIntersection": _set("$setIntersection", _many(F.array_intersect), 1, None),
    "$setDifference": _set("$setDifference", lambda a, b: F.sort_array(F.array_except(a, b)), 2, 2),
    "$setEquals": _set("$setEquals", _equal, 2, None, BOOL),
    "$setIsSubset": _set("$setIsSubset", lambda a, b: F.size(F.array_except(a, b)) == 0, 2, 2, BOOL),
}


def _any_all(name: str, f):
    def op(x, s):
        v = an_array(compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s))
        first = sample(v)
        return v.then(lambda c: f(c, lambda e: truth(Value(e, v.frame, first.probe, first.type)).col), kind=BOOL)

    return op


OPERATORS |= {"$anyElementTrue": _any_all("$anyElementTrue", F.exists), "$allElementsTrue": _any_all("$allElementsTrue", F.forall)}


@operator("$range")
def _range(x, s):
    a, b, *c = (number(v) for v in arguments(x, s, "$range", 2, 3))
    by = c[0] if c else s.literal(1)
    return a.then(lambda p, q, n: F.when(((n > 0) & (p < q)) | ((n < 0) & (p > q)), F.sequence(p, q - F.signum(n).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), b, by, kind=T.ArrayType(LONG))


# --- documents


@operator("$objectToArray")
def _object_to_array(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    if isinstance(v.type, T.MapType):
        return v.then(lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    if not isinstance(v.type, T.StructType):
        return Value(F.lit(None).cast("array<struct<k:string,v:string>>"), s.frame)
    fields = [v.then(lambda c, n=f.name: c.getField(n), kind=f.dataType) for f in v.type.fields]
    if len({rank(f.type) for f in fields if not is_null(f.type)}) > 1:
        fields = [text(f) for f in fields]
    names = v.type.fieldNames()
    return v.then(lambda c, *p: F.when(c.isNotNull(), F.filter(F.array(*[F.struct(F.lit(n).alias("k"), q.alias("v")) for n, q in zip(names, p, strict=True)]), lambda e: e["v"].isNotNull())), *fields)


@operator("$arrayToObject")
def _array_to_object(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    inner = elements(v)
    if isinstance(inner, T.ArrayType):  # pairs
        return v.then(lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(F.get(e, F.lit(0)).cast("string"), F.get(e, F.lit(1))))))
    return v.then(lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(e["k"].cast("string"), e["v"]))))


@operator("$mergeObjects")
def _merge_objects(x, s):
    items = list(x) if isinstance(x, (list, tuple)) else [x]
    pairs = [(v, isinstance(i, dict) and not any(k.startswith("$") for k in i)) for v, i in zip(arguments(x, s, "$mergeObjects", 1), items, strict=True) if not is_null(v.type)]
    if not pairs:
        return s.missing()
    values, written = [v for v, _ in pairs], [w for _, w in pairs]  # documents that are written out are never null
    if any(isinstance(v.type, T.MapType) for v in values):
        return values[0].then(lambda *c: F.map_concat(*c), *values[1:])
    names = list(dict.fromkeys(n for v in values for n in v.type.fieldNames()))

    def merge(*c: Column) -> Column:
        out = []
        for n in names:
            having = [(d, w) for d, v, w in zip(c, values, written, strict=True) if n in v.type.fieldNames()]
            pick = having[0][0].getField(n)
            for d, w in having[1:]:  # the last document that isn't null decides, even with a null
                pick = d.getField(n) if w else F.when(d.isNotNull(), d.getField(n)).otherwise(pick)
            out.append(pick.alias(n))
        return F.struct(*out)

    return values[0].then(merge, *values[1:])


@operator("$getField")
def _get_field(x, s):
    from .values import step

    if isinstance(x, str):
        return s.field(x)
    options(x, "$getField", ("field",), ("input",))
    return step(compiled(x["input"], s), [x["field"]]) if "input" in x else s.field(x["field"])


@operator("$let")
def _let(x, s):
    options(x, "$let", ("vars", "in"))
    return compiled(x["in"], s.bind(**{k: compiled(v, s) for k, v in x["vars"].items()}))


# --- types


def type_name(kind: T.DataType) -> str:
    """The name of a type in the document model (fixed values)."""
    names = ((T.NullType, "null"), (T.BooleanType, "bool"), (T.LongType, "long"), (T.IntegralType, "int"), (T.DecimalType, "decimal"), (T.FractionalType, "double"), (T.StringType, "string"), (T.ArrayType, "array"), (T.BinaryType, "binData"))
    return "date" if is_date(kind) else next((n for k, n in names if isinstance(kind, k)), "object")


@operator("$type")
def _type(x, s):
    v = compiled(x, s)
    if is_null(v.type):
        return s.literal("missing")
    return v.then(lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.lit(type_name(v.type))), kind=STRING)


def convert(v: Value, to: str) -> Value:
    """The value as another type, null where it has no meaning there."""
    kind = v.type
    if to in ("int", "long"):
        spark = "int" if to == "int" else "bigint"
        if isinstance(kind, T.StringType):
            return v.then(lambda c: c.try_cast(spark), kind=T.IntegerType() if to == "int" else LONG)
        if is_date(kind):
            return v.then(lambda c: F.unix_millis(c.cast("timestamp")), kind=LONG)
        if isinstance(kind, T.BooleanType):
            return v.then(lambda c: c.cast(spark))
        return number(v).then(lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).try_cast(spark))
    if to == "double":
        return v.then(lambda c: F.unix_millis(c.cast("timestamp")).cast("double"), kind=DOUBLE) if is_date(kind) else v.then(lambda c: c.try_cast("double"), kind=DOUBLE)
    if to == "decimal":
        return v.then(lambda c: c.try_cast("decimal(38,10)"), kind=T.DecimalType(38, 10))
    if to == "string":
        return text(v)
    if to == "bool":
        if isinstance(kind, T.BooleanType):
            return v
        return v.then(lambda c: F.when(c.isNotNull(), c != 0 if is_number(kind) else F.lit(True)), kind=BOOL)
    if to == "date":
        return date(v)
    if to == "objectId":
        return v.then(lambda c: c.cast("string"), kind=STRING)
    raise ValidationError("UNKNOWN_TYPE", f"can't convert to {to!r}")


#: The types that $convert knows by number (fixed values).
TYPE_NUMBERS = {1: "double", 2: "string", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}
for _name, _to in {"$toInt": "int", "$toLong": "long", "$toDouble": "double", "$toDecimal": "decimal", "$toString": "string", "$toBool": "bool", "$toDate": "date", "$toObjectId": "objectId"}.items():
    OPERATORS[_name] = lambda x, s, to=_to: convert(compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s), to)


@operator("$convert")
def _convert(x, s):
    options(x, "$convert", ("input", "to"), ("onError", "onNull"))
    v = compiled(x["input"], s)
    out = convert(v, TYPE_NUMBERS.get(x["to"], x["to"]))
    if "onError" in x:
        out = out.then(lambda c, i, e: F.when(i.isNotNull(), F.coalesce(c, e)), v, compiled(x["onError"], s))
    return out.then(lambda c, i, n: F.when(i.isNull(), n).otherwise(c), v, compiled(x["onNull"], s)) if "onNull" in x else out


@operator("$isNumber")
def _is_number(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    return v.then(lambda c: c.isNotNull() if is_number(v.type) else F.lit(False), kind=BOOL)


@operator("$isString")
def _is_string(x, s):
    v = compiled(x[0] if isinstance(x, list) and len(x) == 1 else x, s)
    return v.then(lambda c: c.isNotNull() if isinstance(v.type, T.StringType) else F.lit(False), kind=BOOL)
