"""Compiled expressions with their types, and the scope that paths and variables are looked up in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import segments


class Value:
    """A compiled expression. Inside a lambda the column holds lambda variables, which can't be analysed alone; probe() gives
    the same expression over columns of the frame, from which the type is found."""

    __slots__ = ("col", "_probe", "_type", "frame")

    def __init__(self, col: Column, frame: DataFrame, probe: Callable[[], Column] | None = None, kind: T.DataType | None = None):
        self.col, self.frame, self._probe, self._type = col, frame, probe, kind

    def probe(self) -> Column:
        return self._probe() if self._probe else self.col

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.frame.select(self.probe().alias("x")).schema[0].dataType
        return self._type

    def then(self, f: Callable[..., Column], *more: Value, kind: T.DataType | None = None) -> Value:
        """f of this value's column and those of more."""
        all_ = (self, *more)
        local = any(v._probe for v in all_)
        return Value(f(*[v.col for v in all_]), self.frame, (lambda: f(*[v.probe() for v in all_])) if local else None, kind)


@dataclass
class Scope:
    """Where names are looked up: a document (the frame's columns, or a struct) and variables."""

    frame: DataFrame
    variables: dict[str, Value] = field(default_factory=dict)
    document: Value | None = None  # a struct in place of the frame's columns
    hidden: tuple[str, ...] = ()  # columns that aren't part of the document

    def bind(self, **values: Value) -> Scope:
        return replace(self, variables=self.variables | values)

    def inside(self, document: Value) -> Scope:
        return replace(self, document=document)

    def names(self) -> list[str]:
        return [f.name for f in self.document.type.fields] if self.document else [c for c in self.frame.columns if c not in self.hidden]

    def literal(self, x) -> Value:
        return Value(F.lit(x), self.frame)

    def missing(self) -> Value:
        return Value(F.lit(None), self.frame, kind=T.NullType())

    def root(self) -> Value:
        if self.document:
            return self.document
        return Value(F.struct(*[F.col(quoted(c)) for c in self.names()]), self.frame)

    def field(self, path: str) -> Value:
        first, *rest = segments(path)
        if self.document:
            return step(self.document, [first, *rest])
        if first not in self.frame.columns:
            return self.missing()
        value = Value(F.col(quoted(first)), self.frame, kind=self.frame.schema[first].dataType)
        return step(value, rest)

    def variable(self, path: str) -> Value | None:
        name, *rest = path.split(".")
        if name in ("ROOT", "CURRENT"):
            return self.field(".".join(rest)) if rest and name == "ROOT" and not self.document else step(self.root(), rest)
        if name not in self.variables:
            return None
        return step(self.variables[name], rest)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def step(value: Value, path: list[str]) -> Value:
    """The value at a path below value; arrays of documents give arrays of what their elements have; null where there is none."""
    for k, name in enumerate(path):
        kind = value.type
        if isinstance(kind, T.StructType):
            if name not in kind.fieldNames():
                return Value(F.lit(None), value.frame, kind=T.NullType())
            value = value.then(lambda c, n=name: c.getField(n), kind=kind[name].dataType)
        elif isinstance(kind, T.MapType):
            value = value.then(lambda c, n=name: F.try_element_at(c, F.lit(n)), kind=kind.valueType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
            rest = path[k:]
            sample = value.then(lambda c: F.get(c, F.lit(0)), kind=kind.elementType)
            below = step(sample, rest)
            if isinstance(below.type, T.NullType):
                return below
            return value.then(lambda c, r=rest, v=sample: F.transform(c, lambda e: step(Value(e, v.frame, v.probe, v.type), r).col), kind=T.ArrayType(below.type))
        else:
            return Value(F.lit(None), value.frame, kind=T.NullType())
    return value


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_null(kind: T.DataType) -> bool:
    return isinstance(kind, T.NullType)


def rank(kind: T.DataType) -> int:
    """The place of a type in the order of unlike types: numbers, text, documents, arrays, bytes, booleans, dates."""
    groups = ((T.NumericType,), (T.StringType,), (T.StructType, T.MapType), (T.ArrayType,), (T.BinaryType,), (T.BooleanType,), (T.TimestampType, T.TimestampNTZType, T.DateType))
    return next((i for i, g in enumerate(groups) if isinstance(kind, g)), -1)


def truth(v: Value) -> Value:
    """Whether a value counts as true: not null, not false, not zero."""
    if isinstance(v.type, T.BooleanType):
        return v.then(lambda c: F.coalesce(c, F.lit(False)), kind=T.BooleanType())
    if is_number(v.type):
        return v.then(lambda c: F.coalesce(c != 0, F.lit(False)), kind=T.BooleanType())
    return v.then(lambda c: c.isNotNull(), kind=T.BooleanType())


def text(v: Value) -> Value:
    """The value as text; whole doubles without a fraction, dates in ISO form."""
    kind = v.type
    if isinstance(kind, T.StringType):
        return v
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return v.then(lambda c: F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string")), kind=T.StringType())
    if is_date(kind):
        return v.then(lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), kind=T.StringType())
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return v.then(lambda c: F.to_json(c), kind=T.StringType())
    return v.then(lambda c: c.cast("string"), kind=T.StringType())


def date(v: Value) -> Value:
    """The value as a date: text in ISO form, whole numbers as milliseconds since 1970."""
    kind = v.type
    if is_date(kind):
        return v
    if isinstance(kind, T.StringType):
        return v.then(lambda c: F.try_to_timestamp(c), kind=T.TimestampType())
    if is_number(kind):
        return v.then(lambda c: F.timestamp_millis(c.cast("long")), kind=T.TimestampType())
    return v.then(lambda c: c.cast("timestamp"), kind=T.TimestampType())


def number(v: Value) -> Value:
    """The value for arithmetic: whole numbers as long; what is no number is null."""
    kind = v.type
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return v.then(lambda c: c.cast("long"), kind=T.LongType())
    if isinstance(kind, T.FloatType):
        return v.then(lambda c: c.cast("double"), kind=T.DoubleType())
    if is_number(kind):
        return v
    if is_null(kind):
        return v.then(lambda c: c.cast("double"), kind=T.DoubleType())
    return v.then(lambda c: F.lit(None).cast("double"), kind=T.DoubleType())
