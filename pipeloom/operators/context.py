"""What a stage gets besides its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accumulators import Order
from ..functions.values import Scope, Value, quoted
from ..sources.catalog import Catalog


@dataclass
class Context:
    """catalog: the collections. run: folds a pipeline over rows. order: that of the last $sort, as far as it still holds; pending:
    rows don't stand in it yet (a stage that cuts by order, or the end, brings them into it). carry: hidden columns that every stage keeps and works within (rows of unlike carry never meet)."""

    catalog: Catalog
    run: Callable[..., tuple[DataFrame, Context]]
    strict: bool = False
    order: Order = field(default_factory=list)
    pending: bool = False
    carry: tuple[str, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)  # names and their hidden columns
    warnings: list[str] = field(default_factory=list)

    def scope(self, df: DataFrame) -> Scope:
        s = Scope(df, hidden=tuple(c for c in df.columns if is_hidden(c)))
        return s.bind(**{k: Value(F.col(quoted(c)), df, kind=df.schema[c].dataType) for k, c in self.variables.items() if c in df.columns})

    def sorted(self, order: Order) -> Context:
        return replace(self, order=order, pending=bool(order))

    def unsorted(self) -> Context:
        return replace(self, order=[], pending=False)

    def moved(self) -> Context:
        """After rows were shuffled: the order still holds by its keys."""
        return replace(self, pending=bool(self.order))

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    def arranged(self, df: DataFrame) -> tuple[DataFrame, Context]:
        """The rows in the order that is pending."""
        if not self.pending or self.carry or df.isStreaming:
            return df, self
        s = self.scope(df)
        keys = [s.field(p).col.asc() if up else s.field(p).col.desc() for p, up in self.order]
        return df.orderBy(*keys), replace(self, pending=False)

    def kept(self) -> list[Column]:
        """The columns whose unlike values keep rows apart."""
        return [F.col(quoted(c)) for c in self.carry]


#: Columns that aren't part of documents: variables of lookups, sort keys, raw documents.
HIDDEN = ("__let_", "__sort_", "__raw")


def is_hidden(name: str) -> bool:
    return name.startswith(HIDDEN)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_hidden(c)]


def beside(df: DataFrame) -> list[Column]:
    """Hidden columns that stay with a document when its fields change; not the raw document, which no longer fits."""
    return [F.col(quoted(c)) for c in df.columns if is_hidden(c) and c != "__raw"]


def bare(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_hidden(c)])
