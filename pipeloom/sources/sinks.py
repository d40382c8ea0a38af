"""$out and $merge: writing results to collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.values import quoted
from ..names import collection


class MergeConflictError(Exception):
    """$merge met documents that it was told to fail on."""


def _target(spec, name: str) -> str:
    if isinstance(spec, dict):
        base, db = spec.get("coll"), spec.get("db")
        if not base:
            raise ValidationError("MISSING_ARGUMENT", f"{name} needs coll")
        return f"{collection(db)}.{collection(base)}" if db else collection(base)
    return collection(spec)


def out(df: DataFrame, spec, ctx):
    """Replaces the collection by the rows. The rows are written before the old table goes, since they may come from it."""
    from ..operators.context import bare

    name = _target(spec, "$out")
    spark = df.sparkSession
    _replace(spark, bare(df), name)
    frame = spark.table(name)
    ctx.catalog.frames.pop(name, None)
    return frame.limit(0), ctx.unsorted()


def _replace(spark, df: DataFrame, name: str) -> None:
    """Writes the rows to a spare table and then gives it the name. The old table keeps its rows under another name until the new one is in place,
    so a crash at any point loses neither; the next run begins by putting back what a crash left (recover)."""
    spare, old = f"{name}__new", f"{name}__old"
    recover(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {spare}")
    df.write.saveAsTable(spare)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {spare} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def recover(spark, name: str) -> None:
    """Puts the old table back if a crash left it without its name; else drops what is left of it."""
    old = f"{name}__old"
    if spark.catalog.tableExists(old):
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {old}")
        else:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")


#: What may be done with documents that are there, and with those that aren't (fixed values).
MATCHED, NOT_MATCHED = ("merge", "replace", "keepExisting", "fail"), ("insert", "discard", "fail")


def merge(df: DataFrame, spec, ctx):
    """Merges the rows into the collection by the fields `on`: one full outer join, written anew."""
    from ..operators.context import bare

    spec = {"into": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or "into" not in spec:
        raise ValidationError("MISSING_ARGUMENT", "$merge needs into")
    name = _target(spec["into"], "$merge")
    on = spec.get("on", "_id")
    on = [on] if isinstance(on, str) else list(on)
    matched, new = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    if matched not in MATCHED or new not in NOT_MATCHED:
        raise ValidationError("BAD_MODE", f"$merge doesn't know {matched!r} with {new!r}")
    spark, df = df.sparkSession, bare(df)
    recover(spark, name)
    known = name in ctx.catalog.frames or spark.catalog.tableExists(name)
    if not known:
        if new == "fail" and df.limit(1).count():
            raise MergeConflictError("documents aren't in the collection")
        _replace(spark, df if new == "insert" else df.limit(0), name)
        return spark.table(name).limit(0), ctx.unsorted()
    old = ctx.catalog.get(name).drop("__raw")
    if df.groupBy(*on).count().where("count > 1").limit(1).count():
        raise MergeConflictError("several documents have the same key")
    if matched == "fail" and df.join(old.select(*on).distinct(), on, "left_semi").limit(1).count():
        raise MergeConflictError("documents are already in the collection")
    if new == "fail" and df.join(old.select(*on).distinct(), on, "left_anti").limit(1).count():
        raise MergeConflictError("documents aren't in the collection")
    a = old.select(F.lit(True).alias("__old"), F.struct(*[F.col(quoted(c)) for c in old.columns]).alias("o"))
    b = df.select(F.lit(True).alias("__new"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("n"))
    joined = a.join(b, [F.col(f"o.{quoted(k)}").eqNullSafe(F.col(f"n.{quoted(k)}")) for k in on], "full" if new == "insert" else "left")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    cols = []
    for c in dict.fromkeys([*old.columns, *df.columns]):
        o = F.col(f"o.{quoted(c)}") if c in old.columns else F.lit(None)
        n = F.col(f"n.{quoted(c)}") if c in df.columns else F.lit(None)
        both = o if matched == "keepExisting" else n if matched == "replace" else n if c in df.columns else o
        cols.append(F.when(has_old & has_new, both).when(has_old, o).otherwise(n).alias(c))
    _replace(spark, joined.select(*cols), name)
    ctx.catalog.frames.pop(name, None)
    return spark.table(name).limit(0), ctx.unsorted()
