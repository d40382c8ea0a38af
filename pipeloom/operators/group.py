"""Grouping stages: $group, $bucket, $bucketAuto, $count, $sortByCount, $facet."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.accumulators import accumulator, needs_order, sort_key
from ..functions.expressions import compiled, plain
from ..functions.values import is_null, quoted
from ..plans.durable import cut
from .context import Context, visible
from .shape import ordered, ordering


def group(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or "_id" not in spec:
        raise ValidationError("MISSING_ID", "$group needs _id")
    s = ctx.scope(df)
    key = spec["_id"]
    constant = key is None or not isinstance(key, (str, dict)) or isinstance(key, str) and not key.startswith("$")
    id_col = F.lit(key) if constant else compiled(key, s).col
    rows = df
    ranked = None
    if ctx.order and any(needs_order(a) for k, a in spec.items() if k != "_id") and sort_key(ctx.order, s) is None:
        # keys of both directions that can't be made one column: rows are numbered within their group
        rows = df.withColumn("__key", id_col).withColumn("__place", F.row_number().over(Window.partitionBy("__key", *ctx.kept()).orderBy(*ordering(df, ctx))))
        s, ranked = ctx.scope(rows), F.col("__place")
    aggs = [accumulator(k, a, s, ctx.order, ranked).alias(k) for k, a in spec.items() if k != "_id"]
    aggs = aggs or [F.count(F.lit(1)).alias("__n")]
    if constant:
        if ctx.carry:
            out = rows.groupBy(*ctx.kept()).agg(*aggs)
        else:  # no rows give no group
            out = rows.agg(F.count(F.lit(1)).alias("__rows"), *aggs).where("__rows > 0").drop("__rows")
        out = out.select(id_col.alias("_id"), *[F.col(quoted(c)) for c in out.columns])
    else:
        out = rows.groupBy(id_col.alias("_id"), *ctx.kept()).agg(*aggs)
    return out.drop("__n"), ctx.unsorted()


def count(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise ValidationError("BAD_NAME", "$count takes a name")
    if ctx.carry:
        return df.groupBy(*ctx.kept()).agg(F.count(F.lit(1)).alias(spec)), ctx.unsorted()
    return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(quoted(spec)) > 0), ctx.unsorted()


def sort_by_count(df: DataFrame, spec, ctx: Context):
    out, ctx = group(df, {"_id": spec, "count": {"$sum": 1}}, ctx)
    return ordered(out, ctx, [(F.col("count"), False)])


def _output(spec: dict) -> dict:
    return spec.get("output") or {"count": {"$sum": 1}}


def bucket(df: DataFrame, spec, ctx: Context):
    if not isinstance(spec, dict) or "groupBy" not in spec or not isinstance(spec.get("boundaries"), list) or len(spec["boundaries"]) < 2:
        raise ValidationError("MISSING_ARGUMENT", "$bucket needs groupBy and at least two boundaries")
    bounds = [plain(b) for b in spec["boundaries"]]
    if any(not a < b for a, b in zip(bounds, bounds[1:])):
        raise ValidationError("UNSORTED", "$bucket's boundaries must ascend")
    v = compiled(spec["groupBy"], ctx.scope(df)).col
    default = plain(spec.get("default"))
    as_text = isinstance(default, str) != isinstance(bounds[0], str) and default is not None
    label = (lambda x: F.lit(str(x))) if as_text else F.lit
    place: Column = F.when((v >= bounds[0]) & (v < bounds[1]), label(bounds[0]))
    for a, b in zip(bounds[1:], bounds[2:]):
        place = place.when((v >= a) & (v < b), label(a))
    if "default" in spec:
        place = place.otherwise(label(default))
    elif ctx.strict:
        place = place.otherwise(F.raise_error(F.lit("a value lies outside the boundaries and there is no default")))
    rows = df.withColumn("__bucket", place)
    s = ctx.scope(rows)
    out = rows.groupBy(F.col("__bucket").alias("_id"), *ctx.kept()).agg(*[accumulator(k, a, s, ctx.order).alias(k) for k, a in _output(spec).items()])
    return ordered(out, ctx, [(F.col("_id"), True)])


def bucket_auto(df: DataFrame, spec, ctx: Context):
    """Buckets of about equal size; equal values share one. The distinct values are counted, dealt by range and numbered within
    their ranges; the ranges' totals (a row each) give what stands before each. Rows find their bucket by its smallest value, of which there are
    as many as buckets."""
    if not isinstance(spec, dict) or "groupBy" not in spec or not isinstance(spec.get("buckets"), int) or spec["buckets"] < 1:
        raise ValidationError("MISSING_ARGUMENT", "$bucketAuto needs groupBy and a positive number of buckets")
    n = spec["buckets"]
    rows = df.withColumn("__value", compiled(spec["groupBy"], ctx.scope(df)).col)
    kept = ctx.kept()
    counts = rows.groupBy("__value", *kept).agg(F.count(F.lit(1)).alias("__n"))
    if kept:
        w = Window.partitionBy(*kept)
        running = counts.withColumn("__before", F.sum("__n").over(w.orderBy(F.col("__value").asc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).withColumn("__all", F.sum("__n").over(w))
    else:
        # where ranges begin is drawn from a sample, so they are fixed by a cut before they are read twice
        dealt = cut(counts.repartitionByRange(F.col("__value").asc()).withColumn("__range", F.spark_partition_id()))
        totals = [(r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.sum("__n").alias("n")).orderBy("__range").collect()]
        offsets, before = [], 0
        for k, m in totals:
            offsets.append((k, before))
            before += m
        starts = df.sparkSession.createDataFrame(offsets, "__range int, __start long")
        inside = Window.partitionBy("__range").orderBy(F.col("__value").asc()).rowsBetween(Window.unboundedPreceding, 0)
        running = dealt.withColumn("__run", F.sum("__n").over(inside)).join(F.broadcast(starts), "__range").select("__value", "__n", (F.col("__start") + F.col("__run") - F.col("__n")).alias("__before"), F.lit(before).alias("__all"))
    size = F.greatest(F.round(F.col("__all") / n), F.lit(1))
    places = running.withColumn("__bucket", F.least(F.floor(F.col("__before") / size), F.lit(n - 1)))
    # the smallest value of each bucket (n at most, for each carry) and that of the next
    low = places.groupBy("__bucket", *kept).agg(F.min(F.struct("__before", F.col("__value").alias("v"))).alias("low")).select("__bucket", F.col("low.v").alias("__low"), *kept)
    above = F.lead(F.struct(F.col("__low").alias("v"))).over((Window.partitionBy(*kept) if kept else Window.partitionBy()).orderBy("__bucket"))
    bounds = low.withColumn("__next", above).withColumnsRenamed({c: f"{c}_p" for c in ctx.carry})
    box = F.struct(F.col("__value").alias("v"))
    on = (box >= F.struct(F.col("__low").alias("v"))) & (F.col("__next").isNull() | (box < F.col("__next")))
    for c in ctx.carry:
        on = on & F.col(quoted(c)).eqNullSafe(F.col(quoted(f"{c}_p")))
    joined = rows.join(bounds if kept else F.broadcast(bounds), on).drop(*[f"{c}_p" for c in ctx.carry])
    s = ctx.scope(joined)
    out = joined.groupBy("__bucket", *kept).agg(F.first("__low").alias("__min"), F.max("__value").alias("__max"), F.first("__next").alias("__next"), *[accumulator(k, a, s, ctx.order).alias(k) for k, a in _output(spec).items()])
    out = out.withColumn("_id", F.struct(F.col("__min").alias("min"), F.coalesce("__next.v", F.col("__max")).alias("max")))
    return ordered(out.select("_id", *_output(spec), *kept, "__bucket"), ctx, [(F.col("__bucket"), True)])[0].drop("__bucket"), ctx.sorted([("__sort_0", True)])


def facet(df: DataFrame, spec, ctx: Context):
    """Each facet's pipeline over the same rows, as one document of arrays. The arrays hold all of a facet's rows, as the stage asks for."""
    if not isinstance(spec, dict) or not spec:
        raise ValidationError("EMPTY_FACET", "$facet takes a document of pipelines")
    if ctx.carry:
        raise ValidationError("NOT_HERE", "$facet can't stand in the pipeline of a $lookup")
    ctx.warn("$facet: each facet reads the input anew, and its rows become one array")
    out = None
    for name, pipeline in spec.items():
        rows, after = ctx.run(df, pipeline, ctx)
        doc = F.struct(*[F.col(quoted(c)) for c in visible(rows)])
        s = after.scope(rows)
        key = sort_key(after.order, s) if after.order else None
        if key is None and after.order:  # keys of both directions that can't be made one column
            rows = rows.withColumn("__sort_place", F.row_number().over(Window.orderBy(*ordering(rows, after))))
            key = F.col("__sort_place"), True
        if key is not None:
            array = F.transform(F.sort_array(F.collect_list(F.struct(key[0].alias("k"), doc.alias("d"))), key[1]), lambda e: e["d"])
        else:
            array = F.collect_list(doc)
        one = rows.agg(array.alias(name))
        out = one if out is None else out.crossJoin(one)  # of single rows
    return out, ctx.unsorted()


def set_window_fields(df: DataFrame, spec, ctx: Context):
    from ..functions.accumulators import calendar, calendar_argument, windowed

    if not isinstance(spec, dict) or not isinstance(spec.get("output"), dict) or not spec["output"]:
        raise ValidationError("MISSING_ARGUMENT", "$setWindowFields needs output")
    s = ctx.scope(df)
    by, order = spec.get("partitionBy"), spec.get("sortBy") or {}
    if by is None and not ctx.carry:
        ctx.warn("$setWindowFields without partitionBy: all rows go through one task")
    parts = [compiled(by, s).col] if by is not None else []
    w = Window.partitionBy(*parts, *ctx.kept())
    keys = []
    for path, way in order.items():
        v = s.field(path)
        if not is_null(v.type):
            keys.append(v.col.asc() if way > 0 else v.col.desc())
    if keys:
        w = w.orderBy(*keys)
    new, extra = {}, {}
    for name, how in spec["output"].items():
        how = dict(how)
        frame = how.pop("window", None)
        if len(how) != 1:
            raise ValidationError("ONE_ACCUMULATOR", f"{name} takes one function")
        (op, x), *_ = how.items()
        if frame and (frame.get("unit") in _MONTHS or _fractional(frame)):
            extra |= {f"__w_{len(extra)}_part": F.struct(*[p.alias(f"p{i}") for i, p in enumerate([*parts, *ctx.kept()])]) if parts or ctx.carry else F.lit(0)}
            part = next(reversed(extra))
            at, way = _sorted_by(order, s)
            extra |= {f"__w_{len(extra)}_time": at.cast("timestamp" if "unit" in frame else "double")}
            time = next(reversed(extra))
            new[name] = (op, x, part, time, way, frame)
            continue
        framed = _frame(w, frame, order, s)
        new[name] = windowed(name, op, x, s, w if keys else w.orderBy(F.lit(1)), framed)
    if not extra:
        return df.withColumns(new), ctx.moved()
    # ranges of months and of fractions are written as SQL, which alone has them
    rows, made = df.withColumns(extra), {}
    for name, c in new.items():
        if isinstance(c, tuple):
            op, x, part, time, way, frame = c
            over = f"OVER (PARTITION BY {part} ORDER BY {time} {'ASC' if way > 0 else 'DESC'} RANGE BETWEEN {_sql_bound(frame, 0)} AND {_sql_bound(frame, 1)})"
            rows = rows.withColumn(f"__w_{name}_arg", calendar_argument(op, x, s))
            c = calendar(op, f"__w_{name}_arg", over, rows)
        made[name] = c
    return rows.withColumns(made).drop(*[c for c in rows.columns if c.startswith("__w_")]), ctx.moved()


#: Microseconds of each unit of time, and months of each unit of the calendar (fixed values).
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _sorted_by(order: dict, s) -> tuple[Column, int]:
    if len(order) != 1:
        raise ValidationError("BAD_WINDOW", "a range needs one field to sort by")
    (path, way), *_ = order.items()
    return s.field(path).col, way


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _bounds(frame: dict, kind: str) -> list:
    """The two bounds of the frame: numbers, "current" or "unbounded", the lower one first."""
    pair = frame[kind]
    for x in pair:
        if x not in ("unbounded", "current") and not (_whole(x) or isinstance(x, float) and isfinite(x) and (kind == "range" or x.is_integer())):
            raise ValidationError("BAD_WINDOW", f"no bound of {kind}: {x!r}")
    low, high = (0 if x == "current" else x for x in pair)
    if "unbounded" not in pair and low > high:
        raise ValidationError("BAD_WINDOW", f"the lower bound {low} lies above the upper one, {high}")
    return pair


def _fractional(frame: dict) -> bool:
    pair = frame.get("range")
    return "unit" not in frame and isinstance(pair, list) and any(isinstance(x, float) and not x.is_integer() for x in pair)


def _sql_bound(frame: dict, which: int) -> str:
    if len(frame.get("range") or []) != 2:
        raise ValidationError("BAD_WINDOW", "a window has documents or range with two bounds")
    x = _bounds(frame, "range")[which]
    if x == "unbounded":
        return "UNBOUNDED FOLLOWING" if which else "UNBOUNDED PRECEDING"
    if x == "current" or x == 0:
        return "CURRENT ROW"
    way = "FOLLOWING" if x > 0 else "PRECEDING"
    if "unit" not in frame:
        return f"{float(abs(x))!r}D {way}"
    if not _whole(x):
        raise ValidationError("BAD_WINDOW", f"{frame['unit']}s are counted in whole numbers")
    return f"INTERVAL '{abs(x) * _MONTHS[frame['unit']]}' MONTH {way}"


def _frame(w, frame, order: dict, s):
    if frame is None:  # the whole partition
        return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = "documents" if "documents" in frame else "range" if "range" in frame else None
    if kind is None or not isinstance(frame[kind], list) or len(frame[kind]) != 2:
        raise ValidationError("BAD_WINDOW", "a window has documents or range with two bounds")
    low, high = _bounds(frame, kind)
    if "unit" in frame and (frame["unit"] not in _UNITS or kind != "range"):
        raise ValidationError("BAD_UNIT", f"no unit of a range: {frame['unit']!r}")
    unit = _UNITS.get(frame.get("unit"))

    def bound(x, edge):
        if x in ("unbounded", "current"):
            return edge if x == "unbounded" else Window.currentRow
        return round(x * unit) if unit else int(x)

    a, b = bound(low, Window.unboundedPreceding), bound(high, Window.unboundedFollowing)
    if kind == "documents":
        return w.rowsBetween(a, b)
    if {low, high} - {"unbounded", "current"}:
        _sorted_by(order, s)
    if unit:  # a range of time: over microseconds
        at, way = _sorted_by(order, s)
        us = F.unix_micros(at.cast("timestamp"))
        w = w.orderBy(us.asc() if way > 0 else us.desc())
    return w.rangeBetween(a, b)
