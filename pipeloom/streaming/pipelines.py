"""Pipelines over streams: stages that look at one document at a time run as they do over tables; groups need an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import ValidationError
from ..functions.accumulators import accumulator
from ..functions.values import Scope

#: Stages that keep no state.
STATELESS = ("$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot", "$replaceWith", "$redact", "$unionWith", "$lookup")


def stream(engine: Engine, frame: DataFrame, pipeline: list) -> DataFrame:
    """A stateless pipeline over a streaming frame."""
    for s in pipeline:
        name = next(iter(s))
        if name not in STATELESS:
            raise ValidationError("STATEFUL", f"{name} needs all rows; use windowed_group for groups of a stream")
    return engine.aggregate(frame, pipeline)


def windowed_group(frame: DataFrame, time: str, width: str, spec: dict, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """$group over windows of event time; rows later than `late` are dropped by the watermark. spec: as that of $group, whose _id is a path or null."""
    marked = frame.withWatermark(time, late)
    s = Scope(marked)
    key = spec.get("_id")
    keys = [s.field(key[1:]).col.alias("_id")] if isinstance(key, str) else []
    out = marked.groupBy(F.window(time, width, slide or width), *keys).agg(*[accumulator(k, a, s).alias(k) for k, a in spec.items() if k != "_id"])
    return out.withColumns({"start": F.col("window.start"), "end": F.col("window.end")}).drop("window")


def run_once(frame: DataFrame, name: str) -> DataFrame:
    """Runs what a stream has until now, into the table `name`, and returns that. Where the stream got to is kept in the checkpoint folder."""
    from ..plans.durable import folder

    frame.writeStream.option("checkpointLocation", folder(frame.sparkSession)).trigger(availableNow=True).toTable(name).awaitTermination()
    return frame.sparkSession.table(name)
