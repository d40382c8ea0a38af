"""The engine: pipelines over collections, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Capability
from .operators import group as g
from .operators import join as j
from .operators import shape as sh
from .operators.context import Context, bare
from .plans.parse import Stage, parse
from .sources import sinks
from .sources.catalog import Catalog

StageFunction = Callable[[DataFrame, object, Context], tuple[DataFrame, Context]]

STAGES: dict[str, StageFunction] = {
    "$match": sh.match, "$project": sh.project, "$addFields": sh.add_fields, "$unset": sh.unset, "$replaceRoot": sh.replace_root,
    "$sort": sh.sort, "$limit": sh.limit, "$skip": sh.skip, "$sample": sh.sample, "$unwind": sh.unwind, "$redact": sh.redact,
    "$unionWith": sh.union_with, "$group": g.group, "$count": g.count, "$sortByCount": g.sort_by_count, "$bucket": g.bucket,
    "$bucketAuto": g.bucket_auto, "$facet": g.facet, "$setWindowFields": g.set_window_fields, "$lookup": j.lookup,
    "$graphLookup": j.graph_lookup, "$out": sinks.out, "$merge": sinks.merge,
}


@dataclass
class Result:
    """A compiled pipeline. Everything that compiles runs in full; warnings say what may surprise."""

    frame: DataFrame
    capability: Capability
    warnings: list[str]

    def explain(self, mode: str = "formatted") -> None:
        self.frame.explain(mode)


class Engine:
    """Compiles pipelines. strict: values that fit no bucket are errors rather than a bucket of null."""

    def __init__(self, spark: SparkSession, catalog: Catalog | dict[str, DataFrame] | None = None, strict: bool = False):
        self.spark = spark
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog(spark, catalog)
        self.strict = strict
        self.stages = dict(STAGES)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")

    def register_stage(self, name: str, f: StageFunction) -> None:
        """Adds a stage of one's own: f(rows, argument, context) returns rows and context."""
        self.stages[name] = f

    def run(self, df: DataFrame, pipeline, ctx: Context | None = None) -> tuple[DataFrame, Context]:
        ctx = ctx or Context(self.catalog, self.run, self.strict)
        for s in pipeline if pipeline and isinstance(pipeline[0], Stage) else parse(pipeline, self.stages):
            df, ctx = self.stages[s.name](df, s.spec, ctx)
        return df, ctx

    def aggregate(self, source: str | DataFrame, pipeline) -> DataFrame:
        """The rows of the pipeline over a collection or a frame (a streaming one too, for stages that need no order)."""
        df = self.catalog.get(source) if isinstance(source, str) else source
        out, ctx = self.run(df, pipeline)
        return bare(ctx.arranged(out)[0])

    def compile(self, source: str | DataFrame, pipeline) -> Result:
        df = self.catalog.get(source) if isinstance(source, str) else source
        out, ctx = self.run(df, pipeline)
        return Result(bare(ctx.arranged(out)[0]), Capability.FULL_SUPPORT, ctx.warnings)

    def documents(self, source: str | DataFrame, pipeline) -> DataFrame:
        """The same as one column of JSON documents."""
        out = self.aggregate(source, pipeline)
        return out.select(F.to_json(F.struct("*")).alias("document"))
