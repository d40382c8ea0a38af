"""Collections by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..names import collection


class Catalog:
    """Names and their frames: registered ones first, then tables of the session."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.frames = {collection(k): v for k, v in (frames or {}).items()}

    def register(self, name: str, frame: DataFrame) -> None:
        self.frames[collection(name)] = frame

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            if not self.spark.catalog.tableExists(collection(name)):
                raise ValidationError("UNKNOWN_COLLECTION", f"no collection {name}")
            return self.spark.table(name)
        return self.frames[name]

    def load(self, name: str, path: str, form: str | None = None, **options) -> DataFrame:
        """Registers a file or folder: parquet, orc, csv (with header), json (a document a line) or documents (the same, with the raw
        documents kept for $exists)."""
        form = form or {".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc"}.get(os.path.splitext(path)[1], "parquet")
        if form == "documents":
            frame = read_documents(self.spark, path, **options)
        elif form == "csv":
            frame = self.spark.read.csv(path, header=options.pop("header", True), **options)
        else:
            frame = getattr(self.spark.read, form)(path, **options)
        self.register(name, frame)
        return frame

    @staticmethod
    def folder(spark: SparkSession, path: str, names: list[str]) -> Catalog:
        """The parquet tables <path>/<name>.parquet."""
        out = Catalog(spark)
        for n in names:
            out.register(n, spark.read.parquet(f"{path}/{n}.parquet"))
        return out


def read_documents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Documents, one a line, as columns of the given or inferred schema, and the raw documents as the hidden column __raw."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path)
    schema = schema or spark.read.json(path).schema
    return lines.select(F.from_json("value", schema).alias("d"), F.try_parse_json("value").alias("__raw")).select("d.*", "__raw")


def stream_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files at a path: a folder, a file, or files by a pattern."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may be that of a file
