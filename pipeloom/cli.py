"""Command line: runs pipelines from a file or argument over files.

    python -m pipeloom -t orders=orders.parquet -c orders pipeline.json
    python -m pipeloom -t orders=orders.parquet -c orders --pipeline '[{"$limit": 3}]'

A pipeline file holds a list of stages, {"pipeline": [...], "collection"?}, or {"pipelines": [{"name", "collection", "pipeline"}, ...]}.
Ends with 0, or 1 for a wrong call, 2 for a pipeline that doesn't compile, 3 for one that fails when it runs.
"""

from __future__ import annotations

import argparse
import json
import sys

from .errors import PipelineError
from .names import file_path

__version__ = "0.2.0"


def pipelines(doc, collection: str | None) -> list[tuple[str, str | None, list]]:
    """(name, collection, pipeline) of each pipeline in a file."""
    if isinstance(doc, list):
        return [("pipeline", collection, doc)]
    if "pipelines" in doc:
        return [(p.get("name", p.get("id", str(i))), p.get("collection", collection), p["pipeline"]) for i, p in enumerate(doc["pipelines"])]
    return [(doc.get("name", "pipeline"), doc.get("collection", collection), doc["pipeline"])]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pipeloom", description="Runs aggregation pipelines with Spark.")
    p.add_argument("file", nargs="?", help="pipeline file")
    p.add_argument("--pipeline", help="the pipeline itself, as JSON")
    p.add_argument("-i", "--inline", action="store_true", help="values stand in the plan itself; they always do here")
    p.add_argument("-p", "--pretty", action="store_true", help="documents over several lines")
    p.add_argument("--no-hints", action="store_true", help="no hints to the planner; there are none here")
    p.add_argument("-c", "--collection", help="collection of pipelines that name none")
    p.add_argument("-t", "--table", action="append", default=[], metavar="NAME=PATH", help="a collection and its file or folder")
    p.add_argument("-o", "--output", help="file for the documents, one a line")
    p.add_argument("--explain", action="store_true", help="shows plans instead of running")
    p.add_argument("--strict", action="store_true")
    p.add_argument("-v", "--version", action="version", version=f"pipeloom {__version__}")
    p.add_argument("--verbose", action="store_true", help="says which pipeline runs, and its warnings")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    try:
        if (a.file is None) == (a.pipeline is None):
            raise ValueError("give a pipeline file or --pipeline")
        if a.pipeline is not None:
            doc = json.loads(a.pipeline)
        else:
            with open(file_path(a.file), encoding="utf-8") as f:
                doc = json.load(f)
        todo = pipelines(doc, a.collection)
        tables = dict(t.split("=", 1) for t in a.table)
        if any(c is None for _, c, _ in todo):
            raise ValueError("a pipeline has no collection; give -c")
    except (ValueError, OSError, KeyError, PipelineError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1

    from pyspark.sql import SparkSession

    from .engine import Engine
    from .sources.catalog import Catalog

    spark = SparkSession.builder.appName("pipeloom").getOrCreate()
    engine = Engine(spark, Catalog(spark), strict=a.strict)
    out = open(file_path(a.output), "w", encoding="utf-8") if a.output else sys.stdout
    try:
        for name, path in tables.items():
            engine.catalog.load(name, path)
        for name, coll, stages in todo:
            if a.verbose:
                print(f"-- {name} over {coll}", file=sys.stderr)
            result = engine.compile(coll, stages)
            if a.verbose:
                for w in result.warnings:
                    print(f"warning: {w}", file=sys.stderr)
            if a.explain:
                result.explain()
                continue
            from pyspark.sql import functions as F

            for row in result.frame.select(F.to_json(F.struct("*")).alias("d")).toLocalIterator():
                print(json.dumps(json.loads(row["d"]), indent=2, ensure_ascii=False) if a.pretty else row["d"], file=out)
    except PipelineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    finally:
        if out is not sys.stdout:
            out.close()
    return 0
