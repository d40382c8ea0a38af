"""Aggregation pipelines over Spark DataFrames."""

from .engine import Engine, Result
from .errors import Capability, PipelineError, UnsupportedOperatorError, ValidationError
from .sources.catalog import Catalog

__all__ = ["Capability", "Catalog", "Engine", "PipelineError", "Result", "UnsupportedOperatorError", "ValidationError"]
