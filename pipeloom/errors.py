"""Errors of parsing and compiling pipelines."""

from __future__ import annotations

from enum import Enum


class PipelineError(Exception):
    """A pipeline can't be compiled."""


class ValidationError(PipelineError):
    """A stage or operator has a malformed argument. code: a short name of the rule that it breaks."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


class UnsupportedOperatorError(PipelineError):
    """No such stage or operator."""

    def __init__(self, operator: str, partial: bool = False):
        super().__init__(f"unsupported operator: {operator}")
        self.operator, self.partial = operator, partial


class Capability(Enum):
    """How far a pipeline can be run."""

    FULL_SUPPORT = "full"
    EMULATED = "emulated"
    PARTIAL = "partial"
    CLIENT_SIDE_ONLY = "client side"
    UNSUPPORTED = "unsupported"
