"""Names of fields and collections."""

from __future__ import annotations

import re

from .errors import ValidationError

#: What names may look like (fixed values).
SEGMENT = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*\Z")
COLLECTION = re.compile(r"[a-zA-Z][a-zA-Z0-9_]{0,127}\Z")
LONGEST = 128


def segments(path: str) -> list[str]:
    """The segments of a dotted path; each begins with a letter or underscore and has 128 characters at most."""
    parts = path.split(".") if isinstance(path, str) else []
    if not parts or not all(SEGMENT.match(p) and len(p) <= LONGEST for p in parts):
        raise ValidationError("INVALID_FIELD", f"not a field path: {path!r}")
    return parts


def collection(name: str) -> str:
    if not isinstance(name, str) or not COLLECTION.match(name):
        raise ValidationError("INVALID_COLLECTION", f"not a collection name: {name!r}")
    return name


def file_path(path: str) -> str:
    """A path from the command line: without parent folders, NUL and other schemes' URLs."""
    if ".." in path.split("/") or "\0" in path or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        raise ValidationError("INVALID_PATH", f"not allowed as a path: {path!r}")
    return path
