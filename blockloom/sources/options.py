"""Option files: NAME VALUE TYPE per line."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession

_TRUE = {"true", "1", "yes"}


def load(spark: SparkSession, path: str, defaults: dict[str, int | float | bool]) -> dict[str, int | float | bool]:
    """The defaults with a file's values; # and // begin comments, an unknown name is told and skipped."""
    out = dict(defaults)
    for (line,) in spark.read.text(path).collect():
        part = line.split("#")[0].split("//")[0].split()
        if not part:
            continue
        if len(part) < 2 or part[0] not in defaults:
            warnings.warn(f"unknown option line: {line}", stacklevel=2)
            continue
        kind = part[2].lower() if len(part) > 2 else type(defaults[part[0]]).__name__
        out[part[0]] = part[1].lower() in _TRUE if kind.startswith("bool") else int(part[1]) if kind.startswith("int") else float(part[1])
    return out
