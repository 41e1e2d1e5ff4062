"""A block-callback source: user functions give the size, the matrix and the vectors of a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from blockloom.plans.lp import COLS, NNZ, ROWS, Problem

#: block -> rows of one of the canonical tables
Callback = Callable[[int], Iterator[tuple]]


def from_callbacks(spark: SparkSession, blocks: int, cols: Callback, rows: Callback, nnz: Callback) -> Problem:
    """A problem whose blocks 0..blocks-1 are asked for where they are used, one task each."""

    def table(callback: Callback, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for pdf in batches:
                for b in pdf.id:
                    yield pd.DataFrame(list(callback(int(b))), columns=names).astype({n: "float64" for n in names if n in ("cost", "lb", "ub", "lo", "hi", "val")})

        return spark.range(0, blocks, 1, blocks).mapInPandas(run, schema)

    return Problem(table(cols, COLS), table(rows, ROWS), table(nnz, NNZ))
