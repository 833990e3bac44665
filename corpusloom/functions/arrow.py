"""Python functions of columns that work on slices of a batch, so that few rows are Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at once.
SLICE = 200


def sliced(kind: str, function: Callable, rows: int = SLICE):
    """A column function: ``function`` takes a list a column, and gives a list of values.

    Values of a struct are tuples in the order of its fields. Results are Arrow arrays at once, not objects
    of a whole batch, which is what a worker's memory would grow by.
    """
    sql = T.DataType.fromDDL(kind)
    sql = sql["value"].dataType if isinstance(sql, T.StructType) and sql.names == ["value"] else sql
    names = sql.names if isinstance(sql, T.StructType) else None
    arrow = to_arrow_type(sql)

    def part(*lists):
        out = function(*lists)
        return pa.array([None if x is None else dict(zip(names, x)) for x in out] if names else out, arrow)

    @F.arrow_udf(sql)
    def of(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        return pa.concat_arrays([part(*(c.slice(at, rows).to_pylist() for c in columns)) for at in range(0, n, rows)] or [pa.array([], arrow)])

    return of
