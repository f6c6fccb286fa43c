"""Parsers as column functions: Arrow arrays in, nested Arrow arrays out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows whose results a worker holds at a time; Spark's own batches have up to 10,000 rows.
ROWS = 256


def parser(parse: Callable[..., object], kind: str):
    """``parse``, called with the values of two columns or more, as a column function of the type ``kind``."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), ROWS):
                yield pa.array([parse(*values) for values in zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)], arrow)

    return F.arrow_udf(run, kind)
