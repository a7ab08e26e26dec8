"""Row-wise Python over Arrow batches, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(df: DataFrame, each: Callable[..., Iterable[tuple]], ddl: str, rows: int = 256) -> DataFrame:
    """The tuples that ``each`` gives for every row's values.

    Only ``rows`` rows of a batch are Python objects at a time, so that nested and long
    values cost memory by the slice, not by the batch.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = [c.to_pylist() for c in batch.slice(at, rows).columns]
                out = [row for record in zip(*columns) for row in each(*record)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return df.mapInArrow(run, ddl)
