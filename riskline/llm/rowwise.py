"""Arrow helper: columns computed from one text column, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskline.llm.text import fresh

#: Rows held as Python objects at once.
ROWS = 256


def with_columns_of(docs: DataFrame, text: str, fields: list[T.StructField], start: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``docs`` with ``fields``, the values that the function made by ``start`` gives for each text.

    ``start`` runs once per task.  NULL is passed as an empty text.  Columns of ``docs``
    named like a field are replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                made = [make(t or "") for t in batch.column(len(kept)).to_pylist()]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *new])

    return docs.select(*kept, F.col(text).alias(fresh(docs.columns, "_text"))).mapInArrow(run, schema)
