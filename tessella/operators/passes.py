"""One pass over rows that lie together and in order, with a state that does not grow with them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def running(rows: DataFrame, key: str, used: list[str], out: str, start: Callable, step: Callable, kind: T.DataType = T.LongType()) -> DataFrame:
    """rows with `out` of some kind, an integer by default: step(state, *used) gives the next state and a row's value, from start() for each new key.

    The rows of a key have to lie together in one partition and in their order, as after an explode of one row a key or
    after a window partitioned by the key. Any number of rows may have a key: nothing is held but the state.
    """

    arrow = to_arrow_type(kind)

    def run(batches):
        last, state = object(), None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *used)]
            values = []
            for k, *own in zip(*columns):
                if k != last:
                    last, state = k, start()
                state, value = step(state, *own)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))
