"""Helpers for mapInArrow functions: one Python value list per column, one record batch out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 1000
#: The same where columns stay arrays.
WIDE_ROWS = 4096


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., Iterator[dict[str, list]]]]) -> DataFrame:
    """Apply make()(column lists...) to each Arrow batch of df.

    make runs once a task, so what it builds (automata, tables) is shared by the batches of a partition.
    The function that it returns yields dictionaries of equally long lists, one for each output batch. It gets
    at most ROWS rows at a time, so Python values of a whole Arrow batch are never held at once.
    """
    schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for out in work(*(column.to_pylist() for column in part.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """map_rows() for numbers: the function gets Arrow arrays of at most WIDE_ROWS rows and returns one dictionary of
    Arrow arrays, numpy arrays or lists, so no value becomes a Python object on the way."""
    schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, WIDE_ROWS):
                out = work(*batch.slice(at, WIDE_ROWS).columns)
                columns = [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of equally many numbers, none null -> rows x width doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
