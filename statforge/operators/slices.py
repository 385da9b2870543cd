"""Sequences of any length cut into slices, and state carried from slice to slice.

A sequence (a video, a match) is range partitioned by key and order, so a long one spreads over
tasks; slices hold at most 2 ** bits rows. What a slice does to any state before it is worked
out for all slices at once; then one small row a slice passes through ``walked`` in order,
which carries the state of one key at a time and holds no group.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

BITS = 10


def sliced(df: DataFrame, key: str, order: str, fields: dict[str, Column], bits: int = BITS) -> DataFrame:
    """key, slice, and arrays of ``place`` (the order values) and each field. Rows with one key
    and order value fall in any order."""
    rows = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("place"), *[c.alias(n) for n, c in fields.items()])
    rows = rows.repartitionByRange("key", "place").sortWithinPartitions("key", "place").withColumn("_id", F.monotonically_increasing_id())
    lists = rows.groupBy("key", F.shiftright("_id", bits).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("_id", "place", *fields))).alias("_rows"))
    return kept(lists.select("key", "slice", *[F.col("_rows")[n].alias(n) for n in ("place", *fields)]), "slices")


def walked(df: DataFrame, columns: list[str], step: Callable, schema: str, backwards: bool = False) -> DataFrame:
    """``step(state, *columns) -> (state, row)`` over the slices of each key in order, with
    state None for the first; rows are (key, slice, *row) and have ``schema``. Rows of a key stream
    through one task, one a slice."""

    def run(batches):
        last, state = object(), None
        for batch in batches:
            out = []
            for key, slice_, *values in zip(*[batch.column(n).to_pylist() for n in ("key", "slice", *columns)], strict=True):
                if key != last:
                    last, state = key, None
                state, row = step(state, *values)
                out.append((key, slice_, *row))
            types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], schema=types)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    by = F.desc("slice") if backwards else F.asc("slice")
    return df.select("key", "slice", *columns).repartition("key").sortWithinPartitions("key", by).mapInArrow(run, schema)
