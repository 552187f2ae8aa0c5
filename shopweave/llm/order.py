"""Places of rows in one global order: how many rows, and how much of a weight, stand before each.

Rows are dealt by ranges of the keys and sorted within each range, whose own running sums are written with them. Totals of
the ranges, one row each, then give where each range starts, and no task sees more than one range of rows or one row a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopweave.llm.common import parts, saved


def in_order(rows: DataFrame, keys: list[str], weight: str, path: str) -> DataFrame:
    """rows with `at` (rows before) and `before` (sum of weight before) in ascending order of keys, nulls first.

    rows should be a written table whose keys together name a row: then a hot key is still cut into several ranges. Rows equal in all
    keys stand in any order. The columns range_no, at and before are the function's own.
    """
    names = rows.columns
    order = [F.col(k).asc_nulls_first() for k in keys]
    own = [T.StructField("range_no", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("before", T.LongType())]

    def run(batches):
        n, total, no = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            w = batch.column(names.index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(w)
            here = n + np.arange(len(w), dtype=np.int64)
            more = [pa.array(np.full(len(w), no, np.int32)), pa.array(here), pa.array(ends - w)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *(f.name for f in own)])
            n, total = n + len(w), int(ends[-1]) if len(w) else total

    dealt = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    local = saved(dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *own])), path)
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("range_no").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    starts = totals.select("range_no", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "w")])
    # One row for each range, of which there are as many as shuffle partitions.
    placed = local.join(F.broadcast(starts), "range_no")
    return placed.select(*names, (F.col("at") + F.col("n0")).alias("at"), (F.col("before") + F.col("w0")).alias("before"))
