"""Small groups in order, without a frame for each.

``applyInPandas`` builds frames for every group, which costs more than a book of
a page takes to read. Here rows are dealt by key and sorted, and Python reads
the stream, so only the group at hand is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as ST


def tasks(spark: SparkSession) -> int:
    """Tasks for work whose load is in its rows, not in their bytes: as many as a shuffle has, and one for every core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def in_order(rows: DataFrame, by: list[str], order: list[str], solve: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``solve`` makes of each group (key, rows as tuples of all columns, sorted by ``order``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(ST.StructType.fromDDL(schema))
    place = [rows.columns.index(c) for c in by]
    dealt = rows.repartition(tasks(rows.sparkSession), *by).sortWithinPartitions(*by, *order)

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(made)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                here = tuple(row[k] for k in place)
                if held and here != key:
                    out += solve(key, held)
                    held = []
                key = here
                held.append(row)
            yield table(out)
        if held:
            yield table(list(solve(key, held)))

    return dealt.mapInArrow(run, schema)
