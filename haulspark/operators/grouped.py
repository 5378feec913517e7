"""Walks over the ordered rows of many small groups, for steps that depend on the step before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from haulspark.sources.shipping import ship_package

Rows = dict[str, list]


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` dealt by hash over all cores: a small file of many rows is read by one task, which would then do all the work on them."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), F.col(by))


#: Rows of a part, where parts grow in number and not in size.
PART_ROWS = 1 << 19


def in_parts(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` dealt by hash of ``by`` into parts of about ``PART_ROWS`` rows: a task's groups and sorts by that column stay as small in a large table.

    The rows are counted, so they should be columns of a table, whose files tell it. Groups and joins by the column need no other shuffle of them.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS)), F.col(by))


def as_told(value: Column, name: str) -> Column:
    """``value`` as a generated column: filters on it stay above it, so that a row's value is worked out once and not in each of them."""
    return F.explode(F.array(value)).alias(name)


def walk_groups(rows: DataFrame, key: str, order: Sequence[str], walk: Callable[[object, Rows], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``walk(key, columns)`` gives for each group, whose rows come in ``order``.

    Groups are dealt by key and sorted by Spark, which spills; a task reads them one after another from its batches
    and holds one group and one batch at a time. A call a group costs microseconds, where a pandas frame a group
    would cost milliseconds.
    """
    ship_package(rows.sparkSession)
    kind = StructType.fromDDL(schema)
    out_schema = to_arrow_schema(kind)

    def columns_of(batch: pa.RecordBatch) -> Rows:
        # whole numbers stay whole beside nulls, which a pandas column of them would turn into doubles
        return {name: (c.to_pandas() if pa.types.is_floating(c.type) or pa.types.is_temporal(c.type) else c).tolist() for name, c in zip(batch.schema.names, batch.columns, strict=True)}

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type, from_pandas=True) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            columns = columns_of(batch)
            keys, out, lo = columns[key], [], 0
            for at in range(len(keys) + 1):
                if at < len(keys) and at > lo and keys[at] == keys[lo]:
                    continue
                if at > lo:
                    part = {c: v[lo:at] for c, v in columns.items()}
                    if held is not None and keys[lo] == now:
                        held = {c: held[c] + part[c] for c in held}
                    else:
                        if held is not None:
                            out += walk(now, held)
                        now, held = keys[lo], part
                lo = at
            if out:
                yield given(out)
        if held is not None and (out := walk(now, held)):
            yield given(out)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, kind)
