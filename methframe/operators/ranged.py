"""Global order without hot tasks: range partitions on a key, an order and a tie-break.

Spark samples the quantiles of the composite key, so a key that holds a third of all rows is spread over a third of
the partitions. What a partition can't know, because its first key began in an earlier one, is stitched afterwards
from one small state per partition and key. There are at most (partitions + keys) such states, and at most
2 x partitions of them belong to keys that cross a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methframe.session import checkpointed, partitions_of


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in any of the columns; nulls are equal to each other."""
    size = len(columns[0]) if columns else 0
    out = np.zeros(max(size - 1, 0), bool)
    for c in columns:
        a, b = c.slice(0, max(size - 1, 0)), c.slice(1)
        known = pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out |= known | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return out


#: Stored bytes that a range should come from, and ranges at most: the driver holds a sample of 100 keys a range.
RANGE_BYTES, MOST_RANGES = 64 << 20, 50_000


def ranges_of(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, and more if the stored tables behind ``df`` are large."""
    leaves, stored = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            stored += int(leaves.apply(i).stats().sizeInBytes())
    return max(partitions_of(df.sparkSession), min(-(-stored // RANGE_BYTES), MOST_RANGES))


def ranged(df: DataFrame, keys: list[str], tiebreak: str | None = None, partitions: int | None = None, sort: bool = True) -> DataFrame:
    """``df`` in range partitions on keys and tiebreak (by default the row's number in the input).

    The number of partitions is explicit, so adaptive execution neither joins nor splits them and the partition id
    follows the order.
    """
    n = partitions or ranges_of(df)
    if tiebreak is None:
        tiebreak = "_row"
        df = df.withColumn(tiebreak, F.monotonically_increasing_id())
    out = df.repartitionByRange(n, *keys, tiebreak)
    return out.sortWithinPartitions(*keys, tiebreak) if sort else out


def part_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's number, from 0, within ``group`` (null is a group) in the order of ``order``; no task holds a group.

    Rows that tie in ``order`` are numbered in any order. Partitions number their own rows; the groups that go on from an earlier
    partition, at most one for each partition, then get the count of what is before.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = [df.columns.index(c) for c in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = part_id(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i) for i in at]
            heads = np.flatnonzero(np.r_[True, changes(keys) if keys else np.zeros(b.num_rows - 1, bool)])
            local = np.arange(b.num_rows) - np.repeat(heads, np.diff(np.r_[heads, b.num_rows]))
            if last is not None and [k[0].as_py() for k in keys] == last:
                local[: heads[1] if len(heads) > 1 else b.num_rows] += seen
            last, seen = [k[b.num_rows - 1].as_py() for k in keys], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)], [*b.schema.names, "_part", "_local"])

    rows = df.repartitionByRange(partitions or ranges_of(df), *group, *order).sortWithinPartitions(*group, *order)
    rows = checkpointed(rows.mapInArrow(number, f"{kinds}, _part int, _local bigint"))
    ends = rows.groupBy(*group, "_part").agg((F.max("_local") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = ends.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), before.alias("_base")).where("_base is not null")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_part") == F.col("_p"))
    out = rows.join(F.broadcast(base), same, "left").withColumn(name, F.col("_local") + F.coalesce("_base", F.lit(0)))  # at most one row a partition
    return out.select(*df.columns, name)
