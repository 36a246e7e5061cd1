"""Per-key results where a few keys hold most records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methframe.operators.ranged import part_id, ranged


def _segments(keys: pa.Array) -> np.ndarray:
    """The first row of each run of equal keys; nulls are equal to each other."""
    codes = pc.fill_null(keys.dictionary_encode().indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = pc.is_valid(values).to_numpy(zero_copy_only=False)
    return pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), known


class KeyState:
    """What is known of one key in one stretch of the order. ``absorb`` takes the stretch that follows."""

    def __init__(self, key, rows, sums, nums, distinct, first, last, gap):
        self.key, self.rows, self.sums, self.nums = key, rows, sums, nums
        self.distinct, self.first, self.last, self.gap = distinct, first, last, gap

    def absorb(self, later: KeyState) -> None:
        self.rows += later.rows
        self.sums = [a + b for a, b in zip(self.sums, later.sums)]
        self.nums = [a + b for a, b in zip(self.nums, later.nums)]
        if later.first is None:
            return
        if self.last is None:
            self.distinct, self.first, self.last, self.gap = later.distinct, later.first, later.last, later.gap
            return
        step = later.first - self.last
        self.distinct += later.distinct - (step == 0)
        self.gap = max((g for g in (self.gap, later.gap, step or None) if g is not None), default=None)
        self.last = later.last


def _states(batch: pa.RecordBatch, measures: int) -> Iterator[KeyState]:
    keys = batch.column(0)
    starts = _segments(keys)
    ends = np.r_[starts[1:], len(keys)]
    order, known = _column(batch.column(1))
    columns = [_column(batch.column(2 + i)) for i in range(measures)]
    sums = [np.add.reduceat(v, starts) for v, _ in columns]
    nums = [np.add.reduceat(k.astype(np.int64), starts) for _, k in columns]
    first, last, gap = ([None] * len(starts) for _ in range(3))
    distinct = [0] * len(starts)
    if known.any():
        owner, at = np.repeat(np.arange(len(starts)), ends - starts)[known], order[known]
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        steps = np.r_[0, np.diff(at)]
        steps[heads] = 0
        widest, seen = np.maximum.reduceat(steps, heads), np.add.reduceat((steps > 0).astype(np.int64), heads)
        for j, o in enumerate(owner[heads]):
            tail = (heads[j + 1] if j + 1 < len(heads) else len(at)) - 1
            first[o], last[o], distinct[o], gap[o] = int(at[heads[j]]), int(at[tail]), int(seen[j]) + 1, int(widest[j]) or None
    for i, (a, b) in enumerate(zip(starts, ends)):
        yield KeyState(keys[int(a)].as_py(), int(b - a), [int(s[i]) for s in sums], [int(s[i]) for s in nums], distinct[i], first[i], last[i], gap[i])


def key_totals(df: DataFrame, key: str, order: str, measures: list[str], tiebreak: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per value of ``key`` (null is a value of its own), without a task per key.

    n_rows; sum_<m> of each integer measure (null where the key has no value of it); n_<order>: distinct values of the
    integer column ``order``; first_<order>, last_<order>; max_gap: the largest step between neighbouring values
    (null where there are fewer than two). Rows with a null order count in n_rows and sums only. Repeated rows all
    count. An empty table gives no rows.

    Rows go to range partitions on (key, order, tiebreak), so the rows of a heavy key, and even those of one heavy
    (key, order), are spread evenly; each partition folds its rows to one state per key; the states of a key are then
    stitched in partition order.
    """
    n = len(measures)
    tie = [tiebreak] if tiebreak else []
    rows = ranged(df.select(F.col(key).alias("k"), F.col(order).alias("o"), *[F.col(m).alias(f"m{i}") for i, m in enumerate(measures)], *[F.col(t).alias("t") for t in tie]), ["k", "o"], "t" if tie else None, partitions)
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"s{i} bigint, c{i} bigint" for i in range(n))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, done = part_id(), None, []

        def row(s: KeyState) -> dict:
            out = {"k": s.key, "part": part, "n": s.rows, "d": s.distinct, "first": s.first, "last": s.last, "gap": s.gap}
            for i in range(n):
                out |= {f"s{i}": s.sums[i], f"c{i}": s.nums[i]}
            return out

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                whole = [("k", batch.schema.field(0).type), ("part", pa.int32()), *[(x, pa.int64()) for x in ("n", "d", "first", "last", "gap")]]
                schema = pa.schema(whole + [(f"{x}{i}", pa.int64()) for i in range(n) for x in "sc"])
            for state in _states(batch, n):
                if current is not None and current.key == state.key:
                    current.absorb(state)
                    continue
                if current is not None:
                    done.append(row(current))
                current = state
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([*done, row(current)], schema)

    states = rows.mapInArrow(fold, f"k {kind}, part int, n bigint, d bigint, first bigint, last bigint, gap bigint" + (", " + fields if fields else ""))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    step = F.col("first") - F.col("before")
    return (
        states.withColumn("before", before)
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            *[F.when(F.sum(f"c{i}") > 0, F.sum(f"s{i}")).alias(f"sum_{m}") for i, m in enumerate(measures)],
            F.sum(F.col("d") - F.when(step == 0, 1).otherwise(0)).alias(f"n_{order}"),
            F.min("first").alias(f"first_{order}"),
            F.max("last").alias(f"last_{order}"),
            F.max(F.greatest("gap", F.when(step > 0, step))).alias("max_gap"),
        )
        .withColumnRenamed("k", key)
    )


def heavy_keys(totals: DataFrame, rows: DataFrame, key: str, percent: int) -> DataFrame:
    """The non-null keys that hold at least ``percent`` of all rows of ``rows``; none of an empty table."""
    every = rows.agg(F.count(F.lit(1))).scalar()  # answered from Parquet footers
    return totals.where(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= every * percent)).select(key)
