"""Documents in containers of one fixed capacity, by minimum bin slack on the histogram of lengths.

Which documents of a length share a container doesn't matter, so the search runs on the counts by length: at most
``capacity`` numbers, however many documents there are. Each step seeds a container with the longest length left and a
bitset subset-sum over the lengths left fills it as far as any combination can; the combination is taken as often as the
counts allow. Documents are then dealt to the containers by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methframe.operators.ranged import part_id, ranged
from methframe.session import checkpointed

CAPACITY = 4096


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths, each at most as often as it is there, with the greatest sum that fits ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:  # in lots of 1, 2, 4, ...: every number of pieces is a sum of lots
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + lot
            total -= length * lot
    return taken


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) until no length is left; the work depends on the capacity, not on the counts."""
    counts, out = dict(counts), []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        rest = {k: n for k, n in counts.items() if n}
        combination = fullest(rest, capacity - seed)
        counts[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in combination.items())
        out.append((times, combination))
        for k, n in combination.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def _ranked(items: DataFrame) -> DataFrame:
    """row_id, size, rank (from 0) within the size, without a task per size."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = part_id(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(1).to_numpy()
            heads = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
            local = np.arange(len(size)) - np.repeat(heads, np.diff(np.r_[heads, len(size)]))
            if size[0] == last:
                local[: heads[1] if len(heads) > 1 else len(size)] += seen
            last, seen = size[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * len(size), pa.int32()), pa.array(local, pa.int64())], ["row_id", "size", "part", "local"])

    rows = checkpointed(ranged(items.select("row_id", "size"), ["size"], "row_id").mapInArrow(number, "row_id bigint, size bigint, part int, local bigint"))
    ends = rows.groupBy("size", "part").agg((F.max("local") + 1).alias("n"))  # at most partitions + capacity rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ends.select("size", "part", before.alias("base"))), ["size", "part"]).select("row_id", "size", (F.col("local") + F.col("base")).alias("rank"))


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece_no (from 1), n_pieces, start_token, n_tokens, container_id.

    ``sizes`` has row_id (unique), the column ``key`` and n_tokens. Only a document larger than ``capacity`` is split: into full
    containers of its own (``whole-…``) and one remainder, which is packed like any other. No container holds more than ``capacity``.
    Documents without tokens take no room and lie in the first container. Repeated keys are documents of their own. An empty
    table gives no rows. A piece that the plan doesn't place is an error.
    """
    n, cap = F.col("n_tokens"), F.lit(capacity)
    sizes = sizes.select("row_id", F.col(key).alias("_key"), F.coalesce(n, F.lit(0)).alias("n_tokens"))
    item = F.when(n % cap == 0, 0).otherwise(n % cap)
    items = sizes.select("row_id", item.alias("size")).where("size > 0")
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than capacity rows
    slots, first, taken = [], 0, {}
    for times, combination in patterns(counts, capacity):
        for size, each in combination.items():
            start = taken.get(size, 0)
            slots.append((size, start, start + times * each, each, first))
            taken[size] = start + times * each
        first += times
    table = pd.DataFrame(slots, columns=["size", "since", "until", "each", "first"]).astype("int64")
    plan = F.broadcast(sizes.sparkSession.createDataFrame(table, "size bigint, since bigint, until bigint, each bigint, first bigint"))
    dealt = _ranked(items).join(plan, "size").where("rank >= since and rank < until")
    dealt = dealt.select("row_id", F.concat(F.lit("mixed-"), (F.col("first") + F.expr("(rank - since) div each")).cast("string")).alias("_container"))
    full = F.expr(f"cast(n_tokens div {capacity} as int)")
    rest = F.when((F.col("n_tokens") % cap > 0) | (F.col("n_tokens") == 0), 1).otherwise(0)
    pieces = sizes.join(dealt, "row_id", "left").withColumn("n_pieces", (full + rest).cast("int"))
    pieces = pieces.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    start = (F.col("piece_no") - 1).cast("bigint") * cap
    container = F.when(F.col("piece_no") <= full, F.concat_ws("-", F.lit("whole"), F.col("row_id").cast("string"), F.col("piece_no").cast("string"))).when(F.col("n_tokens") == 0, "mixed-0").otherwise(F.coalesce("_container", F.raise_error(F.lit("a piece has no container")).cast("string")))
    return pieces.select(F.col("_key").alias(key), "piece_no", "n_pieces", start.alias("start_token"), F.least(F.col("n_tokens") - start, cap).alias("n_tokens"), container.alias("container_id"))


def fill_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """kind of container (``whole``, ``mixed``), n_containers, n_pieces, n_tokens, unused_share and the fullest container."""
    each = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    kind = F.substring_index("container_id", "-", 1).alias("kind")
    total = F.count(F.lit(1)) * capacity
    return each.groupBy(kind).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("filled").alias("n_tokens"), (1 - F.sum("filled") / total).alias("unused_share"), F.max("filled").alias("most_tokens"))
