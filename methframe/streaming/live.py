"""Structured Streaming forms: pseudobulk of arriving cells, windows over events, and interval maps in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from methframe.operators.intervals import IntervalMap


def live_pseudobulk(sites: DataFrame) -> DataFrame:
    """Running sums per site of a stream of cells; for the update or complete mode."""
    return sites.groupBy("chrom", "pos").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per type and tumbling window; events later than ``late`` are dropped, and windows close by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("since"), "event_type", "n", "total")


def distinct_records(records: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first arrival of each record within the watermark."""
    return records.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def live_intervals(intervals: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """A stream of intervals per entity, in any order: after each batch the stretches that an entity now has.

    entity, version (batches seen by the entity), kind (merged or gap), start, end. The keyed state is the entity's IntervalMap; every insertion
    finds its overlaps by binary search. For the update mode.
    """
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema.fields}
    clean = intervals.select(*entity, F.col(start).cast("bigint").alias(start), F.col(end).cast("bigint").alias(end)).dropna().where(F.col(end) > F.col(start))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, starts, ends = state.get if state.exists else (0, [], [])
        found = IntervalMap(starts, ends)
        for batch in batches:
            for s, e in zip(batch[start].tolist(), batch[end].tolist()):
                found.insert(s, e)
        state.update((version + 1, found.starts, found.ends))
        rows = [("merged", *x) for x in found.stretches()] + [("gap", *x) for x in found.gaps()]
        yield pd.DataFrame([(*key, version + 1, *r) for r in rows], columns=[*entity, "version", "kind", start, end])

    out = ", ".join(f"{c} {kinds[c]}" for c in entity) + f", version int, kind string, {start} bigint, {end} bigint"
    return clean.groupBy(*entity).applyInPandasWithState(update, out, "version int, starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)
