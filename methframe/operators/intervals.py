"""Continuous stretches and gaps of overlapping intervals."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methframe.operators.ranged import part_id, ranged
from methframe.session import checkpointed


class IntervalMap:
    """Disjoint stretches in order, with the gaps between them.

    ``starts`` and ``ends`` are sorted lists. An insertion finds the stretches that it overlaps or touches by
    binary search and puts one stretch in their place; the gap before a stretch is read off its neighbours, so it
    is up to date after every insertion.
    """

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])

    def insert(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def stretches(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def coalesce_batch(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of each owner within one batch, before they are inserted: fewer insertions, the same map."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    new_owner = np.r_[True, owner[1:] != owner[:-1]]
    reach = pd.Series(end).groupby(np.cumsum(new_owner), sort=False).cummax().to_numpy()
    head = new_owner | np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(head)
    return owner[at], start[at], reach[np.r_[at[1:], len(end)] - 1]


def _fragments(df: DataFrame, entity: list[str]) -> DataFrame:
    """Per partition and entity the disjoint stretches, each with the start of the next one in the same partition."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, maps, schema = part_id(), {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([*[(c, batch.schema.field(c).type) for c in entity], ("part", pa.int32()), *[(c, pa.int64()) for c in ("frag_start", "frag_end", "next_start")]])
            frame = batch.to_pandas()
            codes, names = frame.groupby(entity, sort=False).ngroup().to_numpy(), frame[entity].drop_duplicates().itertuples(index=False, name=None)
            names = list(names)
            for o, s, e in zip(*(x.tolist() for x in coalesce_batch(codes, frame["_s"].to_numpy(), frame["_e"].to_numpy()))):
                key = names[o]
                if key not in maps:
                    maps[key] = IntervalMap()
                maps[key].insert(s, e)
        out: dict[str, list] = {c: [] for c in schema.names} if schema else {}
        for key, found in maps.items():
            size = len(found.starts)
            for c, v in zip(entity, key):
                out[c] += [v] * size
            out["part"] += [part] * size
            out["frag_start"] += found.starts
            out["frag_end"] += found.ends
            out["next_start"] += [*found.starts[1:], None]
            if len(out["part"]) >= 50_000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {c: [] for c in schema.names}
        if out and out["part"]:
            yield pa.RecordBatch.from_pydict(out, schema)

    return df.select(*entity, "_s", "_e").mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in entity) + ", part int, frag_start bigint, frag_end bigint, next_start bigint")


def stretches_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """kind (``merged`` or ``gap``), the entity columns, start, end: the continuous stretches and the gaps between them.

    Intervals are half-open; those that overlap or touch belong to one stretch. Rows with a null in the entity or
    the bounds, and rows whose end isn't above their start, are left out. Repeated rows change nothing. An empty
    table gives no rows. Other columns are ignored, whatever their names.

    Rows are range-partitioned on (entity, start), so an entity with a third of all rows is spread over many
    tasks. Each task keeps one IntervalMap per entity it sees. An entity that crosses partition boundaries is
    stitched from one state per (entity, partition): at most 2 x partitions rows, which makes their broadcast safe.
    """
    clean = df.select(*entity, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")).dropna().where("_e > _s")
    clean = ranged(clean, [*entity, "_s"], partitions=partitions, sort=False)
    pieces = checkpointed(_fragments(clean, entity))
    key = [*entity, "part"]

    by_part = Window.partitionBy(*entity).orderBy("part")
    earlier, later = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    ends = pieces.groupBy(*key).agg(F.max("frag_end").alias("reach"))
    carried = ends.withColumn("carry", F.max("reach").over(earlier)).withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*entity)))
    crossing = F.broadcast(checkpointed(carried.where("parts > 1").select(*key, "carry")))
    # a piece that starts within reach of earlier partitions continues their last stretch; the rest of its partition stands alone
    split = pieces.join(crossing.withColumn("crosses", F.lit(True)), key, "left")
    own = F.col("carry").isNull() | (F.col("frag_start") > F.col("carry"))
    state = (
        split.where("crosses")
        .groupBy(*key)
        .agg(
            F.max(F.when(~own, F.col("frag_end"))).alias("joined_end"),
            F.min(F.when(own, F.col("frag_start"))).alias("own_start"),
            F.max(F.when(own, F.col("frag_start"))).alias("last_start"),
        )
    )
    # the last stretch of a partition is open until the next partition with a stretch of its own
    state = state.withColumn("opened", F.count("own_start").over(earlier)).withColumn("open_after", F.count("own_start").over(by_part))
    joined = state.groupBy(*entity, F.col("opened").alias("open_after")).agg(F.max("joined_end").alias("open_end"))
    last = state.where("own_start is not null").withColumn("following", F.min("own_start").over(later))
    opened = last.join(joined, [*entity, "open_after"], "left").select(*key, "last_start", "open_end", "following")
    last_cols = {c: f"l_{c}" for c in (*key, "last_start")}
    opened = F.broadcast(opened.withColumnsRenamed(last_cols))
    here = [F.col(c) == F.col(last_cols[c]) for c in key] + [F.col("frag_start") == F.col("l_last_start")]
    whole = split.where(own).join(opened, here, "left")
    whole = whole.select(*entity, F.col("frag_start").alias(start), F.greatest("frag_end", "open_end").alias(end), F.coalesce("next_start", "following").alias("_next"))
    found = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col(start).alias(start), F.col(end).alias(end)),
        F.struct(F.lit("gap").alias("kind"), F.col(end).alias(start), F.col("_next").alias(end)),
    )
    return whole.select(*entity, F.explode(found).alias("f")).select("f.kind", *entity, f"f.{start}", f"f.{end}").where(F.col(end).isNotNull())


def number_stretches(df: DataFrame, entity: list[str], start: Column, end: Column, partitions: int | None = None) -> DataFrame:
    """Rows of ``df`` with a valid interval, with the bounds (stretch_start, stretch_end) of the stretch of their entity they lie in.

    Stretches come from range partitions, and each interval finds its own by an equi-join on
    (entity, bin) with the range as a residue, so no task holds an entity. Rows with null entities or bounds, or an end not above the start, are left out.
    """
    from methframe.operators.region import sites_in_regions

    rows = df.withColumn("_from", start.cast("bigint")).withColumn("_to", end.cast("bigint")).where("_from < _to").dropna(subset=entity)
    found = stretches_and_gaps(rows, entity, "_from", "_to", partitions).where("kind = 'merged'")
    # one text key, with lengths in front so that different entities can't spell the same
    key = F.concat_ws("|", *[F.concat_ws(":", F.length(F.col(c).cast("string")), F.col(c).cast("string")) for c in entity])
    spans = checkpointed(found.select(key.alias("chrom"), F.col("_from").alias("stretch_start"), (F.col("_to") - 1).alias("stretch_last")))
    points = rows.withColumnsRenamed({c: f"_own_{c}" for c in ("chrom", "pos") if c in rows.columns})
    key = F.concat_ws("|", *[F.concat_ws(":", F.length(F.col(n).cast("string")), F.col(n).cast("string")) for n in (f"_own_{c}" if c in ("chrom", "pos") and c in rows.columns else c for c in entity)])
    joined = sites_in_regions(points.withColumn("chrom", key).withColumn("pos", F.col("_from")), spans, "stretch_start", "stretch_last")
    joined = joined.drop("chrom", "pos", "_from", "_to").withColumn("stretch_end", F.col("stretch_last") + 1).drop("stretch_last")
    return joined.withColumnsRenamed({f"_own_{c}": c for c in ("chrom", "pos")})
