"""Consolidation of very many small files into few well-sized ones.

Every small file is a sorted run, or is made one. Quantiles of a sample of the records, found by a distributed sort, cut the key space (cell, chrom, pos, mc, cov) into
ranges; runs are sliced at the cuts and the slices of a range go to one task as whole arrays. The task merges the runs that overlap, a
batch at a time: what lies below the start of all runs to come leaves in order. A cut never parts equal records, so copies always meet in their task,
and it can write and describe its own files. Of a record that is copied so often that the cuts show it, each mapper sends on one copy only for every batch.
"""

from __future__ import annotations

import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methframe.operators.ranged import changes, numbered, part_id
from methframe.session import checkpointed, partitions_of

#: Sampled keys for each range; as many as Spark's own range partitioning takes.
SAMPLES_PER_RANGE = 100
#: Ranges at most, and so cuts that the driver and each task hold; beyond it a range gives several files.
MAX_RANGES = 50_000
#: An output file is closed when its records reach this many bytes, before compression.
FILE_BYTES = 128 << 20
#: Bytes of a record besides its cell and chrom: pos, mc, cov.
FIXED_RECORD_BYTES = 16
#: Records of one file whose copies are known at once are spread over the ranges in lots of this size.
COPIES_TOGETHER = 256

KEY = ["cell", "chrom", "pos", "mc", "cov"]
SLICE = "part int, known boolean, cell string, chrom string, first bigint, file_id bigint, pos array<bigint>, mc array<int>, cov array<int>, rec_no array<int>"
RECORD = "part int, out_seq int, cell string, chrom string, pos bigint, mc int, cov int, file_id bigint, rec_no int, n_bytes int, is_copy boolean"
#: Nulls come first, below any number that a record can hold; a position of -2^63 counts as null.
NO_POS, NO_COUNT = -(1 << 63), -(1 << 40)


def cell_of(spelling: Column) -> Column:
    """The cell a spelling names: without blanks at the ends, letter case and the suffix from the first dot on."""
    return F.lower(F.trim(F.substring_index(F.trim(spelling), ".", 1)))


def runs_of(files: DataFrame) -> DataFrame:
    """The runs to merge. Records beyond the end of a shorter array have nulls there; empty and null arrays hold none."""
    size = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("pos", "mc", "cov")])
    return files.select("file_id", cell_of(F.col("cell_id")).alias("cell"), "chrom", F.greatest(size, F.lit(0)).alias("n"), "pos", "mc", "cov").where("n > 0")


class Cuts:
    """The cuts in order, as numbers within each (cell, chrom); ``heavy`` marks records that fill a range or more."""

    def __init__(self, quantiles: list[tuple]):
        told = sorted((self.rank(r[0]), self.rank(r[1]), NO_POS if r[2] is None else r[2], *(NO_COUNT if x is None else x for x in r[3:])) for r in quantiles)
        keys = sorted(set(told))
        self.groups = [k[:2] for k in keys]
        self.pos, self.mc, self.cov = (np.array([k[i] for k in keys], np.int64) for i in (2, 3, 4))
        self.heavy = np.array([bisect_right(told, k) - bisect_left(told, k) > 1 for k in keys], bool)
        self.parts = len(told) + 1  # the ranges that a heavy record fills take its known copies

    @staticmethod
    def rank(value: str | None) -> tuple:
        return (0, "") if value is None else (1, value)

    def within(self, cell: str | None, chrom: str | None) -> tuple[int, int]:
        group = (self.rank(cell), self.rank(chrom))
        return bisect_left(self.groups, group), bisect_right(self.groups, group)

    def part(self, low: int, high: int, pos: np.ndarray, mc: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """The ranges of records whose (cell, chrom) has the cuts low to high."""
        cuts = self.pos[low:high]
        out, after = low + np.searchsorted(cuts, pos, "left"), low + np.searchsorted(cuts, pos, "right")
        ties = np.flatnonzero(out < after)
        if len(ties):
            first = out[ties].copy()
            for j in range(int(first.min()), int(after[ties].max())):
                here = ties[(first <= j) & (j < after[ties])]
                out[here] += (mc[here] > self.mc[j]) | ((mc[here] == self.mc[j]) & (cov[here] >= self.cov[j]))
        return out


def cut_points(runs: DataFrame, ranges: int) -> Cuts:
    """Quantiles of the records' keys, from a sample of at most about 2 x SAMPLES_PER_RANGE x ranges keys.

    The sample only places the cuts: any cuts give the same result. It is ranked by a distributed sort; only the cuts reach the driver.
    """
    ranges = min(ranges, MAX_RANGES)
    records = runs.agg(F.sum("n")).first()[0] or 0
    if ranges < 2 or not records:
        return Cuts([])
    share = min(1.0, SAMPLES_PER_RANGE * ranges / records)
    # a run gives as many keys as its share of the sample, a small one one key with that chance: a huge run is cut in many places
    wanted = F.col("n") * share
    lucky = F.pmod(F.xxhash64(F.lit(5), "file_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = runs.where(lucky < wanted).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(wanted), F.lit(1)).cast("int"))))
    place = F.pmod(F.xxhash64(F.lit(6), "file_id", "i"), F.col("n")).cast("int")
    sample = numbered(picked.select("cell", "chrom", *[F.get(c, place).alias(c) for c in ("pos", "mc", "cov")]), [], KEY)
    size = sample.count()
    at = lambda r: F.floor(r * ranges / max(size, 1))
    return Cuts([tuple(r) for r in sample.where(at(F.col("rank")) > at(F.col("rank") - 1)).where("rank > 0").select(*KEY).collect()])


def _flat(values: pa.Array, size: np.ndarray, none: int) -> np.ndarray:
    """The elements of a list column, each list filled up to ``size`` with nulls, as numbers."""
    length = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(values.flatten().cast(pa.int64()), none).to_numpy(zero_copy_only=False)
    if (length == size).all():
        return flat
    out = np.full(size.sum(), none, np.int64)
    start = np.repeat(np.cumsum(size) - size, length)
    out[start + np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _packed(values: np.ndarray, none: int, kind: pa.DataType, offsets: pa.Array | None = None) -> pa.Array:
    missing = values == none
    flat = pa.array(np.where(missing, 0, values) if missing.any() else values, mask=missing if missing.any() else None).cast(kind)
    return flat if offsets is None else pa.ListArray.from_arrays(offsets, flat)


def _names(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The distinct (cell, chrom) of rows, and the place of each row's."""
    place: dict[tuple, int] = {}
    at = np.array([place.setdefault(k, len(place)) for k in zip(*(c.to_pylist() for c in columns))], int)
    return list(place), at


def _slices(runs: DataFrame, cuts: Cuts) -> DataFrame:
    """Each run, sorted by its records, in one slice per range that it meets; ``known`` slices hold copies of heavy records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(3).to_numpy().astype(np.int64)
            pos, mc, cov = _flat(b.column(4), size, NO_POS), _flat(b.column(5), size, NO_COUNT), _flat(b.column(6), size, NO_COUNT)
            run = np.repeat(np.arange(b.num_rows), size)
            number = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + 1
            step = (run[1:] > run[:-1]) | (pos[1:] > pos[:-1]) | ((pos[1:] == pos[:-1]) & ((mc[1:] > mc[:-1]) | ((mc[1:] == mc[:-1]) & (cov[1:] >= cov[:-1]))))
            if not step.all():
                order = np.lexsort((cov, mc, pos, run))  # stable: numbers rise among equal records
                run, pos, mc, cov, number = run[order], pos[order], mc[order], cov[order], number[order]
            names, group = _names([b.column(1), b.column(2)])
            file_id = b.column(0).to_numpy()
            low, high = np.array([cuts.within(*k) for k in names]).T
            part, known = low[group][run], np.zeros(len(run), bool)
            for g in np.flatnonzero(high > low):
                here = np.flatnonzero(group[run] == g)
                part[here] = cuts.part(low[g], high[g], pos[here], mc[here], cov[here])
                for j in np.flatnonzero(cuts.heavy[low[g] : high[g]]) + low[g]:
                    same = here[(pos[here] == cuts.pos[j]) & (mc[here] == cuts.mc[j]) & (cov[here] == cuts.cov[j])]
                    # a record has an earlier copy in this batch unless it is the first here: it is a copy wherever that one ends up
                    same = same[np.lexsort((number[same], file_id[run[same]]))][1:]
                    known[same] = True
                    part[same] = (file_id[run[same]] + number[same] // COPIES_TOGETHER) % cuts.parts
            head = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (part[1:] != part[:-1]) | (known[1:] != known[:-1])])
            offsets, of = pa.array(np.r_[head, len(run)].astype(np.int32)), pa.array(run[head])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[head].astype(np.int32)), pa.array(known[head]), b.column(1).take(of), b.column(2).take(of), pa.array(pos[head]), b.column(0).take(of),
                 _packed(pos, NO_POS, pa.int64(), offsets), _packed(mc, NO_COUNT, pa.int32(), offsets), _packed(cov, NO_COUNT, pa.int32(), offsets), pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32)))],
                [f.split()[0] for f in SLICE.split(", ")],
            )

    slices = runs.select("file_id", "cell", "chrom", "n", "pos", "mc", "cov").mapInArrow(cut, SLICE)
    return slices.repartitionById(cuts.parts, F.col("part")).sortWithinPartitions("cell", "chrom", "first", "file_id")


class _Merge:
    """The merge of one task: slices come by (cell, chrom, first, file_id), records leave by (cell, chrom, pos, mc, cov, file_id, rec_no)."""

    def __init__(self, part: int, file_bytes: int):
        self.part, self.file_bytes, self.seq, self.filled = part, file_bytes, 0, 0
        self.names: list[tuple] = []
        self.held = [np.zeros(0, np.int64) for _ in range(6)]  # group, pos, mc, cov, file_id, rec_no

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = b.column(1).to_numpy(zero_copy_only=False)
        if known.any():
            yield from self.known_copies(b.filter(pa.array(known)))
            b = b.filter(pa.array(~known))
        if not b.num_rows:
            return
        head = np.r_[True, changes([b.column(2), b.column(3)])]
        group = np.cumsum(head) - 1 + len(self.names)
        first = (b.column(2)[0].as_py(), b.column(3)[0].as_py())
        fresh = list(zip(b.column(2).filter(pa.array(head)).to_pylist(), b.column(3).filter(pa.array(head)).to_pylist()))
        if self.names and self.names[-1] == first:
            group, fresh = group - 1, fresh[1:]
        self.names += fresh
        size = pc.list_value_length(b.column(6)).to_numpy()
        told = [np.repeat(group, size), *(_flat(b.column(i), size, none) for i, none in ((6, NO_POS), (7, NO_COUNT), (8, NO_COUNT))), np.repeat(b.column(5).to_numpy(), size), b.column(9).flatten().to_numpy().astype(np.int64)]
        self.held = [np.concatenate(x) for x in zip(self.held, told)]
        yield from self.leave((int(group[-1]), b.column(4)[b.num_rows - 1].as_py()))

    def leave(self, bound: tuple | None) -> Iterator[pa.RecordBatch]:
        """Records below ``bound`` (group, pos), which is where all runs to come start at the earliest; all, if None."""
        group, pos = self.held[:2]
        going = np.ones(len(group), bool) if bound is None else (group < bound[0]) | ((group == bound[0]) & (pos < bound[1]))
        if not going.any():
            return
        out, self.held = [x[going] for x in self.held], [x[~going] for x in self.held]
        order = np.lexsort(out[::-1])
        out = [x[order] for x in out]
        copy = np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in out[:4]])] if len(order) > 1 else np.zeros(1, bool)
        place, at = np.unique(out[0], return_inverse=True)
        width = np.array([FIXED_RECORD_BYTES + sum(len((x or "").encode()) for x in self.names[g]) for g in place])[at]
        yield self.batch(out, at, [self.names[g] for g in place], width, copy, self.roll(np.where(copy, 0, width)))

    def roll(self, width: np.ndarray) -> np.ndarray:
        """The output file of each record: a file is closed before the record that would take it over its bytes."""
        end, seq, i = np.cumsum(width), np.empty(len(width), np.int64), 0
        while i < len(width):
            gone = end[i - 1] if i else 0
            j = max(int(np.searchsorted(end, gone + self.file_bytes - self.filled, "right")), i + (self.filled == 0))
            seq[i:j] = self.seq
            self.filled += int((end[j - 1] if j else 0) - gone)
            if j < len(width):
                self.seq, self.filled = self.seq + 1, 0
            i = j
        return seq

    def known_copies(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(b.column(6)).to_numpy()
        names, at = _names([b.column(2), b.column(3)])
        at = np.repeat(at, size)
        out = [at, *(_flat(b.column(i), size, none) for i, none in ((6, NO_POS), (7, NO_COUNT), (8, NO_COUNT))), np.repeat(b.column(5).to_numpy(), size), b.column(9).flatten().to_numpy().astype(np.int64)]
        yield self.batch(out, at, names, np.zeros(len(at), np.int64), np.ones(len(at), bool), np.full(len(at), self.seq))

    def batch(self, out: list[np.ndarray], at: np.ndarray, names: list[tuple], width: np.ndarray, copy: np.ndarray, seq: np.ndarray) -> pa.RecordBatch:
        text = [pa.array([n[i] for n in names], pa.string()).take(pa.array(at)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), self.part, np.int32)), pa.array(seq.astype(np.int32)), *text, _packed(out[1], NO_POS, pa.int64()), _packed(out[2], NO_COUNT, pa.int32()), _packed(out[3], NO_COUNT, pa.int32()),
             pa.array(out[4]), pa.array(out[5].astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(copy)],
            [f.split()[0] for f in RECORD.split(", ")],
        )


def _merged(batches: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    state = _Merge(part_id(), file_bytes)
    for b in batches:
        if b.num_rows:
            yield from state.add(b)
    yield from state.leave(None)


def merged_records(files: DataFrame, ranges: int | None = None, file_bytes: int = FILE_BYTES, copies_only: bool = False) -> DataFrame:
    """Every record of the small files in merge order, with its output file (part, out_seq) and whether it is a copy.

    Two records are of a kind if cell, chrom, pos, mc and cov are equal, nulls counting as equal; the first by (file_id, rec_no) stays, every other
    one is a copy. ``copies_only``: the other records stay in the tasks.
    """
    runs = runs_of(files)
    cuts = cut_points(runs, ranges or partitions_of(files.sparkSession))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _merged(batches, file_bytes):
            yield b.filter(b.column(10)) if copies_only else b

    return _slices(runs, cuts).mapInArrow(merge, RECORD)


def copies(records: DataFrame) -> DataFrame:
    """file_id, rec_no of every record but the first of its kind."""
    return records.where("is_copy").select("file_id", "rec_no")


def kept(records: DataFrame) -> DataFrame:
    """Each record once, with its output file."""
    return records.where("not is_copy")


def manifest(records: DataFrame) -> DataFrame:
    """The range metadata: per output file the first and last key, records and bytes before compression."""
    key = F.struct("cell", "chrom", "pos")
    return (
        kept(records)
        .groupBy(F.concat_ws("-", F.lpad(F.col("part").cast("string"), 6, "0"), F.lpad(F.col("out_seq").cast("string"), 4, "0")).alias("out_file"))
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
        .select("out_file", *[F.col(f"{a}.{c}").alias(f"{a}_{c}") for a in ("low", "high") for c in ("cell", "chrom", "pos")], "n_records", "n_bytes")
    )


def ranges_for(files: DataFrame, target_bytes: int = FILE_BYTES) -> int:
    """As many ranges as the records need at ``target_bytes`` a file, at least one."""
    size = runs_of(files).agg(F.sum(F.col("n") * (FIXED_RECORD_BYTES + F.coalesce(F.length("cell"), F.lit(0)) + F.coalesce(F.length("chrom"), F.lit(0))))).first()[0] or 0
    return min(max(1, -(-size // target_bytes)), MAX_RANGES)


DESCRIBED = "out_file string, low_cell string, low_chrom string, low_pos bigint, high_cell string, high_chrom string, high_pos bigint, n_records bigint, n_bytes bigint"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def compact(files: DataFrame, path: str, target_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the consolidated table to ``path`` and return its manifest, which is also written to ``path``/_manifest.

    The merging tasks write their own Parquet files, through pyarrow's file systems, and describe them as they close them: nothing is read again. Files
    carry the attempt that wrote them; what the manifest doesn't name (attempts that failed) is removed at the end. What was at ``path`` is replaced.
    As many ranges as the records need at ``target_bytes`` a file, at least one; nothing is lost or held twice.
    """
    runs = runs_of(files)
    cuts = cut_points(runs, ranges_for(files, target_bytes))
    system, root = _file_system(path)
    system.create_dir(root, recursive=True)
    system.delete_dir_contents(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _file_system(path)
        attempt = TaskContext.get().taskAttemptId()
        out, name, told = None, None, {}

        def key(b: pa.RecordBatch, i: int) -> list:
            return [b.column(c)[i].as_py() for c in (2, 3, 4)]

        for b in _merged(batches, target_bytes):
            b = b.filter(pc.invert(b.column(10)))
            seq = b.column(1).to_numpy()
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]) if len(seq) else []
            for i, j in zip(heads, np.r_[heads[1:], len(seq)] if len(seq) else []):
                piece, file = b.slice(i, j - i), f"{part_id():06d}-{seq[i]:04d}-{attempt}.parquet"
                if file != name:
                    if out:
                        out.close()
                    name, rows = file, piece.select(KEY)
                    out = pq.ParquetWriter(posixpath.join(root, file), rows.schema, filesystem=system)
                    told[file] = [*key(piece, 0), *key(piece, 0), 0, 0]
                out.write_batch(piece.select(KEY))
                told[file][3:] = [*key(piece, piece.num_rows - 1), told[file][6] + piece.num_rows, told[file][7] + pc.sum(piece.column(9)).as_py()]
        if out:
            out.close()
        if told:
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(f, *v) for f, v in told.items()]), kinds)], [f.split()[0] for f in DESCRIBED.split(", ")])

    found = checkpointed(_slices(runs, cuts).mapInArrow(write, DESCRIBED))
    from pyarrow import fs

    named = {r.out_file for r in found.select("out_file").toLocalIterator()}  # output files, which are few
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name.endswith(".parquet") and f.base_name not in named:
            system.delete_file(f.path)
    found.write.mode("overwrite").parquet(posixpath.join(path, "_manifest"))
    return found
