"""Aligned reads: BAM files in, counts per cytosine out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.session import ship
from methframe.sources.text import cytosines

#: Fixed values of the format: operations, the letters of packed sequences, and the flags of reads that don't count
#: (unmapped, secondary, failed quality control, duplicate).
CIGAR, LETTERS, DROPPED = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", 4 | 256 | 512 | 1024
PAIRED, PROPER, REVERSE = 1, 2, 16
MIN_MAPQ, MIN_BASE_QUALITY = 10, 20

READ = "file string, name string, flag int, chrom string, start int, mapq int, ref_pos array<int>, bases string, quality array<int>, converted boolean"


def inflate(data: bytes) -> bytes:
    """All blocks of a BGZF file, each read by the size in its header; plain gzip members, which have none, are inflated one after the other."""
    view, out, at = memoryview(data), [], 0
    while at < len(data):
        size = _block_size(view, at)
        if at + size > len(data):
            raise ValueError("truncated BGZF block")
        z = zlib.decompressobj(31)
        out.append(z.decompress(view[at : at + size] if size else view[at:]) + z.flush())
        if not z.eof:
            raise ValueError("truncated BGZF block")
        at = at + size if size else len(data) - len(z.unused_data)
    return b"".join(out)


def _block_size(data: memoryview, at: int) -> int:
    """Bytes of the block at ``at``, from the subfield BC of its header; 0 without one."""
    if len(data) < at + 18 or not data[at + 3] & 4:
        return 0
    p, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while p + 4 <= end:
        length = struct.unpack_from("<H", data, p + 2)[0]
        if bytes(data[p : p + 2]) == b"BC" and length == 2:
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + length
    return 0


#: Bytes of each fixed-size tag type.
_TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def conversion(data: bytes, at: int, end: int) -> bool | None:
    """Whether a read is of the C-to-T conversion, by its tag YZ (+) or else XG (CT); None without either."""
    found: dict[bytes, str] = {}
    while at + 3 <= end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            found[tag] = data[at:stop].decode("ascii", "replace")
            at = stop + 1
        elif kind == "B":
            at += 5 + _TAG_BYTES[chr(data[at])] * struct.unpack_from("<I", data, at + 1)[0]
        else:
            if kind == "A":
                found[tag] = chr(data[at])
            at += _TAG_BYTES[kind]
    return found[b"YZ"] == "+" if b"YZ" in found else found[b"XG"] == "CT" if b"XG" in found else None


def records(data: bytes) -> Iterator[tuple]:
    """name, flag, chrom, start (0-based), mapq, and the aligned bases with their reference positions (1-based) and qualities."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    at = 8 + n
    (n_ref,) = struct.unpack_from("<i", data, at)
    at, names = at + 4, []
    for _ in range(n_ref):
        (k,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        ref, start, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", data, at + 4)
        p = at + 36
        name, p = data[p : p + n_name - 1].decode(), p + n_name
        ops, p = struct.unpack_from(f"<{n_cigar}I", data, p), p + 4 * n_cigar
        packed, p = np.frombuffer(data, np.uint8, (n_seq + 1) // 2, p), p + (n_seq + 1) // 2
        quality = np.frombuffer(data, np.uint8, n_seq, p)
        codes = np.stack([packed >> 4, packed & 15], 1).ravel()[:n_seq]
        here, read, where, which = start + 1, 0, [], []
        for op in ops:
            k, kind = op >> 4, CIGAR[op & 15]
            if kind in "M=X":
                where += range(here, here + k)
                which += range(read, read + k)
            here += k if kind in "MDN=X" else 0
            read += k if kind in "MIS=X" else 0
        yield name, flag, names[ref] if ref >= 0 else None, start, mapq, where, "".join(LETTERS[c] for c in codes[which]), quality[which].tolist(), conversion(data, p + n_seq, at + 4 + size)
        at += 4 + size


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """One row per aligned read. Files go through Spark's own file systems, one task a file: meant for per-cell files, which are small."""

    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.bool_()]
        schema = pa.schema(list(zip([f.split()[0] for f in READ.split(", ")], kinds)))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for r in records(inflate(content.as_py())):
                    rows.append((file, *r))
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, READ)


def count_sites(reads: DataFrame, genome: DataFrame, min_mapq: int = MIN_MAPQ, min_quality: int = MIN_BASE_QUALITY, by: list[str] | None = None, by_conversion: bool = False) -> DataFrame:
    """chrom, pos, strand, context, mc, cov (and ``by``, such as file): at a C, forward reads with C are methylated and with T converted; at a
    G, backward reads with G and A. A base that both mates of a pair cover counts once, with the better quality.
    ``by_conversion``: a read's direction is that of its conversion tag, as for libraries whose mates point both ways; reads without the tag keep theirs."""
    by = by or []
    flag = lambda bits: F.col("flag").bitwiseAND(F.lit(bits))
    good = reads.where((flag(DROPPED) == 0) & (F.col("mapq") >= min_mapq) & ((flag(PAIRED) == 0) | (flag(PROPER) != 0)))
    own = F.when(flag(REVERSE) != 0, "-").otherwise("+")
    strand = F.when(F.col("converted"), "+").when(~F.col("converted"), "-").otherwise(own) if by_conversion else own
    each = good.withColumn("b", F.explode(F.arrays_zip("ref_pos", F.split("bases", "").alias("base"), "quality")))
    each = each.select(*by, "name", "chrom", F.col("b.ref_pos").cast("bigint").alias("pos"), strand.alias("strand"), F.col("b.base").alias("base"), F.col("b.quality").alias("quality"))
    each = each.where(F.col("quality") >= min_quality)
    plus = F.col("strand") == "+"
    each = each.where((plus & F.col("base").isin("C", "T")) | (~plus & F.col("base").isin("G", "A")))
    once = each.groupBy(*by, "name", "chrom", "pos", "strand").agg(F.max(F.struct("quality", "base")).alias("m")).withColumn("base", F.col("m.base"))
    total = once.groupBy(*by, "chrom", "pos", "strand").agg(F.sum(F.when(F.col("base").isin("C", "G"), 1).otherwise(0)).alias("mc"), F.count(F.lit(1)).alias("cov"))
    return total.join(cytosines(genome), ["chrom", "pos", "strand"])
