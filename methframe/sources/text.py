"""Readers of the text formats, and text sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methframe.operators.ranged import part_id, ranged
from methframe.session import checkpointed, ship
from methframe.sources.lines import parse_lines

ALLC = "chrom string, pos bigint, strand string, context string, mc bigint, cov bigint, flag int"


def read_allc(spark: SparkSession, path: str) -> DataFrame:
    """ALLC text, plain or gzip, one or many files: the records with the sample (the file's name without suffixes)."""
    df = spark.read.csv(path, sep="\t", schema=ALLC, comment="#")
    return df.withColumn("sample", sample_of(F.col("_metadata.file_path")))


def read_allc_checked(spark: SparkSession, path: str) -> DataFrame:
    """The same, with damaged lines kept apart (column reason) rather than read as nulls."""
    lines = spark.read.text(path, wholetext=False).withColumn("line_id", F.monotonically_increasing_id())
    return parse_lines(lines, "line_id", "value")


def sample_of(path: Column) -> Column:
    """The name of a file without folder, compression and format suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(allc|tsv|txt|bed|cz|parquet|gz|bgz|bz2)(\.(tsv|txt|gz|bgz|bz2))*$", "")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos, name of BED text; header lines and comments are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value rlike '^[^#\\t]+\\t[0-9]+\\t[0-9]+'")
    return rows.select(f[0].alias("chrom"), f[1].cast("bigint").alias("start_pos"), f[2].cast("bigint").alias("end_pos"), F.get(f, F.lit(3)).alias("name"))


def read_gtf_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ord"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, chrom_length of a sizes or .fai file."""
    return spark.read.csv(path, sep="\t").select(F.col("_c0").alias("chrom"), F.col("_c1").cast("bigint").alias("chrom_length"))


#: Bases of a piece of a sequence.
PIECE = 1 << 20


def read_fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """chrom, start (0-based), before, seq, after of FASTA text: pieces of the sequences, each with the two bases on either side of it.

    Lines are read in any number of splits and put in order by file and place; each partition joins its lines to pieces, and what a partition doesn't
    know (the sequence it begins in, how far into it, the bases beyond its ends) comes from the one row that each partition says of itself. A header takes the first word. Lines
    before any header belong to no sequence.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    lines = ranged(lines, ["file", "block"], "line")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, count, file, held, size = part_id(), [], 0, None, [], 0

        def add(name: str | None, seq: str) -> None:
            nonlocal count
            rows.append((file, part, count, name, seq))
            count += 1

        def cut(least: int) -> None:
            nonlocal held, size
            text = "".join(held)
            while len(text) >= least:
                add(None, text[:piece])
                text = text[piece:]
            held, size = [text] if text else [], len(text)

        for b in batches:
            for f, value in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if f != file or value.startswith(">"):
                    cut(1)
                    file = f
                if value.startswith(">"):
                    add((value[1:].split() or [""])[0], "")
                else:
                    held.append("".join(value.split()))
                    size += len(held[-1])
                    if size >= piece:
                        cut(piece)
            if rows:
                yield _fasta_rows(rows)
                rows.clear()
        cut(1)
        if rows:
            yield _fasta_rows(rows)

    return _placed(checkpointed(lines.mapInArrow(join, FASTA)))


#: ``name`` is that of a header, which has no bases; the pieces have none yet.
FASTA = "file string, part int, no int, name string, seq string"


def _fasta_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in FASTA.split(", ")])


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces with the sequence's name and place, and their neighbours' bases: windows over rows of a few bytes, one a piece."""
    brief = pieces.select("file", "part", "no", "name", F.length("seq").alias("n"), F.substring("seq", 1, 2).alias("head"), F.expr("right(seq, 2)").alias("tail"))
    order = Window.partitionBy("file").orderBy("part", "no")
    brief = brief.withColumn("run", F.sum(F.col("name").isNotNull().cast("int")).over(order))
    run = Window.partitionBy("file", "run").orderBy("part", "no")
    near = lambda c, a, b: F.array_join(F.collect_list(c).over(run.rowsBetween(a, b)), "")
    told = brief.select(
        F.col("part").alias("_p"), F.col("no").alias("_n"), "n", F.first("name", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("chrom"),
        F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start"), near("tail", -2, -1).alias("before"), near("head", 1, 2).alias("after"),
    )
    told = told.where("chrom is not null and n > 0").select("_p", "_n", "chrom", "start", F.expr("right(before, 2)").alias("before"), F.substring("after", 1, 2).alias("after"))
    return pieces.join(told, (F.col("part") == F.col("_p")) & (F.col("no") == F.col("_n"))).select("chrom", "start", "before", "seq", "after")


#: Letters of a sequence and their complements; fixed values.
_LETTERS, _COMPLEMENT = "ACGTN", "TGCAN"
#: Sites in a batch of output.
_SITES = 1 << 16


def cytosines(sequences: DataFrame) -> DataFrame:
    """chrom, pos (1-based), strand, context of every C (+) and G (-, reverse complement) of chrom, seq, and, for pieces of a sequence, start, before and after.

    A context runs three bases on and is padded with N at the ends; letters other than ACGT and N stay as they are. Case doesn't
    matter. Null and empty sequences have no sites. One pass over an array of the characters: expressions on strings would walk
    to each position from the start.
    """
    ship(sequences.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = {ord(a): ord(b) for a, b in zip(_LETTERS, _COMPLEMENT)}
        for b in batches:
            for i in range(b.num_rows):
                chrom, start, seq = b.column(0)[i].as_py(), b.column(2)[i].as_py() or 0, (b.column(1)[i].as_py() or "").upper()
                before, after = ((b.column(k)[i].as_py() or "").upper() for k in (3, 4))
                s = np.frombuffer((before.rjust(2, "N") + seq + after.ljust(2, "N")).encode("utf-32-le"), np.uint32)
                at = np.flatnonzero((s[2:-2] == ord("C")) | (s[2:-2] == ord("G"))) + 2
                for j in range(0, len(at), _SITES):
                    c = at[j : j + _SITES]
                    plus = s[c] == ord("C")
                    three = np.where(plus[:, None], np.stack([s[c], s[c + 1], s[c + 2]], 1), np.stack([s[c], s[c - 1], s[c - 2]], 1))
                    back = three.copy()
                    for a, z in swap.items():
                        back[three == a] = z
                    three = np.where(plus[:, None], three, back).astype(np.uint32)
                    text = three.tobytes().decode("utf-32-le", "replace")
                    context = [text[k : k + 3] for k in range(0, len(text), 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(c), b.column(0).type), pa.array(c - 1 + start, pa.int64()), pa.array(np.where(plus, "+", "-")), pa.array(context)], ["chrom", "pos", "strand", "context"])

    whole = {"start": F.lit(0).cast("bigint"), "before": F.lit(""), "after": F.lit("")}
    given = [F.col(c) if c in sequences.columns else x.alias(c) for c, x in whole.items()]
    return sequences.select(F.col("chrom").cast("string"), "seq", *given).mapInArrow(scan, "chrom string, pos bigint, strand string, context string")


def strip_indels(bases: str) -> str:
    """Pileup bases without insertions and deletions (+n…, -n…) and read starts (^ with its quality)."""
    out, i = [], 0
    while i < len(bases):
        c = bases[i]
        if c == "^":
            i += 2
        elif c in "+-":
            j = i + 1
            while j < len(bases) and bases[j].isdigit():
                j += 1
            i = j + int(bases[i + 1 : j] or 0)
        else:
            out.append(c)
            i += 1
    return "".join(out)


def pileup_counts(lines: DataFrame) -> DataFrame:
    """chrom, pos, strand, mc, cov of pileup lines (chrom, pos, ref, depth, bases): at a C forward matches are methylated and T converted, at
    a G backward matches and a. Sites that nothing covers are left out; null bases cover nothing."""

    @F.pandas_udf("string")
    def clean(bases: pd.Series) -> pd.Series:
        return bases.map(lambda b: strip_indels(b) if isinstance(b, str) else "")

    rows = lines.where("upper(ref) in ('C', 'G')").withColumn("b", clean("bases"))
    count = lambda letters: F.length("b") - F.length(F.translate("b", letters, ""))
    plus = F.upper(F.col("ref")) == "C"
    mc, miss = F.when(plus, count(".")).otherwise(count(",")), F.when(plus, count("T")).otherwise(count("a"))
    out = rows.select("chrom", "pos", F.when(plus, "+").otherwise("-").alias("strand"), mc.cast("bigint").alias("mc"), (mc + miss).cast("bigint").alias("cov"))
    return out.where("cov > 0")


def allc_rows(sites: DataFrame, ref: DataFrame) -> DataFrame:
    """Sites in ALLC layout: reference columns, counts, and flag 1; uncovered sites are left out."""
    return sites.where("cov > 0").join(ref.select("chrom", "pos", "strand", "context"), ["chrom", "pos"]).select("chrom", "pos", "strand", "context", "mc", "cov", F.lit(1).alias("flag"))


def write_tsv(df: DataFrame, path: str, order: list[str], compression: str = "gzip") -> None:
    """Text in files that follow each other in the global order of ``order``."""
    df.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", compression=compression)


def bedgraph(sites: DataFrame, signal: str, min_cov: int = 1) -> DataFrame:
    """chrom, start_pos, end_pos, value for signal unmeth, meth or frac_unmeth; only values above 0."""
    value = {"unmeth": F.col("cov") - F.col("mc"), "meth": F.col("mc"), "frac_unmeth": (F.col("cov") - F.col("mc")) / F.col("cov")}[signal]
    rows = sites.where((F.col("cov") >= min_cov) & (F.col("cov") > 0))
    return rows.select("chrom", (F.col("pos") - 1).alias("start_pos"), F.col("pos").alias("end_pos"), value.cast("double").alias("value")).where("value > 0")


def array_to_sites(long: DataFrame, manifest: DataFrame, value: str = "beta") -> DataFrame:
    """Array values (sample_id, probe_id, value) at their probes' sites; probes off the manifest are dropped, missing values stay missing."""
    return long.join(manifest.select("probe_id", "chrom", "pos", "strand"), "probe_id").select("sample_id", "chrom", "pos", "strand", "probe_id", value)


def rows_in_batches(df: DataFrame) -> Iterator:
    """Rows one by one on the driver, a partition at a time, with the next one fetched meanwhile."""
    return df.toLocalIterator(prefetchPartitions=True)
