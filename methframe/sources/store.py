"""Site tables as Parquet: partitioned by chromosome, sorted by position, so that lookups prune folders and row groups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.functions.numbers import TYPES, clamp, dequantize, quantization

MESSAGE = "message"


def typed(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Columns cast to storage codes, integers saturated; strings lose trailing NULs."""
    out = []
    for name, code in formats.items():
        c = F.col(name)
        if code.endswith(("s", "c")):
            c = F.regexp_replace(c.cast("string"), "\x00+$", "")
        elif code not in "fd":
            c = clamp(c, code)
        out.append(c.cast(TYPES.get(code, "string")).alias(name))
    return df.withColumns({c: x for c, x in zip(formats, out)})


def write(df: DataFrame, path: str, dims: tuple[str, ...] = ("chrom",), sort: tuple[str, ...] = ("cell_id", "pos"), message: str = "", mode: str = "overwrite", files_per_dim: int = 0) -> None:
    """``mode`` append adds rows to keys that exist. Rows go to range partitions on the keys and the sort order, so a chromosome with
    most rows is written by many tasks."""
    order = [*dims, *[c for c in sort if c in df.columns]]
    n = files_per_dim or None
    ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    first = dims[0]
    ranged.sortWithinPartitions(*order).withMetadata(first, {MESSAGE: message}).write.mode(mode).partitionBy(*dims).parquet(path)
    spark = df.sparkSession
    head = spark.createDataFrame([(json.dumps({"dims": list(dims), "sort": list(sort), "columns": df.columns, "message": message}),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/_header")  # names with an underscore are not data


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def header(spark: SparkSession, path: str) -> dict:
    """The declared dims, sort order, columns and message."""
    return json.loads(spark.read.text(f"{path}/_header").first()[0])


def chunks(df: DataFrame, dims: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """One row per key: rows, first and last position."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def files(df: DataFrame) -> DataFrame:
    """One row per stored file: its rows, size and positions."""
    return df.select("pos", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes")).groupBy("file", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def ordered(df: DataFrame, chroms: list[str]) -> DataFrame:
    """Rows of the listed chromosomes in the list's order, then by position."""
    place = F.array_position(F.array(*[F.lit(c) for c in chroms]), F.col("chrom"))
    return df.where(F.col("chrom").isin(chroms)).orderBy(place, "pos")


def read_dequantized(spark: SparkSession, path: str) -> DataFrame:
    """The table with the columns that its message names as quantised back in their own scale."""
    df = read(spark, path)
    for c, (code, low, high) in quantization(header(spark, path).get("message")).items():
        df = df.withColumn(c, dequantize(F.col(c), 8 if code == "B" else 16, low, high))
    return df
