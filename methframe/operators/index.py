"""Context and region indexes of the reference axis, and what is read through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methframe.functions.numbers import clamp, context_is
from methframe.operators.region import sites_in_regions


def context_index(ref: DataFrame, pattern: str | Callable[[Column, Column], Column]) -> DataFrame:
    """chrom, site_id of the sites that match a context pattern, or a condition on context and strand."""
    match = pattern if callable(pattern) else lambda context, strand: context_is(context, strand, pattern)
    return ref.where(match(F.col("context"), F.col("strand"))).select("chrom", "site_id")


def region_index(ref: DataFrame, regions: DataFrame) -> DataFrame:
    """name, chrom, id_start, id_end: the first and last site of each half-open region [start_pos, end_pos); regions without sites have no row."""
    closed = regions.select("chrom", "name", F.col("start_pos").alias("low"), (F.col("end_pos") - 1).alias("high"))
    return sites_in_regions(ref, closed).groupBy("name", "chrom").agg(F.min("site_id").alias("id_start"), F.max("site_id").alias("id_end"))


def subset(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Sites (with site_id) that a context index names."""
    return sites.join(index, ["chrom", "site_id"], "left_semi")


def subset_ranges(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Sites (with site_id) within the ID ranges of a region index, with the region's name; one row per pair."""
    by_id = sites.withColumnRenamed("pos", "_pos").withColumnRenamed("site_id", "pos")
    found = sites_in_regions(by_id, index.select("chrom", "name", F.col("id_start").alias("low"), F.col("id_end").alias("high"))).drop("low", "high")
    return found.withColumnRenamed("pos", "site_id").withColumnRenamed("_pos", "pos")


def region_sums(sites: DataFrame, regions: DataFrame, code: str = "I") -> DataFrame:
    """name, mc, cov summed over each half-open region, saturated at ``code``; regions without sites have zeros. Null counts add nothing."""
    closed = regions.select("chrom", "name", F.col("start_pos").alias("low"), (F.col("end_pos") - 1).alias("high"))
    total = sites_in_regions(sites, closed).groupBy("name").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    out = regions.select("name").distinct().join(total, "name", "left").fillna(0, ["mc", "cov"])
    return out.select("name", *[clamp(F.col(c), code).cast("bigint").alias(c) for c in ("mc", "cov")])
