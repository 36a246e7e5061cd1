"""Sums over cells, strands, bins and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methframe.functions.numbers import clamp, fraction

COUNTS = ("mc", "cov")


def _sums(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[clamp(F.sum(c), code).cast("bigint").alias(c) for c in COUNTS])


def pseudobulk(sites: DataFrame, by: list[str] | None = None, code: str = "I") -> DataFrame:
    """mc and cov summed over all cells per site, and per the columns ``by`` (class, type) in one job; saturated at ``code``."""
    return _sums(sites, [*(by or []), "chrom", "pos"], code)


def pseudobulk_mean(sites: DataFrame) -> DataFrame:
    """Sums per site over the number of cells that have the site's chromosome at all, whether they cover the site or not."""
    cells = sites.select("cell_id", "chrom").distinct().groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    total = sites.groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return total.join(cells, "chrom").select("chrom", "pos", *[(F.col(c) / F.col("n")).alias(c) for c in COUNTS])


def pseudobulk_as(sites: DataFrame, how: dict[str, list[str]], by: list[str] | None = None) -> DataFrame:
    """Several aggregates per column, such as {"mc": ["sum", "mean"], "cov": ["sum"]}, per site and per the columns ``by``: <column>_<aggregate>.

    A mean divides by the cells, of the class, that have the site's chromosome at all. Null is a class.
    """
    by = by or []
    total = sites.groupBy(*by, "chrom", "pos").agg(*[F.sum(c).alias(c) for c in how])
    cells = sites.select(*by, "cell_id", "chrom").distinct().groupBy(*by, "chrom").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumnsRenamed({c: f"_{c}" for c in [*by, "chrom"]})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "chrom"]]
    value = {"sum": lambda c: F.col(c), "mean": lambda c: F.col(c) / F.col("_n")}
    return total.join(cells, same).select(*by, "chrom", "pos", *[value[a](c).alias(f"{c}_{a}") for c, asked in how.items() for a in asked])


def merge_strands(sites: DataFrame, code: str = "I") -> DataFrame:
    """CG sites with the counts of both strands at the forward position; unpaired sites stay. ``sites`` has strand and context."""
    cg = sites.where(F.upper(F.substring("context", 1, 2)) == "CG")
    forward = F.col("pos") - F.when(F.col("strand") == "-", 1).otherwise(0)
    return _sums(cg.withColumn("pos", forward), ["chrom", "pos"], code)


def bin_sums(sites: DataFrame, size: int) -> DataFrame:
    """Counts per cell and bin of ``size``; bin_start is the bin's first position. Only bins with a site come out."""
    start = F.expr(f"(pos - 1) div {size} * {size} + 1")
    return sites.groupBy("cell_id", "chrom", start.alias("bin_start")).agg(*[F.sum(c).alias(c) for c in COUNTS])


def context_summary(sites: DataFrame) -> DataFrame:
    """Counts, sites and rate per context."""
    total = sites.groupBy("context").agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(c).alias(c) for c in COUNTS])
    return total.withColumn("mc_rate", F.round(fraction(F.col("mc"), F.col("cov")), 6))


def global_rates(sites: DataFrame) -> DataFrame:
    """Each cell's overall rate; 0 where it covers nothing."""
    total = sites.groupBy("cell_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return total.select("cell_id", F.round(fraction(F.col("mc"), F.col("cov")), 6).alias("rate"))
