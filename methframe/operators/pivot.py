"""Wide and long matrices of one column per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methframe.functions.numbers import fraction
from methframe.functions.stats import fisher_two_sided, odds_ratio


def pivot_fraction(sites: DataFrame, by: str, names: list[str]) -> DataFrame:
    """One row per site, one column of fractions per name; 0 where a cell doesn't cover the site. The names are given, so no job lists them."""
    total = sites.groupBy("chrom", "pos").pivot(by, names).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return total.select("chrom", "pos", *[F.round(F.coalesce(fraction(F.col(f"`{n}_mc`"), F.col(f"`{n}_cov`")), F.lit(0.0)), 6).alias(n) for n in names])


def one_vs_rest(sites: DataFrame, by: str) -> DataFrame:
    """The table of each sample against all others at each site: a, b, c, d. Totals less the own counts: no sample is joined with another."""
    total = sites.groupBy("chrom", "pos", by).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    site = Window.partitionBy("chrom", "pos")
    return total.select("chrom", "pos", by, F.col("mc").alias("a"), (F.col("cov") - F.col("mc")).alias("b"), (F.sum("mc").over(site) - F.col("mc")).alias("c"), (F.sum(F.col("cov") - F.col("mc")).over(site) - F.col("cov") + F.col("mc")).alias("d"))


def pivot_fisher(sites: DataFrame, by: str) -> DataFrame:
    """odds_ratio and two-sided p of each sample against the rest at each site, in long form; ``wide`` turns it."""
    table = [F.col(c) for c in "abcd"]
    return one_vs_rest(sites, by).select("chrom", "pos", by, odds_ratio(*table).alias("odds_ratio"), fisher_two_sided(*table).alias("pval"))


def wide(long: DataFrame, by: str, names: list[str], values: list[str]) -> DataFrame:
    """One row per site with ``<name>_<value>`` columns."""
    return long.groupBy("chrom", "pos").pivot(by, names).agg(*[F.first(v).alias(v) for v in values])
