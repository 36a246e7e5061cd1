"""Alignment of samples to the reference axis, and unions and comparisons of site tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["chrom", "pos"]


def with_reference(sites: DataFrame, ref: DataFrame) -> DataFrame:
    """Each site that the axis has, with its reference columns; others drop out."""
    return sites.join(ref, KEYS)


def align(ref: DataFrame, sites: DataFrame, fill: int = 0) -> DataFrame:
    """Every site of the axis with the sample's counts, or ``fill`` where the sample has none; sites off the axis are dropped."""
    return ref.join(sites.select(*KEYS, "mc", "cov"), KEYS, "left").fillna(fill, ["mc", "cov"])


def align_cells(ref: DataFrame, sites: DataFrame, by: str = "cell_id", fill: int = 0) -> DataFrame:
    """``align`` for every value of ``by`` (null is none): all sites of the axis, with each cell's counts or ``fill``. The names, one per cell, travel with the axis."""
    names = sites.where(F.col(by).isNotNull()).agg(F.collect_set(by)).scalar()
    return ref.withColumn(by, F.explode(names)).join(sites.select(by, *KEYS, "mc", "cov"), [by, *KEYS], "left").fillna(fill, ["mc", "cov"])


def union_tables(tables: dict[str, DataFrame], key_added: str = "cell_id", key_of: Callable[[str], str] | None = None) -> DataFrame:
    """All rows of all tables, each with the name of its table, or what ``key_of`` makes of it, in ``key_added``; columns go by name, and must be the same."""
    return reduce(DataFrame.unionByName, [df.withColumn(key_added, F.lit(key_of(name) if key_of else name)) for name, df in tables.items()])


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """chrom, pos, side (``both``, ``left``, ``right``) and verdict (``equal``, ``capped``, ``differ``, ``only``): a full outer join of two site tables.

    ``capped``: equal once both are held to 255. Rows with a null key stand on their own side only.
    """
    a = left.select(*KEYS, F.col("mc").alias("mc_l"), F.col("cov").alias("cov_l"), F.lit(True).alias("in_l"))
    b = right.select(*KEYS, F.col("mc").alias("mc_r"), F.col("cov").alias("cov_r"), F.lit(True).alias("in_r"))
    both = a.join(b, KEYS, "full_outer")
    side = F.when(F.col("in_l") & F.col("in_r"), "both").when(F.col("in_l"), "left").otherwise("right")
    same = lambda f: (f(F.col("mc_l")) == f(F.col("mc_r"))) & (f(F.col("cov_l")) == f(F.col("cov_r")))
    verdict = F.when(F.col("in_l").isNull() | F.col("in_r").isNull(), "only").when(same(lambda x: x), "equal").when(same(lambda x: F.least(x, F.lit(255))), "capped").otherwise("differ")
    return both.select(*KEYS, side.alias("side"), verdict.alias("verdict"))
