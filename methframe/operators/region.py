"""Range lookups on sites and joins of sites with regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methframe.operators.ranged import numbered

#: Regions up to this many rows, after binning, are broadcast (three numbers and two short strings each: under 64 MB).
MAX_BROADCAST_ROWS = 500_000


def region(df: DataFrame, chrom: str, start: int, end: int, **dims: str) -> DataFrame:
    """Sites of one chromosome with start <= pos <= end, and of the given values of other key columns; reaches the Parquet scan as filters."""
    for name, value in dims.items():
        df = df.where(F.col(name) == value)
    return df.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def contained(df: DataFrame, chrom: str, start: int, end: int, cols: tuple[str, str]) -> DataFrame:
    """Intervals that lie within [start, end]."""
    return df.where((F.col("chrom") == chrom) & (F.col(cols[0]) >= start) & (F.col(cols[1]) <= end))


def binned(regions: DataFrame, low: str = "low", high: str = "high") -> tuple[DataFrame, int, int]:
    """``regions`` (closed [low, high]) once for each bin they meet, the width of a bin, and a bound on the rows.

    A bin is twice the mean length, so all regions together meet at most 1.5 bins each and one more: the bound holds for any lengths.
    """
    clean = regions.where(f"chrom is not null and {low} <= {high}")
    n, mean = clean.agg(F.count(F.lit(1)), F.avg(F.col(high) - F.col(low) + 1)).first()
    width = max(1, int(2 * (mean or 1)))
    return clean.withColumn("_bin", F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"{high} div {width}")))), width, 2 * n


def sites_in_regions(sites: DataFrame, regions: DataFrame, low: str = "low", high: str = "high", how: str = "inner") -> DataFrame:
    """Pairs of a site and a region (closed [low, high]) of its chromosome that holds it; a site in k regions comes k times.

    An equi-join on (chrom, bin) with the range as a residue: a site lies in one bin, so no pair repeats, and a chromosome with
    a third of the sites is spread over its bins. Regions are broadcast only if there are few. ``how`` may be
    ``left_semi`` or ``left_anti`` to filter sites. Sites and regions with null keys match nothing.
    """
    spread, width, bound = binned(regions, low, high)
    spread = spread.withColumnRenamed("chrom", "_chrom")
    spread = F.broadcast(spread) if bound <= MAX_BROADCAST_ROWS else spread
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_site_bin") == F.col("_bin")) & F.col("pos").between(F.col(low), F.col(high))
    return sites.withColumn("_site_bin", F.expr(f"pos div {width}")).join(spread, on, how).drop("_chrom", "_bin", "_site_bin")


def regions_query(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Sites of many regions (region_idx, chrom, low, high) as a bag: overlapping regions repeat sites."""
    return sites_in_regions(sites, regions).drop("low", "high")


def region_lists(sites: DataFrame, regions: DataFrame, values: list[str]) -> DataFrame:
    """For each region the list of its sites' values in order of position; regions without sites have an empty list."""
    found = sites_in_regions(sites, regions).groupBy("region_idx").agg(F.array_sort(F.collect_list(F.struct("pos", *values))).alias("records"))
    return regions.select("region_idx").join(found, "region_idx", "left").withColumn("records", F.coalesce("records", F.expr("array()")))


def overlaps_any(intervals: DataFrame, others: DataFrame, cols: tuple[str, str] = ("start_pos", "end_pos"), touching: bool = False, negate: bool = False) -> DataFrame:
    """Half-open ``intervals`` that overlap (``negate``: don't overlap) any of ``others``; ``touching`` counts common ends as overlap.

    Both sides are binned and joined on (chrom, bin); an interval is named by its number, so it comes out once.
    """
    start, end = cols
    other, width, bound = binned(others.select("chrom", F.col(start).alias("low"), F.col(end).alias("high")).distinct())
    spread = intervals.withColumn("_bin", F.explode(F.when(F.col("chrom").isNotNull() & (F.col(start) <= F.col(end)), F.sequence(F.expr(f"{start} div {width}"), F.expr(f"{end} div {width}"))).otherwise(F.array(F.lit(None).cast("bigint")))))
    other = other.select(F.col("chrom").alias("_chrom"), F.col("_bin").alias("_other"), "low", "high")
    other = F.broadcast(other) if bound <= MAX_BROADCAST_ROWS else other
    meets = ((F.col(start) <= F.col("high")) & (F.col("low") <= F.col(end))) if touching else ((F.col(start) < F.col("high")) & (F.col("low") < F.col(end)))
    hit = spread.join(other, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_other")) & meets, "left_semi").drop("_bin").distinct()
    on = [intervals[c].eqNullSafe(hit[c]) for c in intervals.columns]
    keep = on[0]
    for x in on[1:]:
        keep &= x
    return intervals.join(hit, keep, "left_anti" if negate else "left_semi")


def with_site_id(ref: DataFrame) -> DataFrame:
    """``ref`` with site_id: the number of a site on its chromosome, from 1, by position; ranked in range partitions."""
    return numbered(ref, ["chrom"], ["pos"], "site_id").withColumn("site_id", F.col("site_id") + 1)
