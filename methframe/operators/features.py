"""Features, and the cell x feature matrix in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methframe.functions.numbers import fraction
from methframe.functions.stats import binomial_tail
from methframe.operators.intervals import stretches_and_gaps
from methframe.operators.ranged import numbered
from methframe.operators.region import overlaps_any, sites_in_regions

#: Fixed value: keeps the rate of a cell without coverage at 0.
EMPTY = 1e-6


def named(features: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, name: a missing name is chrom:start-end; if any name repeats, every name gets its count from 0, in order of position."""
    base = F.coalesce(F.col("name"), F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))) if "name" in features.columns else F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))
    return unique_names(features.select("chrom", "start_pos", "end_pos", base.alias("name")))


def unique_names(features: DataFrame) -> DataFrame:
    """``features`` with a count from 0 after every name, by position, if any name repeats; a name that holds most rows is no single task."""
    repeated = features.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)) > 1).scalar()
    out = numbered(features, ["name"], ["chrom", "start_pos", "end_pos"], "_n")
    return out.withColumn("name", F.when(repeated, F.concat(F.col("name"), F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("name"))).drop("_n")


def parse_gtf(lines: DataFrame, feature: str = "gene", flank: int = 0, exclude: list[str] | None = None) -> DataFrame:
    """name, chrom, start_pos, end_pos, strand, gene_id, gene_type of GTF lines (columns line, ord): 0-based starts, the longest record
    of each gene name (ties: the first line), then widened by ``flank``, never below 0. Comments, short and null lines are left out."""
    f = F.split("line", "\t")
    rows = lines.where("line is not null and not startswith(line, '#')").where(F.size(f) >= 9)
    attribute = lambda key: F.nullif(F.regexp_extract(f[8], key + ' "([^"]*)"', 1), F.lit(""))
    parsed = rows.select("ord", f[0].alias("chrom"), f[2].alias("feature"), (f[3].cast("bigint") - 1).alias("s"), f[4].cast("bigint").alias("e"), f[6].alias("strand"), attribute("gene_id").alias("gene_id"), F.coalesce(attribute("gene_name"), attribute("gene_id")).alias("name"), F.coalesce(attribute("gene_type"), attribute("gene_biotype")).alias("gene_type"))
    parsed = parsed.where(F.col("feature") == feature)
    if exclude:
        parsed = parsed.where(~F.col("chrom").isin(exclude))
    # the longest, then the first: an aggregate, combined before the shuffle
    rank, rest = F.struct((F.col("s") - F.col("e")).alias("length"), "ord"), F.struct("chrom", "s", "e", "strand", "gene_id", "gene_type")
    first = parsed.groupBy("name").agg(F.min_by(rest, rank).alias("r")).select("name", "r.*")
    return first.select("name", "chrom", F.greatest(F.col("s") - flank, F.lit(0)).alias("start_pos"), (F.col("e") + flank).alias("end_pos"), "strand", "gene_id", "gene_type")


def genome_bins(chroms: DataFrame, size: int, exclude: list[str] | None = None) -> DataFrame:
    """Half-open tiles of ``size`` over chrom, chrom_length; the last one ends with its chromosome. Chromosomes of null or no length have none."""
    rows = chroms.where("chrom_length > 0")
    if exclude:
        rows = rows.where(~F.col("chrom").isin(exclude))
    tiles = rows.select("chrom", "chrom_length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chrom_length") - 1, F.lit(size).cast("bigint"))).alias("start_pos"))
    return tiles.select("chrom", "start_pos", F.least(F.col("start_pos") + size, "chrom_length").alias("end_pos"))


def merge_blacklist(regions: DataFrame) -> DataFrame:
    """Stretches of overlapping or touching regions; regions with null or empty bounds drop out."""
    return stretches_and_gaps(regions, ["chrom"], "start_pos", "end_pos").where("kind = 'merged'").drop("kind")


def mask(features: DataFrame, blacklist: DataFrame, touching: bool = False) -> DataFrame:
    """Features that overlap no blacklisted region."""
    return overlaps_any(features, blacklist, touching=touching, negate=True)


def matrix(sites: DataFrame, features: DataFrame) -> DataFrame:
    """cell_id, name, mc, cov over the sites with start < pos <= end of each feature; pairs without coverage are left out."""
    closed = features.select("chrom", "name", (F.col("start_pos") + 1).alias("low"), F.col("end_pos").alias("high"))
    total = sites_in_regions(sites, closed).groupBy("cell_id", "name").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return total.where("cov > 0")


def tile_matrix(sites: DataFrame, chroms: DataFrame, size: int) -> DataFrame:
    """cell_id, chrom, bin, mc, cov: the same for tiles, without a join on ranges; positions beyond the last tile count in it."""
    last = F.broadcast(chroms.where("chrom_length > 0").select("chrom", F.expr(f"(chrom_length - 1) div {size}").alias("last")))  # one row per chromosome
    rows = sites.join(last, "chrom").withColumn("bin", F.least(F.expr(f"(pos - 1) div {size}"), F.col("last")))
    return rows.groupBy("cell_id", "chrom", "bin").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov")).where("cov > 0")


def score(cells: DataFrame, kind: str, cutoff: float = 0.0) -> DataFrame:
    """cell_id, name, score. kinds: frac, mc, cov, umc, hypo-score, hyper-score.

    The hypo-score is P(X > mc) for X ~ Bin(cov, p) with p the cell's rate over all features, the hyper-score its complement; both are 0 below the
    cutoff and where p isn't strictly between 0 and 1.
    """
    mc, cov = F.col("mc"), F.col("cov")
    plain: dict[str, Column] = {"frac": fraction(mc, cov), "mc": mc.cast("double"), "cov": cov.cast("double"), "umc": F.greatest(cov - mc, F.lit(0)).cast("double")}
    if kind in plain:
        return cells.select("cell_id", "name", plain[kind].alias("score"))
    rate = cells.groupBy("cell_id").agg((F.sum("mc") / (F.sum("cov") + EMPTY)).alias("p"))
    tail = binomial_tail(mc, cov, F.col("p"))
    tail = F.when((F.col("p") > 0) & (F.col("p") < 1), tail if kind == "hypo-score" else 1 - tail).otherwise(0.0)
    return cells.join(rate, "cell_id").select("cell_id", "name", F.round(F.when(tail < cutoff, 0.0).otherwise(tail), 6).alias("score"))


def beta_params(cells: DataFrame) -> DataFrame:
    """alpha, beta and prior of each cell from the mean and population variance of its features' fractions; null where they give none."""
    m, v = F.col("m"), F.col("v")
    moments = cells.withColumn("f", F.col("mc") / F.col("cov")).groupBy("cell_id").agg(F.avg("f").alias("m"), F.var_pop("f").alias("v"))
    alpha = (1 - m) * m * m / v - m
    good = (m > 0) & (m < 1) & (v > 1e-15)
    floor = lambda x: F.when(good, F.greatest(x, F.lit(EMPTY)))
    return moments.select("cell_id", floor(alpha).alias("alpha"), floor(alpha * (1 / m - 1)).alias("beta"), F.when(good, m).alias("prior"))


def posterior(cells: DataFrame) -> DataFrame:
    """(mc + alpha) / (cov + alpha + beta) / prior of each cell and feature."""
    value = (F.col("mc") + F.col("alpha")) / (F.col("cov") + F.col("alpha") + F.col("beta")) / F.col("prior")
    return cells.join(beta_params(cells), "cell_id").select("cell_id", "name", value.alias("posterior"))


def cell_by_feature(sites: DataFrame, features: DataFrame, kind: str = "frac", blacklist: DataFrame | None = None, flank: int = 0, obs: DataFrame | None = None, cutoff: float = 0.0) -> DataFrame:
    """The matrix end to end: features widened by ``flank``, without blacklisted ones, summed per cell, scored, and joined with the cells' columns ``obs`` (by cell_id).

    cell_id, name, mc, cov, score and the columns of obs; cells that obs lacks have nulls there.
    """
    wanted = features.withColumn("start_pos", F.greatest(F.col("start_pos") - flank, F.lit(0))).withColumn("end_pos", F.col("end_pos") + flank)
    if blacklist is not None:
        wanted = mask(wanted, blacklist)
    counts = matrix(sites, wanted)
    out = counts.join(score(counts, kind, cutoff), ["cell_id", "name"])
    return out.join(obs, "cell_id", "left") if obs is not None else out
