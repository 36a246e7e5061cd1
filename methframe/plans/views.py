"""The tables that the reference operators' queries run on, derived from the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.operators.region import with_site_id
from methframe.session import table

#: Group A of the two-group design; all other cells with a class are group B.
GROUP_A = "Exc"


def sites(spark: SparkSession, d: str) -> DataFrame:
    """cell_id, chrom, pos, mc, cov: possible counts, runs and deliveries of a cell added up."""
    rows = table(spark, d, "cell_sites").where("cell_id is not null and chrom is not null and pos is not null and mc >= 0 and mc <= cov")
    return rows.groupBy("cell_id", "chrom", "pos").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def reference(spark: SparkSession, d: str, ids: bool = False) -> DataFrame:
    """chrom, pos, strand, context of the sites that still stand, each once, with site_id if ``ids``."""
    rows = table(spark, d, "ref_sites").where("removed_at is null and chrom is not null and pos is not null")
    rows = rows.groupBy("chrom", "pos").agg(F.min("strand").alias("strand"), F.min("context").alias("context"))
    return with_site_id(rows) if ids else rows


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").select("cell_id", "sname", "cell_class")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """chrom, start_pos, end_pos, name: the distinct called regions."""
    rows = table(spark, d, "dmr_calls").where("chrom is not null and start_pos is not null and end_pos > start_pos").select("chrom", "start_pos", "end_pos").distinct()
    return rows.withColumn("name", F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string")))


def blacklist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "probe_manifest").where("chrom is not null and pos is not null")
    return rows.select("chrom", (F.col("pos") - 40).alias("start_pos"), (F.col("pos") + 40).alias("end_pos"))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    """Sites with in_a, for cells with a class."""
    known = cells(spark, d).where("cell_class is not null").select("cell_id", F.col("cell_class").startswith(GROUP_A).alias("in_a"))
    return sites(spark, d).join(known, "cell_id")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dmr_calls")


def gtf_lines(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (p % 5 + 1).cast("string")), F.lit("src"), F.lit("gene"), (p * 7 + 1).cast("string"), (p * 7 + 1 + F.col("p_size") * 10).cast("string"), F.lit("."),
        F.when(p % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit('gene_id "G'), p.cast("string"), F.lit('"; gene_name "'), F.col("p_brand"), F.lit('"; gene_type "'), F.col("p_type"), F.lit('";')),
    )
    return table(spark, d, "part").select(p.alias("ord"), text.alias("line"))


def array_long(spark: SparkSession, d: str) -> DataFrame:
    beta = F.max(F.round(F.col("l_discount") * 100).cast("int")).cast("double") / 10
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("sample_id"), F.col("l_partkey").alias("probe_id")).agg(beta.alias("beta"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("probe_id"), F.concat(F.lit("chr"), (p % 5 + 1).cast("string")).alias("chrom"), (p * 3 + 1).alias("pos"), F.when(p % 2 == 0, "+").otherwise("-").alias("strand"))


SQL = f"""with sites as (select cell_id, chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from cell_sites where cell_id is not null and chrom is not null and pos is not null and mc >= 0 and mc <= cov group by all),
ref0 as (select chrom, pos, min(strand) as strand, min(context) as context from ref_sites where removed_at is null and chrom is not null and pos is not null group by all),
ref as (select *, row_number() over (partition by chrom order by pos) as site_id from ref0),
regions as (select distinct chrom, start_pos, end_pos, chrom || ':' || start_pos || '-' || end_pos as name from dmr_calls where chrom is not null and start_pos is not null and end_pos > start_pos),
blacklist as (select chrom, pos - 40 as start_pos, pos + 40 as end_pos from probe_manifest where chrom is not null and pos is not null),
grouped as (select s.*, starts_with(c.cell_class, '{GROUP_A}') as in_a from sites s join cells c using (cell_id) where c.cell_class is not null),
bulk as (select chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites group by all),
bulk_a as (select chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from grouped where in_a group by all),
bulk_b as (select chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from grouped where not in_a group by all),
gtf as (select p_partkey as ord, 'chr' || (p_partkey % 5 + 1) as chrom, p_partkey * 7 as s, p_partkey * 7 + 1 + p_size * 10 as e, case when p_partkey % 2 = 0 then '+' else '-' end as strand, 'G' || p_partkey as gene_id, p_brand as name, p_type as gene_type from part),
array_long as (select 's' || (l_suppkey % 4) as sample_id, l_partkey as probe_id, cast(max(cast(round(l_discount * 100) as integer)) as double) / 10 as beta from lineitem group by all),
manifest as (select p_partkey as probe_id, 'chr' || (p_partkey % 5 + 1) as chrom, p_partkey * 3 + 1 as pos, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part)
"""
