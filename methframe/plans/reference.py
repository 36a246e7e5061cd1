"""One query for each operator of the inventory, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.functions import numbers
from methframe.operators import align, dmr, features, index, intervals, merge, pivot, region
from methframe.plans import views as v
from methframe.session import table
from methframe.sources import store, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The windows of the query examples, on sites and on intervals; both have rows in tables of any size.
CHROM, LOW, HIGH = "chr19", 3_200_000, 3_900_000
CALLS_LOW, CALLS_HIGH = 1_000_000, 2_200_000
BIN = 10_000
TILE = 50_000
CLASSES = ["Astro", "Exc_L2", "Exc_L5", "Inh_Pv", "Inh_Sst", "Micro", "Oligo"]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = v.SQL + sql
        return f

    return register


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    return merge.pseudobulk(v.sites(spark, d))


# scans


@query("select chrom, pos, cov from cell_sites where chrom is not null")
def scan_columns(spark, d):
    return table(spark, d, "cell_sites").where("chrom is not null").select("chrom", "pos", "cov")


@query("select chrom, count(*) as n_rows, min(pos) as first_pos, max(pos) as last_pos from sites group by chrom")
def summary_chunks(spark, d):
    return store.chunks(v.sites(spark, d))


@query("select cell_id, s.chrom, s.pos, strand, context, mc, cov, site_id from sites s join ref r on s.chrom = r.chrom and s.pos = r.pos")
def view_ref_join(spark, d):
    return align.with_reference(v.sites(spark, d), v.reference(spark, d, ids=True)).select("cell_id", "chrom", "pos", "strand", "context", "mc", "cov", "site_id")


@query("select cell_id, chrom, pos, cast(least(mc, 255) as smallint) as mc, cast(least(cov, 255) as smallint) as cov from sites")
def typed_import(spark, d):
    return store.typed(v.sites(spark, d), {"mc": "B", "cov": "B"})


@query("select chrom, count(*) as n_rows from sites where chrom in ('chr9', 'chr6', 'chrX') group by chrom")
def view_chrom_filter(spark, d):
    return store.ordered(v.sites(spark, d), ["chr9", "chr6", "chrX"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_rows"))


# predicates


@query(f"select * from sites where chrom = '{CHROM}' and pos between {LOW} and {HIGH}")
def region_query(spark, d):
    return region.region(v.sites(spark, d), CHROM, LOW, HIGH)


@query("select * from sites where cell_id = 'pool_ctrl' and chrom = 'chr19'")
def region_query_dims(spark, d):
    return v.sites(spark, d).where((F.col("cell_id") == "pool_ctrl") & (F.col("chrom") == CHROM))


@query("select r.name as region_idx, s.cell_id, s.chrom, s.pos, s.mc, s.cov from sites s join regions r on s.chrom = r.chrom and s.pos between r.start_pos and r.end_pos")
def region_query_multi(spark, d):
    wanted = v.regions(spark, d).select(F.col("name").alias("region_idx"), "chrom", F.col("start_pos").alias("low"), F.col("end_pos").alias("high"))
    return region.regions_query(v.sites(spark, d), wanted).select("region_idx", "cell_id", "chrom", "pos", "mc", "cov")


@query(f"select * from regions where chrom = '{CHROM}' and start_pos >= {CALLS_LOW} and end_pos <= {CALLS_HIGH}")
def region_query_contained(spark, d):
    return region.contained(v.regions(spark, d), CHROM, CALLS_LOW, CALLS_HIGH, ("start_pos", "end_pos"))


@query("select r.name as region_idx, count(b.pos) as n_records, cast(coalesce(sum(b.mc), 0) as bigint) as sum_mc from regions r left join bulk b on b.chrom = r.chrom and b.pos between r.start_pos and r.end_pos group by r.name")
def region_query_lists(spark, d):
    wanted = v.regions(spark, d).select(F.col("name").alias("region_idx"), "chrom", F.col("start_pos").alias("low"), F.col("end_pos").alias("high"))
    lists = region.region_lists(_bulk(spark, d), wanted, ["mc", "cov"])
    return lists.select("region_idx", F.size("records").cast("bigint").alias("n_records"), F.aggregate("records", F.lit(0).cast("bigint"), lambda s, x: s + x["mc"]).alias("sum_mc"))


@query(f"select r.chrom, r.pos, strand, context, cell_id, mc, cov from sites s join ref r on s.chrom = r.chrom and s.pos = r.pos where r.chrom = '{CHROM}' and r.pos between {LOW} and {HIGH}")
def query_with_reference(spark, d):
    return align.with_reference(region.region(v.sites(spark, d), CHROM, LOW, HIGH), region.region(v.reference(spark, d), CHROM, LOW, HIGH)).select("chrom", "pos", "strand", "context", "cell_id", "mc", "cov")


def _context(name: str, pattern: str, where: str) -> None:
    def run(spark, d):
        return index.context_index(v.reference(spark, d, ids=True), pattern)

    run.__name__ = name
    query(f"select chrom, site_id from ref where {where}")(run)


_context("context_cg", "CGN", "substr(context, 1, 2) = 'CG'")
_context("context_ch", "CHN", "substr(context, 1, 2) in ('CA', 'CC', 'CT')")
_context("context_fwd_cg", "+CGN", "substr(context, 1, 2) = 'CG' and strand = '+'")
_context("context_rev_cg", "-CGN", "substr(context, 1, 2) = 'CG' and strand = '-'")


@query("select g.name, g.chrom, min(site_id) as id_start, max(site_id) as id_end from regions g join ref r on r.chrom = g.chrom and r.pos >= g.start_pos and r.pos < g.end_pos group by g.name, g.chrom")
def index_regions(spark, d):
    return index.region_index(v.reference(spark, d, ids=True), v.regions(spark, d))


@query("select s.cell_id, s.chrom, s.pos, s.mc, s.cov from sites s join ref r on s.chrom = r.chrom and s.pos = r.pos where substr(context, 1, 2) = 'CG'")
def subset_by_index(spark, d):
    ref = v.reference(spark, d, ids=True)
    rows = align.with_reference(v.sites(spark, d), ref)
    return index.subset(rows, index.context_index(ref, "CGN")).select("cell_id", "chrom", "pos", "mc", "cov")


@query("select g.name, r.chrom, r.pos, r.site_id, r.context from regions g join ref r on r.chrom = g.chrom and r.pos >= g.start_pos and r.pos < g.end_pos")
def subset_by_regions(spark, d):
    ref = v.reference(spark, d, ids=True)
    return index.subset_ranges(ref, index.region_index(ref, v.regions(spark, d))).select("name", "chrom", "pos", "site_id", "context")


# joins and unions


@query("select r.chrom, r.pos, r.strand, r.context, coalesce(b.mc, 0) as mc, coalesce(b.cov, 0) as cov from ref r left join bulk b on b.chrom = r.chrom and b.pos = r.pos")
def align_left_fill(spark, d):
    return align.align(v.reference(spark, d), _bulk(spark, d))


@query("select c.cell_id, r.chrom, r.pos, r.strand, r.context, coalesce(s.mc, 0) as mc, coalesce(s.cov, 0) as cov from (select distinct cell_id from sites where chrom = 'chr19') c cross join ref r left join sites s on s.cell_id = c.cell_id and s.chrom = r.chrom and s.pos = r.pos where r.chrom = 'chr19'")
def align_every_cell(spark, d):
    """One chromosome's axis, filled for each of its cells."""
    return align.align_cells(v.reference(spark, d).where(F.col("chrom") == CHROM), v.sites(spark, d).where(F.col("chrom") == CHROM))


@query("""select coalesce(a.chrom, b.chrom) as chrom, coalesce(a.pos, b.pos) as pos, case when a.chrom is null then 'right' when b.chrom is null then 'left' else 'both' end as side,
case when a.chrom is null or b.chrom is null then 'only' when a.mc = b.mc and a.cov = b.cov then 'equal' when least(a.mc, 255) = least(b.mc, 255) and least(a.cov, 255) = least(b.cov, 255) then 'capped' else 'differ' end as verdict
from bulk_a a full outer join bulk_b b on a.chrom = b.chrom and a.pos = b.pos""")
def compare_tables(spark, d):
    rows = v.grouped(spark, d)
    return align.compare(merge.pseudobulk(rows.where("in_a")), merge.pseudobulk(rows.where("not in_a")))


@query("select 'a' as cell_id, * from bulk_a union all select 'b', * from bulk_b")
def catcz_union(spark, d):
    rows = v.grouped(spark, d)
    return align.union_tables({"a": merge.pseudobulk(rows.where("in_a")), "b": merge.pseudobulk(rows.where("not in_a"))})


# aggregation


@query("select chrom, pos, least(mc, 65535) as mc, least(cov, 65535) as cov from bulk")
def pseudobulk_sum(spark, d):
    return merge.pseudobulk(v.sites(spark, d), code="H")


@query("select b.chrom, pos, round(mc / n, 6) as mc, round(cov / n, 6) as cov from bulk b join (select chrom, count(distinct cell_id) as n from sites group by chrom) c on c.chrom = b.chrom")
def pseudobulk_mean(spark, d):
    return merge.pseudobulk_mean(v.sites(spark, d)).select("chrom", "pos", F.round("mc", 6).alias("mc"), F.round("cov", 6).alias("cov"))


@query("select cell_class, chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites join cells using (cell_id) group by all")
def pseudobulk_by_class(spark, d):
    return merge.pseudobulk(v.sites(spark, d).join(v.cells(spark, d), "cell_id"), ["cell_class"])


@query("select cell_class, b.chrom, pos, mc as mc_sum, round(mc / n, 6) as mc_mean, round(cov / n, 6) as cov_mean from (select cell_class, chrom, pos, cast(sum(mc) as bigint) as mc, sum(cov) as cov from sites join cells using (cell_id) group by all) b "
       "join (select cell_class as k, chrom, count(distinct cell_id) as n from sites join cells using (cell_id) group by all) c on c.chrom = b.chrom and c.k is not distinct from b.cell_class")  # fmt: skip
def pseudobulk_per_column(spark, d):
    out = merge.pseudobulk_as(v.sites(spark, d).join(v.cells(spark, d), "cell_id"), {"mc": ["sum", "mean"], "cov": ["mean"]}, ["cell_class"])
    return out.withColumns({c: F.round(c, 6) for c in ("mc_mean", "cov_mean")})


@query("select g.name, cast(coalesce(sum(mc), 0) as bigint) as mc, cast(coalesce(sum(cov), 0) as bigint) as cov from regions g left join bulk b on b.chrom = g.chrom and b.pos >= g.start_pos and b.pos < g.end_pos group by g.name")
def region_aggregate(spark, d):
    return index.region_sums(_bulk(spark, d), v.regions(spark, d), "q")


@query("select r.chrom, r.pos - case when strand = '-' then 1 else 0 end as pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from bulk b join ref r on r.chrom = b.chrom and r.pos = b.pos where substr(context, 1, 2) = 'CG' group by all")
def merge_strands(spark, d):
    return merge.merge_strands(align.with_reference(_bulk(spark, d), v.reference(spark, d)))


@query(f"select cell_id, chrom, (pos - 1) // {BIN} * {BIN} + 1 as bin_start, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites group by all")
def ch_bins(spark, d):
    return merge.bin_sums(v.sites(spark, d), BIN)


@query("select context, count(*) as n_sites, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov, round(case when sum(cov) > 0 then sum(mc) / sum(cov) else 0 end, 6) as mc_rate from sites s join ref r on r.chrom = s.chrom and r.pos = s.pos group by context")
def context_summary(spark, d):
    return merge.context_summary(align.with_reference(v.sites(spark, d), v.reference(spark, d)))


@query("select cell_id, round(case when sum(cov) > 0 then sum(mc) / sum(cov) else 0 end, 6) as rate from sites group by cell_id")
def global_rates(spark, d):
    return merge.global_rates(v.sites(spark, d))


# pivots

_CLASS_SITES = "per as (select cell_class, chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites join cells using (cell_id) where cell_class is not null group by all)"


def _class_sites(spark, d):
    return v.sites(spark, d).join(v.cells(spark, d).where("cell_class is not null"), "cell_id")


@query(f", {_CLASS_SITES} select chrom, pos, " + ", ".join(f"round(coalesce(max(case when cell_class = '{c}' then case when cov > 0 then mc / cov else 0 end end), 0), 6) as {c}" for c in CLASSES) + " from per group by chrom, pos")
def pivot_fraction(spark, d):
    return pivot.pivot_fraction(_class_sites(spark, d), "cell_class", CLASSES)


_TEST = """
fisher_in as (select *, greatest(0, (a + b) + (a + c) - (a + b + c + d)) as lo, least(a + b, a + c) as hi, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) as fixed from tables),
fisher_p as (select *, fixed - lgamma(a+1) - lgamma(b+1) - lgamma(c+1) - lgamma(d+1) as seen,
  list_transform(range(cast(lo as bigint), cast(hi as bigint) + 1), lambda x: fixed - lgamma(x+1) - lgamma(a+b-x+1) - lgamma(a+c-x+1) - lgamma(d-a+x+1)) as lp from fisher_in),
tested as (select *, least(1, list_sum(list_transform(lp, lambda y: case when y <= seen + 1e-7 then exp(y) else 0 end))) as p from fisher_p)
"""
_RATIO = "case when b * c > 0 then round(a * d / (b * c), 6) when a * d > 0 then cast('inf' as double) else null end"
_REST = """, {per}, tables as (select chrom, pos, {by}, cast(mc as double) as a, cast(cov - mc as double) as b, cast(sum(mc) over (partition by chrom, pos) - mc as double) as c, cast(sum(cov - mc) over (partition by chrom, pos) - cov + mc as double) as d from per)"""


@query(_REST.format(per=_CLASS_SITES, by="cell_class") + f", {_TEST} select chrom, pos, cell_class, {_RATIO} as odds_ratio, round(p, 6) as pval from tested")
def pivot_fisher(spark, d):
    out = pivot.pivot_fisher(_class_sites(spark, d), "cell_class")
    ratio = F.when(F.isnan("odds_ratio"), None).otherwise(F.col("odds_ratio"))
    return out.select("chrom", "pos", "cell_class", F.round(ratio, 6).alias("odds_ratio"), F.round("pval", 6).alias("pval"))


# features


@query(f"select chrom, unnest(range(0, chrom_length, {TILE})) as start_pos, least(unnest(range(0, chrom_length, {TILE})) + {TILE}, chrom_length) as end_pos from chrom_sizes")
def genome_bins(spark, d):
    return features.genome_bins(table(spark, d, "chrom_sizes"), TILE)


@query("select name, chrom, greatest(s - 100, 0) as start_pos, e + 100 as end_pos, strand, gene_id, gene_type from (select *, row_number() over (partition by name order by e - s desc, ord) as n from gtf) where n = 1")
def gtf_genes(spark, d):
    return features.parse_gtf(v.gtf_lines(spark, d), flank=100)


@query("select chrom, start_pos, end_pos, name from regions")
def parse_features(spark, d):
    return features.named(v.regions(spark, d).drop("name"))


@query(""", named as (select chrom, s as start_pos, e as end_pos, name, row_number() over (partition by name order by chrom, s, e) - 1 as k, max(n) over () as most from (select *, count(*) over (partition by name) as n from gtf))
select chrom, start_pos, end_pos, case when most > 1 then name || '_' || k else name end as name from named""")
def dup_name_suffix(spark, d):
    f = F.split("line", "\t")
    rows = v.gtf_lines(spark, d).select(f[0].alias("chrom"), (f[3].cast("bigint") - 1).alias("start_pos"), f[4].cast("bigint").alias("end_pos"), F.regexp_extract(f[8], 'gene_name "([^"]*)"', 1).alias("name"))
    return features.unique_names(rows)


_MATRIX = ", matrix as (select cell_id, g.name, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites s join regions g on s.chrom = g.chrom and s.pos > g.start_pos and s.pos <= g.end_pos group by all having sum(cov) > 0)"


def _matrix(spark, d):
    return features.matrix(v.sites(spark, d), v.regions(spark, d))


@query(_MATRIX + " select * from matrix")
def feature_matrix_bed(spark, d):
    return _matrix(spark, d)


@query(f"select cell_id, s.chrom, least((pos - 1) // {TILE}, (chrom_length - 1) // {TILE}) as bin, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites s join chrom_sizes c on c.chrom = s.chrom group by all having sum(cov) > 0")
def feature_matrix_tiles(spark, d):
    return features.tile_matrix(v.sites(spark, d), table(spark, d, "chrom_sizes"), TILE)


@query("select * from regions g where not exists (select 1 from blacklist b where b.chrom = g.chrom and g.start_pos < b.end_pos and b.start_pos < g.end_pos)")
def blacklist_filter(spark, d):
    return features.mask(v.regions(spark, d), v.blacklist(spark, d))


@query("""select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from (select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by chrom order by start_pos, end_pos rows unbounded preceding) as g
from (select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from blacklist)) group by chrom, g""")
def blacklist_merge(spark, d):
    return features.merge_blacklist(v.blacklist(spark, d))


def _score(kind: str, value: str) -> None:
    def run(spark, d):
        return features.score(_matrix(spark, d), kind).withColumn("score", F.round("score", 6))

    run.__name__ = "score_" + kind.removesuffix("-score")
    query(_MATRIX + f" select cell_id, name, round({value}, 6) as score from matrix")(run)


for _kind, _value in (("frac", "mc / cov"), ("mc", "cast(mc as double)"), ("cov", "cast(cov as double)"), ("umc", "cast(cov - mc as double)")):
    _score(_kind, _value)

_TAIL = (
    _MATRIX
    + """, rates as (select cell_id, sum(mc) / (sum(cov) + 1e-6) as p from matrix group by cell_id),
tails as (select m.*, p, case when mc >= cov then 0.0 else least(1.0, list_sum(list_transform(range(mc + 1, cov + 1), lambda x: exp(lgamma(cov + 1) - lgamma(x + 1) - lgamma(cov - x + 1) + x * ln(p) + (cov - x) * ln(1 - p))))) end as tail from matrix m join rates using (cell_id) where p > 0 and p < 1)
"""
)


@query(_TAIL + "select m.cell_id, m.name, round(coalesce(case when t.tail < 0.9 then 0 else t.tail end, 0), 6) as score from matrix m left join tails t on t.cell_id = m.cell_id and t.name = m.name")
def score_hypo(spark, d):
    return features.score(_matrix(spark, d), "hypo-score", 0.9)


@query(_TAIL + "select m.cell_id, m.name, round(coalesce(case when 1 - t.tail < 0.9 then 0 else 1 - t.tail end, 0), 6) as score from matrix m left join tails t on t.cell_id = m.cell_id and t.name = m.name")
def score_hyper(spark, d):
    return features.score(_matrix(spark, d), "hyper-score", 0.9)


_BETA = _MATRIX + """, moments as (select cell_id, avg(mc / cov) as m, var_pop(mc / cov) as v from matrix group by cell_id),
beta as (select cell_id, m, v, m > 0 and m < 1 and v > 1e-15 as good, (1 - m) * m * m / nullif(v, 0) - m as alpha0 from moments),
params as (select cell_id, case when good then greatest(alpha0, 1e-6) end as alpha, case when good then greatest(alpha0 * (1 / m - 1), 1e-6) end as beta, case when good then m end as prior from beta)
"""


@query(_BETA + "select cell_id, round(alpha, 6) as alpha, round(beta, 6) as beta, round(prior, 6) as prior from params")
def beta_params(spark, d):
    return features.beta_params(_matrix(spark, d)).select("cell_id", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "prior")])


@query(_BETA + "select cell_id, name, round((mc + alpha) / (cov + alpha + beta) / prior, 6) as posterior from matrix join params using (cell_id)")
def posterior_frac(spark, d):
    return features.posterior(_matrix(spark, d)).select("cell_id", "name", F.round("posterior", 6).alias("posterior"))


@query("""
, wide0 as (select chrom, greatest(start_pos - 50, 0) as start_pos, end_pos + 50 as end_pos, name from regions),
kept as (select * from wide0 g where not exists (select 1 from blacklist b where b.chrom = g.chrom and g.start_pos < b.end_pos and b.start_pos < g.end_pos)),
m as (select cell_id, g.name, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites s join kept g on s.chrom = g.chrom and s.pos > g.start_pos and s.pos <= g.end_pos group by all having sum(cov) > 0)
select m.*, round(mc / cov, 6) as score, sname, cell_class from m left join cells using (cell_id)""")
def cell_by_feature(spark, d):
    out = features.cell_by_feature(v.sites(spark, d), v.regions(spark, d), "frac", v.blacklist(spark, d), 50, v.cells(spark, d))
    return out.withColumn("score", F.round("score", 6))


# values


@query("select probe_id, sample_id, cast(round_even(least(greatest(beta, 0), 1) * 255, 0) as integer) as level, round(cast(round_even(least(greatest(beta, 0), 1) * 255, 0) as integer) / 255, 6) as back from array_long")
def quantize_roundtrip(spark, d):
    level = numbers.quantize(F.col("beta"), 8, 0.0, 1.0)
    return v.array_long(spark, d).select("probe_id", "sample_id", level.alias("level"), F.round(numbers.dequantize(level, 8, 0.0, 1.0), 6).alias("back"))


@query("select sample_id, chrom, pos, strand, probe_id, beta from array_long join manifest using (probe_id)")
def array_to_sites(spark, d):
    return text.array_to_sites(v.array_long(spark, d), v.manifest(spark, d))


@query("select chrom, pos, reverse(translate(context, 'ACGTNacgtn', 'TGCANtgcan')) as rc from ref")
def revcomp_context(spark, d):
    return v.reference(spark, d).select("chrom", "pos", numbers.reverse_complement(F.col("context")).alias("rc"))


@query(r"select distinct cell_id, regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.cz$', '') as sample from cz_files")
def sample_names(spark, d):
    return table(spark, d, "cz_files").select("cell_id", text.sample_of(F.col("file_path")).alias("sample")).distinct()



@query(r""", seqs as (select upper(regexp_replace(text, '\s', '', 'g')) as seq from documents where text is not null),
lists as (select list_concat(['N', 'N'], string_split(seq, ''), ['N', 'N']) as l from seqs where seq <> ''),
triple as (select unnest(l) as a, unnest(l[2:]) as b, unnest(l[3:]) as c from lists),
hits as (select '+' as strand, a || b || c as context from triple where a = 'C' union all select '-', reverse(translate(a || b || c, 'ACGT', 'TGCA')) from triple where c = 'G')
select strand, context, count(*) as n from hits where regexp_full_match(context, '[ACGTN]{3}') group by all""")
def fasta_contexts(spark, d):
    seqs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chrom"), F.regexp_replace("text", r"\s", "").alias("seq"))
    return text.cytosines(seqs).where("context rlike '^[ACGTN]{3}$'").groupBy("strand", "context").agg(F.count(F.lit(1)).alias("n"))


# exports


@query("select b.chrom, b.pos, strand, context, mc, cov, 1 as flag from bulk b join ref r on r.chrom = b.chrom and r.pos = b.pos where cov > 0")
def export_allc(spark, d):
    return text.allc_rows(_bulk(spark, d), v.reference(spark, d))


def _bedgraph(signal: str, value: str) -> None:
    def run(spark, d):
        return text.bedgraph(_bulk(spark, d), signal).withColumn("value", F.round("value", 6))

    run.__name__ = f"bedgraph_{signal}"
    query(f"select chrom, pos - 1 as start_pos, pos as end_pos, round(cast({value} as double), 6) as value from bulk where cov >= 1 and {value} > 0")(run)


for _kind, _value in (("unmeth", "cov - mc"), ("meth", "mc"), ("frac_unmeth", "(cov - mc) / cov")):
    _bedgraph(_kind, _value)


# tests and regions

_PAIR = ", tables as (select x.chrom, x.pos, cast(x.mc as double) as a, cast(x.cov - x.mc as double) as b, cast(y.mc as double) as c, cast(y.cov - y.mc as double) as d from bulk_a x join bulk_b y on x.chrom = y.chrom and x.pos = y.pos where x.cov >= 1 and y.cov >= 1)"


def _pair(spark, d):
    rows = v.grouped(spark, d)
    return merge.pseudobulk(rows.where("in_a")), merge.pseudobulk(rows.where("not in_a"))


@query(_PAIR + f", {_TEST} select chrom, pos, round(p, 6) as p, round(a / (a + b) - c / (c + d), 6) as delta from tested")
def fisher_1v1(spark, d):
    return dmr.fisher_sites(*_pair(spark, d)).select("chrom", "pos", F.round("p", 6).alias("p"), F.round("delta", 6).alias("delta"))


def _islands(by: str, dist: int, source: str) -> str:
    return f"""
st as (select *, case when lag(pos) over (partition by {by} order by pos) is null or pos - lag(pos) over (partition by {by} order by pos) > {dist} then 1 else 0 end as brk from {source}),
gr as (select *, sum(brk) over (partition by {by} order by pos rows unbounded preceding) as g from st),
kn as (select *, sign(delta) as sg, last_value(nullif(sign(delta), 0) ignore nulls) over (partition by {by}, g order by pos rows between unbounded preceding and 1 preceding) as known from gr),
fl as (select *, sum(case when sg <> 0 and known <> sg then 1 else 0 end) over (partition by {by}, g order by pos rows unbounded preceding) as s from kn),
isl as (select {by}, min(pos) - 1 as start_pos, max(pos) as end_pos, count(*) as n_dms, round(min(p), 6) as p_min, round(avg(delta), 6) as frac_delta_mean, case when avg(delta) > 0 then 'hyper' else 'hypo' end as state from fl group by {by}, g, s)
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("p_min", F.round("p_min", 6)).withColumn("frac_delta_mean", F.round("frac_delta_mean", 6))


@query(_PAIR + f", {_TEST}, dms as (select chrom, pos, p, a / (a + b) - c / (c + d) as delta from tested), called as (select * from dms where p < 0.05 and abs(delta) > 0.2), {_islands('chrom', 250, 'called')} select * from isl")
def dmr_fisher_1v1(spark, d):
    return _rounded(dmr.call_dmr_pair(*_pair(spark, d), p=0.05))


@query(", per as (select sname, chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites join cells using (cell_id) group by all)" + _REST.format(per="_u as (select 1)", by="sname") + f", {_TEST}, called as (select chrom, pos, sname, p, a / (a + b) - c / (c + d) as delta from tested where a + b > 0 and c + d > 0 and p < 0.05 and abs(a / (a + b) - c / (c + d)) > 0.2), {_islands('sname, chrom', 250, 'called')} select * from isl")
def dmr_one_vs_rest(spark, d):
    return _rounded(dmr.call_one_vs_rest(v.sites(spark, d).join(v.cells(spark, d), "cell_id"), "sname", p=0.05))


def _with_cells(spark, d, sites):
    return sites.join(v.cells(spark, d), "cell_id")


@query()
def dmr_one_vs_rest_samples(spark, d):
    return dmr.call_dmr_one_vs_rest(_with_cells(spark, d, v.sites(spark, d)), "sname", p=0.05)


@query(""", per as (select sname, chrom, pos, sum(mc) / sum(cov) as f from sites join cells using (cell_id) group by all having sum(cov) > 0),
r as (select *, sum(f) over w - f as others, count(*) over w - 1 as n from per window w as (partition by chrom, pos))
select sname, chrom, pos, round(f, 6) as rate_a, round(others / n, 6) as rate_b from r where n >= 1 and abs(f - others / n) >= 0.2000001""")
def vs_rest_prefilter(spark, d):
    """The sites and rates that the one-vs-rest caller tests: each sample against the others, which stay separate samples."""
    out = dmr.vs_rest_tests(_with_cells(spark, d, v.sites(spark, d)), "sname", delta=0.2000001)
    return out.select("sname", "chrom", "pos", F.round("rate_a", 6).alias("rate_a"), F.round("rate_b", 6).alias("rate_b"))


@query()
def dmr_one_vs_rest_class(spark, d):
    return dmr.call_dmr_one_vs_rest(_with_cells(spark, d, v.sites(spark, d)), "sname", "cell_class", p=0.05)


@query()
def dmr_one_vs_rest_ch(spark, d):
    ch = v.reference(spark, d).where("context not like 'CG%'").select("chrom", "pos")
    return dmr.call_dmr_one_vs_rest(_with_cells(spark, d, v.sites(spark, d).join(ch, ["chrom", "pos"], "left_semi")), "sname", method="ch", p=0.05, log2fc=0.5, min_samples=1, min_dms=1)


@query("""select chrom, pos, n_a, n_b, round(rate_a, 6) as rate_a, round(rate_b, 6) as rate_b from (
select chrom, pos, cast(sum(case when in_a then 1 else 0 end) as bigint) as n_a, cast(sum(case when not in_a then 1 else 0 end) as bigint) as n_b, avg(case when in_a then mc / cov end) as rate_a, avg(case when not in_a then mc / cov end) as rate_b from grouped where cov > 0 group by all)
where n_a >= 1 and n_b >= 1 and abs(rate_a - rate_b) >= 0.2""")
def dms_prefilter(spark, d):
    out = dmr.prefilter(dmr.eligible(v.grouped(spark, d), 1, 1, ["chrom", "pos"]), 0.2)
    return out.select("chrom", "pos", "n_a", "n_b", F.round("rate_a", 6).alias("rate_a"), F.round("rate_b", 6).alias("rate_b"))


@query()
def dmr_cg(spark, d):
    return dmr.call_dmr(v.grouped(spark, d), p=0.05)


def _ch(spark, d):
    ch = v.reference(spark, d).where("context not like 'CG%'").select("chrom", "pos")
    return v.grouped(spark, d).join(ch, ["chrom", "pos"], "left_semi")


@query()
def dmr_ch(spark, d):
    return dmr.call_dmr_ch(_ch(spark, d), p=0.05, log2fc=0.5, min_dms=1)


@query(f""", b as (select cell_id, chrom, (pos - 1) // {BIN} * {BIN} + 1 as bin_start, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites group by all),
rt as (select cell_id, case when sum(cov) > 0 then sum(mc) / sum(cov) else 0 end as rate from sites group by cell_id), t as (select median(rate) as target from rt where rate > 0)
select b.cell_id, chrom, bin_start, least(cast(round_even(mc * case when rate > 0 then (select target from t) / rate else 1 end, 0) as bigint), cov) as mc, cov from b join rt using (cell_id)""")
def rescale_ch(spark, d):
    s = v.sites(spark, d)
    rates = s.groupBy("cell_id").agg(F.when(F.sum("cov") > 0, F.sum("mc") / F.sum("cov")).otherwise(0.0).alias("rate"))
    return dmr.rescale(merge.bin_sums(s, BIN), rates)


@query(f", called as (select chrom, pos, cast(0.01 as double) as p, mc / cov - cast(0.5 as double) as delta from bulk where cov > 0), {_islands('chrom', 250, 'called')} select * from isl")
def island_merge(spark, d):
    rows = _bulk(spark, d).where("cov > 0").select("chrom", "pos", F.lit(0.01).alias("p"), (F.col("mc") / F.col("cov") - 0.5).alias("delta"))
    return _rounded(dmr.merge_sites(rows, 250))


_Q = """
ok as (select dmr_id, cell_class, sname, p_min as p from dmr_calls where p_min is not null),
rk as (select *, row_number() over (partition by cell_class, sname order by p) as r, count(*) over (partition by cell_class, sname) as m from ok),
qv as (select dmr_id, greatest(0, least(1, min(p * m / r) over (partition by cell_class, sname order by r rows between current row and unbounded following))) as q from rk)
"""


@query(f", {_Q} select c.dmr_id, round(q, 9) as q from dmr_calls c left join qv on qv.dmr_id = c.dmr_id")
def bh_fdr(spark, d):
    return dmr.bh_fdr(v.calls(spark, d), "p_min", ["cell_class", "sname"]).select("dmr_id", F.round("q", 9).alias("q"))


@query(f", {_Q} select c.dmr_id, end_pos - start_pos as length, frac_delta_mean as delta_meth, chrom || ':' || start_pos || '-' || end_pos as region_id, case when frac_delta_mean < 0 then 'hypo' else 'hyper' end as direction, round(q, 9) as q_min from dmr_calls c left join qv on qv.dmr_id = c.dmr_id")
def merge_dmr(spark, d):
    return dmr.merged_results(v.calls(spark, d)).select("dmr_id", "length", "delta_meth", "region_id", "direction", F.round("q_min", 9).alias("q_min"))


@query("""
, c as (select *, case when frac_delta_mean < 0 then 'hypo' else 'hyper' end as direction, greatest(start_pos - 100, 0) as ws, end_pos + 100 as we from dmr_calls where chrom is not null and start_pos is not null and end_pos > start_pos),
m as (select *, max(we) over (partition by chrom, direction order by ws, we rows between unbounded preceding and 1 preceding) as reach from c),
i as (select *, sum(case when reach is null or ws > reach then 1 else 0 end) over (partition by chrom, direction order by ws, we rows unbounded preceding) as g from m)
select chrom, direction, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_regions, count(distinct sname) as n_samples, count(distinct cell_class) as n_classes, coalesce(string_agg(distinct sname, ',' order by sname), '') as snames,
coalesce(string_agg(distinct cell_class, ',' order by cell_class), '') as classes, round(avg(frac_delta_mean), 6) as mean_delta, min(p_min) as p_min from i group by chrom, direction, g having count(distinct sname) >= 2""")
def consensus_dmr(spark, d):
    return dmr.consensus(v.calls(spark, d), slop=100, min_samples=2)


_WIDE = ", ".join(f"round(coalesce(max(case when cell_class = '{c}' then case when cov > 0 then mc / cov else 0 end end), 0), 6) as {c}" for c in CLASSES)


@query(f", {_CLASS_SITES}, w as (select chrom, pos, {_WIDE} from per group by chrom, pos), l as (select chrom, pos, unnest([{', '.join(CLASSES)}]) as x, unnest({CLASSES}) as s, unnest(range({len(CLASSES)})) as i from w) "
       "select chrom, pos, first(s order by x, i) as hypo_sample, first(s order by x desc, i) as hyper_sample, min(x) as min_value, max(x) as max_value, round(max(x) - min(x), 6) as delta_beta from l group by chrom, pos having max(x) - min(x) >= 0.3")  # fmt: skip
def annot_dmr(spark, d):
    out = dmr.annotate(pivot.pivot_fraction(_class_sites(spark, d), "cell_class", CLASSES), ["chrom", "pos"], CLASSES, 0.3)
    return out.withColumn("delta_beta", F.round("delta_beta", 6))


_REGION_MATRIX = ", ".join(f"max(case when cell_class = '{c}' then f end) as {c}" for c in CLASSES)


@query(f""", cm as (select g.chrom, g.start_pos, g.end_pos, cell_class, round(sum(mc) / sum(cov), 6) as f from sites s join cells using (cell_id) join regions g on s.chrom = g.chrom and s.pos > g.start_pos and s.pos <= g.end_pos where cell_class is not null group by all having sum(cov) > 0),
w as (select chrom, start_pos, end_pos, {_REGION_MATRIX} from cm group by all), l as (select chrom, start_pos, end_pos, unnest([{', '.join(CLASSES)}]) as x, unnest({CLASSES}) as s, unnest(range({len(CLASSES)})) as i from w),
a as (select chrom, start_pos, end_pos, first(s order by x, i) as hypo_sample, first(s order by x desc, i) as hyper_sample, min(x) as min_value, max(x) as max_value, round(max(x) - min(x), 6) as delta_beta from l where x is not null group by all having max(x) - min(x) >= 0.1)
select a.*, n_dms, snames from a left join (select chrom, start_pos, end_pos, max(n_dms) as n_dms, coalesce(string_agg(distinct sname, ',' order by sname), '') as snames from dmr_calls group by all) using (chrom, start_pos, end_pos)""")
def annot_regions(spark, d):
    g = v.regions(spark, d)
    rows = _class_sites(spark, d).drop("cell_id").withColumnRenamed("cell_class", "cell_id")
    frac = features.score(features.matrix(rows, g), "frac").join(g, "name").groupBy("chrom", "start_pos", "end_pos").pivot("cell_id", CLASSES).agg(F.round(F.first("score"), 6))
    return dmr.annotate_regions(frac, v.calls(spark, d), CLASSES, 0.1).withColumn("delta_beta", F.round("delta_beta", 6))


@query("select chrom, greatest(pos - 50, 0) as start_pos, pos + 50 as end_pos, count(*) as n_reads from (select chrom, pos, unnest(range(cov - mc)) as k from bulk where cov > mc) group by all")
def pseudo_reads(spark, d):
    return dmr.pseudo_reads(_bulk(spark, d), F.col("cov") - F.col("mc"), 50).groupBy("chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n_reads"))


@query(_REST.format(per=_CLASS_SITES, by="cell_class") + f", {_TEST} select chrom, pos - 1 as start_pos, pos as end_pos, cell_class, round(case when b * c > 0 and a * d / (b * c) < 1 then p else 1 end, 6) as p from tested")
def combp_split(spark, d):
    out = dmr.combp_input(pivot.pivot_fisher(_class_sites(spark, d), "cell_class"), "cell_class", "hypo")
    return out.withColumn("p", F.round("p", 6))


@query("""
, c as (select sname, start_pos, end_pos, chrom, max(end_pos) over (partition by sname, chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from dmr_calls where sname is not null and chrom is not null and start_pos is not null and end_pos > start_pos)
select sname, chrom, count(*) as n_intervals, cast(sum(case when reach is null or start_pos > reach then 1 else 0 end) as bigint) as n_stretches from c group by all""")
def interval_islands(spark, d):
    rows = v.calls(spark, d).where("sname is not null and chrom is not null and start_pos is not null and end_pos > start_pos")
    found = intervals.number_stretches(rows, ["sname", "chrom"], F.col("start_pos"), F.col("end_pos"))
    return found.groupBy("sname", "chrom").agg(F.count(F.lit(1)).alias("n_intervals"), F.countDistinct("stretch_start").alias("n_stretches"))


# events


@query("select time_bucket(interval '1 hour', ts) as since, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("since"), "event_type", "n", "total")


@query("select event_type, cast(props->>'$.k' as bigint) as k, count(*) as n from events group by all")
def event_props(spark, d):
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


# the flagship


@query(f"""
, t as (select cell_id, s.chrom, least((pos - 1) // {TILE}, (chrom_length - 1) // {TILE}) as bin, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov from sites s join chrom_sizes c on c.chrom = s.chrom group by all having sum(cov) > 0)
select cell_class, chrom, bin, cast(sum(mc) as bigint) as mc, cast(sum(cov) as bigint) as cov, round(sum(mc) / sum(cov), 6) as frac from t join cells using (cell_id) group by all having sum(cov) >= 20""")
def class_tiles(spark, d):
    tiles = features.tile_matrix(v.sites(spark, d), table(spark, d, "chrom_sizes"), TILE).join(v.cells(spark, d), "cell_id")
    total = tiles.groupBy("cell_class", "chrom", "bin").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    return total.where("cov >= 20").withColumn("frac", F.round(F.col("mc") / F.col("cov"), 6))
