"""Queries p1 to p5 over the whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.operators import compaction, hotkeys, intervals, orphans
from methframe.session import table
from methframe.sources import lines

HEAVY_PERCENT = 8

#: child table, parent table, keys, row key, time of arrival
REFERENCES = [
    ("cell_sites", "ref_sites", ["chrom", "pos"], "rec_id", "loaded_at"),
    ("probe_manifest", "ref_sites", ["chrom", "pos"], "probe_id", "released_at"),
    ("dmr_calls", "chrom_sizes", ["chrom"], "dmr_id", "called_at"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for child, parent, keys, row_key, at in REFERENCES:
        one = orphans.find_orphans(table(spark, d, child), table(spark, d, parent), keys, row_key, at).withColumn("child_table", F.lit(child))
        found = one if found is None else found.unionByName(one)
    return found


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "row_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), ["child_table"])


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_totals(table(spark, d, "cell_sites"), "chrom", "pos", ["mc", "cov"], tiebreak="rec_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(_totals(spark, d), table(spark, d, "cell_sites"), "chrom", HEAVY_PERCENT)


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.stretches_and_gaps(table(spark, d, "dmr_calls"), ["sname", "chrom"], "start_pos", "end_pos")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.copies(compaction.merged_records(table(spark, d, "cz_files"), copies_only=True))


def p4_manifest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "cz_files")
    return compaction.manifest(compaction.merged_records(files, compaction.ranges_for(files)))


def p4_cell_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = compaction.kept(compaction.merged_records(table(spark, d, "cz_files")))
    return rows.groupBy("cell", "chrom").agg(F.count(F.lit(1)).alias("n_records"), F.sum("mc").alias("sum_mc"), F.sum("cov").alias("sum_cov"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return lines.parse_lines(table(spark, d, "allc_lines"), "line_id", "raw_line")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(_parsed(spark, d), "line_id")[1].select("line_id", "reason")


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(_parsed(spark, d), "line_id")[0]


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_totals, p3_found, p4_found, p4_manifest, p4_cell_totals, p5_found, p5_valid)}


def _orphan_sql() -> str:
    parts = []
    for child, parent, keys, row_key, at in REFERENCES:
        same = " and ".join(f"r.{k} = c.{k}" for k in keys)
        known = " and ".join(f"c.{k} is not null" for k in keys)
        first = f"(select min(r.added_at) from {parent} r where {same})"
        parts.append(
            f"select '{child}' as child_table, c.{row_key} as row_key, c.{at} as arrived_at, "
            f"case when not exists (select 1 from {parent} r where {same}) then 'missing' when {first} > c.{at} then 'not_yet' else 'gone' end as kind "
            f"from {child} c where {known} and not exists (select 1 from {parent} r where {same} and r.added_at <= c.{at} and (r.removed_at is null or r.removed_at > c.{at}))"
        )
    return " union all ".join(parts)


_KINDS = """
with rec as (
  select lower(trim(split_part(trim(cell_id), '.', 1))) as cell, chrom, file_id, unnest(range(1, len(pos) + 1)) as rec_no, unnest(pos) as pos, unnest(mc) as mc, unnest(cov) as cov
  from cz_files where len(pos) > 0
), ranked as (select *, row_number() over (partition by cell, chrom, pos, mc, cov order by file_id, rec_no) as n from rec)
"""

_LINES = r"""
with line as (select line_id, regexp_replace(raw_line, '\r$', '') as t from allc_lines where raw_line is not null),
record as (select line_id, t from line where t <> '' and not starts_with(t, '#')),
quoted as (
  select line_id, t, regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') as good,
         regexp_extract_all(chr(9) || t, '(?s)\t(?:"(?:[^"]|"")*"|[^"\t]*)') as raw
  from record
), cell as (select line_id, good, list_transform(raw, lambda x: case when starts_with(x[2:], '"') then replace(x[3:-2], '""', '"') else x[2:] end) as f from quoted),
cast_ as (
  select line_id, good, len(f) as n, f,
    case when regexp_full_match(f[2], '[0-9]+') then try_cast(f[2] as hugeint) end as pos,
    case when regexp_full_match(f[5], '[0-9]+') then try_cast(f[5] as hugeint) end as mc,
    case when regexp_full_match(f[6], '[0-9]+') then try_cast(f[6] as hugeint) end as cov
  from cell
), judged as (
  select *, case when not good then 'quoting' when n <> 7 then 'columns'
    when pos is null or pos < 1 or pos > 9223372036854775807 then 'pos'
    when mc is null or mc > 65535 then 'mc' when cov is null or cov > 65535 then 'cov' when mc > cov then 'mc_over_cov' end as reason
  from cast_
)
"""

SQL = {
    "p1_found": f"select child_table, row_key from ({_orphan_sql()})",
    "p1_report": f"select child_table, date_trunc('month', arrived_at) as month, kind, count(*) as n_orphans from ({_orphan_sql()}) group by all",
    "p2_found": f"select chrom from cell_sites where chrom is not null group by chrom having count(*) * 100 >= {HEAVY_PERCENT} * (select count(*) from cell_sites)",
    "p2_totals": """
with g as (select chrom, pos, pos - lag(pos) over (partition by chrom order by pos) as step from (select distinct chrom, pos from cell_sites where pos is not null)),
w as (select chrom, max(step) as max_gap from g group by chrom)
select c.chrom, count(*) as n_rows, cast(sum(mc) as bigint) as sum_mc, cast(sum(cov) as bigint) as sum_cov, count(distinct pos) as n_pos, min(pos) as first_pos, max(pos) as last_pos, any_value(w.max_gap) as max_gap
from cell_sites c left join w on w.chrom is not distinct from c.chrom group by c.chrom""",
    "p3_found": """
with c as (select sname, chrom, start_pos, end_pos from dmr_calls where sname is not null and chrom is not null and start_pos is not null and end_pos > start_pos),
m as (select *, max(end_pos) over (partition by sname, chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from c),
i as (select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by sname, chrom order by start_pos, end_pos rows unbounded preceding) as g from m),
s as (select sname, chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from i group by sname, chrom, g),
n as (select sname, chrom, end_pos, lead(start_pos) over (partition by sname, chrom order by start_pos) as next_start from s)
select 'merged' as kind, sname, chrom, start_pos, end_pos from s union all select 'gap', sname, chrom, end_pos, next_start from n where next_start is not null""",
    "p4_found": _KINDS + "select file_id, cast(rec_no as integer) as rec_no from ranked where n > 1",
    # one file as long as all records fit it, which the small tables do
    "p4_manifest": _KINDS
    + "select '000000-0000' as out_file, "
    + ", ".join(f"first({c} order by cell {o}, chrom {o}, pos {o}) as {a}_{c}" for a, o in (("low", "asc nulls first"), ("high", "desc nulls last")) for c in ("cell", "chrom", "pos"))
    + f", count(*) as n_records, cast(sum({compaction.FIXED_RECORD_BYTES} + coalesce(strlen(cell), 0) + coalesce(strlen(chrom), 0)) as bigint) as n_bytes from ranked where n = 1 having count(*) > 0",
    "p4_cell_totals": _KINDS + "select cell, chrom, count(*) as n_records, cast(sum(mc) as bigint) as sum_mc, cast(sum(cov) as bigint) as sum_cov from ranked where n = 1 group by cell, chrom",
    "p5_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p5_valid": _LINES + "select line_id, f[1] as chrom, cast(pos as bigint) as pos, f[3] as strand, f[4] as context, cast(mc as integer) as mc, cast(cov as integer) as cov, f[7] as flag from judged where reason is null",
}
