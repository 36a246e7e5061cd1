"""Queries p6 to p9 over the whole tables. SQL can express p6, pair by pair; tests/llm compares the others with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.llm import clusters, mixing, packing, subjects, tokens
from methframe.session import checkpointed, table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = clusters.cluster_ids(table(spark, d, "cell_profiles")).where("profile_id <> cluster_id")
    return rows.select(F.col("cluster_id").alias("profile_id_a"), F.col("profile_id").alias("profile_id_b"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.describe_clusters(checkpointed(clusters.cluster_profiles(table(spark, d, "cell_profiles"))))
    return found.select("cluster_id", "size", F.posexplode("typical").alias("place", "profile_id"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_sizes(table(spark, d, "documents"), ["doc_id", "source"])


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sizes(spark, d), "doc_id"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").select("doc_id", "n_chars")
    return _subjects(spark, d).join(size, "doc_id").groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p6_found, p6_clusters, p7_packing, p7_fill, p8_mixture, p8_shares, p9_found, p9_composition)}

#: Every pair of profiles, and the closure of likeness; quadratic, so for the small tables only.
_PAIRS = f"""with recursive win as (
  select profile_id as id, unnest(range(1, greatest(len(mc), len(cov)) + 1)) as w, unnest(list_transform(range(1, greatest(len(mc), len(cov)) + 1), lambda i: mc[i])) as m,
    unnest(list_transform(range(1, greatest(len(mc), len(cov)) + 1), lambda i: cov[i])) as c from cell_profiles where profile_id is not null
), readable as (select id, w, m / c as f from win where m >= 0 and c >= {clusters.MIN_COV} and m <= c),
pair as (select a.id as a, b.id as b, avg(abs(a.f - b.f)) as d from readable a join readable b on a.w = b.w and a.id <> b.id group by all),
alike as (select a, b from pair where d <= {clusters.ALIKE}),
reach(a, b) as (select a, b from alike union select r.a, x.b from reach r join alike x on r.b = x.a),
named as (select id, least(id, coalesce(min(b), id)) as cluster_id from (select distinct profile_id as id from cell_profiles where profile_id is not null) left join reach on a = id group by id)
"""
SQL: dict[str, str] = {
    "p6_found": _PAIRS + "select cluster_id as profile_id_a, id as profile_id_b from named where id <> cluster_id",
    "p6_clusters": _PAIRS
    + f""", size as (select cluster_id, count(*) as size from named group by all),
near as (select x.id, x.cluster_id, size, round(coalesce(sum(exp(-1 * power(d / {clusters.SIGMA}, 2))), 0) / greatest(size - 1, 1), 9) as affinity
  from named x join size using (cluster_id) left join named y on y.cluster_id = x.cluster_id and y.id <> x.id left join pair on a = x.id and b = y.id group by x.id, x.cluster_id, size),
best as (select *, row_number() over (partition by cluster_id order by affinity desc, id) as n from near)
select cluster_id, size, cast(n - 1 as integer) as place, id as profile_id from best where n <= 3""",
}
