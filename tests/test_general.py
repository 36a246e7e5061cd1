"""The operators behind p1 to p5 on awkward input: nulls, ties, repeats, hot keys, empty tables, clashing names."""

import datetime as dt
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from methframe.operators import compaction, hotkeys, intervals, orphans
from methframe.sources import lines

DAY = dt.datetime(2025, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


# references


def parents(spark, rows):
    return spark.createDataFrame(rows, "chrom string, pos bigint, added_at timestamp, removed_at timestamp, loaded_at string")


def children(spark, rows):
    return spark.createDataFrame(rows, "rec bigint, chrom string, pos bigint, loaded_at timestamp, added_at string")


PARENTS = [("a", 1, day(0), None, ""), ("a", 1, day(0), None, ""), ("a", 2, day(0), day(5), ""), ("a", 2, day(9), None, ""), ("a", 3, None, None, ""), (None, 4, day(0), None, "")]
CHILDREN = [(1, "a", 1, day(1), ""), (2, "a", 2, day(5), ""), (3, "a", 2, day(9), ""), (4, "A", 1, day(1), ""), (5, "a", None, day(1), ""), (6, None, 1, day(1), ""), (7, "a", 1, None, ""), (8, "a", 3, day(1), ""), (9, "a", 1, day(-1), ""), (4, "A", 1, day(1), "")]
KINDS = [(2, "gone"), (4, "missing"), (4, "missing"), (7, "gone"), (8, "gone"), (9, "not_yet")]


@pytest.mark.parametrize("bits", [orphans.MAX_FILTER_BITS, 0])
def test_orphans(spark, monkeypatch, bits):
    monkeypatch.setattr(orphans, "MAX_FILTER_BITS", bits)
    got = orphans.find_orphans(children(spark, CHILDREN), parents(spark, PARENTS), ["chrom", "pos"], "rec", "loaded_at")
    assert sorted((r.row_key, r.kind) for r in got.collect()) == KINDS
    assert {(r.month.month if r.month else None, r.kind): r.n_orphans for r in orphans.orphan_report(got, []).collect()} == {(1, "gone"): 2, (1, "missing"): 2, (None, "gone"): 1, (12, "not_yet"): 1}


def test_orphans_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_BROADCAST_ROWS", 0)
    got = orphans.find_orphans(children(spark, CHILDREN), parents(spark, PARENTS), ["chrom", "pos"], "rec", "loaded_at")
    assert sorted((r.row_key, r.kind) for r in got.collect()) == KINDS


def test_orphans_of_empty_tables(spark):
    none, all_ = children(spark, []), children(spark, CHILDREN)
    assert orphans.find_orphans(none, parents(spark, PARENTS), ["chrom", "pos"], "rec", "loaded_at").count() == 0
    assert orphans.find_orphans(all_, parents(spark, []), ["chrom", "pos"], "rec", "loaded_at").count() == 8


@pytest.mark.parametrize("bits", [orphans.MAX_FILTER_BITS, 0])
def test_filter_proves_most_orphans(spark, monkeypatch, bits):
    """Broadcast or sharded, the filter lets all parents and few others through."""
    monkeypatch.setattr(orphans, "MAX_FILTER_BITS", bits)
    found = orphans.with_hit(spark.range(20_000), spark.range(2000).withColumnRenamed("id", "p"), ["p"], ["id"], 2000)
    hits = found.where("hit")
    assert found.count() == 20_000 and hits.where("id < 2000").count() == 2000
    assert hits.count() < 2000 + 0.02 * 18_000


@pytest.mark.parametrize("bits", [orphans.MAX_FILTER_BITS, 64])
def test_each_child_is_read_once(spark, small, monkeypatch, bits):
    """Also where the filter is too large to be one value, which must not switch it off."""
    import re

    from methframe.plans import general

    monkeypatch.setattr(orphans, "MAX_FILTER_BITS", bits)
    for child, parent, keys, row_key, at in general.REFERENCES:
        t = {name: spark.read.parquet(f"{small}/{name}.parquet") for name in (child, parent)}
        plan = orphans.find_orphans(t[child], t[parent], keys, row_key, at)._jdf.queryExecution().toString()
        plan = plan[plan.index("== Optimized Logical Plan ==") : plan.index("== Physical Plan ==")]
        assert "_need" in plan or "scalar-subquery" in plan
        columns = lambda name: len(re.findall(r"Relation \[" + t[name].columns[0] + "#", plan))
        assert columns(child) == 1 and columns(parent) <= 3  # keys for a sharded filter, validity, kind


# hot keys


def plain_totals(rows):
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        at = sorted({r[1] for r in mine if r[1] is not None})
        m = [r[2] for r in mine if r[2] is not None]
        out[k] = (len(mine), sum(m) if m else None, len(at), at[0] if at else None, at[-1] if at else None, max((b - a for a, b in zip(at, at[1:])), default=None))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(-3, 9))), max_size=60), st.integers(1, 7))
def test_key_totals(spark, rows, parts):
    df = spark.createDataFrame(rows, "k string, n_rows bigint, m int")
    got = hotkeys.key_totals(df, "k", "n_rows", ["m"], partitions=parts).toDF("k", "n", "m", "d", "first", "last", "gap")
    assert {r.k: (r.n, r.m, r.d, r.first, r.last, r.gap) for r in got.collect()} == plain_totals(rows)


def test_one_hot_position_is_spread(spark):
    rows = spark.range(40_000).selectExpr("'x' as k", "1L as o", "1 as m")
    from methframe.operators.ranged import ranged

    sizes = [len(p) for p in ranged(rows, ["k", "o"], partitions=8).rdd.glom().collect()]
    assert max(sizes) < 15_000
    got = hotkeys.key_totals(rows, "k", "o", ["m"], partitions=8).first()
    assert (got.n_rows, got.sum_m, got.n_o, got.max_gap) == (40_000, 40_000, 1, None)


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 8 + [("b", 1)] * 2 + [(None, 1)] * 90, "k string, o bigint")
    totals = hotkeys.key_totals(df, "k", "o", [])
    assert [r.k for r in hotkeys.heavy_keys(totals, df, "k", 8).collect()] == ["a"]
    assert hotkeys.heavy_keys(hotkeys.key_totals(df.limit(0), "k", "o", []), df.limit(0), "k", 8).count() == 0


# intervals


def plain_stretches(rows):
    out = []
    clean = [r for r in rows if None not in r and r[2] > r[1]]
    for k in {r[0] for r in clean}:
        merged = []
        for _, s, e in sorted((r for r in clean if r[0] == k), key=lambda r: r[1]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [("merged", k, *m) for m in merged] + [("gap", k, a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "x", "y", None]), st.one_of(st.none(), st.integers(0, 60)), st.one_of(st.none(), st.integers(0, 70))), max_size=50), st.integers(1, 9))
def test_stretches(spark, rows, parts):
    df = spark.createDataFrame(rows, "kind string, s bigint, e bigint")
    got = intervals.stretches_and_gaps(df.withColumnRenamed("kind", "sample"), ["sample"], "s", "e", parts)
    assert sorted(tuple(r) for r in got.collect()) == plain_stretches(rows)


def test_one_entity_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("x", s := rng.randrange(100_000), s + rng.choice([1, 5, 20, 3000 if rng.random() < 0.02 else 2])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "sample string, s bigint, e bigint")
    got = intervals.stretches_and_gaps(df, ["sample"], "s", "e", 13)
    assert sorted(tuple(r) for r in got.collect()) == plain_stretches(rows)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), max_size=30))
def test_interval_map(rows):
    found = intervals.IntervalMap()
    for s, n in rows:
        found.insert(s, s + n)
    plain = plain_stretches([("x", s, s + n) for s, n in rows])
    assert [("merged", "x", *x) for x in found.stretches()] == [r for r in plain if r[0] == "merged"]
    assert [("gap", "x", *x) for x in found.gaps()] == [r for r in plain if r[0] == "gap"]


# small files

FILES = "file_id bigint, cell_id string, chrom string, pos array<bigint>, mc array<int>, cov array<int>, rec_no string"


def plain_copies(files):
    seen, out = set(), []
    for fid, cell, chrom, *arrays, _ in sorted(files, key=lambda f: f[0]):
        n = max((len(a) for a in arrays if a), default=0)
        for i in range(n):
            rec = (cell.strip().split(".")[0].strip().lower() if cell is not None else None, chrom, *[(a[i] if a and i < len(a) else None) for a in arrays])
            if rec in seen:
                out.append((fid, i + 1))
            seen.add(rec)
    return sorted(out), len(seen)


def some_files(seed, n=60):
    rng = random.Random(seed)
    out = []
    for fid in range(n):
        k = rng.randrange(0, 9)
        pos = [rng.choice([None, 7, 7, 7, rng.randrange(12)]) if seed % 2 else rng.choice([7, 7, 7, rng.randrange(12)]) for _ in range(k)]
        pos = pos if fid % 3 else sorted(pos, key=lambda p: (p is not None, p))
        out.append((fid, rng.choice(["c1", " C1.cz", "c2", None]), rng.choice(["x", "x", "x", None]), pos if k else rng.choice([None, []]), [1] * k, [rng.randrange(1, 3) for _ in range(max(0, k - fid % 2))], "extra"))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_copies(spark, seed, ranges):
    files = some_files(seed)
    records = compaction.merged_records(spark.createDataFrame(files, FILES), ranges)
    expected, distinct = plain_copies(files)
    assert sorted(tuple(r) for r in compaction.copies(records).collect()) == expected
    assert compaction.kept(records).count() == distinct


def test_one_file_and_one_record_hold_most(spark):
    files = [(0, "c", "x", [5] * 3000 + list(range(6, 3006)), [1] * 6000, [2] * 6000, "")] + [(i, "c", "x", [5] * 10, [1] * 10, [2] * 10, "") for i in range(1, 200)]
    df = spark.createDataFrame(files, FILES)
    records = compaction.merged_records(df, 12)
    assert sorted(tuple(r) for r in compaction.copies(records).collect()) == plain_copies(files)[0]
    assert compaction.copies(compaction.merged_records(df, 12, copies_only=True)).count() == len(plain_copies(files)[0])
    sizes = [r["count"] for r in records.groupBy("part").count().collect()]
    assert sum(sizes) == 6000 + 1990 and max(sizes) < 2 * sum(sizes) / 12


def test_no_files(spark):
    none = spark.createDataFrame([], FILES)
    records = compaction.merged_records(none, 4)
    assert compaction.copies(records).count() == 0
    assert compaction.manifest(records).count() == 0


@pytest.mark.parametrize("target", [4000, 900])
def test_consolidated_files(spark, tmp_path, target):
    files = [(i, f"c{i % 3}" if i % 50 else None, "x", list(range(i, i + 20)), [1] * 20, [2] * 20, "") for i in range(200)]
    df = spark.createDataFrame(files, FILES)
    for _ in range(2):  # what is there is replaced
        compaction.compact(df, str(tmp_path / "out"), target)
    rows = spark.read.parquet(str(tmp_path / "out" / "_manifest")).collect()
    low, high = (lambda r: ((r.low_cell is not None, r.low_cell), r.low_pos)), (lambda r: ((r.high_cell is not None, r.high_cell), r.high_pos))
    rows.sort(key=low)
    assert sum(r.n_records for r in rows) == plain_copies(files)[1]
    assert all(high(a) < low(b) for a, b in zip(rows, rows[1:]))
    assert sum(r.n_bytes for r in rows) / target <= len(rows) < 1.5 * 200 * 20 * 19 / target + 2  # ranges are planned with the copies in
    assert {p.name for p in (tmp_path / "out").glob("*.parquet")} == {r.out_file for r in rows}
    for r in rows:
        one = pq.read_table(tmp_path / "out" / r.out_file)
        assert len(one) == r.n_records and r.n_bytes <= target
        assert one.column("pos")[0].as_py() == r.low_pos and one.column("pos")[-1].as_py() == r.high_pos
    written = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert not written[["cell", "chrom", "pos"]].duplicated().any() and len(written) == plain_copies(files)[1]


def test_the_merge_runs_once(spark, small):
    """One scan of the files and one merge in the plan of the manifest, and no sample on the driver beyond the cuts."""
    from methframe.plans import general

    plan = general.QUERIES["p4_manifest"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Relation") == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.integers(1, 30))
def test_rolling(widths, most):
    whole, parts = compaction._Merge(0, most), compaction._Merge(0, most)
    seq = whole.roll(np.array(widths, int)) if widths else np.zeros(0, int)
    sizes = [sum(w for w, s in zip(widths, seq) if s == k) for k in range(len(set(seq.tolist())))]
    assert sorted(set(seq.tolist())) == list(range(len(sizes)))
    assert all(x <= most or [w for w, s in zip(widths, seq) if s == k] == [x] for k, x in enumerate(sizes))
    cut = len(widths) // 2
    again = [parts.roll(np.array(x, int)) for x in (widths[:cut], widths[cut:]) if x]
    assert np.concatenate(again or [seq]).tolist() == seq.tolist()


def test_manifest_has_files_by_bytes(spark, small):
    """Few well-sized files, whatever the session's partitions are: the small table is one file."""
    from methframe.plans import general

    rows = general.QUERIES["p4_manifest"](spark, small).collect()
    assert [r.out_file for r in rows] == ["000000-0000"]
    files = spark.read.parquet(f"{small}/cz_files.parquet")
    assert rows[0].n_records == compaction.kept(compaction.merged_records(files, 5)).count()


# damaged lines

GOOD = "chr1\t12\t+\tCGA\t1\t2\t1"
LINES = [
    (GOOD, None), (GOOD + "\r", None), (GOOD, None), ("", "skip"), ("\r", "skip"), ("# x", "skip"), (None, "skip"), ("\r\r", "columns"), (" ", "columns"), (GOOD + "\t", "columns"), ("a\tb", "columns"),
    ('"a\tb"\t12\t+\tCGA\t1\t2\t1', None), ('"say ""x"""\t12\t+\tCGA\t1\t2\t1', None), ('a"\t12\t+\tCGA\t1\t2\t1', "quoting"), ('"a\t12\t+\tCGA\t1\t2\t1', "quoting"), ('"a"b\t12\t+\tCGA\t1\t2\t1', "quoting"), ('""\t12\t+\tCGA\t1\t2\t1', None),
    (GOOD.replace("12", "0"), "pos"), (GOOD.replace("12", "9223372036854775807"), None), (GOOD.replace("12", "9223372036854775808"), "pos"), (GOOD.replace("12", "0009223372036854775807"), None), (GOOD.replace("12", "٣"), "pos"), (GOOD.replace("12", "+1"), "pos"), (GOOD.replace("12", " 1"), "pos"), (GOOD.replace("12", ""), "pos"),
    ("c\t1\t+\tC\t65536\t1\t1", "mc"), ("c\t1\t+\tC\t0\t65536\t1", "cov"), ("c\t1\t+\tC\t3\t2\t1", "mc_over_cov"), ("c\t1\t+\tC\t-1\tx\t1", "mc"), ("c\t1\t+\tC\t00\t0\t1", None),
    ("c\rd\t1\t+\tC\t0\t0\tx\ny\x10a", None), ("c\t1\t+\tC\t0\t0\t" + "z" * 3_000_000, None), ('c\t1\t+\tC\t0\t0\t"' + "z" * 100_000, "quoting"), ("﻿c\t1\t+\tC\t0\t0\tx", None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(LINES)], "line_id bigint, raw string, reason string")
    parsed = lines.parse_lines(df, "line_id", "raw")
    valid, failed = lines.split_lines(parsed, "line_id")
    assert {r.line_id: r.reason for r in failed.collect()} == {i: r for i, (_, r) in enumerate(LINES) if r not in (None, "skip")}
    rows = {r.line_id: r for r in valid.collect()}
    assert set(rows) == {i for i, (_, r) in enumerate(LINES) if r is None}
    named = {LINES[i][0]: r for i, r in rows.items()}
    assert named['"a\tb"\t12\t+\tCGA\t1\t2\t1'].chrom == "a\tb"
    assert named['"say ""x"""\t12\t+\tCGA\t1\t2\t1'].chrom == 'say "x"'
    assert (named["c\rd\t1\t+\tC\t0\t0\tx\ny\x10a"].chrom, named["c\rd\t1\t+\tC\t0\t0\tx\ny\x10a"].flag) == ("c\rd", "x\ny\x10a")
    assert named["﻿c\t1\t+\tC\t0\t0\tx"].chrom == "﻿c"


def test_only_damaged_lines(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "line_id int, raw string").coalesce(1)
    assert [(r.line_id, r.reason) for r in lines.parse_lines(df, "line_id", "raw").orderBy("line_id").collect()] == [(1, "columns"), (2, "columns")]
    assert lines.parse_lines(df.limit(0), "line_id", "raw").count() == 0
