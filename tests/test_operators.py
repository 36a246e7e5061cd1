"""Operators that the SQL comparison doesn't reach: exact tests, permutation, text sources, stores, streams, ties and nulls."""

import gzip
import math
import random
import struct
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from methframe import cli
from methframe.functions import numbers, stats
from methframe.functions.rms import rms_p
from methframe.operators import align, dmr, features, index, intervals, merge, pivot, region
from methframe.sources import bam, store, text
from methframe.streaming import live
from pyspark.sql import functions as F

SITES = "cell_id string, chrom string, pos bigint, mc bigint, cov bigint"


def sites(spark, rows):
    return spark.createDataFrame(rows, SITES)


# numbers


def plain_fisher(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    p = lambda x: Fraction(math.comb(r, x) * math.comb(n - r, k - x), math.comb(n, k))
    return float(sum(p(x) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= p(a) * (1 + Fraction(1, 10**9))))


def test_fisher(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(0, top) for _ in range(4)) for top in (3, 9, 40, 300) for _ in range(60)] + [(0, 0, 0, 0), (5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    got = df.select("a", "b", "c", "d", stats.fisher_two_sided(*map(F.col, "abcd")).alias("p")).collect()
    assert max(abs(r.p - plain_fisher(r.a, r.b, r.c, r.d)) for r in got) < 1e-9


def test_deep_tables_and_nulls(spark):
    """Counts whose support would be long: against the symmetric case, the sum over the support, and no value for what is no table."""
    a = np.array([50_000, 60_000, 10, 100_000]), np.array([50_000, 40_000, 99_990, 0]), np.array([50_000, 50_000, 12, 0]), np.array([50_000, 50_000, 99_988, 100_000])
    got = stats.fisher_p(*a)
    assert got[0] == pytest.approx(1) and got[1] == 0.0 and got[3] == 0.0
    low = sum(math.exp(stats._Tables(*(x[2:3] for x in a)).log_p(np.array([x]))[0]) for x in range(11))
    assert got[2] == pytest.approx(2 * low, rel=1e-6)
    df = spark.createDataFrame([(1, 2, None, 4), (1, -2, 3, 4), (1, 2, 3, 4)], "a bigint, b bigint, c bigint, d bigint")
    assert [r.p is None for r in df.select(stats.fisher_two_sided(*map(F.col, "abcd")).alias("p")).collect()] == [True, True, False]
    assert df.select(stats.binomial_tail(F.col("a"), F.col("c"), F.lit(1.0)).alias("p")).where("p is not null").count() == 0
    assert stats.binomial_above(np.array([499_999]), np.array([1_000_000]), np.array([0.5]))[0] == pytest.approx(0.5004, abs=1e-4)


def test_binomial_tail_and_log_factorial(spark):
    rows = [(m, c, p) for c in (1, 7, 60) for m in range(0, c + 1, max(1, c // 5)) for p in (0.01, 0.4, 0.99)]
    df = spark.createDataFrame(rows, "mc bigint, cov bigint, p double").select("*", stats.binomial_tail(F.col("mc"), F.col("cov"), F.col("p")).alias("t"))
    for r in df.collect():
        assert abs(r.t - sum(math.comb(r["cov"], x) * r.p**x * (1 - r.p) ** (r["cov"] - x) for x in range(r.mc + 1, r["cov"] + 1))) < 1e-9
    for n, got in spark.range(0, 3000, 7).select("id", stats.log_factorial(F.col("id"))).collect():
        assert abs(got - math.lgamma(n + 1)) < 1e-8


def test_clamp_and_quantize(spark):
    df = spark.createDataFrame([(-5, -0.2), (300, 1.2), (None, None), (7, float("nan")), (255, 0.5)], "v bigint, f double")
    got = df.select(numbers.clamp(F.col("v"), "B").alias("b"), numbers.quantize(F.col("f"), 8, 0.0, 1.0).alias("q")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (255, 255), (None, 0), (7, 0), (255, 128)]
    assert df.limit(1).select(numbers.fraction(F.lit(0), F.lit(0)).alias("a"), numbers.fraction(F.lit(None).cast("int"), F.lit(0)).alias("b")).first() == (0.0, None)


@pytest.mark.parametrize("pattern,hits", [("CGN", 3), ("+CGN", 2), ("-CGN", 1), ("CHN", 1), ("NNN", 4), ("SGR", 2)])
def test_patterns(spark, pattern, hits):
    df = spark.createDataFrame([("CGA", "+"), ("cgt", "+"), ("CGG", "-"), ("CAT", "+"), (None, "+")], "context string, strand string")
    assert df.where(numbers.context_is(F.col("context"), F.col("strand"), pattern)).count() == hits


# regions


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "x", "y", None]), st.one_of(st.none(), st.integers(0, 300))), max_size=30), st.lists(st.tuples(st.sampled_from(["x", "x", "y", None]), st.integers(0, 300), st.integers(-3, 260)), max_size=12))
def test_range_join(spark, points, spans):
    spans = [(i, c, a, a + n) for i, (c, a, n) in enumerate(spans)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "mc bigint, chrom string, pos bigint")
    r = spark.createDataFrame(spans, "region_idx int, chrom string, low bigint, high bigint")
    got = sorted((x.region_idx, x.mc) for x in region.regions_query(p, r).collect())
    assert got == sorted((i, k) for i, c, a, b in spans for k, (d, q) in enumerate(points) if c is not None and c == d and q is not None and a <= q <= b)
    half = r.toDF("name", "chrom", "start_pos", "end_pos")
    others = [(c, q, q + 5) for c, q in points if q is not None]
    o = spark.createDataFrame(others, "chrom string, start_pos bigint, end_pos bigint")
    meets = {i for i, c, a, b in spans if c is not None and any(c == d and a < e and s < b for d, s, e in others)}
    proper = {i for i, c, a, b in spans if a < b}
    assert {x.name for x in region.overlaps_any(half, o).collect()} & proper == meets & proper
    assert {x.name for x in region.overlaps_any(half, o, negate=True).collect()} & proper == proper - meets


def test_range_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(region, "MAX_BROADCAST_ROWS", 0)
    p = spark.range(1000).selectExpr("'x' as chrom", "id as pos")
    r = spark.createDataFrame([(1, "x", 10, 19), (2, "x", 15, 900), (3, "y", 0, 5)], "region_idx int, chrom string, low bigint, high bigint")
    assert {x.region_idx: x["count"] for x in region.regions_query(p, r).groupBy("region_idx").count().collect()} == {1: 10, 2: 886}
    lists = {x.region_idx: len(x.records) for x in region.region_lists(p.withColumn("mc", F.lit(1)), r, ["mc"]).collect()}
    assert lists == {1: 10, 2: 886, 3: 0}


def test_touching_blacklist(spark):
    f = spark.createDataFrame([("x", 0, 10, "a"), ("x", 20, 30, "b")], "chrom string, start_pos bigint, end_pos bigint, name string")
    black = spark.createDataFrame([("x", 10, 12)], "chrom string, start_pos bigint, end_pos bigint")
    assert {r.name for r in features.mask(f, black).collect()} == {"a", "b"}
    assert {r.name for r in features.mask(f, black, touching=True).collect()} == {"b"}


def test_empty_tables(spark):
    none = sites(spark, [])
    ref = region.with_site_id(spark.createDataFrame([], "chrom string, pos bigint, strand string, context string"))
    spans = spark.createDataFrame([], "chrom string, start_pos bigint, end_pos bigint, name string")
    for df in (
        align.align(ref, none), merge.pseudobulk(none), merge.pseudobulk_mean(none), merge.bin_sums(none, 10), merge.global_rates(none), index.region_sums(none, spans), index.region_index(ref, spans), features.matrix(none, spans), features.named(spans),
        features.score(features.matrix(none, spans), "hypo-score"), features.beta_params(features.matrix(none, spans)), pivot.pivot_fraction(none, "cell_id", ["a"]), pivot.pivot_fisher(none, "cell_id"), dmr.call_one_vs_rest(none, "cell_id"),
        dmr.call_dmr(none.withColumn("in_a", F.lit(True))), dmr.call_dmr_ch(none.withColumn("in_a", F.lit(True))), features.merge_blacklist(spans), text.bedgraph(none, "meth"),
    ):
        assert df.count() == 0
    calls = "chrom string, start_pos bigint, end_pos bigint, frac_delta_mean double, p_min double, sname string, cell_class string"
    assert dmr.consensus(spark.createDataFrame([], calls)).count() == 0
    assert dmr.merged_results(spark.createDataFrame([], calls)).count() == 0


def test_names_get_numbers_only_if_one_repeats(spark):
    rows = [("x", 5, 6, "a"), ("x", 1, 2, "a"), ("x", 3, 4, None)]
    df = spark.createDataFrame(rows, "chrom string, start_pos bigint, end_pos bigint, name string")
    assert {r.name for r in features.named(df).collect()} == {"a_0", "a_1", "x:3-4_0"}
    assert {r.name for r in features.named(df.where("start_pos > 2")).collect()} == {"a", "x:3-4"}


# differential tests


def plain_islands(rows, dist):
    out = []
    for chrom in {r[0] for r in rows}:
        last, known = None, 0.0
        for _, pos, delta in sorted(r for r in rows if r[0] == chrom):
            sign = float(np.sign(delta))
            if last is None or pos - last > dist or (sign and known and sign != known):
                out.append([chrom, pos - 1, pos, 0])
                known = 0.0
            known = sign or known
            out[-1][2], last = pos, pos
            out[-1][3] += 1
    return sorted(map(tuple, out))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(1, 200), st.sampled_from([-0.5, 0.0, 0.0, 0.5])), unique_by=lambda r: r[:2], max_size=40))
def test_islands(spark, rows):
    df = spark.createDataFrame([(c, p, 0.01, d) for c, p, d in rows], "chrom string, pos bigint, p double, delta double")
    got = dmr.merge_sites(df, 10)
    assert sorted((r.chrom, r.start_pos, r.end_pos, r.n_dms) for r in got.collect()) == plain_islands(rows, 10)


def test_bh_with_ties_and_nulls(spark):
    rows = [(1, None, 0.01), (2, None, 0.01), (3, None, 0.5), (4, None, None), (5, "s", float("nan")), (6, "s", 0.2)]
    got = {r.i: r.q for r in dmr.bh_fdr(spark.createDataFrame(rows, "i int, s string, p double"), "p", ["s"]).collect()}
    assert got[1] == got[2] == pytest.approx(0.015) and got[3] == pytest.approx(0.5) and got[4] is None and got[5] is None and got[6] == pytest.approx(0.2)


def one_draw_at_a_time(mc, cov, in_a, seed, n, min_p):
    table = np.stack([mc, cov - mc], 1)
    real, m = dmr.rms_statistic(table), int(table.sum())
    chance = (table.sum(1, keepdims=True) * table.sum(0, keepdims=True)).ravel() / m**2
    rng, hits = np.random.default_rng(seed), 1
    for i in range(n):
        hits += dmr.rms_statistic(rng.multinomial(m, chance / chance.sum()).reshape(-1, 2)) >= real - 1e-12
        if hits > n * min_p:
            return hits / (i + 2)
    return hits / n


def test_batches_of_permutations_equal_single_draws():
    rng = np.random.default_rng(2)
    for seed in range(12):
        cov = rng.integers(1, 12, 8)
        mc = rng.binomial(cov, np.where(np.arange(8) < 4, 0.7, 0.4))
        in_a = np.arange(8) < 4
        p, delta = dmr.rms_test(mc, cov, in_a, seed, 500, 0.05, 50, 3000)
        assert p == pytest.approx(one_draw_at_a_time(mc, cov, in_a, seed, 500, 0.05))
        assert delta == pytest.approx((mc / cov)[in_a].mean() - (mc / cov)[~in_a].mean())
    assert dmr.rms_test(np.array([1]), np.array([2]), np.array([True]), 1, 10, 0.1, 50, 300) == (1.0, 0.0)
    assert dmr.rms_test(np.array([9000, 10]), np.array([9999, 9999]), np.array([True, False]), 1, 100, 0.5, 50, 60)[0] <= 0.02


def group_sites(spark, shift, back=False):
    rng = random.Random(3)
    rows = []
    for pos in list(range(100, 200, 10)) + list(range(5000, 5100, 10)):
        for cell in range(10):
            rate = (0.9 if cell < 5 else 0.1) if pos < 1000 and shift else (0.1 if cell < 5 else 0.9) if back else 0.5
            cov = rng.randrange(6, 12)
            rows.append((f"c{cell}", "x", pos, sum(rng.random() < rate for _ in range(cov)), cov, cell < 5))
    return spark.createDataFrame(rows, SITES + ", in_a boolean")


def test_regions_that_differ_are_called(spark):
    got = dmr.call_dmr(group_sites(spark, True)).collect()
    assert [(r.start_pos, r.end_pos, r.n_dms, r.state) for r in got] == [(99, 190, 10, "hyper")]
    assert got == dmr.call_dmr(group_sites(spark, True).repartition(7)).collect()
    assert dmr.call_dmr(group_sites(spark, False)).count() == 0
    # cells of equal overall rate, so that scaling changes little
    ch = dmr.call_dmr_ch(group_sites(spark, True, True), bin=50, p=0.01, min_dms=1, max_dist=50, permutations=2000).orderBy("start_pos").collect()
    assert [(r.chrom, r.start_pos, r.end_pos, r.n_dms, r.state) for r in ch] == [("x", 50, 200, 3, "hyper"), ("x", 4950, 5100, 3, "hypo")]


def test_annotation_ties(spark):
    df = spark.createDataFrame([("x", 0.5, 0.5, 0.1), ("y", None, 0.2, 0.2), ("z", None, None, None)], "k string, a double, b double, c double")
    got = {r.k: r for r in dmr.annotate(df, ["k"], ["a", "b", "c"]).collect()}
    assert (got["x"].hypo_sample, got["x"].hyper_sample) == ("c", "a")
    assert (got["y"].hypo_sample, got["y"].hyper_sample, got["y"].delta_beta) == ("b", "b", 0)
    assert "z" not in got


# text and stores


def test_quantized_table(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 0.25), ("x", 2, 1.0)], "chrom string, pos bigint, beta double")
    path, message = str(tmp_path / "q"), '{"quant": {"beta": ["B", 0, 1]}}'
    store.write(df.withColumn("beta", numbers.quantize(F.col("beta"), 8, 0.0, 1.0)), path, message=message)
    assert [round(r.beta, 2) for r in store.read_dequantized(spark, path).orderBy("pos").collect()] == [0.25, 1.0]
    assert numbers.quantization(message) == {"beta": ("B", 0.0, 1.0)}
    assert all(numbers.quantization(m) == {} for m in (None, "", "mm10", "[]", '{"quant": 3}', '{"quant": {"b": [1]}}'))


def test_cytosines(spark):
    seq = "CGnacgtcCX" * 3
    got = {(r.chrom, r.pos): (r.strand, r.context) for r in text.cytosines(spark.createDataFrame([("a", seq), ("b", ""), ("c", None), ("d", "G")], "chrom string, seq string")).collect()}
    s, back = seq.upper(), str.maketrans("ACGTN", "TGCAN")
    plain = {("d", 1): ("-", "CNN")}
    for i, ch in enumerate(s):
        if ch == "C":
            plain["a", i + 1] = ("+", (s + "NN")[i : i + 3])
        elif ch == "G":
            plain["a", i + 1] = ("-", ("NN" + s)[i : i + 3].translate(back)[::-1])
    assert got == plain


@pytest.mark.parametrize("piece,width", [(7, 5), (50, 11), (1 << 20, 60)])
def test_fasta_in_pieces(spark, tmp_path, piece, width):
    """Pieces, lines and splits anywhere: the sites are those of the whole sequences."""
    rng = random.Random(piece)
    seqs = {f"c{i}": "".join(rng.choice("ACGTNacg") for _ in range(n)) for i, n in enumerate((1, 400, 0, 2, 333, 90))}
    for k, names in enumerate((["c0", "c1", "c2"], ["c3", "c4", "c5"])):
        lines = [x for c in names for x in [f">{c} about", *[seqs[c][i : i + width] for i in range(0, len(seqs[c]), width)]]]
        (tmp_path / f"g{k}.fa").write_text("\n".join((["stray"] if k else []) + lines) + "\n")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        pieces = text.read_fasta(spark, str(tmp_path), piece)
        assert pieces.agg(F.max(F.length("seq"))).first()[0] <= piece
        got = sorted(map(tuple, text.cytosines(pieces).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert got == sorted(map(tuple, text.cytosines(spark.createDataFrame(list(seqs.items()), "chrom string, seq string")).collect()))


def test_block_sizes():
    blocks = [bgzf(bytes([i]) * 1000) for i in range(5)]
    plain = gzip.compress(b"x" * 10)
    assert bam.inflate(b"".join(blocks) + plain + plain) == b"".join(bytes([i]) * 1000 for i in range(5)) + b"x" * 20
    with pytest.raises(ValueError):
        bam.inflate(b"".join(blocks)[:-3])


def bgzf(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def plain_regions(rows, dist):
    out = []
    for k in {r[0] for r in rows}:
        known, before, mine = 0, None, None
        for _, pos, p, d in sorted(r for r in rows if r[0] == k):
            sign = (d > 0) - (d < 0)
            if before is None or pos - before > dist or (sign and known and sign != known):
                known = known if before is not None and pos - before <= dist else 0
                mine = []
                out.append((k, mine))
            known, before = sign or known, pos
            mine.append((pos, p, d))
    return sorted((k, m[0][0] - 1, m[-1][0], len(m), min(x[1] for x in m), round(sum(x[2] for x in m) / len(m), 9)) for k, m in out)


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 5, 60, 700]))
def test_regions_over_many_partitions(spark, seed, n):
    rng = random.Random(seed)
    rows = [(k, p, rng.random(), rng.choice([-0.5, 0.5, 0.0, 0.0, 0.25])) for k in ("a", "b", None) for p in rng.sample(range(1, 3 * n + 5), n)]
    got = dmr.merge_sites(spark.createDataFrame(rows, "chrom string, pos bigint, p double, delta double"), 4).collect()
    key = lambda r: (str(r[0]), *r[1:])
    want = plain_regions([(str(k), *r) for k, *r in rows], 4)
    assert sorted(key((r.chrom, r.start_pos, r.end_pos, r.n_dms, r.p_min, round(r.frac_delta_mean, 9))) for r in got) == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "x", "y", None]), st.one_of(st.none(), st.integers(0, 9))), max_size=40), st.integers(1, 9))
def test_numbers_within_groups(spark, rows, parts):
    from methframe.operators.ranged import numbered

    df = spark.createDataFrame(rows, "g string, o bigint")
    got = sorted((str(r.g), r["rank"], -1 if r.o is None else r.o) for r in numbered(df, ["g"], ["o"], partitions=parts).collect())
    order = sorted((str(g), -1 if o is None else o) for g, o in rows)
    assert got == [(g, i - next(j for j, x in enumerate(order) if x[0] == g), o) for i, (g, o) in enumerate(order)]
    assert sorted(r["rank"] for r in numbered(df, [], ["g", "o"], partitions=parts).collect()) == list(range(len(rows)))


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nCC\n>chr2\nGG\n")
    got = {}
    for r in text.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("chrom", "start").collect():
        assert r.start == len(got.get(r.chrom, ""))
        got[r.chrom] = got.get(r.chrom, "") + r.seq
    assert got == {"chr1": "ACGTCC", "chr2": "GG"}
    (tmp_path / "f.bed").write_text("track x\n#c\nchr1\t1\t5\tn\nchr1\t7\t9\nchr2\tx\t9\n")
    assert sorted((r.start_pos, r.end_pos, r.name) for r in text.read_bed(spark, str(tmp_path / "f.bed")).collect()) == [(1, 5, "n"), (7, 9, None)]
    (tmp_path / "s.fai").write_text("chr1\t99\t0\n")
    assert text.read_chrom_sizes(spark, str(tmp_path / "s.fai")).collect() == [("chr1", 99)]
    with gzip.open(tmp_path / "cell7.allc.tsv.gz", "wt") as f:
        f.write("chr1\t5\t+\tCGA\t1\t2\t1\n")
    assert text.read_allc(spark, str(tmp_path / "cell7.allc.tsv.gz")).first().sample == "cell7"
    (tmp_path / "bad.tsv").write_text("chr1\t5\t+\tCGA\t1\t2\t1\nchr1\t5\n")
    assert sorted(r.reason or "" for r in text.read_allc_checked(spark, str(tmp_path / "bad.tsv")).collect()) == ["", "columns"]
    gtf = 'x\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N";\nx\ts\tgene\t5\t40\t.\t-\t.\tgene_id "G2"; gene_name "N";\n#c\nbad\n'
    (tmp_path / "g.gtf").write_text(gtf)
    assert [tuple(r)[:4] for r in features.parse_gtf(text.read_gtf_lines(spark, str(tmp_path / "g.gtf")), flank=10).collect()] == [("N", "x", 0, 50)]


def test_pileup(spark):
    assert text.strip_indels("..+2AC,^].$-1t*T") == "..,.$*T"
    rows = [("x", 1, "C", 4, "..+3TTTT,"), ("x", 2, "g", 4, ",a.A"), ("x", 3, "A", 1, "."), ("x", 4, "C", 0, None)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, ref string, depth int, bases string")
    assert sorted((r.pos, r.strand, r.mc, r["cov"]) for r in text.pileup_counts(df).collect()) == [(1, "+", 2, 3), (2, "-", 1, 2)]


def test_store(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", rng.choice(["chr1", "chr1", "chr2"]), rng.randrange(10_000), 300, 70_000) for _ in range(500)]
    df = store.typed(sites(spark, rows), {"mc": "B", "cov": "H"})
    path = str(tmp_path / "t")
    store.write(df, path, message="mm10")
    store.write(df.limit(10), path, mode="append")
    back = store.read(spark, path)
    assert back.count() == 510 and back.where("mc = 255 and cov = 65535").count() == 510
    assert store.header(spark, path)["dims"] == ["chrom"]
    plan = region.region(back, "chr2", 10, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(pos,10)" in plan
    assert sum(r.n_rows for r in store.chunks(back).collect()) == 510
    assert sum(r.n_rows for r in store.files(back).collect()) == 510
    shown = [r.chrom for r in store.ordered(back, ["chr2", "chr1", "none"]).collect()]
    assert shown == sorted(shown, reverse=True)


# alignments


TAGS = {"a": b"NMC\x01XGZGA\0", "b": b"ZBBs\x02\0\0\0\1\0\2\0YZA+"}


def bam_bytes(reads):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    body = b""
    for name, flag, pos, mapq, cigar, seq, qual in reads:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        rec = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(qual) + TAGS.get(name, b"")
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    data = head + body
    for i in range(0, len(data), 100):  # small blocks, so that records cross them
        piece = data[i : i + 100]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        comp = z.compress(piece) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(comp) + 25) + comp + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


def test_bam(spark, tmp_path):
    genome = spark.createDataFrame([("chr1", "ACGTCCGATTTT")], "chrom string, seq string")
    q = [30] * 8
    reads = [
        ("a", 0, 0, 60, [(8, "M")], "ACGTTCGA", q), ("b", 0, 0, 60, [(2, "M"), (1, "I"), (4, "M"), (1, "S")], "ATTGTCCA", q), ("c", 16, 0, 60, [(8, "M")], "ACATCCGA", q),
        ("low", 0, 0, 5, [(8, "M")], "ACGTCCGA", q), ("dup", 1024, 0, 60, [(8, "M")], "ACGTCCGA", q), ("dim", 0, 0, 60, [(8, "M")], "ACGTCCGA", [5] * 8), ("del", 0, 0, 60, [(1, "M"), (3, "D"), (2, "M")], "ACC", [30] * 3),
    ]
    (tmp_path / "x.bam").write_bytes(bam_bytes(reads))
    aligned = bam.read_bam(spark, str(tmp_path / "*.bam"))
    assert aligned.count() == 7
    got = {(r.pos, r.strand): (r.mc, r["cov"], r.context) for r in bam.count_sites(aligned, genome).collect()}
    assert {r.name: r.converted for r in aligned.collect() if r.name in "abc"} == {"a": False, "b": True, "c": None}
    turned = {(r.pos, r.strand): (r.mc, r["cov"]) for r in bam.count_sites(aligned, genome, by_conversion=True).collect()}
    assert turned[2, "+"] == (0, 1) and turned[3, "-"] == (1, 2)  # a now tells of the G at 3, no longer of the C at 2
    # C at 2, 5, 6 on forward reads a, b, del; G at 3, 7 on the backward read c
    assert got == {(2, "+"): (1, 2, "CGT"), (5, "+"): (2, 3, "CCG"), (6, "+"): (3, 3, "CGA"), (3, "-"): (0, 1, "CGT"), (7, "-"): (1, 1, "CGG")}


# streams


def run(stream, mode):
    name = f"t{time.time_ns()}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return name


def test_streams(spark, tmp_path, small):
    rows = [("c1", "x", p, 1, 2) for p in range(5)]
    sites(spark, rows).write.parquet(str(tmp_path / "a"), mode="append")
    sites(spark, rows).write.parquet(str(tmp_path / "a"), mode="append")
    source = spark.readStream.schema(SITES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    assert {tuple(r) for r in spark.table(run(live.live_pseudobulk(source), "complete")).collect()} == {("x", p, 2, 4) for p in range(5)}
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    assert spark.table(run(live.event_windows(stream, "1 hour", "1000 days"), "complete")).agg(F.sum("n")).first()[0] == events.count()


def test_live_intervals(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), s := rng.randrange(300), s + rng.randrange(-2, 15)) for _ in range(90)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "k string, s bigint, e bigint").coalesce(1).write.parquet(str(tmp_path / "i"), mode="append")
    stream = spark.readStream.schema("k string, s bigint, e bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "i"))
    out = spark.table(run(live.live_intervals(stream, ["k"], "s", "e"), "update")).collect()
    newest = {r.k: max(x.version for x in out if x.k == r.k) for r in out}
    last = [r for r in out if r.version == newest[r.k]]
    batch = intervals.stretches_and_gaps(spark.createDataFrame(rows, "k string, s bigint, e bigint"), ["k"], "s", "e")
    assert sorted((r.kind, r.k, r.s, r.e) for r in last) == sorted((r.kind, r.k, r.s, r.e) for r in batch.collect())


# command line


def test_cli(spark, tmp_path, capsys):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    store.write(sites(spark, [("c1", "x", 5, 1, 2), ("c2", "x", 6, 0, 2), ("c2", "y", 5, 3, 3)]), path)
    cli.main(["query", path, "-c", "x", "-s", "5", "-e", "5"], spark)
    assert "c1" in capsys.readouterr().out
    cli.main(["merge", path, "-o", out], spark)
    assert spark.read.parquet(out).count() == 3
    cli.main(["summary", path], spark)
    cli.main(["header", path], spark)
    assert '"dims"' in capsys.readouterr().out
    cli.main(["bedgraph", path, "-o", out, "--signal", "meth"], spark)
    assert spark.read.csv(out, sep="\t").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_callables(spark):
    ref = spark.createDataFrame([("x", 1, "CGA", "+"), ("x", 2, "CAT", "-")], "chrom string, site_id bigint, context string, strand string")
    assert [r.site_id for r in index.context_index(ref, lambda context, strand: (strand == "-") & context.startswith("CA")).collect()] == [2]
    assert {r.cell_id for r in align.union_tables({"a.cz": ref, "b.cz": ref}, key_of=lambda name: name.split(".")[0]).collect()} == {"a", "b"}


def test_large_tables_have_more_ranges(spark, small, monkeypatch):
    from methframe.operators import ranged

    df = spark.read.parquet(f"{small}/cell_sites.parquet").where("chrom is not null").select("chrom", "pos", "rec_id")
    assert ranged.ranges_of(df) == 4
    monkeypatch.setattr(ranged, "RANGE_BYTES", 1000)
    assert ranged.ranges_of(df) > 20 and ranged.ranged(df, ["chrom", "pos"], "rec_id").rdd.getNumPartitions() > 20
    monkeypatch.setattr(ranged, "MOST_RANGES", 7)
    assert ranged.ranges_of(df) == 7 and ranged.ranges_of(spark.range(10)) == 4


def test_cli_of_callers(spark, tmp_path):
    path, out, matrix = (str(tmp_path / x) for x in ("t", "out", "m"))
    rows = [(c, "x", pos, 38 if (c < "c3") == (pos < 2000) else 2, 40) for c in ("c1", "c2", "c3", "c4") for pos in range(1000, 3000, 100)]
    store.write(sites(spark, rows), path)

    def told(*args):
        cli.main([*args, "-o", out], spark)
        return spark.read.parquet(out).collect()

    calls = told("call-dmr", path, "--group-a", "c1,c2", "--max-dist", "500", "--permutations", "2000", "--p", "0.05")
    assert sorted((r.start_pos, r.end_pos, r.state) for r in calls) == [(999, 1900, "hyper"), (1999, 2900, "hypo")]
    assert told("call-dmr", path, "--group-a", "c1", "--group-b", "c3", "--max-dist", "500", "--p", "0.05") and told("call-dmr-ch", path, "--group-a", "c1,c2", "--bin", "500", "--min-dms", "1", "--p", "0.2")
    assert {r.cell_id for r in told("call-one-vs-rest", path, "--min-class-size", "2")} <= {"c1", "c2", "c3", "c4"}
    assert len(told("pivot-fraction", path, "--names", "c1,c3")) == 20 and "c1_pval" in told("pivot-fisher", path, "--names", "c1,c2")[0]
    assert len(told("pivot-fisher", path)) == len(told("combp-input", path)) == 80
    assert len(told("pseudo-reads", path, "--signal", "meth")) == sum(r[3] for r in rows)
    assert {r.file for r in told("concat", path, path, "--key-added", "file")} == {"t"}
    spark.createDataFrame([("x", 999, 1900, 0.9, 0.1, 7)], "chrom string, start_pos bigint, end_pos bigint, c1 double, c3 double, extra int").write.parquet(matrix)
    spark.createDataFrame([("x", 999, 1900, 10, "c1", None, 0.01, 0.8, 0.9, 0.1), ("x", 5, 9, 1, "c1", None, 0.5, -0.8, 0.0, 0.1)], "chrom string, start_pos bigint, end_pos bigint, n_dms int, sname string, cell_class string, p_min double, frac_delta_mean double, rate_a double, rate_b double").write.parquet(str(tmp_path / "calls"))
    assert [(r.hyper_sample, r.n_dms) for r in told("annot-dmr", str(tmp_path / "calls"), "--matrix", matrix, "--samples", "c1,c3")] == [("c1", 10)]
    merged = {r.start_pos: r for r in told("merge-dmr", str(tmp_path / "calls"))}
    assert merged[999].log2fc == pytest.approx(math.log2(9)) and merged[5].log2fc is None and merged[5].delta_rate == pytest.approx(-0.1)
    (tmp_path / "in.tsv").write_text("x\t5\t300\t400\n#c\nx\t6\t1\t2\n")
    cli.main(["import-table", str(tmp_path / "in.tsv"), "-o", out, "--columns", "chrom:c,pos:Q,mc:B,cov:H"], spark)
    assert sorted((r.pos, r.mc, r["cov"]) for r in spark.read.parquet(out).collect()) == [(5, 255, 400), (6, 1, 2)]
    with gzip.open(tmp_path / "s1.allc.tsv.gz", "wt") as f:
        f.write("x\t5\t+\tCGA\t1\t2\t1\n")
    spark.createDataFrame([("x", 5, "+", "CGA"), ("x", 9, "+", "CGT")], "chrom string, pos bigint, strand string, context string").write.parquet(str(tmp_path / "ref"))
    assert sorted((r.cell_id, r.pos, r["cov"]) for r in told("import-allc", str(tmp_path / "s1.allc.tsv.gz"), "-r", str(tmp_path / "ref"))) == [("s1", 5, 2), ("s1", 9, 0)]


def test_dmr_ch_has_the_callers_permutations(spark, small, monkeypatch):
    """10 hits of 10,000 permutations before a test stops early, as the reference has it."""
    from methframe.plans import reference

    seen, test = [], dmr.permutation_test
    monkeypatch.setattr(dmr, "permutation_test", lambda sites, keys, how, *seed: (seen.append(how), test(sites, keys, how, *seed))[1])
    reference.QUERIES["dmr_ch"](spark, small)
    assert [(how["permutations"], how["permutations"] * how["min_p"]) for how in seen] == [(10_000, 10)]


def test_one_vs_rest_keeps_the_samples_apart(spark):
    """As the two-group caller gives it, sample by sample; one deep sample doesn't stand for the rest."""
    rows = []
    for pos in range(100, 200, 10):
        for s in range(6):
            rows.append((f"s{s}", "k", "x", pos, 18 if s == 0 else 1, 20))
        rows.append(("deep", "k", "x", pos, 360, 400))  # like s0: pooled, it hides that s0 differs from the others
        rows += [("s8", "two", "x", pos, 19, 20), ("s9", "two", "x", pos, 1, 20), ("s7", "lone", "x", pos, 9, 20), ("s6", None, "x", pos, 9, 20)]
    df = spark.createDataFrame(rows, "sname string, cell_class string, chrom string, pos bigint, mc bigint, cov bigint")
    shape = lambda out, *key: sorted((*[r[k] for k in key], r.chrom, r.start_pos, r.end_pos, r.n_dms, r.state, round(r.frac_delta_mean, 9)) for r in out.collect())
    known = df.where("cell_class = 'k'")
    for method, call, how in (("cg", dmr.call_dmr, {"permutations": 500, "p": 0.05}), ("ch", dmr.call_dmr_ch, {"permutations": 500, "p": 0.05, "bin": 50, "min_samples": 1, "min_dms": 1, "max_dist": 50})):
        expected = []
        for s in [r.sname for r in known.select("sname").distinct().collect()]:
            expected += [(s, *r) for r in shape(call(known.withColumn("in_a", F.col("sname") == s).withColumn("cell_id", F.col("sname")), **how))]
        assert shape(dmr.call_dmr_one_vs_rest(known, "sname", method=method, **how), "sname") == sorted(expected)
        classed = shape(dmr.call_dmr_one_vs_rest(df, "sname", "cell_class", method, **how), "cell_class", "sname")
        assert [r[1:] for r in classed if r[0] == "k"] == sorted(expected) and {r[0] for r in classed} <= {"k", "two"}
        if method == "cg":
            assert "s0" in {r[0] for r in expected} and "s0" not in {r[0] for r in shape(dmr.call_one_vs_rest(known, "sname", p=0.05), "sname")}
            assert [r[1] for r in classed if r[0] == "two"] == ["s8", "s9"]


def test_many_tables_have_the_p_of_single_draws():
    """The chances of a draw are those of the multinomial table, whatever its total; a p knows its own table and seed only."""
    rng = np.random.default_rng(5)
    tables, n = [], 20_000
    for cells, cov in ((2, 3), (7, 9), (12, 40), (60, 8), (40, 90)):
        c = rng.integers(1, 2 * cov, cells)
        c[0] = cov
        mc = rng.binomial(c, rng.uniform(0.3, 0.6, cells))
        tables.append(np.stack([mc, c - mc], 1))
    tables.append(np.array([[0, 4], [0, 0], [0, 9]]))
    got = rms_p(tables, list(range(6)), n, 2.0)
    for t, p in zip(tables, got):
        m = t.sum()
        chance = (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)).ravel() / m**2
        expected = np.mean(dmr.rms_statistic(rng.multinomial(m, chance / chance.sum(), n).reshape(n, -1, 2)) >= dmr.rms_statistic(t) - 1e-12)
        assert abs(p - expected) < 5 * (2 * expected * (1 - expected) / n) ** 0.5 + 2 / n
    assert [rms_p([t], [i], n, 2.0)[0] for i, t in enumerate(tables)] == list(got)
    early = rms_p(tables, list(range(6)), 3000, 0.01)  # over 30 hits: no more draws
    assert all(round(31 / p) == pytest.approx(31 / p) for p in early if p > 31 / 3000) and early[5] == pytest.approx(31 / 31)
    assert rms_p([np.array([[1, 2]]), np.zeros((3, 2), int)], [1, 2], 100, 0.1).tolist() == [1, 1]


def own_p(spark, within, method):
    """Samples that differ alike from the others, at one site each of two chromosomes, with one overall rate; the p by region."""
    rows = [(f"s{s}", "k", c, 100, 8 if s % 2 == (c == "x") else 3, 12) for s in range(10) for c in "xy"]
    df = spark.createDataFrame(rows, "sname string, cell_class string, chrom string, pos bigint, mc bigint, cov bigint")
    how = {"p": 0.5, "log2fc": 0.1} | ({"min_samples": 1, "min_dms": 1} if method == "ch" else {})
    return sorted((r.chrom, r.sname, r.p_min) for r in dmr.call_dmr_one_vs_rest(df, "sname", within, method, **how).collect())


def test_a_site_is_tested_once_for_all_its_samples(spark):
    got = own_p(spark, None, "cg")
    assert len(got) == 20 and [len({p for c, _, p in got if c == x}) for x in "xy"] == [1, 1]


def test_a_bin_is_tested_once_for_all_its_samples(spark):
    got = own_p(spark, None, "ch")
    assert len(got) == 20 and [len({p for c, _, p in got if c == x}) for x in "xy"] == [1, 1]


def test_a_site_is_tested_once_for_the_samples_of_a_class(spark):
    got = own_p(spark, "cell_class", "cg")
    assert len(got) == 20 and [len({p for c, _, p in got if c == x}) for x in "xy"] == [1, 1]
