"""Differential testing: sites, regions, false discovery and consensus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methframe.functions.rms import rms_p
from methframe.functions.stats import fisher_p, fisher_two_sided
from methframe.operators.intervals import number_stretches
from methframe.operators.merge import bin_sums
from methframe.operators.ranged import changes, part_id, ranged, ranges_of
from methframe.session import checkpointed, shipped

#: The defaults of both callers.
CG = {"p": 1e-3, "delta": 0.2, "min_cov": 1, "min_samples": 1, "max_dist": 250, "min_dms": 1, "permutations": 3000, "min_p": 0.01, "max_row": 50, "max_total": 3000}
CH = {"bin": 5000, "p": 1e-3, "delta": 0.005, "log2fc": 1.0, "min_cov": 3, "min_samples": 2, "max_dist": 2000, "min_dms": 2, "permutations": 10_000, "min_p": 0.001, "max_row": 200, "max_total": 10_000}


def rms_statistic(tables: np.ndarray) -> np.ndarray:
    """The root mean square distance to independence of (…, cells, 2) tables."""
    m = tables.sum((-2, -1), keepdims=True)
    expected = tables.sum(-1, keepdims=True) * tables.sum(-2, keepdims=True) / np.maximum(m, 1)
    return np.sqrt(((tables - expected) ** 2).sum((-2, -1)) / (2 * tables.shape[-2]))


def counts_table(mc: np.ndarray, cov: np.ndarray, max_row: int, max_total: int) -> np.ndarray:
    """The (cells, 2) table of a site, with rows scaled down to ``max_row`` and the whole to ``max_total``."""
    table = np.stack([mc, np.maximum(cov - mc, 0)], 1).astype(np.int64)
    total = table.sum(1)
    big = total > max_row
    if big.any():
        table[big, 0] = (table[big, 0] * max_row / total[big] + 0.5).astype(np.int64)
        table[big, 1] = max_row - table[big, 0]
    if table.sum() > max_total:
        table = (table * (max_total / table.sum()) + 0.5).astype(np.int64)
    return table


def rms_test(mc: np.ndarray, cov: np.ndarray, in_a: np.ndarray, seed: int, permutations: int, min_p: float, max_row: int, max_total: int) -> tuple[float, float]:
    """p and delta (mean fraction of group A less that of B) of one site; cells without coverage don't count."""
    use = cov > 0
    order = np.argsort(~in_a[use], kind="stable")
    mc, cov, in_a = mc[use][order], cov[use][order], in_a[use][order]
    if len(mc) < 2 or in_a.all() or not in_a.any():
        return 1.0, 0.0
    rate = mc / cov
    delta = float(rate[in_a].mean() - rate[~in_a].mean())
    table = counts_table(mc, cov, max_row, max_total)
    real, m = rms_statistic(table), int(table.sum())
    chance = (table.sum(1, keepdims=True) * table.sum(0, keepdims=True)).ravel() / float(m) ** 2
    rng, hits, done, limit, size = np.random.default_rng(seed), 1, 0, permutations * min_p, 64
    while done < permutations:
        k = min(size, permutations - done)
        at = hits + np.cumsum(rms_statistic(rng.multinomial(m, chance / chance.sum(), k).reshape(k, -1, 2)) >= real - 1e-12)
        over = np.flatnonzero(at > limit)
        if len(over):
            i = int(over[0])
            return float(at[i] / (done + i + 2)), delta
        hits, done, size = int(at[-1]), done + k, min(size * 4, 1024)
    return hits / permutations, delta


def eligible(cells: DataFrame, min_cov: int, min_samples: int, keys: list[str]) -> DataFrame:
    """Per site the cells' counts as lists, for sites with enough covering cells in both groups.

    ``cells``: keys, in_a (boolean), mc, cov with one row per cell. Also rate_a, rate_b: means of the cells' fractions, unweighted.
    """
    n = lambda a: F.sum(F.when((F.col("in_a") == a) & (F.col("cov") >= min_cov), 1).otherwise(0))
    rate = lambda a: F.avg(F.when((F.col("in_a") == a) & (F.col("cov") > 0), F.col("mc") / F.col("cov")))
    agg = cells.where("in_a is not null").groupBy(*keys).agg(n(True).alias("n_a"), n(False).alias("n_b"), rate(True).alias("rate_a"), rate(False).alias("rate_b"), F.collect_list(F.struct("in_a", "mc", "cov")).alias("cells"))
    return agg.where((F.col("n_a") >= min_samples) & (F.col("n_b") >= min_samples))


def permutation_test(sites: DataFrame, keys: list[str], how: dict, seed: int = 7) -> DataFrame:
    """keys, rate_a, rate_b, p, delta for sites with a list ``cells``; the seed of a site comes from its keys, so partitions don't matter."""

    shipped()

    @F.pandas_udf("p double, delta double")
    def test(in_a: pd.Series, mc: pd.Series, cov: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for a, m, c, key in zip(in_a, mc, cov, at):
            order = np.lexsort((c, m, a))  # a list's order may vary between runs
            out.append(rms_test(m[order], c[order], a[order] == 1, int(key) & 0x7FFFFFFF, how["permutations"], how["min_p"], how["max_row"], how["max_total"]))
        return pd.DataFrame(out, columns=["p", "delta"])

    lists = [F.col("cells.in_a").cast("array<bigint>"), F.col("cells.mc").cast("array<bigint>"), F.col("cells.cov").cast("array<bigint>")]
    tested = sites.withColumn("t", test(*lists, F.xxhash64(F.lit(seed), *keys)))
    return tested.select(*keys, "rate_a", "rate_b", F.col("t.p").alias("p"), F.col("t.delta").alias("delta"))


def prefilter(sites: DataFrame, delta: float) -> DataFrame:
    """Sites whose group means differ by at least ``delta``: what the final filter would drop anyway never reaches the costly test."""
    return sites.where(F.abs(F.col("rate_a") - F.col("rate_b")) >= delta)


def fisher_sites(a: DataFrame, b: DataFrame, min_cov: int = 1) -> DataFrame:
    """chrom, pos, p, delta of two samples, one row per site in both."""
    both = a.select("chrom", "pos", F.col("mc").alias("ma"), F.col("cov").alias("ca")).join(b.select("chrom", "pos", F.col("mc").alias("mb"), F.col("cov").alias("cb")), ["chrom", "pos"])
    both = both.where((F.col("ca") >= min_cov) & (F.col("cb") >= min_cov))
    covered = (F.col("ca") > 0) & (F.col("cb") > 0)
    p = F.when(covered, fisher_two_sided(F.col("ma"), F.col("ca") - F.col("ma"), F.col("mb"), F.col("cb") - F.col("mb"))).otherwise(1.0)
    delta = F.when(covered, F.col("ma") / F.col("ca") - F.col("mb") / F.col("cb")).otherwise(0.0)
    return both.select("chrom", "pos", p.alias("p"), delta.alias("delta"))


def _pieces(rows: DataFrame, by: list[str], max_dist: int) -> DataFrame:
    """Per range partition the regions of its sites; ``open`` are those that a neighbouring partition may continue, at most three.

    A leading run of zero differences stands apart, since it belongs to the region before it, if there is one. ``apart``: surely no part of what precedes it.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    n = len(by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys, pos, p, delta = b.columns[:n], *(b.column(n + i).to_numpy(zero_copy_only=False).astype(k) for i, k in enumerate((np.int64, float, float)))
            sign = np.sign(delta)
            new = changes(keys)
            head = np.flatnonzero(np.r_[True, new | (np.diff(pos) > max_dist) | (sign[1:] != sign[:-1])])
            here = [k[0].as_py() for k in keys]
            fresh = np.r_[last is None or here != last, new][head]
            last = [k[b.num_rows - 1].as_py() for k in keys]
            ends = np.r_[head[1:], len(pos)]
            runs.append((pa.Table.from_arrays([k.take(pa.array(head)) for k in keys], names=by), fresh, pos[head], pos[ends - 1], ends - head, np.fmin.reduceat(p, head), np.add.reduceat(delta, head), sign[head]))
        if not runs:
            return
        keys = pa.concat_tables([r[0] for r in runs])
        fresh, first, end, size, p, total, sign = (np.concatenate([r[i] for r in runs]) for i in range(1, 8))
        i = np.arange(len(first))
        gap = np.r_[True, fresh[1:] | (first[1:] - end[:-1] > max_dist)]
        start = np.maximum.accumulate(np.where(gap, i, 0))
        signed = np.r_[-1, np.maximum.accumulate(np.where(sign != 0, i, -1))[:-1]]  # the last run before with a sign
        flip = (sign != 0) & (signed >= start) & (sign[np.maximum(signed, 0)] != sign)
        # zeros at the very start, and what follows them
        lead = sign[0] == 0
        signs = np.flatnonzero(sign != 0)
        after = int(signs[0]) if lead and len(signs) and start[signs[0]] == 0 else 0
        head = np.flatnonzero(gap | flip | ((i == after) & (after > 0)))
        opened = np.zeros(len(head), bool)
        opened[[0, -1]] = True
        if after:
            opened[np.searchsorted(head, after)] = True
        apart = np.zeros(len(head), bool)
        apart[-1] = len(head) > 1 and head[-1] != after
        of = np.add.reduceat(sign, head)  # the signs of a region's runs are one sign and zeros
        yield pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() for c in keys.take(pa.array(head)).columns), pa.array(first[head]), pa.array(np.maximum.reduceat(end, head)), pa.array(np.add.reduceat(size, head)), pa.array(np.fmin.reduceat(p, head)), pa.array(np.add.reduceat(total, head)),
             pa.array(np.where(np.abs(of) > 0, np.sign(of), 0.0)), pa.array(opened), pa.array(apart)],
            [*by, "first", "last", "n", "p", "total", "sign", "open", "apart"],
        )

    rows = ranged(rows.select(*by, "pos", F.col("p").cast("double").alias("p"), F.col("delta").cast("double").alias("delta")).where("pos is not null and delta is not null and not isnan(delta)"), by, "pos")
    return checkpointed(rows.mapInArrow(fold, f"{kinds}, first bigint, last bigint, n bigint, p double, total double, sign double, open boolean, apart boolean"))


def merge_sites(dms: DataFrame, max_dist: int, min_dms: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Regions of called sites (chrom, pos, p, delta): a new one where the step exceeds ``max_dist`` or the sign flips; a zero does neither.

    keys, chrom, start_pos (first pos - 1), end_pos, n_dms, p_min, frac_delta_mean, state (hyper above zero, else hypo). Rows without a position or a difference are left
    out. Range partitions find their regions; those at their ends are stitched, so no task holds a chromosome.
    """
    by = [*(keys or []), "chrom"]
    pieces = _pieces(dms, by, max_dist)
    order = Window.partitionBy(*by).orderBy("first")  # over the open pieces, at most three a partition
    step = F.col("first") - F.lag("last").over(order)
    rows = pieces.where("open").withColumn("_g", F.sum(F.when(step.isNull() | (step > max_dist) | F.col("apart"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(*by, "_g").orderBy("first")
    known = F.last(F.nullif("sign", F.lit(0.0)), ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_known", known).withColumn("_flip", F.when((F.col("sign") != 0) & (F.col("_known") != F.col("sign")), 1).otherwise(0))
    rows = rows.withColumn("_s", F.sum("_flip").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    told = ["first", "last", "n", "p", "total"]
    joined = rows.groupBy(*by, "_g", "_s").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("p").alias("p"), F.sum("total").alias("total"))
    out = pieces.where("not open").select(*by, *told).unionByName(joined.select(*by, *told)).where(F.col("n") >= min_dms)
    mean = F.col("total") / F.col("n")
    return out.select(*by, (F.col("first") - 1).alias("start_pos"), F.col("last").alias("end_pos"), F.col("n").alias("n_dms"), F.nanvl("p", F.lit(None)).alias("p_min"), mean.alias("frac_delta_mean"), F.when(mean > 0, "hyper").otherwise("hypo").alias("state"))


def call_dmr(cells: DataFrame, **options: float) -> DataFrame:
    """Regions that differ between the groups of ``cells`` (chrom, pos, in_a, mc, cov, one row per cell and site)."""
    how = CG | options
    sites = prefilter(eligible(cells, how["min_cov"], how["min_samples"], ["chrom", "pos"]), how["delta"])
    tested = permutation_test(sites, ["chrom", "pos"], how)
    return merge_sites(tested.where((F.col("p") < how["p"]) & (F.abs("delta") > how["delta"])), how["max_dist"], how["min_dms"])


def call_dmr_pair(a: DataFrame, b: DataFrame, **options: float) -> DataFrame:
    """The same for one sample against one, by Fisher's exact test."""
    how = CG | options
    tested = fisher_sites(a, b, how["min_cov"])
    return merge_sites(tested.where((F.col("p") < how["p"]) & (F.abs("delta") > how["delta"])), how["max_dist"], how["min_dms"])


def rescale(bins: DataFrame, rates: DataFrame) -> DataFrame:
    """Counts scaled to a common overall rate, the median of the positive ones: mc = min(rint(mc * target / rate), cov); a rate of 0 scales by 1."""
    target = rates.where("rate > 0").agg(F.median("rate")).scalar()
    scale = F.when(F.col("rate") > 0, target / F.col("rate")).otherwise(1.0)
    return bins.join(rates, "cell_id").withColumn("mc", F.least(F.rint(F.col("mc") * scale).cast("bigint"), F.col("cov"))).drop("rate")


def call_dmr_ch(cells: DataFrame, **options: float) -> DataFrame:
    """Regions of bins that differ: ``cells`` has cell_id, chrom, pos, in_a, mc, cov of CH sites.

    Counts are binned, scaled to one overall rate per cell and weighed by coverage within a group; bins need the p, the
    difference and the log2 fold change.
    """
    how = CH | options
    group = cells.select("cell_id", "in_a").distinct()
    rates = cells.groupBy("cell_id").agg(F.when(F.sum("cov") > 0, F.sum("mc") / F.sum("cov")).otherwise(0.0).alias("rate"))
    bins = rescale(bin_sums(cells, how["bin"]), rates).join(group, "cell_id").withColumnRenamed("bin_start", "pos")
    sites = eligible(bins, how["min_cov"], how["min_samples"], ["chrom", "pos"])
    of = lambda a, c: F.aggregate("cells", F.lit(0.0), lambda s, x: s + F.when(x["in_a"] == a, x[c]).otherwise(0))
    weighed = lambda a: F.when(of(a, "cov") > 0, of(a, "mc") / of(a, "cov")).otherwise(0.0)
    sites = sites.withColumn("rate_a", weighed(True)).withColumn("rate_b", weighed(False))
    tested = permutation_test(prefilter(sites, how["delta"]), ["chrom", "pos"], how)
    fold = F.when((F.col("rate_a") > 0) & (F.col("rate_b") > 0), F.log2(F.col("rate_a") / F.col("rate_b"))).otherwise(0.0)
    called = tested.withColumn("delta", F.col("rate_a") - F.col("rate_b")).withColumn("fold", fold)
    called = called.where((F.col("p") < how["p"]) & (F.abs("fold") >= how["log2fc"]) & (F.abs("delta") >= how["delta"]))
    return merge_sites(called, max(how["max_dist"], how["bin"]), how["min_dms"]).withColumn("end_pos", F.col("end_pos") + how["bin"] - 1)


def one_vs_rest_sites(sites: DataFrame, by: str) -> DataFrame:
    """chrom, pos, by, p, delta of each sample against the pooled rest, in one job."""
    from methframe.operators.pivot import one_vs_rest

    t = one_vs_rest(sites, by).where("a + b > 0 and c + d > 0")
    p = fisher_two_sided(*[F.col(c) for c in "abcd"])
    return t.select("chrom", "pos", by, p.alias("p"), (F.col("a") / (F.col("a") + F.col("b")) - F.col("c") / (F.col("c") + F.col("d"))).alias("delta"))


def _away(s: pd.DataFrame, sites: int, how: dict, bins: bool) -> pd.DataFrame:
    """``s`` (site, mc, cov: a sample's counts at a site) with rate_a and rate_b, of the sample and of the others; only rows that both groups cover and whose rates differ enough.

    The rates of the others are a mean of their fractions, or for ``bins`` their counts' fraction, and come from the site's sums.
    """
    of = s["site"].to_numpy()
    mc, cov = s["mc"].to_numpy(), s["cov"].to_numpy()
    covered, own = cov > 0, cov >= how["min_cov"]
    total = lambda x: np.bincount(of, x, sites)[of]
    n = total(covered)
    keep = covered & (n > 1) & (own >= how["min_samples"]) & (total(own) - own >= how["min_samples"])
    if bins:
        m, c = total(mc) - mc, total(cov) - cov
        a, b = np.where(covered, mc / np.maximum(cov, 1), 0.0), np.where(c > 0, m / np.maximum(c, 1), 0.0)
        fold = np.where((a > 0) & (b > 0), np.log2(np.where(a > 0, a, 1.0) / np.where(b > 0, b, 1.0)), 0.0)
        keep &= (np.abs(a - b) >= how["delta"]) & (np.abs(fold) >= how["log2fc"])
    else:
        a = np.where(covered, mc / np.maximum(cov, 1), 0.0)
        b = (total(a) - a) / np.maximum(n - covered, 1)
        for i in np.flatnonzero(keep & (np.abs(np.abs(a - b) - how["delta"]) < 1e-9)):  # at the cutoff, the others' own sum decides
            others = a[slice(*np.searchsorted(of, [of[i], of[i] + 1]))]
            b[i] = math.fsum([*others, -a[i]]) / (n[i] - 1)
        keep &= np.abs(a - b) >= how["delta"]
    return s.assign(rate_a=a, rate_b=b)[keep]


def _against_rest(samples: DataFrame, by: str, within: list[str], how: dict, bins: bool = False, called: bool = False) -> DataFrame:
    """Of each sample and site that both groups cover, with enough of a difference: within, by, chrom, pos, n_samples (of the class), rate_a, rate_b and p; only p under how["p"] if ``called``, else p is null.

    The statistic and the draws of the permutation test know the samples of a site, not which of them is set against the others: one p of a
    site is the p of each of its samples. Where a class has two samples, ``called`` takes Fisher's test for sites.
    """
    keys = [*within, "chrom", "pos"]
    shipped()
    kept = samples.where("mc is not null and cov is not null").select(*within, "n_samples", "chrom", "pos", F.struct(F.col(by).alias("s"), F.col("mc").cast("bigint").alias("mc"), F.col("cov").cast("bigint").alias("cov")).alias("one"))
    # a number of partitions that adaptive execution keeps, since the work isn't in the bytes
    lists = kept.repartition(ranges_of(kept), "chrom", "pos").groupBy(*keys, "n_samples").agg(F.array_sort(F.collect_list("one")).alias("all"))
    lists = lists.withColumn("seed", F.xxhash64(F.lit(7), *keys))
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in [*keys, "n_samples", by])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("all")
            each = lists.flatten()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            s = pd.DataFrame({"site": np.repeat(np.arange(len(size)), size), **{c: each.field(c).to_numpy(zero_copy_only=False) for c in ("mc", "cov")}})
            away = _away(s, len(size), how, bins)
            if called:
                away = away.assign(p=_site_p(s, away["site"].unique(), batch.column("n_samples").to_numpy(zero_copy_only=False), batch.column("seed").to_numpy(), how, bins)[away["site"].to_numpy()])
                away = away[away["p"] < how["p"]]
            at = pa.array(away["site"].to_numpy())
            columns = [batch.column(c).take(at) for c in [*keys, "n_samples"]] + [each.field("s").take(pa.array(away.index.to_numpy())), pa.array(away["rate_a"].to_numpy()), pa.array(away["rate_b"].to_numpy())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(away["p"].to_numpy()) if called else pa.nulls(len(away), pa.float64())], [*keys, "n_samples", by, "rate_a", "rate_b", "p"])

    return lists.mapInArrow(test, f"{kinds}, rate_a double, rate_b double, p double")


def _site_p(s: pd.DataFrame, sites: np.ndarray, n_samples: np.ndarray, seeds: np.ndarray, how: dict, bins: bool) -> np.ndarray:
    """By site the p of its samples (site, mc, cov, in the order of the sites), for the numbers in ``sites``; 1 elsewhere."""
    out = np.ones(len(seeds))
    of, mc, cov = (s[c].to_numpy() for c in ("site", "mc", "cov"))
    start, end = np.searchsorted(of, sites), np.searchsorted(of, sites, "right")
    pair = (n_samples[sites] == 2) & (not bins)
    if pair.any():
        i = start[pair]
        out[sites[pair]] = fisher_p(mc[i], cov[i] - mc[i], mc[i + 1], cov[i + 1] - mc[i + 1])
    rest = np.flatnonzero(~pair)
    tables = [counts_table(mc[a:b][k], cov[a:b][k], how["max_row"], how["max_total"]) for a, b in zip(start[rest], end[rest]) for k in [np.flatnonzero(cov[a:b] > 0)]]
    # rows in one order: neither a list's nor the samples' names matter
    tables = [t[np.lexsort((t[:, 1], t[:, 0]))] for t in tables]
    out[sites[rest]] = rms_p(tables, [int(k) & 0x7FFFFFFF for k in seeds[sites[rest]]], how["permutations"], how["min_p"])
    return out


def vs_rest_tests(rows: DataFrame, by: str, group: list[str] | None = None, size: DataFrame | None = None, called: bool = False, **options: float) -> DataFrame:
    """What is tested of each sample against the separate others: rows as ``_against_rest`` has them, where the groups' mean rates differ enough."""
    how, group = CG | options, group or []
    samples = rows.groupBy(*group, by, "chrom", "pos").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    samples = samples.withColumn("n_samples", F.lit(None).cast("bigint")) if size is None else samples.join(F.broadcast(size), group) if group else samples.crossJoin(size)  # one row
    return _against_rest(samples, by, group, how, called=called)


def call_dmr_one_vs_rest(sites: DataFrame, by: str, within: str | None = None, method: str = "cg", min_class_size: int = 2, **options: float) -> DataFrame:
    """Regions in which a sample differs from all others (of its class, the column ``within``), which stay separate samples; one job for all.

    ``sites`` (by, within, chrom, pos, mc, cov) are added up per sample. Classes under ``min_class_size`` samples, and samples without a class,
    drop out. ``cg`` tests as ``call_dmr`` does, with Fisher's test where a class has two samples; ``ch`` as ``call_dmr_ch`` does,
    with counts scaled to the median rate of the class. A sample is a group of one: ``ch`` needs min_samples=1 to find any.
    """
    if method not in ("cg", "ch"):
        raise ValueError(f"method must be cg or ch, not {method}")
    how = (CG if method == "cg" else CH) | options
    group = [within] if within else []
    rows = sites.where(F.col(within).isNotNull()) if within else sites
    name = F.to_json(F.struct(F.col(by).alias("s")))  # a null sample counts
    size = rows.groupBy(*group).agg(F.countDistinct(name).alias("n_samples")).where(F.col("n_samples") >= max(2, min_class_size if within else 2))
    sized = lambda df: df.join(F.broadcast(size), group) if group else df.crossJoin(size)
    keys = [*group, by, "chrom", "pos"]
    if method == "cg":
        # written once: the ranges of the regions are found by a pass of their own over it
        tested = checkpointed(vs_rest_tests(rows, by, group, size, True, **how).withColumn("delta", F.col("rate_a") - F.col("rate_b")).where(F.abs("delta") > how["delta"]))
        return merge_sites(tested, how["max_dist"], how["min_dms"], [*group, by])
    start = F.expr(f"(pos - 1) div {how['bin']} * {how['bin']} + 1")
    bins = rows.groupBy(*group, by, "chrom", start.alias("pos")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    rates = bins.groupBy(*group, by).agg(F.when(F.sum("cov") > 0, F.sum("mc") / F.sum("cov")).otherwise(0.0).alias("rate"))
    target = rates.groupBy(*group).agg(F.median(F.when(F.col("rate") > 0, F.col("rate"))).alias("target"))
    rates = (rates.join(target, group) if group else rates.crossJoin(target)).withColumnsRenamed({k: f"_{k}" for k in [*group, by]})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*group, by]]
    scale = F.when(F.col("rate") > 0, F.col("target") / F.col("rate")).otherwise(1.0)
    scaled = bins.join(F.broadcast(rates), same).withColumn("mc", F.least(F.rint(F.col("mc") * scale).cast("bigint"), F.col("cov"))).select(*keys, "mc", "cov")
    called = checkpointed(_against_rest(sized(scaled), by, group, how, True, True).withColumn("delta", F.col("rate_a") - F.col("rate_b")))
    return merge_sites(called, max(how["max_dist"], how["bin"]), how["min_dms"], [*group, by]).withColumn("end_pos", F.col("end_pos") + how["bin"] - 1)


def call_one_vs_rest(sites: DataFrame, by: str, **options: float) -> DataFrame:
    """Each sample against the pooled rest by Fisher's test, a plainer question than ``call_dmr_one_vs_rest``: a deep sample dominates the rest."""
    how = CG | options
    tested = one_vs_rest_sites(sites, by)
    return merge_sites(tested.where((F.col("p") < how["p"]) & (F.abs("delta") > how["delta"])), how["max_dist"], how["min_dms"], [by])


def bh_fdr(df: DataFrame, p: str, by: list[str], name: str = "q") -> DataFrame:
    """``df`` with the Benjamini-Hochberg q of ``p`` within ``by`` (null is a group); a null or NaN p has a null q and doesn't count.

    Distinct values with their counts go to range partitions on (by, p); ranks need the counts of earlier partitions and the running minimum from
    above those of later ones, both stitched from one state per group and partition. So a group with a third of all rows is no single task.
    """
    value = F.when(F.isnan(F.col(p).cast("double")), None).otherwise(F.col(p)).cast("double")
    code = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit("{}")
    coded = df.withColumn("_g", code).withColumn("_p", value)
    each = coded.where("_p is not null").groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    local = checkpointed(ranged(each, ["_g"], "_p").mapInPandas(_local_ranks, "_g string, _p double, rank bigint, part int"))
    state = local.groupBy("_g", "part").agg(F.max("rank").alias("n"))
    order = Window.partitionBy("_g").orderBy("part")
    state = state.withColumn("base", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("m", F.sum("n").over(Window.partitionBy("_g")))
    scaled = local.join(state.select("_g", "part", "base", "m"), ["_g", "part"]).withColumn("v", F.col("_p") * F.col("m") / (F.col("base") + F.col("rank")))
    lowest = scaled.groupBy("_g", "part").agg(F.min("v").alias("low"))
    lowest = lowest.select("_g", "part", F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    # the minimum from above within a partition: values in blocks of equal rank order, never more than a partition's rows
    inner = Window.partitionBy("_g", "part").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    q = scaled.withColumn("v", F.min("v").over(inner)).join(lowest, ["_g", "part"])
    q = q.select("_g", "_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least("v", "later"))).alias(name))
    return coded.join(q, ["_g", "_p"], "left").drop("_g", "_p")


def _local_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts up to and with each value of a group within the partition, whose rows come in order."""
    part, last, seen = part_id(), None, 0
    for b in batches:
        if not len(b):
            continue
        rank = b.groupby("_g", sort=False)["_n"].cumsum()
        first = b["_g"] == b["_g"].iloc[0]
        rank = rank + np.where(first, seen if b["_g"].iloc[0] == last else 0, 0)
        last, seen = b["_g"].iloc[-1], int(rank.iloc[-1])
        yield pd.DataFrame({"_g": b["_g"], "_p": b["_p"], "rank": rank.astype("int64"), "part": part})


def merged_results(calls: DataFrame) -> DataFrame:
    """All samples' regions with length, region_id, direction (hypo below zero, else hyper) and q_min within (cell_class, sname).

    Where the calls have rate_a and rate_b also delta_rate and log2fc (null unless both are positive), and otherwise delta_meth, the mean difference of the fractions.
    """
    out = calls.withColumn("length", F.col("end_pos") - F.col("start_pos"))
    region = F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"))
    out = out.withColumn("region_id", region).withColumn("direction", F.when(F.col("frac_delta_mean") < 0, "hypo").otherwise("hyper"))
    if {"rate_a", "rate_b"} <= set(calls.columns):
        a, b = F.col("rate_a"), F.col("rate_b")
        out = out.withColumn("delta_rate", a - b).withColumn("log2fc", F.when((a > 0) & (b > 0), F.log2(a / b)))
    else:
        out = out.withColumn("delta_meth", F.col("frac_delta_mean"))
    return bh_fdr(out, "p_min", ["cell_class", "sname"], "q_min")


def consensus(calls: DataFrame, slop: int = 0, min_samples: int = 1, by_direction: bool = True) -> DataFrame:
    """Regions that samples share: intervals widened by ``slop`` (not below 0) merge if they overlap or touch; the extent is that of the originals.

    chrom, start_pos, end_pos, n_regions, n_samples, n_classes, snames, classes (sorted lists), mean_delta, p_min, and direction if asked for.
    """
    by = ["chrom", *(["direction"] if by_direction else [])]
    clean = calls.where("chrom is not null and start_pos is not null and end_pos > start_pos").withColumn("direction", F.when(F.col("frac_delta_mean") < 0, "hypo").otherwise("hyper"))
    merged = number_stretches(clean, by, F.greatest(F.col("start_pos") - slop, F.lit(0)), F.col("end_pos") + slop)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = merged.groupBy(*by, "stretch_start").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_regions"), F.countDistinct("sname").alias("n_samples"), F.countDistinct("cell_class").alias("n_classes"),
        names("sname").alias("snames"), names("cell_class").alias("classes"), F.round(F.avg("frac_delta_mean"), 6).alias("mean_delta"), F.min("p_min").alias("p_min"),
    )
    return out.where(F.col("n_samples") >= min_samples).drop("stretch_start")


def annotate(matrix: DataFrame, keys: list[str], samples: list[str], cutoff: float = 0.0) -> DataFrame:
    """The samples of least and greatest value in each row (ties: the first column), and their difference; rows below ``cutoff`` drop out."""
    values = F.array(*[F.struct(F.col(s).alias("v"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(samples) ])
    low = F.array(*[F.struct(F.col(s).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(samples)])
    known = lambda a: F.filter(a, lambda x: x["v"].isNotNull())
    least, most = F.array_min(known(low)), F.array_max(known(values))
    out = matrix.select(*keys, least["s"].alias("hypo_sample"), most["s"].alias("hyper_sample"), least["v"].alias("min_value"), most["v"].alias("max_value"))
    return out.withColumn("delta_beta", F.col("max_value") - F.col("min_value")).where(F.col("delta_beta") >= cutoff)


def annotate_regions(matrix: DataFrame, calls: DataFrame, samples: list[str], cutoff: float = 0.0) -> DataFrame:
    """``annotate`` for regions (chrom, start_pos, end_pos), with n_dms and the sorted list of the samples that called them; null where none did."""
    keys = ["chrom", "start_pos", "end_pos"]
    told = calls.groupBy(*keys).agg(F.max("n_dms").alias("n_dms"), F.array_join(F.array_sort(F.collect_set("sname")), ",").alias("snames"))
    return annotate(matrix, keys, samples, cutoff).join(told, keys, "left")


def pseudo_reads(sites: DataFrame, signal: Column, half: int) -> DataFrame:
    """chrom, start_pos, end_pos: ``signal`` reads around each site, [max(0, pos - half), pos + half), as input for a peak caller."""
    rows = sites.withColumn("_n", signal.cast("int")).where("_n > 0")
    return rows.select("chrom", F.greatest(F.col("pos") - half, F.lit(0)).alias("start_pos"), (F.col("pos") + half).alias("end_pos"), F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_")).drop("_")


def combp_input(fisher: DataFrame, by: str, state: str) -> DataFrame:
    """chrom, start_pos, end_pos, by, p for the external combination of p-values: sites of the other direction have p = 1.

    Hypomethylated sites have an odds ratio under 1, hypermethylated ones above; a NaN ratio has no direction.
    """
    ratio = F.col("odds_ratio")
    wrong = F.isnan(ratio) | ((ratio >= 1) if state == "hypo" else (ratio <= 1))
    return fisher.select("chrom", (F.col("pos") - 1).alias("start_pos"), F.col("pos").alias("end_pos"), by, F.when(wrong, 1.0).otherwise(F.col("pval")).alias("p"))
