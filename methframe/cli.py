"""Command line over stored tables: python -m methframe.cli COMMAND …"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methframe.operators import align, compaction, dmr, features, index, merge, pivot, region
from methframe.sources import bam, store, text


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="methframe")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, out: bool = True) -> None:
        p = sub.add_parser(name)
        p.add_argument("input")
        if out:
            p.add_argument("-o", "--output", help="Parquet folder; without it the rows are shown")
        for names, options in args:
            p.add_argument(*names, **options)

    ref = (("-r", "--reference"), {"required": True})
    add("header", out=False)
    add("summary")
    add("view", (("--chroms",), {"default": ""}))
    add("query", (("-c", "--chrom"), {"required": True}), (("-s", "--start"), {"type": int, "required": True}), (("-e", "--end"), {"type": int, "required": True}))
    add("query-regions", (("--bed",), {"required": True}))
    add("import-allc", (("-r", "--reference"), {"default": "", "help": "align to this axis: every site of it, with zeros where a file has none"}))
    add("build-ref")
    add("count-bam", (("--fasta",), {"required": True}))
    add("index", (("--pattern",), {"default": "CGN"}))
    add("extract", ref, (("--pattern",), {"default": "CGN"}))
    add("merge", (("--by",), {"default": ""}), (("--code",), {"default": "I"}))
    add("merge-strands", ref)
    add("aggregate", (("--bed",), {"required": True}))
    add("align", ref)
    add("matrix", (("--bed",), {"required": True}), (("--score",), {"default": "frac"}))
    add("bins", (("--size",), {"type": int, "default": 5000}))
    add("one-vs-rest", (("--by",), {"default": "cell_id"}))
    add("consensus", (("--slop",), {"type": int, "default": 0}), (("--min-samples",), {"type": int, "default": 1}))
    add("bedgraph", (("--signal",), {"default": "frac_unmeth"}), (("--min-cov",), {"type": int, "default": 1}))
    add("export-allc", ref)
    add("compact")
    add("import-table", (("--columns",), {"required": True, "help": "name:code pairs of the text's columns, such as chrom:c,pos:Q,mc:H"}), (("--sep",), {"default": "\t"}), (("--keys",), {"default": "chrom"}))
    add("concat", (("inputs",), {"nargs": "*"}), (("--key-added",), {"default": "cell_id"}))
    add("pivot-fraction", (("--by",), {"default": "cell_id"}), (("--names",), {"required": True}))
    add("pivot-fisher", (("--by",), {"default": "cell_id"}), (("--names",), {"default": ""}))
    groups = (("--group-a",), {"required": True}), (("--group-b",), {"default": ""}), (("--p",), {"type": float}), (("--delta",), {"type": float}), (("--min-cov",), {"type": int}), (("--min-samples",), {"type": int}), (("--max-dist",), {"type": int}), (("--min-dms",), {"type": int}), (("--permutations",), {"type": int})
    add("call-dmr", *groups)
    add("call-dmr-ch", *groups, (("--bin",), {"type": int}), (("--log2fc",), {"type": float}))
    add("call-one-vs-rest", (("--by",), {"default": "cell_id"}), (("--within",), {}), (("--method",), {"default": "cg", "choices": ["cg", "ch"]}), (("--min-class-size",), {"type": int, "default": 2}))
    add("pseudo-reads", (("--half",), {"type": int, "default": 50}), (("--signal",), {"default": "unmeth", "choices": ["unmeth", "meth"]}))
    add("combp-input", (("--by",), {"default": "cell_id"}), (("--state",), {"default": "hypo", "choices": ["hypo", "hyper"]}))
    add("annot-dmr", (("--matrix",), {"required": True}), (("--samples",), {"required": True}), (("--cutoff",), {"type": float, "default": 0.0}))
    add("merge-dmr")
    return top


def _options(a: argparse.Namespace) -> dict[str, float]:
    """The thresholds that were given; the callers know their defaults."""
    names = ("p", "delta", "min_cov", "min_samples", "max_dist", "min_dms", "permutations", "bin", "log2fc")
    return {n: getattr(a, n) for n in names if getattr(a, n, None) is not None}


def _two_groups(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Rows with in_a by cell; without a second group it is all other cells."""
    own, other = a.group_a.split(","), [x for x in a.group_b.split(",") if x]
    rows = df.where(F.col("cell_id").isin([*own, *other])) if other else df.where("cell_id is not null")
    return rows.withColumn("in_a", F.col("cell_id").isin(own))


def _bed(spark: SparkSession, path: str) -> DataFrame:
    return features.named(text.read_bed(spark, path))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("methframe").getOrCreate()
    if a.command == "header":
        print(json.dumps(store.header(spark, a.input)))
        return
    if a.command == "compact":
        compaction.compact(store.read(spark, a.input), a.output).show(truncate=False)
        return
    ref = (lambda: region.with_site_id(store.read(spark, a.reference))) if getattr(a, "reference", "") else None
    formats = dict(x.split(":") for x in a.columns.split(",")) if a.command == "import-table" else {}
    names = [x for x in (getattr(a, "names", None) or "").split(",") if x]
    raw = {
        "import-allc": lambda: text.read_allc(spark, a.input).drop("flag").withColumnRenamed("sample", "cell_id"),
        "build-ref": lambda: text.cytosines(text.read_fasta(spark, a.input)),
        "import-table": lambda: store.typed(spark.read.csv(a.input, sep=a.sep, comment="#").toDF(*formats), formats),
        "count-bam": lambda: bam.count_sites(bam.read_bam(spark, a.input), text.read_fasta(spark, a.fasta), by=["file"]),
    }
    df = raw[a.command]() if a.command in raw else store.read(spark, a.input)
    chosen = {
        "summary": lambda: store.chunks(df),
        "view": lambda: store.ordered(df, a.chroms.split(",")) if a.chroms else df,
        "query": lambda: region.region(df, a.chrom, a.start, a.end),
        "query-regions": lambda: region.regions_query(df, _bed(spark, a.bed).selectExpr("name as region_idx", "chrom", "start_pos + 1 as low", "end_pos as high")),
        "import-allc": lambda: align.align_cells(ref(), df) if ref else df,
        "index": lambda: index.context_index(region.with_site_id(df), a.pattern),
        "extract": lambda: index.subset(align.with_reference(df, ref()), index.context_index(ref(), a.pattern)),
        "merge": lambda: merge.pseudobulk(df, [x for x in a.by.split(",") if x], a.code),
        "merge-strands": lambda: merge.merge_strands(align.with_reference(df, ref())),
        "aggregate": lambda: index.region_sums(df, _bed(spark, a.bed), "q"),
        "align": lambda: align.align(ref(), merge.pseudobulk(df)),
        "matrix": lambda: features.score(features.matrix(df, _bed(spark, a.bed)), a.score),
        "bins": lambda: merge.bin_sums(df, a.size),
        "one-vs-rest": lambda: dmr.call_one_vs_rest(df, a.by),
        "consensus": lambda: dmr.consensus(df, a.slop, a.min_samples),
        "bedgraph": lambda: text.bedgraph(merge.pseudobulk(df), a.signal, a.min_cov),
        "export-allc": lambda: text.allc_rows(merge.pseudobulk(df), ref()),
        "concat": lambda: align.union_tables({p.rstrip("/").rsplit("/", 1)[-1]: store.read(spark, p) for p in [a.input, *a.inputs]}, a.key_added),
        "pivot-fraction": lambda: pivot.pivot_fraction(df, a.by, names),
        "pivot-fisher": lambda: pivot.wide(pivot.pivot_fisher(df, a.by), a.by, names, ["odds_ratio", "pval"]) if names else pivot.pivot_fisher(df, a.by),
        "call-dmr": lambda: dmr.call_dmr(_two_groups(df, a), **_options(a)),
        "call-dmr-ch": lambda: dmr.call_dmr_ch(_two_groups(df, a), **_options(a)),
        "call-one-vs-rest": lambda: dmr.call_dmr_one_vs_rest(df, a.by, a.within, a.method, a.min_class_size),
        "pseudo-reads": lambda: dmr.pseudo_reads(merge.pseudobulk(df), F.col("cov") - F.col("mc") if a.signal == "unmeth" else F.col("mc"), a.half),
        "combp-input": lambda: dmr.combp_input(pivot.pivot_fisher(df, a.by), a.by, a.state),
        "annot-dmr": lambda: dmr.annotate_regions(store.read(spark, a.matrix), df, a.samples.split(","), a.cutoff),
        "merge-dmr": lambda: dmr.merged_results(df),
    }
    out = chosen[a.command]() if a.command in chosen else df
    if not a.output:
        out.show(50, truncate=False)
    elif a.command == "import-table":
        store.write(out, a.output, tuple(a.keys.split(",")))
    elif a.command == "bedgraph":
        text.write_tsv(out, a.output, ["chrom", "start_pos"])
    elif a.command == "export-allc":
        text.write_tsv(out, a.output, ["chrom", "pos"])
    else:
        out.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
