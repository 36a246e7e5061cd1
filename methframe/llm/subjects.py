"""Subject areas of documents, by label propagation with clamped seeds.

The graph of similar documents is kept in factored form: cells are linked through the words that they share, so two cells are
joined by as many verified links as they have subject-bearing words in common, and no pair of documents is ever written out.
A link through a word is verified: on trusted seeds, or in propagation, the word's occurrences must be concentrated on a subject
by share and by significance. Words of the tooling around a notebook are found on the seeds too: words of cells that
look like a subject which the document isn't labelled with; such cells are cut out of that subject.

One iteration goes cells -> words -> cells by DataFrame joins, until the links settle. Seeds are trusted if what their own cells bear out is just
what they are labelled with; in every pass, and in the result, their cells are clamped to those labels. The other labelled documents are judged by their
cells, like any document. Each cell keeps a share for every subject it supports; a document has the subjects with enough cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methframe.llm.notebooks import cells
from methframe.llm.tokens import spread
from methframe.session import checkpointed

#: Trusted seeds used at most; beyond it, those of the smallest hash.
MAX_SEEDS = 200_000
#: Rows of a word table that may be broadcast (a hash, a subject and two numbers each: under 32 MB); larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: A word is a link to a subject if this share of its uses is there, and this many standard deviations more than chance.
SHARE, SHARE_UNSEEN, DEVIATIONS = 0.3, 0.6, 3.0
#: Uses on seeds that make a word's seed statistics binding; a word seen less often may be learned in propagation.
SEEN = 10
#: Evidence that a cell needs to count for a subject.
LEAST_EVIDENCE = 0.6
#: Cells, and share of the document's cells with a subject, that make a document be about a subject.
LEAST_CELLS, LEAST_SHARE = 0.9, 0.15
#: Cells that a subject needs beside a stronger one: a single cell is a mention.
LEAST_CELLS_BESIDE = 1.5
#: Passes at most, and the share of links that may still change when they have settled.
ITERATIONS = 6
SETTLED = 0.01

_WORD = re.compile(r"[^\W\d_A-Z]{1}[^\W\d_A-Z]+|[A-Z][^\W\d_A-Z]+|[A-Z]{2,}")


def words_of_cells(documents: DataFrame) -> DataFrame:
    """doc_id, cell (unique), words: the distinct words of each cell's source, camel and snake case taken apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                piece = b.slice(i, 512)
                ids, rows, numbers, words = [], [], [], []
                for doc, row, form, text in zip(*(piece.column(k).to_pylist() for k in range(4))):
                    for n, (kind, source) in enumerate(cells(text, form)):
                        if kind != "output" and (found := {w.lower() for w in _WORD.findall(source)}):
                            ids.append(doc)
                            rows.append(row)
                            numbers.append(n)
                            words.append(list(found))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "row", "n", "words"])

    rows = spread(documents.select("doc_id", "nb_format", "text").where("doc_id is not null and text <> ''"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "nb_format", "text")
    found = rows.mapInArrow(read, "doc_id bigint, row bigint, n int, words array<string>")
    return found.select("doc_id", F.xxhash64("row", "n").alias("cell"), "words")


def trusted_seeds(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, mask: the labelled subjects as bits (0: about none of them). Documents labelled both with a subject and with none are not trusted."""
    known = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(1 << i))]) if subjects else None
    rows = labels.where("doc_id is not null").select("doc_id", "subject")
    bit = F.coalesce(F.element_at(known, F.col("subject")), F.lit(0)) if subjects else F.lit(0)
    each = rows.groupBy("doc_id").agg(F.bit_or(bit).alias("mask"), F.max(F.col("subject").isNull()).alias("none"))
    return each.where("not none or mask = 0").select("doc_id", "mask").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SEEDS)


def _sized(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, which is checkpointed, with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.count() <= most else df


def _bits(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << k)) != 0


def _shares(total: DataFrame, keys: list[str], n: int, least: float) -> DataFrame:
    """keys, p0..: a cell's share of each subject from its evidence s0.. and blocks b0..: those near the strongest, squared and scaled to 1.

    Step by step, each step a projection of its own: written as one expression the terms would multiply.
    """
    score, block = F.array(*[F.col(f"s{k}") for k in range(n)]), F.array(*[F.col(f"b{k}") for k in range(n)])
    step = total.select(*keys, score.alias("s"), block.alias("b")).withColumn("top", F.array_max("s"))
    kept = F.transform("s", lambda x: F.when((x >= 0.5 * F.col("top")) & (F.col("top") >= least), x * x).otherwise(0.0))
    step = step.withColumn("kept", kept).withColumn("whole", F.aggregate("kept", F.lit(0.0), lambda a, x: a + x))
    step = step.withColumn("p", F.zip_with("kept", "b", lambda k, b: F.when(b | (F.col("whole") <= 0), 0.0).otherwise(k / F.col("whole"))))
    return step.select(*keys, *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(n)])


class _Graph:
    """The passes over cells (doc_id, cell, mask, words as hashes) for subjects 0..n-1."""

    def __init__(self, n: int):
        self.n, self.p = n, [f"p{k}" for k in range(n)]

    def cell_shares(self, cells_: DataFrame, weights: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
        """doc_id, cell, mask, p0..: ``weights`` has word, subject, weight and mark (the word cuts a cell out of the subject)."""
        use = cells_.select("doc_id", "cell", "mask", F.explode("words").alias("word")).join(weights, "word")
        sums = [F.sum(F.when(F.col("subject") == k, F.col("weight")).otherwise(0.0)).alias(f"s{k}") for k in range(self.n)]
        marks = [F.max((F.col("subject") == k) & F.col("mark")).alias(f"b{k}") for k in range(self.n)]
        total = use.groupBy("doc_id", "cell", "mask").agg(*sums, *marks)
        return _shares(total, ["doc_id", "cell", "mask"], self.n, least)

    def clamped(self, shares: DataFrame) -> DataFrame:
        """``shares`` with those of trusted seeds (mask) set to their labels: what a cell has of them, scaled to 1; nothing of other subjects."""
        own = [F.when(_bits(F.col("mask"), k), F.col(p)).otherwise(0.0) for k, p in enumerate(self.p)]
        whole = sum(own[1:], own[0])
        step = shares.withColumn("_own", F.when(F.col("mask").isNotNull(), whole))
        return step.withColumns({p: F.when(F.col("mask").isNull(), F.col(p)).when(F.col("_own") > 0, o / F.col("_own")).otherwise(0.0) for p, o in zip(self.p, own)}).drop("_own")

    def judged(self, shares: DataFrame) -> DataFrame:
        """doc_id, mask, subject, n_cells: the subjects with enough cells."""
        mass = shares.groupBy("doc_id", "mask").agg(*[F.sum(p).alias(p) for p in self.p])
        whole = sum([F.col(p) for p in self.p[1:]], F.col(self.p[0]))
        mass = mass.withColumn("whole", whole).withColumn("most", F.greatest(*[F.col(p) for p in self.p], F.lit(0.0), F.lit(0.0)))
        enough = F.when(F.col("n_cells") < F.col("most"), LEAST_CELLS_BESIDE).otherwise(LEAST_CELLS)
        rows = self.long(mass, ["doc_id", "mask", "whole", "most"], {"n_cells": self.p})
        return rows.where((F.col("n_cells") >= enough) & (F.col("n_cells") >= LEAST_SHARE * F.col("whole"))).select("doc_id", "mask", "subject", "n_cells")

    def long(self, sums: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
        """One row per word and subject from one column per subject."""
        each = F.array(*[F.struct(F.lit(k).alias("subject"), *[F.col(c[k]).alias(name) for name, c in columns.items()]) for k in range(self.n)])
        return sums.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def _significant(found: Column, uses: Column, share: Column) -> Column:
    expected = uses * share
    return (found - expected) / F.sqrt(expected + 1e-9) >= DEVIATIONS


def _without(cells_: DataFrame, idle: DataFrame) -> DataFrame:
    """``cells_`` without the words of ``idle``, which is checkpointed and goes to the tasks where it is small; it only saves work."""
    if idle.count() > MAX_BROADCAST_ROWS:
        return cells_
    sent = cells_.sparkSession.sparkContext.broadcast(np.sort(idle.select("word").toArrow().column(0).to_numpy()))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(3)
            flat, size = words.flatten().to_numpy(), pc.list_value_length(words).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(sent.value, flat), max(len(sent.value) - 1, 0))
            stay = sent.value[at] != flat if len(sent.value) else np.ones(len(flat), bool)
            left = np.bincount(np.repeat(np.arange(len(size)), size)[stay], minlength=len(size))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), pa.array(flat[stay]))], b.schema.names)

    return cells_.select("doc_id", "cell", "mask", "words").mapInArrow(drop, "doc_id bigint, cell bigint, mask int, words array<bigint>")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, passes: int = ITERATIONS) -> DataFrame:
    """doc_id, subject, n_cells (cells' shares summed): one row per document and subject that its cells are about.

    Documents without cells, or with none about a subject, have no row; a trusted seed has the rows of its labels. Null and empty texts have no cells; damaged
    notebooks are read as far as they go. Rows that repeat a doc_id count as one document. Labels with a subject that isn't in ``subjects`` count as none of
    them. Without labels, documents or subjects there are no rows. ``passes``: of propagation at most; with 0 the words of the seeds decide alone.
    """
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.where("subject is not null").select("subject").distinct().collect())  # a configuration table
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string, n_cells double")
    g = _Graph(len(names))
    seeds = checkpointed(trusted_seeds(labels, names))
    sent = F.broadcast(seeds)  # at most MAX_SEEDS rows of 12 bytes
    n_seeds = seeds.count()
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    # texts are parsed once
    whole = words_of_cells(documents.select("doc_id", "nb_format", "text")).select("doc_id", "cell", hashed.alias("words"))
    whole = checkpointed(whole.join(sent, "doc_id", "left").select("doc_id", "cell", "mask", "words"))

    # words on the seeds: how often in documents of each subject
    taught = whole.where("mask is not null")
    labelled = sum(_bits(F.col("mask"), k).cast("int") for k in range(g.n))
    part = [F.when(_bits(F.col("mask"), k), 1.0 / F.greatest(labelled, F.lit(1))).otherwise(0.0) for k in range(g.n)]
    prior = seeds.agg(*[(F.coalesce(F.sum(x), F.lit(0.0)) / max(n_seeds, 1)).alias(p) for x, p in zip(part, g.p)]).first()
    prior_of = F.element_at(F.array(*[F.lit(float(prior[p])) for p in g.p]), F.col("subject") + 1)
    uses = taught.select("doc_id", "mask", F.explode("words").alias("word")).distinct()
    stats = checkpointed(uses.groupBy("word").agg(F.count(F.lit(1)).alias("uses"), *[F.sum(x).alias(p) for x, p in zip(part, g.p)]))
    links = g.long(stats, ["word", "uses"], {"found": g.p}).withColumn("weight", F.col("found") / F.col("uses"))
    good = (F.col("uses") >= 3) & (F.col("weight") >= SHARE) & _significant(F.col("found"), F.col("uses"), prior_of)
    links = checkpointed(links.where(good).select("word", "subject", "weight", F.lit(False).alias("mark")))

    # tooling: words of seed cells that look like a subject which the seed isn't labelled with
    # (any link is evidence enough here: what is weak on the seeds may be learned to be strong later)
    looks = g.cell_shares(taught, _sized(links), SHARE)
    off = looks.select("cell", *[F.col(p) for p in g.p], *[F.when(_bits(F.col("mask"), k), 0.0).otherwise(F.col(p)).alias(f"o{k}") for k, p in enumerate(g.p)])
    off = checkpointed(off)
    total = off.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in off.columns if c != "cell"]).first()
    usual = F.element_at(F.array(*[F.lit(float(total[f"o{k}"] / max(total[p], 1.0))) for k, p in enumerate(g.p)]), F.col("subject") + 1)
    per = taught.select("cell", F.explode("words").alias("word")).join(off, "cell").groupBy("word").agg(*[F.sum(c).alias(c) for c in off.columns if c != "cell"])
    marks = g.long(per, ["word"], {"all": g.p, "off": [f"o{k}" for k in range(g.n)]})
    marks = marks.where((F.col("off") >= 3) & (F.col("off") >= 0.5 * F.col("all")) & _significant(F.col("off"), F.col("all"), usual))
    marks = checkpointed(marks.select("word", "subject", F.lit(0.0).alias("weight"), F.lit(True).alias("mark")))

    # trusted are the seeds whose cells bear out just their labels
    seen_in = g.judged(g.cell_shares(taught, _sized(checkpointed(links.unionByName(marks))))).groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("subject"))).alias("found"))
    trusted = seeds.join(seen_in, "doc_id", "left").where(F.coalesce("found", F.lit(0)) == F.col("mask")).select("doc_id", "mask")
    trusted = checkpointed(trusted)

    # words that the seeds show to bear no subject link nothing; marks stay
    often = stats.where(F.col("uses") >= SEEN).select("word")
    idle = checkpointed(often.join(links.select("word").union(marks.select("word")), "word", "left_anti"))
    seen = checkpointed(often.withColumn("seen", F.lit(True)))
    every = _without(whole, idle).drop("mask").join(F.broadcast(trusted), "doc_id", "left")
    every = checkpointed(every.select("doc_id", "cell", "mask", "words"))
    n_cells = max(every.count(), 1)

    weights, before = links, None
    for _ in range(passes):
        shares = checkpointed(g.clamped(g.cell_shares(every, _sized(checkpointed(weights.unionByName(marks))))).select("cell", *g.p))
        mean = shares.agg(*[(F.coalesce(F.sum(p), F.lit(0.0)) / n_cells).alias(p) for p in g.p]).first()
        mean_of = F.element_at(F.array(*[F.lit(float(mean[p])) for p in g.p]), F.col("subject") + 1)
        told = every.select("cell", "words").join(shares, "cell", "left").select(F.explode("words").alias("word"), *g.p)
        found = told.groupBy("word").agg(F.count(F.lit(1)).alias("uses"), *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in g.p]).where("uses >= 4")
        found = g.long(found, ["word", "uses"], {"found": g.p}).withColumn("weight", F.col("found") / F.col("uses"))
        found = found.where((F.col("weight") >= SHARE) & _significant(F.col("found"), F.col("uses"), mean_of))
        # a word that the seeds have shown often needs a link there; others need a larger share
        found = found.join(_sized(seen), "word", "left").join(links.select("word").distinct().withColumn("linked", F.lit(True)), "word", "left")
        found = found.where(F.when(F.col("seen"), F.col("linked")).otherwise(F.col("weight") >= SHARE_UNSEEN))
        before, weights = weights, checkpointed(found.select("word", "subject", "weight", F.lit(False).alias("mark")))
        same = weights.join(before, ["word", "subject"], "left_semi").count()
        if max(weights.count(), before.count()) - same <= SETTLED * max(same, 1):
            break
    final = g.clamped(g.cell_shares(every, _sized(checkpointed(weights.unionByName(marks)))))
    rows = g.judged(final.where("mask is null")).select("doc_id", "subject", "n_cells")
    fixed = g.long(final.where("mask is not null").groupBy("doc_id", "mask").agg(*[F.sum(p).alias(p) for p in g.p]), ["doc_id", "mask"], {"n_cells": g.p})
    fixed = fixed.where(F.call_function("shiftright", F.col("mask"), F.col("subject")).bitwiseAND(F.lit(1)) == 1).select("doc_id", "subject", "n_cells")
    subject = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("subject") + 1)
    return rows.unionByName(fixed).select("doc_id", subject.alias("subject"), "n_cells")
