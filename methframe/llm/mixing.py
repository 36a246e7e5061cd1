"""A mixture of sources with target shares, by Efraimidis-Spirakis sampling within each source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methframe.operators.ranged import part_id, ranged
from methframe.session import checkpointed

SEED = 20_240_601
#: Quality weights lie between these: characters per token, high for prose and low for encoded data.
LOW_QUALITY, HIGH_QUALITY = 0.5, 5.0


def source_name(source: Column) -> Column:
    """Sources compare without case and outer blanks."""
    return F.lower(F.trim(source))


def quality(n_text: Column, n_tokens: Column) -> Column:
    return F.when(n_tokens > 0, F.least(F.greatest(n_text / n_tokens, F.lit(LOW_QUALITY)), F.lit(HIGH_QUALITY))).otherwise(F.lit(1.0))


def exponential_key(weight: Column, *identity: str, seed: int = SEED) -> Column:
    """-ln(u) / weight with u from a hash of the identity: the smallest keys are a weighted sample without replacement."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _running(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``upto``: the tokens of the source up to and with the row, in the order of the keys; no task per source."""
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = part_id(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).to_numpy()
            tokens = b.column(3).to_numpy()
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            total = np.cumsum(tokens)
            base = np.repeat(total[heads] - tokens[heads], np.diff(np.r_[heads, len(code)]))
            local = total - base
            if code[0] == last:
                local[: heads[1] if len(heads) > 1 else len(code)] += carry
            last, carry = code[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([part] * len(code), pa.int32()), pa.array(local, pa.int64()), *b.columns[4:]], ["target_no", "n_tokens", "part", "local", *keep])

    rows = ranged(rows.select("target_no", "key", "row_id", "n_tokens", *keep), ["target_no", "key"], "row_id")
    rows = checkpointed(rows.mapInArrow(add, f"target_no int, n_tokens bigint, part int, local bigint{kinds}"))
    ends = rows.groupBy("target_no", "part").agg(F.max("local").alias("n"))  # at most partitions + sources rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("target_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ends.select("target_no", "part", before.alias("base"))), ["target_no", "part"]).select("target_no", "n_tokens", (F.col("local") + F.col("base")).alias("upto"), *keep)


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """The mixture (the columns ``keep``, source, n_tokens, repeats) and the shares reached.

    ``sizes``: row_id (unique), source, n_tokens, n_text and ``keep``. ``targets``: source, target_share, max_repeats; rows of one
    source count as one with the sum of the shares and the least max_repeats; null sources, and null or non-positive shares or
    repeats, are no targets. The total is the largest that lets every source with documents reach its share within max_repeats, or
    ``total_tokens`` if that is less. Complete epochs come first; the fraction that is left goes to documents in the order of
    their exponential keys until the nearest document boundary. Documents of other sources, or without one, aren't used. Documents
    without tokens are used in every epoch. A target without documents can't be met: it is reported with share 0. Shares are of all
    tokens in the mixture. The keys come from the columns
    ``keep``, so the choice doesn't depend on how the rows are laid out. Empty tables give an empty mixture.
    """
    spark = sizes.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    wanted = sorted(wanted.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most")).collect(), key=lambda r: r.source)
    # a configuration table: as many rows as there are sources in the recipe
    names = spark.createDataFrame([(i, r.source) for i, r in enumerate(wanted)], "target_no int, source string")
    weight = quality(F.col("n_text"), F.col("n_tokens"))
    rows = sizes.withColumn("source", source_name(F.col("source"))).join(F.broadcast(names), "source")
    rows = rows.select("target_no", "source", "row_id", "n_tokens", exponential_key(weight, *keep).alias("key"), *keep)
    there = {r.target_no: r.n for r in rows.groupBy("target_no").agg(F.sum("n_tokens").alias("n")).collect()}
    feasible = [r.most * there[i] / r.share for i, r in enumerate(wanted) if there.get(i)]
    total = int(min([*feasible, *([total_tokens] if total_tokens is not None else [])])) if feasible else 0
    plan = []
    for i, r in enumerate(wanted):
        have, budget = there.get(i) or 0, int(r.share * total)
        epochs = min(budget // have, r.most) if have else 0
        plan.append((i, r.source, float(r.share), r.most, epochs, budget - epochs * have if epochs < r.most else 0))
    recipe = F.broadcast(spark.createDataFrame(plan, "target_no int, source string, target_share double, max_repeats int, epochs int, rest bigint"))
    running = _running(rows, keep).join(recipe, "target_no")
    part = (F.col("rest") > 0) & (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("n_tokens") > 0)
    chosen = running.select(*keep, "source", "n_tokens", (F.col("epochs") + F.when(part, 1).otherwise(0)).cast("int").alias("repeats"))
    mixture = chosen.where("repeats > 0")
    used = F.col("n_tokens") * F.col("repeats")
    reached = chosen.groupBy("source").agg(F.sum(used).alias("used_tokens"), F.sum(F.when(F.col("repeats") > 0, 1).otherwise(0)).alias("n_documents"), F.max("repeats").alias("most_repeats"))
    shares = recipe.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens")
    )
    whole = F.sum("used_tokens").over(Window.partitionBy())  # over the recipe's rows only
    return mixture, shares.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)))
