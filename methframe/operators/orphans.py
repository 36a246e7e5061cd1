"""References to records that do not exist.

A Bloom filter over the parent keys is built with aggregates only and proves orphans: a reference it rejects has no parent. A filter of up to
MAX_FILTER_BITS is one value that goes to all tasks; a larger one is sharded by key hash, word by word, and each shard goes to the tasks of its range of the
references. The references it lets through are verified by an exact anti-join that also checks that the parent stands at the time of
the reference; for those it rejects the join has no key to look up. Each child is read once, and so is each use of the parents: their keys, and their validity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of filter for each parent key; with PROBES bits set in one 64-bit word about 1 % pass wrongly.
BITS_PER_KEY = 16
PROBES = 4
#: A filter of up to this many bits (16 MB) is broadcast; a larger one is sharded.
MAX_FILTER_BITS = 1 << 27
#: Parents up to this many rows are broadcast to the exact join (keys and two timestamps, under 100 MB).
MAX_BROADCAST_ROWS = 1_000_000


def _probe(keys: list[str], words: int) -> tuple[Column, Column]:
    """The word of a key, and the bits it sets there."""
    spread = F.xxhash64(F.lit(17), *keys)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return F.pmod(F.xxhash64(*keys), F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def filter_words(keys_: DataFrame, keys: list[str], words: int) -> DataFrame:
    """word, mask: the words of the filter over non-null ``keys`` that have a bit set, combined before the shuffle."""
    word, mask = _probe(keys, words)
    return keys_.dropna(subset=keys).select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def words_for(rows: int) -> int:
    """The length of a filter for ``rows`` keys in 64-bit words, a power of two."""
    words = 1
    while words * 64 < max(rows, 1) * BITS_PER_KEY:
        words *= 2
    return words


def whole_filter(found: DataFrame, words: int) -> Column:
    """The filter as one value, an array of its words."""
    every = found.sparkSession.range(words).withColumnRenamed("id", "word").join(found, "word", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("w"))
    return packed.select(F.transform("w", lambda x: x["mask"])).scalar()


def might_contain(bloom: Column, words: int, keys: list[str]) -> Column:
    word, mask = _probe(keys, words)
    return F.get(bloom, word.cast("int")).bitwiseAND(mask) == mask


def with_hit(refs: DataFrame, known: DataFrame, p_keys: list[str], keys: list[str], rows: int) -> DataFrame:
    """``refs`` with ``hit``: whether the filter over ``known``'s keys, of which there are ``rows`` at most, lets the reference through."""
    words = words_for(rows)
    found = filter_words(known, p_keys, words)
    if words * 64 <= MAX_FILTER_BITS:
        return refs.withColumn("hit", might_contain(whole_filter(found, words), words, keys))
    word, mask = _probe(keys, words)
    shards = found.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    return refs.withColumn("_at", word).withColumn("_need", mask).join(shards, F.col("_at") == F.col("_word"), "left").withColumn("hit", F.coalesce(F.col("_mask").bitwiseAND(F.col("_need")) == F.col("_need"), F.lit(False))).drop("_at", "_need", "_word", "_mask")


def find_orphans(child: DataFrame, parent: DataFrame, keys: list[str], row_key: str, at: str, since: str = "added_at", until: str = "removed_at") -> DataFrame:
    """One row per record of ``child`` whose reference fails: row_key, arrived_at, kind.

    kind: ``missing`` (no parent ever had the key), ``not_yet`` (the first such parent came later) or
    ``gone``. A parent stands from ``since`` (inclusive) to ``until`` (exclusive; null: it still stands).
    Records with a null in ``keys`` refer to nothing and are no orphans. A record with a null ``at`` stands at
    no time: it is an orphan (``gone`` unless the key is missing). Parents with a null ``since`` never stand.
    Keys compare exactly as stored. Repeated parents and repeated children are fine; every child row counts.
    Columns of the two tables may clash: only the named ones are read.
    """
    refs = child.select(*keys, F.col(row_key).alias("row_key"), F.col(at).alias("arrived_at")).dropna(subset=keys)
    sites = parent.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col(since).alias("p_since"), F.col(until).alias("p_until"))
    p_keys = [f"p_{k}" for k in keys]
    rows = sites.count()  # answered from Parquet footers
    send = F.broadcast if rows <= MAX_BROADCAST_ROWS else lambda x: x
    first = sites.dropna(subset=p_keys).groupBy(*p_keys).agg(F.min("p_since").alias("first"), F.lit(True).alias("known"))
    refs = with_hit(refs, first, p_keys, keys, rows)
    # what the filter rejects has no key to look up in the joins
    probe = ["_probe", *keys[1:]]
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(p) for k, p in zip(probe, p_keys)])
    stands = (F.col("p_since") <= F.col("arrived_at")) & (F.col("p_until").isNull() | (F.col("p_until") > F.col("arrived_at")))
    broken = refs.withColumn("_probe", F.when(F.col("hit"), F.col(keys[0]))).join(send(sites), same & stands, "left_anti")
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("arrived_at"), "not_yet").otherwise("gone")
    return broken.join(send(first), same, "left").select("row_key", "arrived_at", kind.alias("kind"))


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Orphans counted per month of arrival (null: unknown) and kind, and per the columns ``by``."""
    return orphans.groupBy(*by, F.date_trunc("month", "arrived_at").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_orphans"))
