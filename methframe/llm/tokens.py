"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methframe.session import checkpointed

#: Where the vocabulary files lie on every machine, and the one used.
TOKENIZERS = os.environ.get("METHFRAME_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary, in its form without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def spread(df: DataFrame) -> DataFrame:
    """``df`` on every core, where its files give fewer partitions than there are cores; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_sizes(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """row_id (unique), the columns ``keep``, n_tokens and n_text (characters) of every row; texts are read whole.

    A null text has no tokens, like an empty one. Strings of special tokens are ordinary text. The result is
    checkpointed, so that texts are tokenized once however often the sizes are used, and row_id stays what it is.
    """
    path = vocabulary or f"{TOKENIZERS}/{VOCABULARY}"
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1)
            tokens, chars = [], []
            for i in range(0, len(texts), 256):
                for t in texts.slice(i, 256).to_pylist():
                    tokens.append(len(encode(t)) if t else 0)
                    chars.append(len(t) if t else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(tokens, pa.int64()), pa.array(chars, pa.int64())], [*b.schema.names[:-1], "n_tokens", "n_text"])

    sized = spread(documents.select(*keep, F.col(text).alias("_text"))).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint, n_text bigint")
    return checkpointed(sized.withColumn("row_id", F.monotonically_increasing_id()))
