"""Token counts by a two-tier map-side lookup.

Tier one is a compact table ``pre-token -> number of tokens`` of the corpus'
frequent pre-tokens, broadcast to the workers (at most ``table_size`` entries
of at most ``max_key`` characters).  Tier two is a bounded cache in each worker
that encodes what the table lacks.  No pre-token is ever shuffled: the first
pass sends each task's heaviest pre-tokens only, the second one row a document.

Byte-level BPE never merges over the border of a pre-token, so a text's token
count is the sum over its pre-tokens; strings of special tokens are taken out
first, as the tokenizer does by default, and count one token each.

Null and empty texts have 0 bytes and 0 tokens; texts of any length are counted
whole; of equally heavy pre-tokens the smaller one goes into the table (which
changes no count); repeated rows give repeated results; extra columns, whatever
their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark

#: Fixed by the byte-level pre-tokenizer that the vocabulary file names.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenLengths(dict):
    """pre-token -> number of tokens; misses are encoded and kept while there is room."""

    def __init__(self, path: str, known: dict[str, int] | None = None, room: int = 200_000):
        super().__init__(known or {})
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), spec["normalizer"]) != ("ByteLevel", False, True, None):
            raise ValueError("only a byte-level BPE without normalizer or prefix space is counted by pre-tokens")
        special = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens that strip or bind to words are not handled")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.limit = len(self) + room

    def __missing__(self, key: str) -> int:
        n = len(self.tokenizer.encode(key, add_special_tokens=False).ids)
        if len(self) < self.limit and len(key) <= 64:
            self[key] = n
        return n

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens outside special strings, and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in self.find(p)], len(parts) - 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found, n = self.pre_tokens(text)
        return n + sum(map(self.__getitem__, found))


def frequent_pre_tokens(df: DataFrame, text: str, tokenizer: str, table_size: int = 1 << 15, per_task: int = 1 << 14, max_key: int = 32) -> list[str]:
    """The corpus' heaviest pre-tokens, over all texts.

    Each task counts all its pre-tokens (thinned to the heaviest half when there are a million of
    them) and sends its per_task heaviest; their sums, not the pre-tokens, meet in a shuffle.
    The table only saves time, so its being approximate leaves no trace in the counts.
    """
    def run(batches):
        lengths, seen = TokenLengths(tokenizer, room=0), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(lengths.pre_tokens(t)[0])
                    if len(seen) > 1_000_000:
                        seen = Counter(dict(seen.most_common(500_000)))
        top = [(k, n) for k, n in seen.most_common(per_task) if len(k) <= max_key]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["k", "n"])

    top = df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "k string, n long")
    rows = top.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(table_size).collect()
    return [r.k for r in rows]


def token_counts(spark: SparkSession, df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = 1024, table_size: int = 1 << 15) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of df; tokenizer: path of a byte-level BPE .json."""
    keys = frequent_pre_tokens(df, text, tokenizer, table_size)
    lengths = TokenLengths(tokenizer, room=0)
    known = spark.sparkContext.broadcast({k: lengths[k] for k in keys})

    def run(batches):
        counter = TokenLengths(tokenizer, known.value)
        for batch in batches:
            col = batch.column(1)
            n = np.fromiter(map(counter.count, col.to_pylist()), np.int64, len(col))
            size = pa.compute.binary_length(col.cast(pa.large_string()).fill_null("")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n)], names=["i", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  pa.compute

    picked = df.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t"))
    out = picked.mapInArrow(run, f"i {picked.dtypes[0][1]}, n_bytes long, n_tokens long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
