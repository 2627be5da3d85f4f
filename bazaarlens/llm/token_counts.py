"""Operator 1: exact length histogram of encoded documents.

Documents are encoded once and aggregated to (length, documents), which Spark combines before the
shuffle. Suffix sums over that histogram answer, exactly and for every context limit, how many
documents and tokens there are at or above the limit, any quantile, and the total after truncation.

Defined results: a null or empty text has length 0; each row counts, repeated rows included; ids and
other columns are not read; an empty table gives an empty histogram.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import tiktoken
from functools import lru_cache
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import map_rows

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


@lru_cache(2)
def _encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row ``n_tokens`` for each document."""
    out = pa.schema([("n_tokens", pa.int64())])
    return map_rows(docs, [text_col], lambda t: (len(_encoder(path).encode_ordinary(t)) if t else 0,), "n_tokens long", out)


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: documents and tokens at or above it, documents and tokens up to
    and including it, and the corpus total when each document is cut to it.

    Two levels: blocks of lengths are summed first, so the one ordered pass over everything sees a
    row per block (the longest length / 1024), and the rest runs per block.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"), F.sum("bd").over(all_of).alias("dn"), F.sum("bt").over(all_of).alias("tn")
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(blocks, "block").select("n_tokens", "n_docs", "t", "dn", "tn", (F.col("d0") + F.sum("n_docs").over(upto)).alias("docs_up_to"), (F.col("t0") + F.sum("t").over(upto)).alias("tokens_up_to"))
    at_least = F.col("dn") - F.col("docs_up_to") + F.col("n_docs")
    below = F.col("tokens_up_to") - F.col("t")
    return s.select(
        "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", at_least.alias("docs_at_least"), (F.col("tn") - below).alias("tokens_at_least"),
        (below + F.col("n_tokens") * at_least).alias("truncated_total"), F.col("tn").alias("corpus_tokens"), (F.col("docs_up_to") / F.col("dn")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, also those between lengths: documents longer than the limit,
    tokens kept after cutting each document to it, and tokens in documents that fit whole. Each is looked
    up in the suffix sums of the next length above the limit, all limits in one pass."""
    wanted = sorted({int(x) for x in limits})
    if not wanted:
        return sums.sparkSession.createDataFrame([], "limit long, docs_cut long, truncated_total long, tokens_in_whole_docs long")
    above = lambda x: F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    rows = sums.agg(F.max("corpus_tokens").alias("all"), F.array(*[F.struct(F.lit(x).cast("long").alias("limit"), above(x).alias("next")) for x in wanted]).alias("found"))
    rows = rows.where("all is not null").select("all", F.inline("found"))
    cut, whole = F.coalesce("next.docs_at_least", F.lit(0)).cast("long"), (F.col("all") - F.coalesce("next.tokens_at_least", F.lit(0))).cast("long")
    return rows.select("limit", cut.alias("docs_cut"), (whole + F.col("limit") * cut).alias("truncated_total"), whole.alias("tokens_in_whole_docs"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length up to which at least the given share of documents lies, all shares in one pass."""
    wanted = sorted({float(x) for x in shares})
    if not wanted:
        return sums.sparkSession.createDataFrame([], "share double, n_tokens long")
    rows = sums.agg(F.array(*[F.struct(F.lit(x).alias("share"), F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias("n_tokens")) for x in wanted]).alias("found"))
    return rows.select(F.inline("found")).where("n_tokens is not null")
