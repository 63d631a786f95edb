"""Token counts from an exact histogram of document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cached_tokenizer, documents, slices, stored, text_of, tokenizer_file


def lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_ids: int = 0) -> DataFrame:
    """n_tokens and n_docs, pre-aggregated by task (at most one row for each distinct length in an Arrow batch)."""
    path = tokenizer_file(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = cached_tokenizer(path, 1_200_000)  # no shuffle competes for memory here
        for pdf in batches:
            texts = pdf["text"].tolist()
            sizes = [len(x) for a, b in slices(texts) for x in tok.encode(texts[a:b])]
            values, counts = np.unique(np.array(sizes, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"n_tokens": values + end_ids, "n_docs": counts})

    return docs.select(text_of().alias("text")).mapInPandas(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_ids: int = 0, width: int = 1024) -> DataFrame:
    """The exact histogram of encoded lengths with the suffix sums that answer every context limit.

    One row per length L that occurs: n_tokens (L), n_docs (of exactly L), docs_longer (over L), docs_upto, tokens_upto (in documents
    of up to L), tokens_longer (in documents over L), truncated_tokens (what is left of the whole corpus when every
    document is cut at L) and quantile (the share of documents of up to L). Null texts count as empty, length
    ``end_ids``; an empty table gives no rows. The sums run in ranges of ``width`` lengths and over the ranges' totals,
    so no single task orders all lengths.
    """
    hist = lengths(docs, tokenizer, end_ids).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    hist = stored(hist, "lengths")  # read more than once below
    hist = hist.withColumn("r", F.floor(F.col("n_tokens") / width)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    totals = hist.groupBy("r").agg(F.sum("n_docs").alias("rd"), F.sum("t").alias("rt"))
    zero, first, last = F.lit(0), Window.unboundedPreceding, Window.unboundedFollowing
    below, above = Window.orderBy("r").rowsBetween(first, -1), Window.orderBy("r").rowsBetween(1, last)
    totals = totals.select(
        "r",
        *(F.coalesce(F.sum(c).over(w), zero).alias(n) for c, w, n in (("rd", below, "bd"), ("rt", below, "bt"), ("rd", above, "ad"), ("rt", above, "at"))),
    )
    inside = Window.partitionBy("r").orderBy("n_tokens")
    upto, after = inside.rowsBetween(first, 0), inside.rowsBetween(1, last)
    out = hist.join(totals, "r").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(upto) + F.col("bd")).alias("docs_upto"),
        (F.coalesce(F.sum("n_docs").over(after), zero) + F.col("ad")).alias("docs_longer"),
        (F.sum("t").over(upto) + F.col("bt")).alias("tokens_upto"),
        (F.coalesce(F.sum("t").over(after), zero) + F.col("at")).alias("tokens_longer"),
    )
    return out.select(
        "*",
        (F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        (F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_longer"))).alias("quantile"),
    )


def answers(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, tokens in all, tokens left after cutting at the limit."""
    total = F.sum(F.col("n_docs") * F.col("n_tokens"))
    rows = [
        histogram.agg(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
            F.coalesce(total, F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        )
        for limit in limits
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(documents(spark, sf_dir))
