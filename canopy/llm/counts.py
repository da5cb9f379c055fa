"""Token counts: an exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.bpe import encode_batches
from canopy.llm.common import lean, materialise, ship_code

#: Lengths summed in one task.
STRETCH = 1024


def token_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens of each whole text (null and empty: 0), one row a row of docs; its other columns don't matter."""
    ship_code(docs.sparkSession)
    read = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunks in encode_batches(batches, path, read):
            n = [np.diff(first) for _, first in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n) if n else [], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias(read)).mapInArrow(lean(run), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens) -> one row for each length that occurs, answering every limit up to the next one.

    n_tokens, n_docs; docs_at_least and tokens_at_least (documents of this length
    or more, and their tokens); total_tokens; truncated_tokens (what is left when
    each document is cut at n_tokens); share_at_most (of documents, for quantiles).
    Documents are aggregated before any shuffle and the counts, a row for each
    length, are stored: both branches of the sums read them, so texts are encoded
    once.  Sums run in two steps, over stretches of lengths and within each.  An
    empty table gives no rows.
    """
    counts = materialise(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("_stretch", F.floor(F.col("n_tokens") / STRETCH).cast("long")).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    inner = Window.partitionBy("_stretch").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = counts.groupBy("_stretch").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s"))
    base = sums.select(
        F.col("_stretch").alias("_of"),
        *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}_above") for c in ("_d", "_s")],
        *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("_d", "_s")],
    )
    docs = F.sum("n_docs").over(inner) + F.col("_d_above")
    tokens = F.sum("_t").over(inner) + F.col("_s_above")
    out = counts.join(base, F.col("_stretch") == F.col("_of")).select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), F.col("_s_all").alias("total_tokens"), F.col("_d_all"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("_d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_d_all")).alias("share_at_most"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``: one row of the histogram answers."""
    row = histogram.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1).collect()
    if not row:
        return histogram.agg(F.coalesce(F.max("total_tokens"), F.lit(0))).first()[0]
    r = row[0]
    return r["total_tokens"] - r["tokens_at_least"] + limit * r["docs_at_least"]


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that a share q of documents doesn't exceed; None without documents."""
    return histogram.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens")).first()[0]
