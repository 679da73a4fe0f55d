"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary finds the digests that hold more than a share PHI of all rows. There are at most
1 / (PHI - 1 / (K + 1)) of them, whatever the size of the table, so their verified winners are broadcast
and their rows never meet in one task. Every other digest has at most PHI of the rows; its winner is a partial aggregate,
joined back by a shuffle in which a large group can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty, without_space

#: Counters of a summary, and the share of all rows from which a digest counts as heavy.
K = 1000
PHI = 1 / 500


def misra_gries(counters: pd.Series, more: pd.Series, k: int) -> pd.Series:
    """Merge two summaries (digest -> count) into one with at most k counters."""
    merged = more if counters.empty else counters.add(more, fill_value=0)
    if len(merged) > k:
        merged = merged - merged.nlargest(k + 1).iloc[-1]
        merged = merged[merged > 0]
    return merged


def frequent(rows: DataFrame, key: str, k: int = K, phi: float = PHI) -> DataFrame:
    """The keys with at least phi of the rows, and perhaps some with at least phi - 1/(k+1) of them."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = pd.Series(dtype="int64")
        for batch in batches:
            counters = misra_gries(counters, batch[key].value_counts(), k)
        yield pd.DataFrame({key: counters.index.astype(str), "estimate": counters.to_numpy("int64")})

    n = rows.count()
    return (
        rows.select(key)
        .mapInPandas(summarise, f"{key} string, estimate long")
        .groupBy(key)
        .agg(F.sum("estimate").alias("estimate"))
        .filter(F.col("estimate") >= n * (phi - 1 / (k + 1)))
        .select(key)
    )


def exact_dedup(docs: DataFrame, k: int = K, phi: float = PHI, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the characters of SPACE; null counts as empty. Of equal
    texts the one with the most code points in its original stays, then that with the smallest doc_id. Rows
    that are repeated whole (same doc_id and text) form a group too, and all of them carry kept = true; a
    null doc_id loses every tie. An empty table gives an empty result. Other columns are ignored; those of extra are
    made from docs and come with the rows.
    """
    text, extra = text_or_empty(), extra or {}
    rows = staged(docs.select("doc_id", *(c.alias(n) for n, c in extra.items()), F.sha2(without_space(text), 256).alias("text_sha256"), F.length(text).alias("size")), "digests")
    heavy = staged(frequent(rows, "text_sha256", k, phi), "heavy")
    best = F.min(F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id")))
    winners = (
        rows.join(F.broadcast(heavy), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best.doc_id.alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = staged(winners, "winners")  # at most as many rows as heavy has
    of_heavy = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    of_rest = rest.join(rest.groupBy("text_sha256").agg(best.doc_id.alias("keep_id"), F.count("*").alias("group_size")), "text_sha256")
    return of_heavy.select(of_rest.columns).unionAll(of_rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *extra
    )


def op3_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""
