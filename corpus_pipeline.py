"""A corpus pipeline of five stages, each one operator of tapeloom.llm.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all rows that its
predecessor left. Its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, language_id, mixing, sentencepiece_codec, simhash_dedup
from tapeloom.llm.common import only, row_mark, staged


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that aren't held out, and drop documents without a language (null or no letter).

    A document without a label gets the language that is found, unless it is ambiguous; ambiguous documents stay. Rows with
    a null doc_id aren't learned from; repeated rows stay; columns may have any names.
    """
    model = language_id.trained(docs)
    found = language_id.predict(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    label = F.coalesce("row.lang", F.when(~F.col("ambiguous"), F.col("lang_pred")))
    return found.select(*(label.alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that exact dedup keeps stays: the longest original, then the smallest doc_id; of rows repeated
    whole, one. A null text counts as empty, a null doc_id loses ties; columns may have any names."""
    judged = exact_dedup.exact_dedup(docs, extra={"row_mark": row_mark()})
    return only(docs, judged.filter("kept").select("doc_id", "row_mark"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, of several texts with that doc_id one, of rows
    repeated whole one. A null text counts as empty, a null doc_id stays only in a group without another; columns may have any names."""
    groups = simhash_dedup.simhash_groups(docs.select("doc_id", "text", row_mark().alias("row_mark")), ["row_mark"])
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row_mark").alias("row_mark")))
    kept = groups.groupBy("component_root").agg(least.alias("k")).select("k.doc_id", "k.row_mark")
    return only(docs, kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: the largest source once, smaller ones up to twice. Rows come in the
    mixture's order, from file to file, so whoever reads them in turn reads the block permutations. A null source is one of
    its own, a null text has no tokens; repeated rows are taken each; columns may have any names."""
    held = mixing.mix(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source"))
    return held.select("row", "mix_order").orderBy("mix_order").select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text again. A null text has no tokens; repeated rows stay;
    other columns go."""
    done = sentencepiece_codec.decoded(sentencepiece_codec.encode(docs.select("doc_id", "source", "lang", "text")))
    same = F.col("decoded_text") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "source", "lang", "token_ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("language ID", identify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenise),
]

#: SQL expresses neither the classifier nor the segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
