"""The live feed with Structured Streaming: ticks come in as files, queries keep minute bars, last quotes and merged fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources.store import shared_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks of events.parquet, be it one file or a folder of part files."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("user_id").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("price"), F.col("event_id").alias("seq"))


def minute_bars(ticks: DataFrame) -> DataFrame:
    return ticks.withWatermark("ts", "10 minutes").groupBy("instrument", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"), F.count("*").alias("n")
    ).select("instrument", F.col("w.start").alias("minute"), "o", "h", "l", "c", "n")


def last_quotes(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("instrument").agg(F.max_by(F.struct("ts", "price", "event_type"), "seq").alias("x"), F.count("*").alias("n")).select("instrument", "x.ts", "x.price", "x.event_type", "n")


def merged_fields(ticks: DataFrame) -> DataFrame:
    """Partial updates merged by key: each event type sets one field of its instrument, and the others keep their values.

    State is one small row for each field of an instrument, whatever the number of ticks.
    """

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in batches:
            for name, seq, price in zip(pdf["event_type"], pdf["seq"], pdf["price"], strict=True):
                if name not in fields or seq > fields[name][0]:
                    fields[name] = (int(seq), float(price))
        names = sorted(fields)
        state.update((names, [list(fields[n]) for n in names]))
        yield pd.DataFrame({"instrument": [key[0]] * len(names), "field": names, "seq": [fields[n][0] for n in names], "price": [fields[n][1] for n in names]})

    return ticks.groupBy("instrument").applyInPandasWithState(
        merge, "instrument long, field string, seq long, price double", "names array<string>, latest array<array<double>>", "update", "NoTimeout"
    )


def run_to_end(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that there is, in as many triggers as the source makes of it."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The table that a stream in complete mode ends with: each batch replaces the one before."""
    out = shared_path(spark, f"stream-{name}")
    run_to_end(stream, "complete", lambda df, _: df.write.mode("overwrite").parquet(f"{out}/table"), f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def upserted(spark: SparkSession, stream: DataFrame, name: str, key: list[str], order: str) -> DataFrame:
    """The table that a stream in update mode ends with: batches are kept apart by number, so a batch that runs again
    replaces itself, and the newest row of a key wins."""
    out = shared_path(spark, f"stream-{name}")
    run_to_end(stream, "update", lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/table/batch={i}"), f"{out}/checkpoint")
    rows = spark.read.parquet(f"{out}/table").drop("batch")
    others = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("_batch", order)).alias("x")).select(*key, "x.*")
