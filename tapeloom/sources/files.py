"""Files of an exchange archive: tapes, bars and JSON with explicit schemas, boards as sinks with guards."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.nulls import ratio0
from ..operators.calendar import broker_code, number, whole

TAPE_FIELDS = ["buyer", "seller", "quantity", "rate", "amount", "contract"]


def tape_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files <symbol>/<date>.txt, six fields parted by tabs, or by blanks where a row has no tab; headers and blank lines go.

    `fault` says why a row isn't `kept`: 'fields' or 'numbers' that can't be parsed, an unknown 'broker', or a quantity, rate
    or broker that isn't 'positive'. Symbol and date come from the file's path.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path")).withColumn("value", F.regexp_replace("value", "\r", ""))
    parts = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split(F.trim("value"), " +"))
    rows = lines.filter(F.trim(F.regexp_replace("value", "\t", " ")) != "").select("file", F.transform(parts, F.trim).alias("p")).filter(F.lower(F.get("p", F.lit(0))) != "buyer")
    at = lambda i: F.get("p", F.lit(i))
    typed = rows.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("symbol"), F.to_date(F.regexp_extract("file", r"([0-9]{4}-[0-9]{2}-[0-9]{2})[^/]*$", 1)).alias("dt"), (F.size("p") < 6).alias("short"),
        broker_code(at(0)).alias("buyer"), broker_code(at(1)).alias("seller"), whole(at(2)).alias("qty"), number(at(3)).alias("rate"), number(at(4)).alias("source_amount"), at(5).alias("contract"),
    )
    none = lambda *names: F.greatest(*(F.col(n).isNull() for n in names))
    fault = F.when(F.col("short"), "fields").when(none("buyer", "seller"), "broker").when(none("qty", "rate", "source_amount"), "numbers").when((F.col("qty") <= 0) | (F.col("rate") <= 0) | (F.col("buyer") <= 0) | (F.col("seller") <= 0), "positive")
    return typed.withColumns({"amount": F.col("qty") * F.col("rate"), "fault": fault, "kept": fault.isNull()}).drop("short")


def tape_quality(trades: DataFrame) -> DataFrame:
    """A score of 0 to 100 for each session: rows kept of all, less a tenth for amounts that are off by more than 1 and 0.1 %.

    Faults, mismatches and repeated contracts or rows make a warning; rows of dealers don't.
    """
    c = F.count_if
    kept = F.col("kept")
    gap = kept & (F.col("source_amount") > 0) & (F.abs(F.col("source_amount") - F.col("amount")) > F.greatest(F.lit(1.0), 0.001 * F.col("amount")))
    named = kept & (F.col("contract") != "")
    q = trades.groupBy("symbol", "dt").agg(
        F.count("*").alias("total"), c(kept).alias("kept"), c(F.col("fault").isin("fields", "numbers")).alias("unparsable"), c(F.col("fault") == "broker").alias("unknown_brokers"), c(F.col("fault") == "positive").alias("not_positive"), c(gap).alias("mismatches"),
        (c(named) - F.count_distinct(F.when(named, F.col("contract")))).alias("repeated"), (c(kept) - F.count_distinct(F.when(kept, F.struct("buyer", "seller", "qty", "rate", "contract")))).alias("repeated_rows"),
        c(kept & ((F.col("buyer") >= 900000) | (F.col("seller") >= 900000))).alias("dealer_rows"),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * ratio0(F.col("kept"), F.col("total")) - 10 * ratio0(F.col("mismatches"), F.col("total"))))
    flaws = F.col("total") - F.col("kept") + F.col("mismatches") + F.col("repeated") + F.col("repeated_rows")
    return q.withColumns({"score": F.round(score, 4), "status": F.when(F.col("kept") == 0, "INVALID").when(flaws > 0, "WARNING").otherwise("VALID")})


def bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of files <symbol>/1D.txt with a header; rows without a close or a volume go, other blanks are null."""
    fields = ["date", "open", "high", "low", "close", "change", "percent_change", "volume", "amount"]
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{f} string" for f in fields), recursiveFileLookup=True)
    n = lambda f: number(F.col(f))
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("symbol"), F.to_date("date").alias("dt"), *(n(f).alias(f[0]) for f in ("open", "high", "low", "close")), n("volume").alias("v"), n("amount").alias("amount")
    ).filter("c is not null and v is not null")


def column_arrays(json: Column) -> Column:
    """Bars from JSON that holds a column for each field: {"t": [...], "o": [...], ...} -> array of structs."""
    x = F.from_json(json, "t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>")
    return F.arrays_zip(*(x[f].alias(f) for f in "tohlcv"))


@F.pandas_udf(StringType())
def inflate(frames: pd.Series) -> pd.Series:
    """Feed frames `<n>^<base64 of deflated text>`; null if a frame isn't one. Spark has no function that inflates."""

    def one(frame: str | None) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(frame.split("^", 1)[1])).decode()
        except (AttributeError, IndexError, ValueError, zlib.error):
            return None

    return frames.map(one)


def records(text: Column) -> Column:
    """Records of an inflated frame, a line each: exchange $ type $ symbol $ time $ values separated by ^."""
    line = lambda x: F.split(x, r"\$")
    one = lambda p: F.struct(F.get(p, F.lit(0)).alias("exchange"), F.get(p, F.lit(1)).alias("type"), F.get(p, F.lit(2)).alias("symbol"), F.get(p, F.lit(3)).alias("time"), F.split(F.get(p, F.lit(4)), r"\^").alias("fields"))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: one(line(x))), lambda r: r["fields"].isNotNull())


def operable(instruments: DataFrame, hard: list[str] | None = None) -> DataFrame:
    """Instruments (symbol, type, name) less funds, indices, bonds, promoters' shares and debentures.

    A symbol that ends in P or PO is a promoter's share if the symbol without it is listed.
    """
    base = instruments.select(F.col("symbol").alias("base"))
    stem = F.regexp_replace("symbol", "(PO|P)$", "")
    promoters = instruments.withColumn("stem", stem).filter(F.col("stem") != F.col("symbol")).join(base, F.col("stem") == F.col("base"), "left_semi").select("symbol")
    bad = F.col("type").isin("Mutual Fund", "Index", "Bond") | F.lower("name").contains("promot") | F.col("symbol").rlike("^[A-Z]+D[0-9]{2,4}$") | F.col("symbol").isin(*(hard or [""]))
    return instruments.filter(~F.coalesce(bad, F.lit(False))).join(promoters, "symbol", "left_anti")


class RefusedWrite(ValueError):
    """A sink's guard has found the new rows implausible; what was there stays."""


def write_board(board: DataFrame, path: str, least_share: float = 0.5) -> None:
    """Replace a board: refuse rows without a date, and fewer than `least_share` of the rows that are there.

    The new board is written beside the old one before anything is replaced.
    """
    spark = board.sparkSession
    if "date" not in board.columns:
        raise RefusedWrite("a board needs a date")
    last = board.select(*(c for c in board.columns if c != "date"), "date")
    fresh = f"{path}.new"
    last.write.mode("overwrite").parquet(fresh)
    written = spark.read.parquet(fresh)
    n, undated = written.agg(F.count("*"), F.count_if(F.col("date").isNull())).first()
    if undated:
        raise RefusedWrite(f"{undated} rows have no date")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        had = spark.read.parquet(path).count()
        if n < least_share * had:
            raise RefusedWrite(f"{n} rows would replace {had}")
        fs.delete(hadoop, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), hadoop)


def write_sessions(rows: DataFrame, path: str) -> None:
    """Replace the sessions that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
