"""What the operators of this subpackage share: staging in the shared folder and text constants."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor reach.

    It is the cluster's `spark.checkpoint.dir`; where that is unset, a temporary folder of this machine is made once for
    each session, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tapeloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor reach")
        base = f"file://{tempfile.mkdtemp(prefix='tapeloom-')}"
        spark.conf.set("tapeloom.shared.dir", base)
    return base.rstrip("/") + "/tapeloom"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A lost executor then costs a task of the writing or of the reading job, never the whole chain. row_group: bytes of a
    row group, for tables with very large rows; the writer looks at its size after every row, not first after 100, which
    can be all rows of a task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    large = {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1} if row_group else {}
    df.write.options(**large).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without_space(text: Column) -> Column:
    """Text without the characters of SPACE. One plain byte replacement each is faster than a regular expression."""
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_mark() -> Column:
    """Tells rows with the same doc_id and unlike texts apart."""
    return F.xxhash64(text_or_empty())


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and row_mark() are in kept (doc_id, row_mark); of rows repeated whole, one.

    The columns of docs may have any names: they travel as one struct.
    """
    wanted = staged(kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("row_mark").alias("kept_mark")).agg(F.count("*").alias("copies")), "kept")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"), row_mark().alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_mark") == F.col("kept_mark"))
    found = keyed.join(wanted.filter("copies = 1"), same, "left_semi")
    repeated = wanted.filter("copies > 1")
    if not repeated.isEmpty():
        found = found.unionAll(keyed.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_mark"]))
    return found.select("row.*")


def blocks(docs: DataFrame, fields: dict[str, Column], name: str, block_bytes: int, work: Callable[[int, dict[str, list]], list[dict]], parts: dict[str, pa.DataType]) -> DataFrame:
    """docs packed as they stand into rows of about block_bytes of text, written to the shared folder and read again.

    Columns: block, an array for each of fields (strings and booleans), `sizes` and `blob`, from which texts_of() makes the
    texts again, and `parts`, an array of structs that work(block, {field: values, "data": texts}) returns; parts has their
    fields. A null text is empty. No row moves, so copies lie where their rows lay, and a text larger than block_bytes is a
    block of its own. Reading `parts` alone leaves the texts on disk.
    """
    rows = docs.select(*(c.alias(n) for n, c in fields.items()), text_or_empty().cast("binary").alias("data"))
    kinds = {"string": pa.string(), "boolean": pa.bool_()}
    types = {n: pa.list_(kinds[t]) for n, t in rows.dtypes[:-1]} | {"sizes": pa.list_(pa.int64()), "blob": pa.binary(), "parts": pa.list_(pa.struct(list(parts.items())))}
    names = {pa.int64(): "long", pa.binary(): "binary"}
    ddl = "block long, " + "".join(f"{n} array<{t}>, " for n, t in rows.dtypes[:-1]) + "sizes array<long>, blob binary, parts array<struct<" + ", ".join(f"{n}: {names[t]}" for n, t in parts.items()) + ">>"
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list] = {c: [] for c in columns}
        for batch in batches:
            at, upto = 0, np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = upto[at - 1] if at else 0
                end = max(int(np.searchsorted(upto, block_bytes - size + before, "right")), at + (not size))
                for c in columns:
                    held[c] += batch.column(c).slice(at, end - at).to_pylist()
                size += int(upto[end - 1] - before) if end > at else 0
                if end < batch.num_rows or size >= block_bytes:
                    yield full(task << 32 | n, held)
                    held, size, n = {c: [] for c in columns}, 0, n + 1
                at = end
        if held["data"]:
            yield full(task << 32 | n, held)

    def full(block: int, held: dict[str, list]) -> pa.RecordBatch:
        texts = held["data"]
        made = {c: held[c] for c in columns[:-1]} | {"sizes": [len(x) for x in texts], "blob": zstandard.ZstdCompressor().compress(b"".join(texts)), "parts": work(block, held)}
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([made[c]], t) for c, t in types.items())], ["block", *types])

    return staged(rows.mapInArrow(run, ddl), name, row_group=block_bytes)


def texts_of(block: pd.DataFrame) -> list[bytes]:
    """The texts of a frame with one row of blocks(), or none."""
    if not len(block):
        return []
    ends = np.cumsum(block["sizes"].iloc[0]).tolist()
    data = zstandard.ZstdDecompressor().decompress(block["blob"].iloc[0])
    return [data[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
