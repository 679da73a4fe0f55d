"""Tables that are derived once and stored in the shared folder, so that queries read them and don't derive them anew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: the cluster's checkpoint folder, or a local one with a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor reach")
        base = f"file://{tempfile.gettempdir()}/tapeloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder, by Hadoop's file system, so any store that Spark reads will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def stored(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], by: list[str], then: list[str] | None = None) -> DataFrame:
    """The table `name` of a folder's inputs. A session makes it once for each state of the folder, sorted by the columns `by` and `then`.

    Ranges of `by` go to one file each, so that filters on them skip files and row groups, and no key makes a small file.
    """
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, folder, name, stamp(spark, folder))
    if key not in _PATHS:
        path = shared_path(spark, name)
        make().repartitionByRange(*by).sortWithinPartitions(*by, *(then or [])).write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])
