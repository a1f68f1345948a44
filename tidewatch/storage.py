"""Tables written between steps: Parquet in the folder that all machines share.

A written table cuts lineage, survives lost executors and is computed once however often it is read.  The folder is that of
spark.checkpoint.dir; only a local master, where the machine is the cluster, may go without and gets a temporary one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def scratch() -> str:
    """A folder of the driver's own, removed at exit."""
    if not _own_folder:
        _own_folder.append(os.path.realpath(tempfile.mkdtemp(prefix="tidewatch-")))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + scratch()


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df written in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """The results of makers that don't depend on each other, whose jobs run at the same time."""
    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(m)) for m in makers]]


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles() if "/tidewatch/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
