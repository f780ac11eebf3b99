"""The folder that driver and executors share, and intermediate tables written there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


class NoSharedFolder(RuntimeError):
    """A cluster whose session names no folder that all machines see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the checkpoint folder already set.

    Only where the driver is the only machine (a local master), as in tests, may it be unset; a folder of our own
    is then made and set as the checkpoint folder. Elsewhere that is an error: executors would write to their own disks.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean_up() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


atexit.register(_clean_up)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it goes when the driver's process ends, if not before."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder`` once nothing reads it any more."""
    _delete(spark, path)
    _MADE[:] = [x for x in _MADE if x[1] != path]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and the rows outlive any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result, all dropped at the end of the ``with`` block; the result must be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_folder(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
