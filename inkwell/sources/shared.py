"""Staged tables: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session makes a folder of its own; on a cluster that would be one machine's, so there it is a RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def write(df: DataFrame, label: str, *, light: bool = False, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under a new name in the shared folder; the table read back, and its path.

    ``light`` is for tables of a few numbers a row: they are written by two tasks a core at most, as every file costs a few calls of the
    file system whatever it holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    options = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"} | options  # nobody looks for the mark
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if light else df).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str, *, light: bool = False, **options: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    return write(df, label, light=light, **options)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one operator. ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, {}, []

    def staged(self, df: DataFrame, label: str, *, light: bool = False, **options: str) -> DataFrame:
        table, path = write(df, label, light=light, **options)
        self.paths[path] = table
        return table

    def kept(self, df: DataFrame) -> DataFrame:
        """Hold ``df`` on the executors' disks, for small tables between two staged ones: what a lost executor held is computed anew from those."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def drop(self, *keep: DataFrame) -> None:
        """Remove all tables but the staged ones of ``keep``."""
        while self.held:
            self.held.pop().unpersist()
        for path, table in list(self.paths.items()):
            if not any(table is k for k in keep):
                delete(self.spark, path)
                del self.paths[path]
