"""Reading the workspace's tables and the few settings every operator shares."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


class Files:
    """Small files and folders on whatever file system a path names, through Hadoop's."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._utils = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; fails if there is one."""
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a fresh local folder is made and set.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="loamdex-checkpoint-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but the result can be scanned with
    column pruning and survives the loss of executors. Tables of an application stand
    in a folder of its id, to be deleted when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loamdex/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/loamdex/" in folder:
            Files(df.sparkSession, folder).delete(folder)


def default_data_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
