"""Cut the lineage of loops in storage that survives lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (as in tests), else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quoin-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


class _Written(threading.local):
    """Paths written by a thread while each of its passing() lasts."""

    def __init__(self):
        self.lists: list[list[str]] = []


_written = _Written()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as a table, whose size Spark then knows: small ones are broadcast by its own check."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    for paths in _written.lists:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove, at the end, what was settled inside, but for the frames put into the list that this gives."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    _written.lists.append(paths)
    try:
        yield kept
    finally:
        _written.lists.pop()
        names = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()}
        for path in paths:
            if path.rpartition("/")[2] not in names:
                removed(spark, path)
