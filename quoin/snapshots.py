"""Snapshots of reports, in rows (name, raw_value, grade), as numbered versions beside the tree they tell of.

A version is written to a folder of its own and put in its place by one rename, so readers see all of it or nothing, and
of two that are written at once one takes the next number. Trees on disk and in shared storage are treated alike.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, raw_value double, grade string"


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        """folder: a URL, or a path on disk."""
        self.spark, self.folder = spark, (folder if "://" in folder else f"file://{folder}").rstrip("/")
        self.paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.store = self.paths(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.store.exists(self.paths(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.store.listStatus(self.paths(self.folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))

    def write(self, rows: DataFrame) -> int:
        """The number of the version that rows are now."""
        made = f"{self.folder}/_{uuid.uuid4().hex}"
        rows.select("name", "raw_value", "grade").coalesce(1).write.parquet(made)
        number = (self.versions() or [0])[-1] + 1
        # a rename onto a folder that exists would put this one inside it
        while self.store.exists(self.paths(f"{self.folder}/v{number}")) or not self.store.rename(self.paths(made), self.paths(f"{self.folder}/v{number}")):
            number += 1
        return number

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the last by default; None where there is none."""
        known = self.versions()
        number = number if number is not None else (known or [None])[-1]
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{number}") if number in known else None


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text in any storage; None where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in its place by one rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made, place = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    if store.getScheme() == "file":
        store = store.getRawFileSystem()  # no sums beside a file that people edit
    out = store.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(place, False)
    if not store.rename(made, place):
        raise OSError(f"{path} can't be written")
