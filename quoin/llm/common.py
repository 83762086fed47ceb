"""Helpers that the text operators share: table access, shared storage, row fan-out."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many rows, of about so many bytes together, become Python objects at a time.
ARROW_ROWS, ARROW_BYTES = 500, 2 << 20
#: A key of more than this part of all rows is hot.
HOT = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (as in tests), else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quoin-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Paths given out while a scratch() lasts.
_given: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _given:
        paths.append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Remove, at the end, all that was stored inside, but for the paths to be kept: nothing lazy that reads it may outlive this."""
    paths: list[str] = []
    _given.append(paths)
    try:
        yield
    finally:
        _given.remove(paths)
        for path in paths:
            if path not in kept:
                removed(spark, path)
        swept(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Have the driver forget finished shuffles now, as it would in time, so that executors remove their files."""
    # what the first collection queues has to be seen to before the second can free the plans
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        gc.collect()
        time.sleep(0.3)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a frame made by stored(), once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a stored table in buckets by key, which joins by key don't move again (if the other side is hinted shuffle_merge); and what removes it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table, n = path.rpartition("/")[2].replace("-", "_"), partitions(df.sparkSession)
    df.repartition(n, key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    swept(spark)

    def gone() -> None:
        dropped(spark, spark.table(table))
        spark.sql(f"drop table {table}")

    return spark.table(table), gone


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this lasts, Arrow batches hold at most so many rows: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def looked_up(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how) for a right side of one row a key, however many rows of left share one.

    Keys of more than a HOT-th of left's rows, of which there are fewer than HOT, are joined where left's rows are; the
    others by key. left is read several times, so it should be stored.
    """
    sizes = left.groupBy(*on).agg(F.count("*").alias("_rows"))
    hot = stored(sizes.crossJoin(F.broadcast(left.agg(F.count("*").alias("_all")))).filter(F.col("_rows") * HOT > F.col("_all")).select(*on), "hot")
    if hot.count() >= HOT or hot.isEmpty():
        return left.join(right, on, how)
    few, here = F.broadcast(hot), F.broadcast(stored(right.join(F.broadcast(hot), on, "left_semi"), "looked_up"))
    return left.join(few, on, "left_anti").join(right, on, how).unionByName(left.join(few, on, "left_semi").join(here, on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[Iterable[dict[str, list]]], Iterator[dict[str, list]]], schema: str | T.StructType, most_rows: int = ARROW_ROWS, most_bytes: int = ARROW_BYTES) -> DataFrame:
    """mapInArrow with plain Python columns: fn gets dicts of lists, of about so many rows and bytes, and yields dicts of lists.

    Texts are long, so the session's Arrow batches are held to 4 * ARROW_ROWS rows, which bounds what waits on either side.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 4 * ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * ARROW_ROWS))
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def columns() -> Iterator[dict[str, list]]:
            for batch in batches:
                rows = max(1, min(most_rows, most_bytes * batch.num_rows // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pydict()

        for cols in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones renamed, so that an operator's own names can't clash with them; and the way back."""
    names = {c: c if c in used else f"_aside{i}" for i, c in enumerate(docs.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(new).alias(old) for old, new in names.items()))

    return docs.toDF(*names.values()), back
