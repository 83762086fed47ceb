"""Commit history: the log as text, parsed by Catalyst expressions."""

from __future__ import annotations

import subprocess
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.plans.storage import shared_dir

#: How commits and their fields are told apart in the log.
COMMIT, FIELD = "---COMMIT_SEPARATOR---", "---FIELD_SEPARATOR---"


def _asked(days: float) -> list[str]:
    form = f"{COMMIT}%n%H{FIELD}%aN{FIELD}%aI"
    return ["git", "log", f"--format={form}", "--numstat", "--no-merges", f"--since={days:g}.days.ago"]


def git_log(root: str, days: float = 90) -> str | None:
    """The log of the last days without merges; None where git can't tell."""
    try:
        out = subprocess.run(_asked(days), cwd=root, capture_output=True, check=True, timeout=300).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return out.decode("utf-8", "replace")


def git_changes(spark: SparkSession, root: str, days: float = 90) -> DataFrame | None:
    """The changes of the last days, from a log of any size: git writes it to a file, which is moved to the shared folder
    and cut into commits by the tasks. None where git can't tell, or tells nothing."""
    with tempfile.TemporaryDirectory(prefix="quoin-log-") as folder:
        local = Path(folder, "log")
        try:
            with local.open("wb") as sink:
                subprocess.run(_asked(days), cwd=root, stdout=sink, stderr=subprocess.DEVNULL, check=True, timeout=3600)
        except (OSError, subprocess.SubprocessError):
            return None
        if not local.stat().st_size:
            return None
        url = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(url)
        target.getFileSystem(conf).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(local.as_uri()), target)
    return stored_log(spark, url)


def parsed_log(chunks: DataFrame) -> DataFrame:
    """(hash, author, ts, path, added, deleted, ord) from rows (ord, chunk), a chunk being the text of one commit.

    Binary and renamed files are left out, and commits without three header fields or a valid date.
    """
    lines = chunks.withColumn("lines", F.split(F.regexp_replace(F.translate("chunk", "\r", ""), r"^\s+|\s+$", ""), "\n")).withColumn("head", F.split(F.get("lines", F.lit(0)), FIELD))
    headed = lines.filter(F.size("head") >= 3).select("ord", F.trim(F.get("head", F.lit(0))).alias("hash"), F.trim(F.get("head", F.lit(1))).alias("author"), F.try_to_timestamp(F.trim(F.get("head", F.lit(2)))).alias("ts"), F.posexplode("lines").alias("pos", "line")).filter("ts is not null and pos > 0")
    cells = headed.withColumn("c", F.split(F.trim("line"), "\t")).filter(F.size("c") >= 3)
    path = F.array_join(F.slice("c", 3, F.size("c") - 2), "\t")
    told = cells.select("hash", "author", "ts", path.alias("path"), F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("d"), F.struct("ord", "pos").alias("ord"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^\\\\s*([+-]?[0-9]+)', 1) as bigint)")
    return told.filter("a <> '-' and d <> '-' and not contains(path, ' => ')").select("hash", "author", "ts", "path", number("a").alias("added"), number("d").alias("deleted"), "ord").filter("added is not null and deleted is not null")


def changes_of(spark: SparkSession, log: str) -> DataFrame:
    chunks = [c for c in log.split(COMMIT) if c.strip()]
    return parsed_log(spark.createDataFrame(list(enumerate(chunks)), "ord bigint, chunk string"))


def stored_log(spark: SparkSession, url: str) -> DataFrame:
    """A saved log of any size, cut into commits by the reader rather than held whole."""
    rows = spark.read.option("lineSep", COMMIT).text(url).filter("trim(value) <> ''")
    return parsed_log(rows.select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("chunk")))
