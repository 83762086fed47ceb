"""Source trees: which files there are, and what is in them.

Names are listed and filtered before anything is read. A tree on shared storage is read by the executors
(binaryFile), one on a disk that all see is listed by them, too; either way contents are parsed in parallel, each file
once, and no list of all files comes to the driver.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import schemas
from quoin.functions import columns as C
from quoin.functions.globs import is_ignored
from quoin.functions.lines import count_lines
from quoin.functions.typescript import read_source
from quoin.operators.ranking import numbered
from quoin.plans.storage import settled, shared_dir

#: Folders that a walk doesn't enter.
CLOSED = {"node_modules", "dist", ".git", "testing", "fixtures"}


def git_listed(spark: SparkSession, root: str) -> DataFrame | None:
    """(ord, path) of the tracked files, in git's order, which git writes to a file and tasks read; None where git can't tell."""
    with tempfile.TemporaryDirectory(prefix="quoin-files-") as folder:
        local = Path(folder, "files")
        try:
            with local.open("wb") as sink:
                subprocess.run(["git", "ls-files"], cwd=root, stdout=sink, stderr=subprocess.DEVNULL, check=True, timeout=600)
        except (OSError, subprocess.SubprocessError):
            return None
        url = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(url)
        target.getFileSystem(conf).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(local.as_uri()), target)
    rows = spark.read.option("lineSep", "\n").text(url).filter("value <> ''")
    return rows.select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("path"))


def included(path, prefixes: Iterable[str]):
    """Whether a path begins with one of some folders; none: all do."""
    tests = [path.startswith(p if p.endswith("/") else p + "/") for p in prefixes]
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(True) if out is None else out


def in_order_of_walks(paths: DataFrame) -> DataFrame:
    """(ord, path): a folder's files by name, then its folders by name, each with all that is in it."""
    parts = F.split("path", "/")
    key = F.transform(parts, lambda p, i: F.concat(F.when(i < F.size(parts) - 1, F.lit("1")).otherwise(F.lit("0")), p))
    return numbered(paths.select("path", key.alias("_key")), ["_key"], "ord").select("ord", "path")


def source_paths(spark: SparkSession, root: str, include: Iterable[str] = (), ignore: Iterable[str] = (), there: DataFrame | None = None) -> DataFrame:
    """(ord, path) of the sources, tests and what is set aside left out. there: what existing() lists, if it is known."""
    p = F.col("path")
    asked = C.is_source(p) & included(p, include) & ~is_ignored(p, list(ignore))
    tracked = git_listed(spark, root)
    if tracked is not None:
        return tracked.filter(asked)
    there = existing(spark, root)[0] if there is None else there
    return in_order_of_walks(there.filter(asked & ~p.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in sorted(CLOSED)) + ")/")))


def test_paths(spark: SparkSession, root: str) -> DataFrame:
    """(ord, path) of the test files; none outside git."""
    tracked = git_listed(spark, root)
    return spark.createDataFrame([], "ord bigint, path string") if tracked is None else tracked.filter(C.is_test(F.col("path")))


#: Folders in which no import is looked up: nothing is scanned there, and they are large.
UNSEEN = {"node_modules", ".git"}


def _starts(base: str, least: int = 64, deepest: int = 3) -> list[tuple[str, bool]]:
    """(folder, whether with all below it), which together hold everything: a few levels, until there are enough to share out."""
    flat: list[str] = []
    whole = [""]
    for _ in range(deepest):
        if len(whole) >= least:
            break
        flat += whole
        whole = [e.path[len(base) + 1 :] for rel in whole for e in sorted(os.scandir(os.path.join(base, rel)), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in UNSEEN]
    return [*((rel, False) for rel in flat), *((rel, True) for rel in whole)]


def existing(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """((path) of all files below root that aren't links, (link, target) of the links; target is null where it leaves root).

    Folders are listed by tasks, and what they find stays with them: the driver looks at the folders at the top only.
    root must be where all of them see it.
    """
    base = os.path.realpath(root)

    def told(start: str, whole: bool) -> Iterator[tuple[str, str | None, bool]]:
        for folder, inner, names in os.walk(os.path.join(base, start)):
            inner[:] = [d for d in inner if d not in UNSEEN]
            for name in (*inner, *names):
                at = os.path.join(folder, name)
                if os.path.islink(at):
                    target = os.path.relpath(os.path.normpath(os.path.join(folder, os.readlink(at))), base)
                    yield at[len(base) + 1 :], None if target.startswith("..") else "" if target == "." else target, True
                elif name in names:
                    yield at[len(base) + 1 :], None, False
            if not whole:
                break

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for start, whole in zip(rows.start, rows.whole, strict=True):
                found = told(start, whole)
                while held := list(islice(found, 10_000)):
                    yield pd.DataFrame(held, columns=["path", "target", "link"])

    starts = _starts(base)
    listed = spark.createDataFrame(starts, "start string, whole boolean").repartition(max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism)), "start")
    found = settled(listed.mapInPandas(run, "path string, target string, link boolean"))
    return found.filter("not link").select("path"), found.filter("link").select(F.col("path").alias("link"), "target")


def stored_paths(spark: SparkSession, url: str) -> DataFrame:
    """(path) of all files below a folder in any storage that Spark reads, by name alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(url).select("path")
    rel = F.regexp_replace(F.substring_index(F.col("path"), url.split("://")[-1].rstrip("/") + "/", -1), "^/+", "")
    return files.select(rel.alias("path")).filter(~F.col("path").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in sorted(UNSEEN)) + ")/"))


def with_text(paths: DataFrame, root: str) -> DataFrame:
    """paths with text read by the tasks; files that can't be read are left out. root must be where all of them see it."""
    base = str(Path(root).resolve())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            texts = []
            for p in rows.path:
                try:
                    texts.append(Path(base, p).read_bytes().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield rows.assign(text=texts).dropna(subset=["text"])

    spread = paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInPandas(run, "ord bigint, path string, text string")


def stored_tree(spark: SparkSession, url: str, include: Iterable[str] = (), ignore: Iterable[str] = (), tests: bool = False) -> DataFrame:
    """(ord, path, text) of the sources (or the tests) below a folder in any storage that Spark reads; order is that of names.

    Files are parted by ranges of names, which spreads the parsing, too. Keep what is made of it: ord is given by partition.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx}").load(url)
    rel = F.regexp_replace(F.substring_index(F.col("path"), url.split("://")[-1].rstrip("/") + "/", -1), "^/+", "")
    p = F.col("path")
    closed = p.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in sorted(CLOSED)) + ")/")
    asked = C.is_test(p) if tests else C.is_source(p) & included(p, include) & ~is_ignored(p, list(ignore))
    kept = files.select(rel.alias("path"), "content").filter(asked & ~closed)
    spread = kept.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "path").sortWithinPartitions("path")
    return spread.select(F.monotonically_increasing_id().alias("ord"), "path", F.decode("content", "UTF-8").alias("text"))


def extracted(sources: DataFrame) -> DataFrame:
    """What is in each file: counts of lines, functions, classes, specifiers. A file that can't be parsed has parsed false."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                counts = count_lines(r.text)
                try:
                    read = read_source(r.text, r.path.endswith(".tsx"))
                    parsed = True
                except Exception:  # noqa: BLE001  one file's text must not end the scan
                    read, parsed = {"functions": [], "classes": [], "imports": []}, False
                out.append((r.path, r.ord, *counts, parsed, read["functions"], read["classes"], read["imports"]))
            yield pd.DataFrame(out, columns=["path", "ord", "lines", "logic", "comments", "blanks", "parsed", "functions", "classes", "specifiers"])

    return sources.select("path", "ord", "text").mapInPandas(run, schemas.EXTRACTED)


def files(read: DataFrame) -> DataFrame:
    return read.select("path", C.base_name(F.col("path")).alias("name"), C.language(F.col("path")).alias("lang"), "lines", "logic", "comments", "blanks", F.size("functions").alias("funcs"), "parsed", "ord")


def functions(read: DataFrame) -> DataFrame:
    return read.select("path", "ord", F.posexplode("functions").alias("pos", "f")).select("path", F.struct("ord", "pos").alias("ord"), "f.*")


def classes(read: DataFrame) -> DataFrame:
    return read.select("path", "ord", F.posexplode("classes").alias("pos", "c")).select("path", F.struct("ord", "pos").alias("ord"), "c.*")


def specifiers(read: DataFrame) -> DataFrame:
    return read.select("path", "ord", F.posexplode("specifiers").alias("pos", "specifier")).select("path", F.struct("ord", "pos").alias("ord"), "specifier")
