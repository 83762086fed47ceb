"""Shapes that reports need: module matrices, folder sums, flags by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.columns import is_entry, module_of
from quoin.functions.dimensions import Thresholds
from quoin.operators import aggregates as A

DEFAULTS = Thresholds()


def dsm_cells(edges: DataFrame) -> DataFrame:
    return A.cross_edges(edges).filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("n"))


def dsm_matrix(edges: DataFrame, modules: list[str]) -> DataFrame:
    """A row for each importing module, a column for each of modules; own edges count zero."""
    crossing = F.when(F.col("from_module") != F.col("to_module"), 1).otherwise(0)
    wide = A.cross_edges(edges).withColumn("n", crossing).groupBy("from_module").pivot("to_module", modules).agg(F.sum("n"))
    return wide.na.fill(0)


def degenerate_modules(files: DataFrame) -> DataFrame:
    """(warning, module, n): every module where there are fewer than three, else those with over four fifths of the files."""
    sizes = files.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n"))
    totals = sizes.agg(F.count("*").alias("modules"), F.sum("n").alias("total"))
    both = sizes.crossJoin(F.broadcast(totals)).withColumn("warning", F.when(F.col("modules") < 3, "few_modules").when(F.col("n") > 0.8 * F.col("total"), "large_module"))
    return both.filter("warning is not null").select("warning", "module", "n")


def folder_rollup(files: DataFrame) -> DataFrame:
    """(folder, lines, n): sums over every folder of the paths, the root as an empty name."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(folders).alias("folder"), "lines").groupBy("folder").agg(F.sum("lines").alias("lines"), F.count("*").alias("n"))


def flagged(files: DataFrame, functions: DataFrame, degrees: DataFrame, at: Thresholds = DEFAULTS, changes: DataFrame | None = None, uncovered: DataFrame | None = None, now=None) -> DataFrame:
    """(path, dimension) for all files that a dimension names."""
    tests = {"complexFn": F.col("cc") > at.complexity, "longFunctions": F.col("line_count") > at.long_function, "highParams": F.col("param_count") > at.params, "cognitiveComplexity": F.col("cognitive") > at.cognitive}
    # one pass over the functions for four dimensions
    named = F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in tests.items())))
    rows = [functions.select("path", F.explode(named).alias("dimension"))]
    rows.append(functions.join(A.duplicates(functions).select("body_hash"), "body_hash", "left_semi").select("path", F.lit("duplication").alias("dimension")))
    rows.append(files.filter(F.col("lines") > at.large_file).select("path", F.lit("largeFiles").alias("dimension")))
    god = (F.col("fan_out") > at.god_fan_out) & ~is_entry(F.col("node"))
    named = F.array_compact(F.array(F.when(god, F.lit("godFiles")), F.when(A.hotspot_score() >= at.hotspot, F.lit("hotspots"))))
    rows.append(degrees.select(F.col("node").alias("path"), F.explode(named).alias("dimension")))
    rows.append(A.imported(files, degrees).filter("dead and funcs > 0").select("path", F.lit("deadCode").alias("dimension")))
    if changes is not None:
        rows.append(A.file_churn(changes).select("path", F.lit("codeChurn").alias("dimension")))
        rows.append(changes.groupBy("path").agg(F.min("author").alias("a"), F.max("author").alias("b")).filter("a = b").select("path", F.lit("busFactor").alias("dimension")))
        rows.append(A.change_pairs(changes, at.change_coupling).select(F.explode(F.array("a", "b")).alias("path"), F.lit("changeCoupling").alias("dimension")))
        if now is not None:
            rows.append(A.last_modified(changes).filter(A.whole_days(now, F.col("ts")) >= at.age_days).select("path", F.lit("codeAge").alias("dimension")))
    if uncovered is not None:
        rows.append(uncovered.select("path", F.lit("testCoverageGap").alias("dimension")))
    return reduce(DataFrame.unionByName, rows).distinct()


def file_flags(files: DataFrame, named: DataFrame) -> DataFrame:
    counts = named.groupBy("path").agg(F.count("*").alias("flags"))
    return files.join(counts, "path", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))
