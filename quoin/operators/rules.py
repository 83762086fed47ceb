"""Rules on layers, boundaries and constraints; gates and session differences.

One implementation each: the engine, its gate and its tools compare by these, and so do the queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.columns import grade_value, value_grade
from quoin.functions.globs import matches, star_regex


def layer_of(path: Column, layers: list) -> Column:
    """The position of the first layer with a pattern that matches; null for none."""
    hits = [F.when(reduce(lambda a, b: a | b, (matches(p, path) for p in layer.paths), F.lit(False)), F.lit(i)) for i, layer in enumerate(layers)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("int")


#: Patterns that are asked as predicates on each edge, without a join; more are looked up by their literal beginnings.
PREDICATES = 64


def matched(paths: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(path, i) for each distinct path (path) and each number i of a pattern (i, pattern) that matches it.

    Patterns are a table by the folder that they begin with; a path's folders are joined with it, and only the patterns
    met there are matched. So work grows with the patterns that share a path's folders, not with all of them.
    """
    rows = []
    for i, p in patterns:
        rows.append((i, p, "is", "", "", ""))
        before, star, after = p.partition("**")
        if star and "**" not in after:
            after = "" if after == "/" else after.removeprefix("/")
            rows.append((i, before.rpartition("/")[0], "name" if "*" in after else "tree", before, after, star_regex(after)))
        elif not star:
            rows.append((i, p.partition("*")[0].rpartition("/")[0], "star", "", "", star_regex(p)) if "*" in p else (i, p, "folder", "", "", ""))
    table = paths.sparkSession.createDataFrame(rows, "i int, at string, kind string, before string, after string, regex string")
    parts = F.split("path", "/")
    asked = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("at"))
    rest = "substring(path, length(before) + 1)"
    test = f"""CASE kind WHEN 'is' THEN path = at WHEN 'folder' THEN path <> at WHEN 'star' THEN path rlike regex
        WHEN 'tree' THEN startswith(path, before) AND endswith({rest}, after) ELSE startswith(path, before) AND element_at(split({rest}, '/'), -1) rlike regex END"""
    return asked.join(table, "at").filter(test).select("path", "i").distinct()


def _by_index(edges: DataFrame, layers: list) -> DataFrame:
    """edges with a and b, the positions of the layers of their ends; those without both are left out."""
    paths = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    of = matched(paths, [(i, p) for i, layer in enumerate(layers) for p in layer.paths]).groupBy("path").agg(F.min("i").alias("i"))
    return edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst")


def layer_violations(edges: DataFrame, layers: list) -> DataFrame:
    """Edges from a layer to one of lower order. Few patterns are predicates on the edge, without a join."""
    names, orders = F.array(*(F.lit(x.name) for x in layers)), F.array(*(F.lit(float(x.order)) for x in layers))
    few = sum(len(x.paths) for x in layers) <= PREDICATES
    placed = edges.withColumn("a", layer_of(F.col("src"), layers)).withColumn("b", layer_of(F.col("dst"), layers)).filter("a is not null and b is not null") if few else _by_index(edges, layers)
    told = placed.select("*", F.get(names, F.col("a")).alias("from_layer"), F.get(names, F.col("b")).alias("to_layer"), F.get(orders, F.col("a")).alias("from_order"), F.get(orders, F.col("b")).alias("to_order"))
    return told.filter("from_order > to_order").drop("a", "b")


def boundary_violations(edges: DataFrame, boundaries: list) -> DataFrame:
    """A row for each edge and each boundary that it crosses."""
    if len(boundaries) > PREDICATES:
        ends = [matched(edges.select(F.col(c).alias("path")), [(i, getattr(b, side)) for i, b in enumerate(boundaries)]).toDF(c, "boundary") for c, side in (("src", "source"), ("dst", "target"))]
        return edges.join(ends[0], "src").join(ends[1], ["dst", "boundary"]).select(*edges.columns, "boundary")
    hits = F.array_compact(F.array(*(F.when(matches(b.source, F.col("src")) & matches(b.target, F.col("dst")), F.lit(i)) for i, b in enumerate(boundaries))))
    return edges.withColumn("boundary", F.explode(hits)) if boundaries else edges.withColumn("boundary", F.lit(None).cast("int")).filter("false")


def gate_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(name, base, current, degraded) from raw values by dimension: coupling may rise by a twentieth, others not at all."""
    both = base.select("name", F.col("raw_value").alias("base")).join(current.select("name", F.col("raw_value").alias("current")), "name")
    slack = F.when(F.col("name") == "coupling", F.lit(0.05)).otherwise(F.lit(0.0))
    return both.withColumn("degraded", F.col("name").isin("coupling", "cycles", "godFiles", "complexFn", "depth") & (F.col("current") > F.col("base") + slack))


def grade_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """(name, from_grade, to_grade) of the dimensions whose grades differ."""
    both = base.select("name", F.col("grade").alias("from_grade")).join(current.select("name", F.col("grade").alias("to_grade")), "name")
    return both.filter("from_grade <> to_grade")


def composite(grades: DataFrame, *by: str) -> DataFrame:
    """(*by, composite): the grade of all rows with grade, or of each group: the mean, rounded down, but at most one above the worst; A for no rows."""
    v = grade_value(F.col("grade"))
    level = grades.groupBy(*by).agg(F.least(F.floor(F.avg(v)), F.min(v) + 1).cast("int").alias("v"))
    return level.select(*by, F.coalesce(value_grade(F.col("v")), F.lit("A")).alias("composite"))
