"""Typed rows behind each dimension, and their shapes in reports.

Rows are ranked by Spark (ranking.py) and never gathered whole: a report reads the first SHOWN of them; where there are
more, all are written as a table of pages, which the report names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.columns import is_entry, is_uncovered, whole_days
from quoin.operators import aggregates as A
from quoin.operators import graph as G
from quoin.operators.ranking import numbered
from quoin.plans.context import COMPUTED, Context
from quoin.plans.storage import settled, shared_dir

#: Rows of a dimension that a report reads, and that a page of the table of all has.
SHOWN = 10_000

Ranked = tuple[DataFrame, list[str | Column]]


def _functions(test: Callable[[Context], Column], value: str) -> Callable[[Context], Ranked]:
    return lambda c: (c.functions.filter(test(c)).select(F.col("path").alias("file"), "name", value, F.col("ord").alias("_o")), ["_o"])


def _of_files(c: Context, df: DataFrame, *more: str) -> Ranked:
    return df.select(F.col("path").alias("file"), *more, F.col("ord").alias("_o")), ["_o", "file"]


def _duplicates(c: Context) -> Ranked:
    twice = c.functions.join(A.duplicates(c.functions).select("body_hash"), "body_hash")
    first = twice.groupBy("body_hash").agg(F.min("ord").alias("_first"))
    return twice.join(first, "body_hash").select("body_hash", F.col("path").alias("file"), "name", "_first", F.col("ord").alias("_o")), ["_first", "body_hash", "_o"]


def uncovered(c: Context) -> DataFrame:
    """The files that tests should reach and don't."""
    return c.files.filter(~is_uncovered(F.col("path"))).join(c.tested.withColumnRenamed("node", "path"), "path", "left_anti")


def _aged(c: Context) -> Ranked:
    return A.last_modified(c.changes).select(F.col("path").alias("file"), whole_days(c.now, F.col("ts")).alias("days")).filter(F.col("days") >= c.at.age_days), [F.desc("days"), "file"]


#: The rows behind a dimension and their order; names that begin with _ only order. History and tests may be missing.
ROWS: dict[str, Callable[[Context], Ranked]] = {
    "cycles": lambda c: (c.components.select("component", "node"), ["component", "node"]),
    "godFiles": lambda c: (c.degrees.filter((F.col("fan_out") > c.at.god_fan_out) & ~is_entry(F.col("node"))).select(F.col("node").alias("file")), ["file"]),
    "complexFn": _functions(lambda c: F.col("cc") > c.at.complexity, "cc"),
    "cognitiveComplexity": _functions(lambda c: F.col("cognitive") > c.at.cognitive, "cognitive"),
    "longFunctions": _functions(lambda c: F.col("line_count") > c.at.long_function, "line_count"),
    "highParams": _functions(lambda c: F.col("param_count") > c.at.params, "param_count"),
    "largeFiles": lambda c: _of_files(c, c.files.filter(F.col("lines") > c.at.large_file), "lines"),
    "duplication": _duplicates,
    "deadCode": lambda c: _of_files(c, A.imported(c.files, c.degrees).filter("dead and funcs > 0")),
    "depth": lambda c: (c.deepest.select(F.col("node").alias("file"), F.col("place").alias("_o")), ["_o"]),
    "hotspots": lambda c: (c.degrees.select(F.col("node").alias("file"), A.hotspot_score().alias("score")).filter(F.col("score") >= c.at.hotspot), ["file"]),
    "codeChurn": lambda c: (A.file_churn(c.changes).select(F.col("path").alias("file"), "churn"), [F.desc("churn"), "file"]),
    "changeCoupling": lambda c: (A.change_pairs(c.changes, c.at.change_coupling), [F.desc("n"), "a", "b"]),
    "busFactor": lambda c: (A.file_authors(c.changes).filter("authors = 1").select(F.col("path").alias("file")), ["file"]),
    "codeAge": _aged,
    "testCoverageGap": lambda c: _of_files(c, uncovered(c)),
}
_HISTORY = ("codeChurn", "changeCoupling", "busFactor", "codeAge")


def ranked_rows(c: Context, name: str) -> DataFrame | None:
    """(place, ...) of the rows behind a dimension, from 0; None where it has none to show."""
    if name not in ROWS or name in _HISTORY and c.changes is None or name == "testCoverageGap" and c.test_targets is None or name == "depth" and c.deepest is None:
        return None
    df, order = ROWS[name](c)
    ranked = numbered(df, order)
    return ranked.drop(*(x for x in ranked.columns if x.startswith("_")))


def _one(c: Context, name: str) -> dict:
    return COMPUTED[name](c).head().asDict()


def _shown(c: Context, name: str) -> tuple[list[dict], int, dict]:
    """The first rows, how many there are, and where all are if these aren't."""
    df = ranked_rows(c, name)
    if df is None:
        return [], 0, {}
    ranked = settled(df)
    total = ranked.count()
    rows = [r.asDict(recursive=True) for r in ranked.filter(F.col("place") < SHOWN).orderBy("place").collect()]
    if total <= SHOWN:
        return rows, total, {}
    path = f"{shared_dir(ranked.sparkSession)}/details-{name}-{uuid.uuid4().hex}"
    ranked.withColumn("page", F.floor(F.col("place") / SHOWN)).write.partitionBy("page").parquet(path)
    return rows, total, {"more": {"rows": total, "table": path}}


def details_of(c: Context, name: str) -> dict:
    """The details that a report shows for one dimension; lists are in order of files, or as their dimension ranks them."""
    if name == "coupling":
        r = _one(c, name)
        return {"crossModuleEdges": r["cross_edges"], "crossModuleToUnstable": r["to_unstable"]}
    if name == "cohesion":
        r = _one(c, name)
        return {"worstModule": r["worst_module"], "worstCohesion": r["worst_cohesion"]}
    if name == "entropy":
        return {"normalizedEntropy": _one(c, name)["raw_value"]}
    if name == "comments":
        r = _one(c, name)
        return {"commentRatio": r["found"] / r["total"] if r["total"] else 0}
    if name == "levelization":
        r = _one(c, name)
        return {"violations": r["found"], "totalEdges": r["total"]}
    if name == "blastRadius":
        r = _one(c, name)
        return {"maxBlastRadius": r["radius"], "totalFiles": r["total"], "maxBlastRadiusFile": r["path"]}
    if name == "distanceFromMainSeq":
        r = _one(c, name)
        return {"worstModule": r["worst_module"], "distance": r["raw_value"]}
    if name == "attackSurface":
        r = _one(c, name)
        return {"reachableCount": r["found"], "totalFiles": r["total"]}
    rows, total, more = _shown(c, name)
    files = [r["file"] for r in rows if "file" in r]
    if name == "cycles":
        cycles: dict = {}
        for r in rows:
            cycles.setdefault(r["component"], []).append(r["node"])
        return {"cycles": list(cycles.values()), **more}
    if name == "godFiles":
        return {"files": files, "count": total, **more}
    if name == "complexFn":
        return {"totalFunctions": c.functions.count(), "complexCount": total, "complexFunctions": rows_of(rows, cc="cc"), **more}
    if name == "cognitiveComplexity":
        return {"totalFunctions": c.functions.count(), "complexCount": total, "functions": rows_of(rows, cognitiveComplexity="cognitive"), **more}
    if name == "longFunctions":
        return {"functions": rows_of(rows, lineCount="line_count"), **more}
    if name == "highParams":
        return {"functions": rows_of(rows, paramCount="param_count"), **more}
    if name == "largeFiles":
        return {"files": [{"file": r["file"], "lines": r["lines"]} for r in rows], **more}
    if name == "duplication":
        groups: dict = {}
        for r in rows:
            groups.setdefault(r["body_hash"], []).append({"file": r["file"], "name": r["name"]})
        return {"groups": [{"bodyHash": h, "functions": f} for h, f in groups.items()], **more}
    if name == "depth":
        return {"deepestPath": files, **more}
    if name == "hotspots":
        return {"files": [{"file": r["file"], "score": r["score"]} for r in rows], **more}
    if name == "codeChurn":
        return {"files": [{"file": r["file"], "churn": r["churn"]} for r in rows], **more}
    if name == "changeCoupling":
        return {"pairs": [{"fileA": r["a"], "fileB": r["b"], "count": r["n"]} for r in rows], **more}
    if name == "busFactor":
        return {"files": [{"file": f, "authorCount": 1} for f in files], **more}
    if name == "codeAge":
        return {"files": [{"file": r["file"], "daysSinceUpdate": r["days"]} for r in rows], **more}
    if name in ("deadCode", "testCoverageGap"):
        return {"files": files, **more}
    raise KeyError(name)


def rows_of(rows: list[dict], **labels: str) -> list[dict]:
    return [{"file": r["file"], "name": r["name"], **{label: r[column] for label, column in labels.items()}} for r in rows]


def violations_of(c: Context) -> DataFrame:
    return G.violations(c.edges, c.components)
