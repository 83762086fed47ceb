"""The engine: scan, check, gate and visualise a source tree."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.config import FOLDER, Rules, load_rules, stored_rules
from quoin.functions import columns as C
from quoin.functions.dimensions import GRADE_VALUE, GRADES, NAMES, Thresholds
from quoin.operators import aggregates as A
from quoin.operators import graph as G
from quoin.operators import rules as R
from quoin.operators import shaping as S
from quoin.operators.resolving import resolved
from quoin.plans import details as shown_rows
from quoin.plans.context import Context, report
from quoin.plans.details import details_of, uncovered
from quoin.plans.storage import settled
from quoin.snapshots import Snapshots, read_text, write_text
from quoin.sources import history, tree

#: Dimensions whose details are asked for at once.
DETAILS = 6


def spark_session(name: str = "quoin") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


@dataclass
class Report:
    dimensions: dict[str, dict]  # name: rawValue, grade, details
    composite: str
    file_count: int
    total_lines: int
    duration_ms: int
    context: Context
    rows: DataFrame  # name, raw_value, grade


class Engine:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or spark_session()

    # reading

    def snapshot(self, root: str, include: tuple[str, ...] = (), ignore: tuple[str, ...] | None = None, now=None, log: str | None = None, history_url: str | None = None) -> tuple[Context, Rules | None]:
        """The relations of a tree on the driver's disk, or in shared storage if root is a URL.

        Ignore patterns given here go before those of its rules. History is that of git, the text log, or, for a tree
        in shared storage, a saved log (the output of git log in the form that history.py asks for) at history_url.
        """
        remote = "://" in root
        root = root.rstrip("/") if remote else str(Path(root).resolve())
        rules = stored_rules(self.spark, root) if remote else load_rules(root)
        patterns = ignore if ignore is not None else (rules.ignore if rules and rules.ignore else ())
        there, links = (tree.stored_paths(self.spark, root), None) if remote else tree.existing(self.spark, root)
        sources = tree.stored_tree(self.spark, root, include, patterns) if remote else tree.with_text(tree.source_paths(self.spark, root, include, patterns, there), root)
        read = settled(tree.extracted(sources))
        edges = self.edges_of(read, there, links)
        at = Thresholds()
        days = 90
        if rules:
            e = rules.evolution
            days = e.get("days", days)
            at = replace(at, change_coupling=e.get("change_coupling_threshold", at.change_coupling), age_days=e.get("code_age_threshold_days", at.age_days))
        if log is not None:
            changes = history.changes_of(self.spark, log) if log.strip() else None
        elif history_url is not None:
            changes = history.stored_log(self.spark, history_url)
        else:
            changes = None if remote else history.git_changes(self.spark, root, days)
        if changes is not None:
            changes = settled(changes)
        return self.context(read, edges, changes, self.test_targets(root, read, there, links), at, now), rules

    def edges_of(self, read: DataFrame, there: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
        """Edges between files that were read; there: all files that exist, where these aren't all."""
        known = tree.files(read)
        return settled(G.edges_between(resolved(tree.specifiers(read), known if there is None else known.select("path").union(there), links if links is None or not links.isEmpty() else None), known))

    def test_targets(self, root: str, read: DataFrame, there: DataFrame, links: DataFrame | None) -> DataFrame | None:
        if "://" in root:
            found = settled(tree.extracted(tree.stored_tree(self.spark, root, tests=True)))
            tests = found.select("path")
        else:
            tests = tree.test_paths(self.spark, root)
            found = tree.extracted(tree.with_text(tests, root))
        if tests.isEmpty():
            return None
        specs = tree.specifiers(found)
        known = tree.files(read).select("path").union(tests.select("path")).union(there)
        return settled(resolved(specs, known, links if links is None or not links.isEmpty() else None).filter("resolved is not null").select(F.col("resolved").alias("node")).distinct())

    def context(self, read: DataFrame, edges: DataFrame, changes: DataFrame | None = None, test_targets: DataFrame | None = None, at: Thresholds = Thresholds(), now=None) -> Context:
        return Context(tree.files(read), tree.functions(read), tree.classes(read), edges, changes, test_targets, F.current_timestamp() if now is None else now, at)

    # results

    def health(self, c: Context, names: tuple[str, ...] = NAMES, details: bool = True) -> Report:
        began = time.time()
        told = settled(report(c, names))
        rows = {r["name"]: r for r in told.collect()}
        with ThreadPoolExecutor(DETAILS) as pool:  # small jobs, side by side
            shown = dict(zip(names, pool.map(lambda n: details_of(c, n), names), strict=True)) if details else dict.fromkeys(names, {})
        dimensions = {n: {"rawValue": rows[n]["raw_value"], "grade": rows[n]["grade"], "details": shown[n]} for n in names}
        sums = A.totals(c.files).head()
        composite = R.composite(told).head()["composite"]
        return Report(dimensions, composite, sums["files"], sums["lines"], round((time.time() - began) * 1000), c, told)

    def scan(self, root: str, include: tuple[str, ...] = (), **options) -> Report:
        return self.health(self.snapshot(root, include, **options)[0])

    def check(self, root: str, include: tuple[str, ...] = (), **options) -> tuple[bool, list[dict], int] | None:
        """(passed, violations, number of rules); None where there are no rules."""
        c, rules = self.snapshot(root, include, **options)
        return None if rules is None else self.checked(self.health(c), rules)

    def checked(self, r: Report, rules: Rules) -> tuple[bool, list[dict], int]:
        found = constraint_violations(rules.constraints or {}, r.dimensions, r.context.functions.filter(F.col("cc") > r.context.at.complexity))
        edges = r.context.edges
        for x in R.layer_violations(edges, list(rules.layers)).orderBy("ord").collect() if rules.layers else []:
            text = f'"{x.from_layer}" (order {plain(x.from_order)}) imports from "{x.to_layer}" (order {plain(x.to_order)}): {x.src} -> {x.dst}'
            found.append(violation("layer_violation", text, [x.src, x.dst]))
        for x in R.boundary_violations(edges, list(rules.boundaries)).orderBy("ord", "boundary").collect() if rules.boundaries else []:
            b = rules.boundaries[x.boundary]
            because = f": {b.reason}" if b.reason else ""
            found.append(violation("boundary_violation", f'Import from "{b.source}" to "{b.target}" is forbidden{because}: {x.src} -> {x.dst}', [x.src, x.dst]))
        number = len(rules.constraints or {}) + (rules.layers is not None) + len(rules.boundaries or ())
        return not found, found, number

    def save_baseline(self, root: str, include: tuple[str, ...] = (), **options) -> dict:
        """The baseline, kept beside the tree: as text, and all dimensions as a version."""
        r = self.scan(root, include, **options)
        told = baseline_of(r)
        Snapshots(self.spark, baseline_path(root).removesuffix(".json")).write(r.rows)
        write_text(self.spark, baseline_path(root), json.dumps(told, indent=2))
        return told

    def gate(self, root: str, include: tuple[str, ...] = (), **options) -> list[str]:
        """What got worse since the baseline was saved."""
        base = load_baseline(self.spark, root)
        return self.degradations(base, baseline_of(self.scan(root, include, **options)))

    def degradations(self, base: dict, now: dict) -> list[str]:
        """What is told of the dimensions that R.gate_changes finds to be worse, and of the composite grade."""
        frames = [self.spark.createDataFrame([(d, float(x[k])) for k, d in KEPT.items()], "name string, raw_value double") for x in (base, now)]
        rows = {r["name"]: r for r in R.gate_changes(*frames).filter("degraded").collect()}
        out = []
        for name, what in GATED.items():
            if name in rows:
                a, b = rows[name]["base"], rows[name]["current"]
                out.append(f"{what} degraded: {fixed(a)} -> {fixed(b)} (threshold: +0.05)" if name == "coupling" else f"{what} increased: {plain(a)} -> {plain(b)}")
        if GRADES.index(now["compositeGrade"]) > GRADES.index(base["compositeGrade"]):
            out.append(f"composite grade dropped: {base['compositeGrade']} -> {now['compositeGrade']}")
        return out

    def visual(self, r: Report) -> dict:
        """Files with lines and grade, modules and the edges between them."""
        c = r.context
        named = S.flagged(c.files, c.functions, c.degrees, c.at, c.changes, uncovered(c).select("path") if c.test_targets is not None else None, c.now)
        tiles = S.file_flags(c.files, named).orderBy("ord").select("path", "lines", C.flag_grade(F.col("flags")).alias("grade")).collect()
        modules = [x.module for x in c.files.select(C.module_of(F.col("path")).alias("module")).distinct().orderBy("module").collect()]
        cells = S.dsm_cells(c.edges).orderBy("from_module", "to_module").collect()
        return {"treemapFiles": [t.asDict() for t in tiles], "dsmData": {"modules": modules, "cells": [{"from": x.from_module, "to": x.to_module, "count": x.n} for x in cells]}, "compositeGrade": r.composite, "fileCount": r.file_count, "totalLines": r.total_lines}


def plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def violation(rule: str, message: str, paths: list[str], number: int | None = None) -> dict:
    """number: how many it is about, where paths show the first only."""
    return {"rule": rule, "severity": "error", "message": message, "affectedFiles": paths, "count": len(paths) if number is None else number}


def constraint_violations(limits: dict, dimensions: dict[str, dict], functions: DataFrame | None = None) -> list[dict]:
    """max_cc looks at functions that count as complex anyway, and no_god_files at a detail that scans don't give: both as users know them.

    functions: those that count as complex, of which details may show the first only.
    """
    out = []
    raw = {n: d["rawValue"] for n, d in dimensions.items()}
    if "max_cycles" in limits and raw["cycles"] > limits["max_cycles"]:
        out.append(violation("max_cycles", f"Cycle count {plain(raw['cycles'])} exceeds limit of {plain(limits['max_cycles'])}", []))
    if "max_coupling" in limits and raw["coupling"] > limits["max_coupling"]:
        out.append(violation("max_coupling", f"Coupling {plain(raw['coupling'])} exceeds limit of {plain(limits['max_coupling'])}", []))
    for key, dim, listed in (("max_cc", "complexFn", "complexFunctions"), ("no_god_files", "godFiles", "godFiles")):
        if key not in limits or limits[key] is False:
            continue
        told = dimensions[dim].get("details")
        if told is None:
            if raw[dim] > 0:
                what = "Complex functions" if key == "max_cc" else "God files"
                out.append(violation(key, f"{what} detected (rawValue: {plain(raw[dim])}) but details unavailable", []))
            continue
        rows = told.get(listed, [])
        if key == "max_cc":
            over = [f["file"] for f in rows if f["cc"] > limits[key]]
            number = len(over)
            if functions is not None and "more" in told:
                whole = functions.filter(F.col("cc") > limits[key])
                number, over = whole.count(), [r.path for r in whole.orderBy("ord").select("path").limit(shown_rows.SHOWN).collect()]
            if number:
                out.append(violation(key, f"{number} function(s) exceed cyclomatic complexity limit of {plain(limits[key])}", over, number))
        elif rows:
            out.append(violation(key, f"{len(rows)} god file(s) detected", list(rows)))
    return out


#: What a baseline keeps of the raw values.
KEPT = {"couplingScore": "coupling", "cycleCount": "cycles", "godFileRatio": "godFiles", "complexFnRatio": "complexFn", "maxDepth": "depth"}


def baseline_of(r: Report) -> dict:
    return {k: r.dimensions[d]["rawValue"] for k, d in KEPT.items()} | {"compositeGrade": r.composite, "dimensionGrades": {n: d["grade"] for n, d in r.dimensions.items()}}


#: How a gate names what it looks at.
GATED = {"coupling": "coupling score", "cycles": "cycle count", "godFiles": "god file ratio", "complexFn": "complex function ratio", "depth": "max depth"}


def baseline_path(root: str) -> str:
    """Beside the tree, wherever that is."""
    return f"{root.rstrip('/')}/{FOLDER}/baseline.json" if "://" in root else f"file://{Path(root).resolve()}/{FOLDER}/baseline.json"


def load_baseline(spark: SparkSession, root: str) -> dict:
    path = baseline_path(root)
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(f"No baseline found at {path}. Save one first.")
    try:
        told = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"Baseline at {path} isn't valid JSON: {e}") from e
    grades = told.get("dimensionGrades") if isinstance(told, dict) else None
    sound = isinstance(grades, dict) and all(grades.get(n) in GRADE_VALUE for n in NAMES) and told.get("compositeGrade") in GRADE_VALUE and all(isinstance(told.get(k), (int, float)) for k in KEPT)
    if not sound:
        raise ValueError(f"Baseline at {path} has an invalid schema")
    return told


def fixed(x: float, digits: int = 2) -> str:
    """x with so many decimals, its exact binary value rounded half up."""
    from decimal import ROUND_HALF_UP, Decimal

    return str(Decimal(float(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


