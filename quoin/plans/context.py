"""What the dimensions are computed from, and the plan that computes all of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoin.functions.columns import grade_of, is_entry, whole_days
from quoin.functions.dimensions import NAMES, Thresholds
from quoin.operators import aggregates as A
from quoin.operators import graph as G
from quoin.operators.visiting import deepest
from quoin.plans.storage import settled


@dataclass
class Context:
    """Relations of one snapshot; what several dimensions need is computed once."""

    files: DataFrame
    functions: DataFrame
    classes: DataFrame
    edges: DataFrame
    changes: DataFrame | None = None
    test_targets: DataFrame | None = None
    now: Column = field(default_factory=F.current_timestamp)
    at: Thresholds = field(default_factory=Thresholds)
    few: int | None = None  # edges of a graph that one task may solve

    def __post_init__(self) -> None:
        self.edges = settled(self.edges)

    @cached_property
    def between(self) -> DataFrame:
        """The edges of which both ends are files: those that modules are judged by."""
        return settled(self.edges.join(self.files.select(F.col("path").alias("src")), "src", "left_semi").join(self.files.select(F.col("path").alias("dst")), "dst", "left_semi"))

    @cached_property
    def degrees(self) -> DataFrame:
        return settled(G.degrees(self.edges).join(self.files.select(F.col("path").alias("node")), "node", "left_semi"))

    @cached_property
    def components(self) -> DataFrame:
        return G.components(self.edges, held=True, few=self.few)

    @cached_property
    def dag(self) -> DataFrame:
        return settled(G.condensed(self.edges, self.components))

    @cached_property
    def levels(self) -> DataFrame:
        return G.levels(self.dag, few=self.few)

    @cached_property
    def deepest(self) -> DataFrame | None:
        """(place, node) of the deepest way in order of visits; None for edges that have no order."""
        if "ord" not in self.edges.columns:
            return None
        within = "ord.pos" if isinstance(self.edges.schema["ord"].dataType, StructType) else "ord"
        return deepest(self.edges.select("src", "dst", F.col(within).alias("ord")), self.files.select(F.col("path").alias("node"), "ord"), self.few)

    @cached_property
    def radii(self) -> DataFrame:
        """Of files that most depend on: what the largest number needs."""
        outside = self.files.select(F.col("path").alias("node")).join(self.foundation, "node", "left_anti")
        return G.largest_radii(self.edges, outside, held=True, few=self.few)

    @cached_property
    def foundation(self) -> DataFrame:
        return settled(A.foundation(self.files, self.degrees, self.at))

    @cached_property
    def surface(self) -> DataFrame:
        return G.reachable(self.edges, self.files.filter(is_entry(F.col("path"))).select(F.col("path").alias("node")), held=True, few=self.few)

    @cached_property
    def tested(self) -> DataFrame:
        return G.reachable(self.edges, self.test_targets, held=True, few=self.few)


def _none(c: Context) -> DataFrame:
    return c.files.sparkSession.range(1).select(F.lit(0.0).alias("raw_value"))


def _levelization(c: Context) -> DataFrame:
    found, total = G.violations(c.edges, c.components).agg(F.count("*").alias("found")), c.edges.agg(F.count("*").alias("total"))
    return found.crossJoin(total).withColumn("raw_value", A.ratio(F.col("found"), F.col("total")))


def _depth(c: Context) -> DataFrame:
    if c.deepest is not None:
        return c.deepest.agg(F.coalesce(F.max("place"), F.lit(0)).cast("double").alias("raw_value"))
    return c.levels.agg(F.coalesce(F.max("level"), F.lit(0)).cast("double").alias("raw_value"))


def _of_history(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    return lambda c: fn(c) if c.changes is not None else _none(c)


#: A function for each dimension; the first column that counts is raw_value.
COMPUTED: dict[str, Callable[[Context], DataFrame]] = {
    "cycles": lambda c: c.components.agg(F.countDistinct("component").cast("double").alias("raw_value")),
    "coupling": lambda c: A.coupling(c.between, c.degrees, c.at),
    "cohesion": lambda c: A.cohesion(c.files, c.between),
    "entropy": lambda c: A.entropy(c.between),
    "godFiles": lambda c: A.god_files(c.degrees, c.at),
    "complexFn": lambda c: A.share(c.functions, F.col("cc") > c.at.complexity),
    "cognitiveComplexity": lambda c: A.share(c.functions, F.col("cognitive") > c.at.cognitive),
    "longFunctions": lambda c: A.share(c.functions, F.col("line_count") > c.at.long_function),
    "largeFiles": lambda c: A.share(c.files, F.col("lines") > c.at.large_file),
    "highParams": lambda c: A.share(c.functions, F.col("param_count") > c.at.params),
    "duplication": lambda c: A.duplication(c.functions),
    "deadCode": lambda c: A.dead_code(c.files, c.degrees),
    "comments": lambda c: A.comments(c.files),
    "depth": _depth,
    "levelization": _levelization,
    "blastRadius": lambda c: A.blast_radius(c.files, c.radii, c.foundation),
    "distanceFromMainSeq": lambda c: A.distance_from_main_sequence(c.files, c.classes, c.degrees),
    "attackSurface": lambda c: A.attack_surface(c.files, c.surface),
    "hotspots": lambda c: A.hotspots(c.degrees, c.at),
    "codeChurn": _of_history(lambda c: A.churn_concentration(c.changes, c.at)),
    "changeCoupling": _of_history(lambda c: A.change_coupling(c.changes, c.at)),
    "busFactor": _of_history(lambda c: A.bus_factor(c.changes)),
    "codeAge": _of_history(lambda c: A.code_age(c.changes, c.now, c.at)),
    "testCoverageGap": lambda c: A.coverage_gap(c.files, c.tested) if c.test_targets is not None else _none(c),
}
assert tuple(COMPUTED) == NAMES


def _rows(sums: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row of sums as a row (name, raw_value) for each dimension."""
    told = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("raw_value")) for n, v in values.items())))
    return sums.select(told.alias("x")).select("x.name", "x.raw_value")


def _tests(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Shares of rows for several tests, from one pass."""
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(F.when(t, 1).otherwise(0)).alias(n) for n, t in tests.items()))
    return _rows(sums, {n: A.ratio(F.col(n), F.col("n")) for n in tests})


def _of_functions(c: Context) -> DataFrame:
    at = c.at
    return _tests(c.functions, {"complexFn": F.col("cc") > at.complexity, "cognitiveComplexity": F.col("cognitive") > at.cognitive, "longFunctions": F.col("line_count") > at.long_function, "highParams": F.col("param_count") > at.params})


def _of_files(c: Context) -> DataFrame:
    sums = c.files.agg(F.count("*").alias("n"), F.sum(F.when(F.col("lines") > c.at.large_file, 1).otherwise(0)).alias("large"), F.sum("comments").alias("comments"), F.sum("lines").alias("lines"))
    some = F.coalesce(F.col("lines"), F.lit(0)) > 0
    return _rows(sums, {"largeFiles": A.ratio(F.col("large"), F.col("n")), "comments": F.when(some, 1.0 - A.ratio(F.col("comments"), F.col("lines"))).otherwise(0.0)})


def _of_degrees(c: Context) -> DataFrame:
    return _tests(c.degrees, {"godFiles": (F.col("fan_out") > c.at.god_fan_out) & ~is_entry(F.col("node")), "hotspots": A.hotspot_score() >= c.at.hotspot})


def _of_changed_files(c: Context) -> DataFrame:
    by_file = c.changes.groupBy("path").agg((F.min("author") == F.max("author")).alias("one"), F.max("ts").alias("ts"))
    return _tests(by_file, {"busFactor": F.col("one"), "codeAge": whole_days(c.now, F.col("ts")) >= c.at.age_days})


#: Dimensions that one pass over a relation gives together; asked for singly, COMPUTED gives the same.
BUNDLES: tuple[tuple[tuple[str, ...], Callable[[Context], DataFrame]], ...] = (
    (("complexFn", "cognitiveComplexity", "longFunctions", "highParams"), _of_functions),
    (("largeFiles", "comments"), _of_files),
    (("godFiles", "hotspots"), _of_degrees),
    (("busFactor", "codeAge"), _of_changed_files),
)


#: What a dimension is read off and takes jobs of its own.
NEEDS = {"cycles": "components", "levelization": "components", "depth": "deepest", "blastRadius": "radii", "attackSurface": "surface", "testCoverageGap": "tested"}


def _prepared(c: Context, names: tuple[str, ...]) -> None:
    """Compute what the dimensions need, side by side; none of these needs another."""
    needed = {NEEDS[n] for n in names if n in NEEDS} - ({"tested"} if c.test_targets is None else set())
    if "radii" in needed:
        c.foundation  # noqa: B018  (kept by its name)
    with ThreadPoolExecutor(max(1, len(needed))) as pool:
        list(pool.map(lambda name: getattr(c, name), sorted(needed)))


def report(c: Context, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(position, name, raw_value, grade) of the dimensions asked for; others aren't computed."""
    _prepared(c, names)
    left, rows = list(names), []
    for own, fn in BUNDLES:
        asked = [n for n in own if n in left]
        if len(asked) > 1 and not (c.changes is None and fn is _of_changed_files):
            rows.append(fn(c).filter(F.col("name").isin(asked)))
            left = [n for n in left if n not in asked]
    rows += [COMPUTED[n](c).select(F.lit(n).alias("name"), F.col("raw_value").cast("double").alias("raw_value")) for n in left]
    places = F.create_map(*(F.lit(x) for i, n in enumerate(NAMES) for x in (n, i)))
    told = reduce(DataFrame.unionByName, rows).select(places[F.col("name")].alias("position"), "name", F.coalesce("raw_value", F.lit(0.0)).alias("raw_value"))
    return told.withColumn("grade", grade_of(F.col("name"), F.col("raw_value")))
