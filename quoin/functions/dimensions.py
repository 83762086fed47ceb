"""The 24 dimensions: names, labels, categories and grade ladders. Fixed values throughout."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dimension:
    name: str
    label: str
    category: str
    ladder: tuple[float, float, float, float]  # upper bounds, inclusive, of A, B, C and D
    is_integer: bool = False


CATEGORIES = {
    "module-structure": "Module Structure",
    "file-function": "File & Function",
    "architecture": "Architecture",
    "evolution": "Evolution",
    "test-structure": "Test & Structure",
}

DIMENSIONS: tuple[Dimension, ...] = (
    Dimension("cycles", "Cycles", "module-structure", (0, 1, 3, 6), True),
    Dimension("coupling", "Coupling", "module-structure", (0.2, 0.35, 0.5, 0.7)),
    Dimension("cohesion", "Cohesion", "module-structure", (0.5, 0.7, 0.85, 1.0)),
    Dimension("entropy", "Entropy", "module-structure", (0.4, 0.55, 0.7, 0.9)),
    Dimension("godFiles", "God Files", "file-function", (0, 0.01, 0.03, 0.05)),
    Dimension("complexFn", "Complex Fns", "file-function", (0.02, 0.05, 0.1, 0.2)),
    Dimension("cognitiveComplexity", "Cognitive Complexity", "file-function", (0.02, 0.05, 0.1, 0.2)),
    Dimension("longFunctions", "Long Functions", "file-function", (0.05, 0.1, 0.15, 0.25)),
    Dimension("largeFiles", "Large Files", "file-function", (0.05, 0.1, 0.15, 0.25)),
    Dimension("highParams", "High Params", "file-function", (0.03, 0.05, 0.08, 0.15)),
    Dimension("duplication", "Duplication", "file-function", (0.01, 0.03, 0.05, 0.1)),
    Dimension("deadCode", "Dead Code", "file-function", (0.03, 0.05, 0.08, 0.15)),
    Dimension("comments", "Comments", "file-function", (0.92, 0.95, 0.97, 0.99)),
    Dimension("depth", "Depth", "architecture", (5, 8, 10, 15), True),
    Dimension("levelization", "Levelization", "architecture", (0, 0.02, 0.05, 0.1)),
    Dimension("blastRadius", "Blast Radius", "architecture", (0.1, 0.2, 0.35, 0.5)),
    Dimension("distanceFromMainSeq", "Distance from Main Seq", "architecture", (0.3, 0.5, 0.7, 0.85)),
    Dimension("attackSurface", "Attack Surface", "architecture", (0.75, 0.85, 0.92, 0.97)),
    Dimension("hotspots", "Hotspots", "architecture", (0, 0.01, 0.03, 0.05)),
    Dimension("codeChurn", "Code Churn", "evolution", (0.5, 0.6, 0.7, 0.85)),
    Dimension("changeCoupling", "Change Coupling", "evolution", (0, 0.02, 0.05, 0.1)),
    Dimension("busFactor", "Bus Factor", "evolution", (0.2, 0.35, 0.5, 0.7)),
    Dimension("codeAge", "Code Age", "evolution", (0.1, 0.2, 0.35, 0.5)),
    Dimension("testCoverageGap", "Test Coverage Gap", "test-structure", (0.1, 0.2, 0.35, 0.5)),
)
BY_NAME = {d.name: d for d in DIMENSIONS}
NAMES = tuple(BY_NAME)

GRADES = "ABCDF"
GRADE_VALUE = {"A": 4, "B": 3, "C": 2, "D": 1, "F": 0}
VALUE_GRADE = {v: g for g, v in GRADE_VALUE.items()}


@dataclass(frozen=True)
class Thresholds:
    """From where on something is found; all strict but hotspot, stable_fan_in and stable_instability."""

    stable_instability: float = 0.15
    stable_fan_in: int = 3
    god_fan_out: int = 15
    complexity: int = 15
    cognitive: int = 15
    long_function: int = 50
    large_file: int = 500
    params: int = 4
    hotspot: float = 5.0
    change_coupling: int = 5
    age_days: int = 365
    churn_share: float = 0.1


def dimension(name: str) -> Dimension:
    if name not in BY_NAME:
        raise KeyError(f"Unknown dimension: {name}")
    return BY_NAME[name]
