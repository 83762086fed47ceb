"""Rules of a project: constraints, layers, boundaries, ignored paths and history settings, from a TOML file.

Entries of a wrong type are left out; a file that isn't TOML is an error; a missing file is no rules.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

#: Where a project keeps its rules and its baseline.
FOLDER = ".quoin"


@dataclass(frozen=True)
class Layer:
    name: str
    paths: tuple[str, ...]
    order: float


@dataclass(frozen=True)
class Boundary:
    source: str
    target: str
    reason: str | None = None


@dataclass(frozen=True)
class Rules:
    constraints: dict | None = None
    layers: tuple[Layer, ...] | None = None
    boundaries: tuple[Boundary, ...] | None = None
    ignore: tuple[str, ...] | None = None
    evolution: dict = field(default_factory=dict)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _texts(x) -> tuple[str, ...]:
    return tuple(p for p in x if isinstance(p, str))


def rules_of(doc: dict) -> Rules:
    constraints = layers = boundaries = ignore = None
    if isinstance(c := doc.get("constraints"), dict):
        kinds = {"max_cycles": _number, "max_coupling": _number, "max_cc": _number, "no_god_files": lambda x: isinstance(x, bool)}
        constraints = {k: c[k] for k, fits in kinds.items() if k in c and fits(c[k])}
    if isinstance(rows := doc.get("layers"), list):
        layers = tuple(Layer(r["name"], _texts(r["paths"]), r["order"]) for r in rows if isinstance(r, dict) and isinstance(r.get("name"), str) and isinstance(r.get("paths"), list) and _number(r.get("order")))
    if isinstance(rows := doc.get("boundaries"), list):
        boundaries = tuple(Boundary(r["from"], r["to"], r["reason"] if isinstance(r.get("reason"), str) else None) for r in rows if isinstance(r, dict) and isinstance(r.get("from"), str) and isinstance(r.get("to"), str))
    if isinstance(i := doc.get("ignore"), dict) and isinstance(i.get("patterns"), list):
        ignore = _texts(i["patterns"])
    evolution = doc.get("evolution") if isinstance(doc.get("evolution"), dict) else {}
    kept = {k: evolution[k] for k in ("days", "change_coupling_threshold", "code_age_threshold_days") if _number(evolution.get(k))}
    return Rules(constraints, layers, boundaries, ignore, kept)


def stored_rules(spark: SparkSession, url: str) -> Rules | None:
    """load_rules() for a folder in any storage that Spark reads."""
    path = f"{url.rstrip('/')}/{FOLDER}/rules.toml"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    text = bytes(spark.read.format("binaryFile").load(path).select("content").head().content)
    try:
        return rules_of(tomllib.loads(text.decode()))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"Failed to parse {path}: {e}") from e


def load_rules(root: str | Path) -> Rules | None:
    path = Path(root) / FOLDER / "rules.toml"
    if not path.exists():
        return None
    try:
        return rules_of(tomllib.loads(path.read_text(encoding="utf-8")))
    except (tomllib.TOMLDecodeError, OSError, UnicodeDecodeError) as e:
        raise ValueError(f"Failed to parse {path}: {e}") from e
