"""Scalar functions as Catalyst expressions: paths, stability, grades, body hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.dimensions import DIMENSIONS, GRADE_VALUE, VALUE_GRADE, Thresholds

#: Path patterns.
BARREL = r"/index\.tsx?$"
ENTRY = r"/(index|main)\.tsx?$"
UNCOVERED = r"(\.d\.tsx?$)|((^|/)(main|cli/index|bin/index)\.tsx?$)|(/index\.tsx?$)"
SOURCE = r"\.(ts|tsx)$"
TEST = r"\.test\.tsx?$"
SET_ASIDE = r"(^|/)(testing|fixtures)/"
#: White space as JavaScript sees it; Java's \s is ASCII only.
JS_SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def module_of(path: Column) -> Column:
    """The first two folders of a path; its one folder, or the path itself where there is none."""
    plain = F.regexp_replace(normal_path(path), "/+$", "")
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n <= 1, plain).when(n == 2, F.get(parts, F.lit(0))).otherwise(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def same_module(a: Column, b: Column) -> Column:
    return module_of(a) == module_of(b)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    return F.when(path.endswith(".tsx"), "tsx").otherwise("ts")


def is_entry(path: Column) -> Column:
    return path.rlike(ENTRY)


def is_barrel(path: Column) -> Column:
    return path.rlike(BARREL)


def is_uncovered(path: Column) -> Column:
    """Files that tests aren't expected to reach."""
    return path.rlike(UNCOVERED)


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE) & ~path.rlike(TEST) & ~path.rlike(SET_ASIDE)


def is_test(path: Column) -> Column:
    return path.rlike(TEST) & ~path.rlike(SET_ASIDE)


def instability(fan_in: Column, fan_out: Column) -> Column:
    total = F.coalesce(fan_in, F.lit(0)) + F.coalesce(fan_out, F.lit(0))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(fan_out, F.lit(0)) / F.when(total == 0, F.lit(1)).otherwise(total))


def is_stable(fan_in: Column, fan_out: Column, at: Thresholds = Thresholds()) -> Column:
    return (F.coalesce(fan_in, F.lit(0)) >= at.stable_fan_in) & (instability(fan_in, fan_out) <= at.stable_instability)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 for an empty whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(part, F.lit(0)).cast("double") / F.when(whole == 0, F.lit(1)).otherwise(whole))


def ladder_grade(raw: Column, ladder: tuple[float, ...]) -> Column:
    steps = [(raw <= F.lit(float(t))) for t in ladder]
    return reduce(lambda out, x: out.when(*x), list(zip(steps[1:], "BCD", strict=True)), F.when(steps[0], "A")).otherwise("F")


def grade_of(name: Column, raw: Column) -> Column:
    """The grade of a raw value by its dimension's ladder; NaN is F, an unknown dimension null."""
    return F.coalesce(*(F.when(name == d.name, ladder_grade(raw, d.ladder)) for d in DIMENSIONS))


def grade_value(grade: Column) -> Column:
    return F.coalesce(*(F.when(grade == g, F.lit(v)) for g, v in GRADE_VALUE.items()))


def value_grade(value: Column) -> Column:
    return F.coalesce(*(F.when(value == v, F.lit(g)) for v, g in VALUE_GRADE.items()))


def clamped_value(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(value + 0.5))).cast("int")


def flag_grade(flags: Column) -> Column:
    return F.when(flags <= 0, "A").when(flags <= 1, "B").when(flags <= 3, "C").when(flags <= 5, "D").otherwise("F")


def body_hash(body: Column) -> Column:
    """16 hex digits of the body without comments (strings aren't respected) and with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(body, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.substring(F.sha2(F.trim(F.regexp_replace(bare, JS_SPACE + "+", " ")), 256), 1, 16)


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / F.lit(86_400_000)).cast("long")


def script_safe(json: Column) -> Column:
    return F.regexp_replace(json, "(?i)</(script)", "<\\\\/$1")
