"""Scalar functions, patterns, ladders, lines."""

import pytest
from pyspark.sql import functions as F

from quoin.functions import columns as C
from quoin.functions.dimensions import DIMENSIONS, NAMES, dimension
from quoin.functions.globs import is_ignored, matches
from quoin.functions.lines import count_lines


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string" if isinstance(v, str) or v is None else "double" if isinstance(v, float) else "int" for v in values.values()], strict=True)))
    return row.select(column.alias("x")).head().x


@pytest.mark.parametrize("path,module", [("src/a/b.ts", "src/a"), ("src/a/b/c.ts", "src/a"), ("src/a.ts", "src"), ("a.ts", "a.ts"), ("src\\a\\b.ts", "src/a"), ("/src/a/", "src"), ("", ""), ("a//b///c", "a/b")])
def test_module_of(spark, path, module):
    assert one(spark, C.module_of(F.col("p")), p=path) == module


@pytest.mark.parametrize("path,entry,barrel,uncovered", [("src/index.ts", 1, 1, 1), ("index.ts", 0, 0, 0), ("src/main.tsx", 1, 0, 1), ("main.ts", 0, 0, 1), ("src/a.d.ts", 0, 0, 1), ("cli/index.ts", 1, 1, 1), ("src/domain.ts", 0, 0, 0)])
def test_path_kinds(spark, path, entry, barrel, uncovered):
    p = F.col("p")
    assert list(map(int, one(spark, F.array(C.is_entry(p), C.is_barrel(p), C.is_uncovered(p)), p=path))) == [entry, barrel, uncovered]


@pytest.mark.parametrize("path,source,test", [("a.ts", 1, 0), ("a.test.ts", 0, 1), ("x/testing/a.ts", 0, 0), ("testing.ts", 1, 0), ("x/fixtures/a.test.ts", 0, 0), ("a.js", 0, 0), ("a.tsx", 1, 0)])
def test_sources(spark, path, source, test):
    assert list(map(int, one(spark, F.array(C.is_source(F.col("p")), C.is_test(F.col("p"))), p=path))) == [source, test]


@pytest.mark.parametrize("pattern,path,hit", [
    ("src/a.ts", "src/a.ts", 1), ("src/domain", "src/domain/a.ts", 1), ("src/domain", "src/domain2/a.ts", 0), ("src/*.ts", "src/a.ts", 1), ("src/*.ts", "src/b/a.ts", 0),
    ("src/**", "src/b/a.ts", 1), ("src/**/a.ts", "src/b/c/a.ts", 1), ("src/**/*.ts", "src/b/c/a.ts", 1), ("src/**/*.ts", "src/b/c/a.js", 0), ("**/b/**", "x/b/y", 0), ("a+b/*", "a+b/c", 1),
])
def test_layer_patterns(spark, pattern, path, hit):
    assert one(spark, matches(pattern, F.col("p")), p=path) == bool(hit)


@pytest.mark.parametrize("pattern,path,hit", [
    ("src/**", "src/a/b.ts", 1), ("src/*", "src/a/b.ts", 0), ("**/*.gen.ts", "a/b/x.gen.ts", 1), ("**/*.gen.ts", "x.gen.ts", 1), ("*.ts", "a.ts", 1), ("*.ts", "b/a.ts", 0), ("*.ts", ".a.ts", 0),
    ("src/{a,b}/*.ts", "src/b/x.ts", 1), ("src/{a,b}/*.ts", "src/c/x.ts", 0), ("src/?.ts", "src/a.ts", 1), ("src/?.ts", "src/ab.ts", 0), ("src/[ab].ts", "src/b.ts", 1), ("src/[!ab].ts", "src/b.ts", 0), ("!src/**", "lib/a.ts", 1), ("!src/**", "src/a.ts", 0), ("src/**/x.ts", "src/x.ts", 1), ("src/**", "src/.h/x.ts", 0),
])
def test_ignore_patterns(spark, pattern, path, hit):
    assert one(spark, is_ignored(F.col("p"), [pattern]), p=path) == bool(hit)


def test_every_step_of_every_ladder(spark):
    rows = [(d.name, float(x) + e, g if e <= 0 else "BCDF"["ABCD".index(g)]) for d in DIMENSIONS for x, g in zip(d.ladder, "ABCD", strict=True) for e in (0.0, 1e-9)]
    rows += [(d.name, float("nan"), "F") for d in DIMENSIONS] + [("cycles", float("inf"), "F")]
    got = spark.createDataFrame(rows, "name string, raw double, want string").select("want", C.grade_of(F.col("name"), F.col("raw")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_registry():
    assert len(NAMES) == 24 and dimension("depth").is_integer
    with pytest.raises(KeyError):
        dimension("nothing")


def test_small_columns(spark):
    assert [one(spark, C.flag_grade(F.col("n")), n=n) for n in (0, 1, 2, 3, 5, 6)] == list("ABCCDF")
    assert [one(spark, C.clamped_value(F.col("n")), n=x) for x in (-3.0, 2.4, 2.5, 9.0)] == [0, 2, 3, 4]
    assert one(spark, C.base_name(F.col("p")), p="a/b.ts") == "b.ts" and one(spark, C.language(F.col("p")), p="b.tsx") == "tsx"
    a = one(spark, C.body_hash(F.col("b")), b="{ return  1; // told\n}")
    assert a == one(spark, C.body_hash(F.col("b")), b="{ return 1; /* not\ntold */ }") and len(a) == 16
    assert one(spark, C.script_safe(F.col("s")), s="</SCRIPT>") == "<\\/SCRIPT>"
    assert [one(spark, C.is_stable(F.col("i"), F.col("o")), i=i, o=o) for i, o in ((3, 0), (17, 3), (2, 0), (3, 1))] == [True, True, False, False]


@pytest.mark.parametrize("source,counts", [
    ("", (0, 0, 0, 0)), ("a\n", (1, 1, 0, 0)), ("a\n\n// b\n", (3, 1, 1, 1)), ("/* a\n\n b */\nc", (4, 1, 3, 0)), ("a /* b\nc */ d", (2, 2, 0, 0)), ("const a = `x\n\n// no\n`;", (4, 4, 0, 0)),
    ("a = \"//\"; // b", (1, 1, 0, 0)), ("/* a */ /* b */", (1, 0, 1, 0)), ("'it\\'s' // x\n/* y */ z", (2, 2, 0, 0)), ("/* a */ `b\nc`", (2, 2, 0, 0)), ("\n\n", (2, 0, 0, 2)), ("// a\r\nb\r\n", (2, 1, 1, 0)),
])
def test_lines(source, counts):
    assert count_lines(source) == counts


@pytest.mark.parametrize("pattern,hits,misses", [
    ("src/@(a|b)/**", "src/a/x.ts src/b/c/x.ts", "src/ab/x.ts src/c/x.ts"), ("src/!(a|b)/*.ts", "src/c/x.ts src/ab/x.ts", "src/a/x.ts src/b/x.ts src/c/d/x.ts src/.c/x.ts"),
    ("src/+(a|b).ts", "src/a.ts src/abba.ts", "src/c.ts src/abc.ts"), ("src/?(a)b.ts", "src/b.ts src/ab.ts", "src/aab.ts src/a.ts"), ("src/x*(a|b).ts", "src/x.ts src/xab.ts", "src/xc.ts"),
    ("**/!(*.d).ts", "x/a.ts x/y/a.ts a.ts", "x/a.d.ts a.d.ts"), ("src/(a|b).ts", "src/a.ts src/b.ts", "src/c.ts"), ("src/@(a|+(b|c)d)/*", "src/a/x src/bcbd/x", "src/d/x"),
])
def test_extended_patterns(pattern, hits, misses):
    import re

    from quoin.functions.globs import ignore_regex

    found = re.compile(ignore_regex(pattern)).search
    assert all(found(p) for p in hits.split()) and not any(found(p) for p in misses.split())
