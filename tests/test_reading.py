"""What is read from source text, as relations: functions, declarations, lines, imports, logs and gates."""

from pyspark.sql import functions as F

from quoin.functions.lines import counted_lines
from quoin.operators import resolving
from quoin.operators.resolving import resolved
from quoin.session import Engine
from quoin.sources import history, tree
from tests import cases as K


def read(spark, rows):
    return tree.extracted(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, path string, text string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_functions(spark):
    found = read(spark, [(f"f{i:02}.ts", "function f(a: Map<string, number>, b?: string) {\n" + body + "\n}") for i, (body, _, _) in enumerate(K.BODIES)])
    assert rows(tree.functions(found).select("path", "name", "cc", "cognitive", "param_count")) == [(f"f{i:02}.ts", "f", cc, cognitive, 2) for i, (_, cc, cognitive) in enumerate(K.BODIES)]


def test_declarations(spark):
    found = read(spark, [r[:2] for r in K.DECLARED])
    kinds = tree.classes(found).groupBy("path").agg(F.sum((F.col("kind") == "class").cast("int")).alias("n_classes"), F.sum((F.col("kind").isin("interface", "type-alias")).cast("int")).alias("n_abstract"), F.sum(F.when(~F.col("kind").isin("interface", "type-alias"), F.size("methods")).otherwise(0)).alias("n_methods"))
    specs = tree.specifiers(found).groupBy("path").agg(F.count("*").alias("n_imports"))
    assert rows(tree.files(found).select("path", "funcs").join(kinds, "path", "left").join(specs, "path", "left").na.fill(0)) == sorted((r[0], *r[2:]) for r in K.DECLARED)


def test_lines(spark):
    table = spark.createDataFrame([(i, r[0]) for i, r in enumerate(K.COUNTED)], "id int, text string")
    assert rows(counted_lines(table, "text").select("id", "counts.*")) == [(i, *r[1:]) for i, r in enumerate(K.COUNTED)]


def test_imports(spark):
    imports = spark.createDataFrame([(p, i, s) for i, (p, s, _) in enumerate(K.ASKED)], "path string, ord long, specifier string")
    found = resolved(imports, spark.createDataFrame([(p,) for p in K.KNOWN], "path string")).select("path", "specifier", "resolved").collect()
    assert sorted(map(tuple, found), key=str) == sorted(K.ASKED, key=str)


def test_log(spark):
    assert rows(history.changes_of(spark, K.LOG).select("hash", "author", "path", "added", "deleted")) == sorted(K.CHANGED)


def test_gate_texts(spark):
    base = {"couplingScore": 0.1, "cycleCount": 1.0, "godFileRatio": 0.0, "complexFnRatio": 0.5, "maxDepth": 3.0, "compositeGrade": "B"}
    said = Engine(spark).degradations(base, {"couplingScore": 0.21, "cycleCount": 2.0, "godFileRatio": 0.0, "complexFnRatio": 0.4, "maxDepth": 5.0, "compositeGrade": "C"})
    assert said == ["coupling score degraded: 0.10 -> 0.21 (threshold: +0.05)", "cycle count increased: 1 -> 2", "max depth increased: 3 -> 5", "composite grade dropped: B -> C"]


def test_paths_joined_with_and_without_lists(spark):
    folders = ["", "a", "a/b", "/a", "a//b", "a/./b", "a/../b", "..", "a/b/", "a.b/..c"]
    said = ["./x", "../x", "../../x", "../../../x/y", "x", ".", "..", "./", "../", "./../x", ".././x", "../x/../y", "../x//y", "/x/y", "/../x", "../.x", "../..x", "..x", "./x/", "", None]
    both = spark.createDataFrame([(a, b) for a in folders for b in said], "a string, b string").select("a", "b", resolving.joined_path(F.col("a"), F.col("b")).alias("x"), resolving._worked_out(F.col("a"), F.col("b")).alias("y"))
    assert [tuple(r) for r in both.filter("not x <=> y").collect()] == []


def test_imports_of_one_path_are_tried_once(spark, monkeypatch):
    """Whatever their order says: two imports of a file may share their place, and many may mean the same path."""
    asked, own = [], resolving.real_paths
    monkeypatch.setattr(resolving, "real_paths", lambda paths, links: asked.append(paths) or own(paths, links))
    imports = spark.createDataFrame([("a/x.ts", 0, "./y"), ("a/x.ts", 0, "./z"), *((f"a/f{i}.ts", i, "./y") for i in range(50))], "path string, ord long, specifier string")
    files, links = spark.createDataFrame([("a/y.ts",), ("b/z.ts",)], "path string"), spark.createDataFrame([("a/z.ts", "b/z.ts")], "link string, target string")
    found = resolved(imports, files, links).select("path", "specifier", "resolved")
    assert rows(found) == sorted([("a/x.ts", "./y", "a/y.ts"), ("a/x.ts", "./z", "b/z.ts"), *((f"a/f{i}.ts", "./y", "a/y.ts") for i in range(50))])
    assert asked[0].count() == 22
