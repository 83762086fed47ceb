"""Reading projects, rules, gates, reports and tools."""

import io
import json
import shutil
import subprocess

import pytest

from quoin import cli
from quoin.config import Layer, Rules, load_rules, rules_of
from quoin.functions.dimensions import NAMES
from quoin.functions.typescript import read_source
from quoin.operators.resolving import resolved
from quoin.reporting import as_json, as_page, as_table, formatter
from quoin.operators import rules as R
from quoin.session import Engine, constraint_violations, fixed, load_baseline
from quoin.snapshots import Snapshots, read_text, write_text
from quoin.sources import tree
from quoin.sources.history import changes_of, git_changes, git_log, parsed_log
from quoin.sources.tree import stored_tree
from quoin.tools import TOOLS, Tools, serve

FILES = {
    "src/index.ts": 'import { run } from "./core/run";\nexport const start = () => run(1);\n',
    "src/core/run.ts": 'import { help } from "../util/help.js";\nimport type { T } from "../util";\nexport function run(n: number): number {\n  if (n > 1 && n < 5) { return help(n); }\n  return n;\n}\n',
    "src/util/help.ts": 'import { run } from "../core/run";\n// told\nexport function help(n: number) { return run(n - 1); }\nexport interface T { a: string }\n',
    "src/util/index.ts": 'export * from "./help";\nexport type { T } from "./help";\n',
    "src/util/alone.ts": "export function alone(a, b, c, d, e) { return a; }\n",
    "src/core/run.test.ts": 'import { run } from "./run";\nrun(1);\n',
    "src/testing/skip.ts": "export const x = () => 1;\n",
}


@pytest.fixture
def project(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def git(project, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *args], cwd=project, check=True, capture_output=True)


@pytest.fixture
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize("body,cc,cognitive", [
    ("", 1, 0), ("if (a) {}", 2, 1), ("if (a) { if (b) {} }", 3, 3), ("if (a) { for (const x of y) { while (z) {} } }", 4, 6), ("if (a) {} else {}", 2, 2), ("if (a) {} else if (b) {} else {}", 3, 3),
    ("switch (a) { case 1: break; case 2: break; case 3: }", 4, 1), ("if (a && b || c) {}", 4, 3), ("if (a && b && c) {}", 4, 2), ("try {} catch (e) { if (e) {} }", 3, 3), ("if (a) { return b ? 1 : 2; }", 3, 3),
    ("do { a() } while (b)", 2, 1), ("const r = /[/`'\"]if(/.test(s) ? `${a ? 1 : 2}` : 'while (x) {}';", 3, 3), ("x?.y ?? z; const o = { if: 1, default: 2, case: 3 };", 2, 1), ("items.map((i) => i ? 1 : 2);", 2, 1), ("if (a) if (b) c();", 3, 1), ("type Q = A extends B ? C : D;", 1, 0),
])
def test_complexities(body, cc, cognitive):
    f = read_source("function f(a: Map<string, number>, b?: string) {\n" + body + "\n}")["functions"][0]
    assert (f["cc"], f["cognitive"], f["param_count"]) == (cc, cognitive, 2)


def test_declarations():
    source = """import a from "./a"; import "./b"; export { c } from './c'; const d = await import("./d"); const e = require("./e"); import type { A } from "./a";
export const one = async <T,>(x: T, { y }: { y?: string } = {}): Promise<void> => {
};
export class K<T> extends Base<T> implements I, J<T>, L.M { private p = () => 1; constructor(private q: string) { super(); } static async *m(): AsyncGenerator<{ r: T }> { if (q) {} } n(): void; get v() { return 1; } }
interface P extends Q, R<S> { a: string; m(x: number): void; o?(): string; f: () => void }
type U = { a: string } | string;
abstract class N { z() {} }
function over(a: string): void;
function over(a: any) { function inner() {} }
export default () => 1;
enum E { A }
"""
    r = read_source(source)
    assert r["imports"] == ["./a", "./b", "./c", "./d", "./e"]
    assert [(f["name"], f["start_line"], f["end_line"], f["param_count"]) for f in r["functions"]] == [("one", 2, 3, 2), ("constructor", 4, 4, 1), ("m", 4, 4, 0), ("v", 4, 4, 0), ("over", 9, 9, 1)]
    assert [(c["name"], c["kind"], c["methods"]) for c in r["classes"]] == [("K", "class", ["constructor", "m", "v"]), ("P", "interface", ["m", "o"]), ("U", "type-alias", [])]
    assert r["classes"][0]["bases"] == ["Base", "I"] and r["classes"][1]["bases"] == ["Q"]


def test_markup_and_broken_text():
    f = read_source("export const App = () => {\n  return <div a='x'>don't {b ? <i>it's</i> : null}</div>;\n};\nfunction g() { if (a) {} }", True)["functions"]
    assert [(x["name"], x["cc"]) for x in f] == [("App", 2), ("g", 2)]
    for text in ("function f( {", "class {{{", "`${", "'", "/* ", "}}}", "export", "import", "const a = (", "<div>", "interface X {"):
        assert set(read_source(text, True)) == {"functions", "classes", "imports"}


def test_resolving(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.tsx", "src/c.tsx", "src/d.js.ts", "e.ts")], "path string")
    asked = ["./a", "./a.js", "./b", "./c.jsx", "../e", "../../e", "react", "./none", "././b/../a", "/src/a", "./d.js"]
    imports = spark.createDataFrame([("src/x.ts", i, s) for i, s in enumerate(asked)], "path string, ord long, specifier string")
    got = {r.specifier: r.resolved for r in resolved(imports, files).collect()}
    assert [got[s] for s in asked] == ["src/a.ts", "src/a.ts", "src/b/index.tsx", "src/c.tsx", "e.ts", None, None, None, "src/a.ts", "src/a.ts", "src/d.js.ts"]


def test_links_and_files_that_are_not_scanned(spark, tmp_path):
    """What is imported by way of a link is the real file; a file that isn't scanned comes before one that is, if it is a better candidate."""
    for name in ("src/a.ts", "src/b/c.ts", "src/b/d.js", "src/d.ts", "dist/e.ts", "deep/x/y.ts", "node_modules/m.ts"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("")
    for name, target in {"src/l": "b", "src/far": "../deep", "deep/z": "x", "src/one.ts": "l/c.ts", "src/loop": "pool", "src/pool": "loop", "src/out": "/usr", "src/root": ".."}.items():
        (tmp_path / name).symlink_to(target)
    there, links = tree.existing(spark, str(tmp_path))
    assert sorted(r.path for r in there.collect()) == ["deep/x/y.ts", "dist/e.ts", "src/a.ts", "src/b/c.ts", "src/b/d.js", "src/d.ts"]
    asked = {"./l/c": "src/b/c.ts", "./far/z/y": "deep/x/y.ts", "./one": "src/b/c.ts", "./loop/a": None, "./out/a": None, "./root/src/d": "src/d.ts", "../dist/e": "dist/e.ts", "./l/d": "src/b/d.js", "./l/d.js": "src/b/d.js", "m": None}
    imports = spark.createDataFrame([("src/a.ts", i, s) for i, s in enumerate(asked)], "path string, ord long, specifier string")
    assert {r.specifier: r.resolved for r in resolved(imports, there, links).collect()} == asked


def test_log_parsing(spark):
    head = "---COMMIT_SEPARATOR---\n{}---FIELD_SEPARATOR---{}---FIELD_SEPARATOR---{}\n"
    log = head.format("abc", "alice", "2025-06-01T10:00:00+02:00") + "\n10\t5\tsrc/foo.ts\n3\t1\tsrc/bar.ts\n-\t-\tpic.png\n1\t1\tsrc/{old => new}/a.ts\n" + head.format("def", "bob", "2025-05-15T10:00:00Z") + "20\t10\tsrc/foo.ts\nnot a line\n" + head.format("ghi", "carl", "no date") + "1\t1\tsrc/foo.ts\n"
    got = [(r.hash, r.author, str(r.ts), r.path, r.added, r.deleted) for r in changes_of(spark, log).orderBy("ord").collect()]
    assert [(h, a, p, x, y) for h, a, _, p, x, y in got] == [("abc", "alice", "src/foo.ts", 10, 5), ("abc", "alice", "src/bar.ts", 3, 1), ("def", "bob", "src/foo.ts", 20, 10)]


def test_scan_without_git(engine, project):
    r = engine.scan(str(project))
    raw = {n: d["rawValue"] for n, d in r.dimensions.items()}
    assert r.file_count == 5 and set(raw) == set(NAMES) and raw["cycles"] == 1 and raw["depth"] == 3
    assert raw["deadCode"] == 0.25 and raw["highParams"] == 0.25 and all(raw[n] == 0 for n in ("codeChurn", "changeCoupling", "busFactor", "codeAge", "testCoverageGap"))
    assert r.dimensions["cycles"]["details"]["cycles"] == [["src/core/run.ts", "src/util/help.ts", "src/util/index.ts"]]
    text, told, page = as_table(r), json.loads(as_json(r)), as_page(engine.visual(r))
    assert "Module Structure" in text and "5 files scanned in" in text and told["compositeGrade"] == r.composite and list(told["dimensions"]) == list(NAMES)
    assert "</script>" in page and "src/util/alone.ts" in page


def test_git_history_tests_rules_and_gate(engine, project, capsys):
    git(project, "init", "-q")
    git(project, "add", ".")
    git(project, "commit", "-qm", "a")
    folder = project / ".quoin"
    folder.mkdir()
    (folder / "rules.toml").write_text('[constraints]\nmax_cycles = 0\nmax_cc = 15\nno_god_files = true\n[[layers]]\nname = "util"\npaths = ["src/util"]\norder = 1\n[[layers]]\nname = "core"\npaths = ["src/core/**"]\norder = 0\n[[boundaries]]\nfrom = "src/core"\nto = "src/util/**"\nreason = "no"\n')
    passed, found, n = engine.check(str(project))
    assert not passed and n == 5
    assert [v["rule"] for v in found] == ["max_cycles", "layer_violation", "boundary_violation", "boundary_violation"]
    assert found[0]["message"] == "Cycle count 1 exceeds limit of 0" and found[1]["message"] == '"util" (order 1) imports from "core" (order 0): src/util/help.ts -> src/core/run.ts'
    r = engine.scan(str(project))
    assert r.dimensions["busFactor"]["rawValue"] == 1.0 and r.dimensions["testCoverageGap"]["details"]["files"] == ["src/util/alone.ts"]
    assert git_log(str(project)) and cli.main(["gate", str(project), "--save"], engine) == 0
    base = load_baseline(engine.spark, str(project))
    assert base["cycleCount"] == 1 and cli.main(["gate", str(project)], engine) == 0
    assert engine.degradations(base | {"cycleCount": 0, "couplingScore": -1}, base)[1] == "cycle count increased: 0 -> 1"
    (folder / "baseline.json").write_text("{}")
    with pytest.raises(ValueError, match="schema"):
        load_baseline(engine.spark, str(project))
    assert cli.main(["check", str(project)], engine) == 1 and "[error] max_cycles" in capsys.readouterr().err


def test_versions_and_texts_in_any_storage(spark, tmp_path):
    kept = Snapshots(spark, f"{tmp_path}/baseline")
    assert kept.read() is None and kept.versions() == []
    rows = [[("cycles", float(k), "A"), ("depth", 2.0, "B")] for k in range(3)]
    assert [kept.write(spark.createDataFrame(r, "name string, raw_value double, grade string")) for r in rows] == [1, 2, 3]
    (tmp_path / "baseline" / "_left_behind").mkdir()  # as of a writer that was lost
    assert sorted(map(tuple, kept.read().collect())) == rows[2] and sorted(map(tuple, kept.read(1).collect())) == rows[0] and kept.read(9) is None
    for text in ("one\ntwo é", "three"):
        write_text(spark, f"file://{tmp_path}/deep/x.json", text)
        assert read_text(spark, f"file://{tmp_path}/deep/x.json") == text == (tmp_path / "deep" / "x.json").read_text()
    assert read_text(spark, f"file://{tmp_path}/none.json") is None


def test_baseline_lies_beside_a_tree_in_shared_storage(engine, project):
    url = f"file://{project}"
    assert cli.main(["gate", url, "--save"], engine) == 0
    assert (project / ".quoin" / "baseline.json").exists() and cli.main(["gate", url], engine) == 0
    assert Snapshots(engine.spark, f"{url}/.quoin/baseline").read().count() == len(NAMES)


def test_long_details_are_pages_of_a_table(spark, engine, project, monkeypatch):
    from quoin.plans import details

    whole = engine.scan(str(project)).dimensions["cycles"]["details"]
    monkeypatch.setattr(details, "SHOWN", 2)
    told = engine.scan(str(project)).dimensions["cycles"]["details"]
    assert told["cycles"] == [whole["cycles"][0][:2]] and told["more"]["rows"] == 3
    rows = spark.read.parquet(told["more"]["table"]).orderBy("place").collect()
    assert [r.node for r in rows] == whole["cycles"][0] and [r.page for r in rows] == [0, 0, 1]


def test_a_thousand_patterns_give_what_predicates_give(spark, monkeypatch):
    from quoin.config import Boundary

    paths = [f"src/m{i % 40}/p{i % 7}/f{i}.ts" for i in range(300)] + ["src/m1", "a.ts", "src/m2/**", "src/m3/x*.ts"]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(zip(paths, reversed(paths), strict=True))], "src string, dst string, ord long")
    kinds = ["src/m{}", "src/m{}/**", "src/m{}/**/f1{}.ts", "src/m{}/**/*{}.ts", "src/m{}/p1/*", "*.ts", "src/m{}/x*.ts", "**/p{}/f7.ts", "**", "src/**/a/**"]
    patterns = [kinds[i % len(kinds)].format(i // 10, i % 10) for i in range(1000)]
    layers = [Layer(f"l{i}", tuple(patterns[i::50]), i % 9) for i in range(50)]
    bounds = [Boundary(a, b) for a, b in zip(patterns[::4], patterns[2::4], strict=True)]
    told = {}
    for limit in (0, 1 << 30):
        monkeypatch.setattr(R, "PREDICATES", limit)
        told[limit] = [sorted(map(tuple, R.layer_violations(edges, layers[:20]).select("ord", "from_layer", "to_layer", "from_order").collect())), sorted(map(tuple, R.boundary_violations(edges, bounds[:60]).select("ord", "src", "boundary").collect()))]
    assert told[0] == told[1 << 30] and all(told[0])
    monkeypatch.setattr(R, "PREDICATES", 64)
    assert R.layer_violations(edges, layers).count() and R.boundary_violations(edges, bounds).count()


def test_empty_folder_and_include(engine, tmp_path, project):
    (tmp_path / "none").mkdir()
    r = engine.scan(str(tmp_path / "none"))
    assert r.file_count == 0 and r.composite == "A"
    assert engine.scan(str(project), ("src/util",)).file_count == 3
    assert engine.scan(str(project), ignore=("src/util/**",)).file_count == 2


def test_stored_tree(spark, project):
    got = {r.path for r in stored_tree(spark, f"file://{project}").collect()}
    assert got == {p for p in FILES if "test" not in p}


def test_a_tree_in_shared_storage_is_scanned_as_one_on_disk(engine, project, tmp_path_factory):
    (project / ".quoin").mkdir()
    (project / ".quoin" / "rules.toml").write_text('[constraints]\nmax_cycles = 0\n[ignore]\npatterns = ["src/util/alone.ts"]\n')
    log = "---COMMIT_SEPARATOR---\nabc---FIELD_SEPARATOR---alice---FIELD_SEPARATOR---2025-06-01T10:00:00Z\n\n10\t5\tsrc/core/run.ts\n3\t1\tsrc/index.ts\n"
    saved = tmp_path_factory.mktemp("logs") / "log.txt"
    saved.write_text(log)
    url = f"file://{project}"
    there, here = engine.scan(url, history_url=f"file://{saved}"), engine.scan(str(project), log=log)
    raw = lambda r: {n: d["rawValue"] for n, d in r.dimensions.items() if n != "testCoverageGap"}  # noqa: E731  outside git there are no tests
    assert raw(there) == raw(here) and there.file_count == here.file_count == 4 and there.dimensions["busFactor"]["rawValue"] == 1.0
    assert there.dimensions["highParams"]["details"] == here.dimensions["highParams"]["details"]
    assert there.dimensions["testCoverageGap"]["rawValue"] == 0.0
    passed, found, n = engine.check(url)
    assert not passed and [v["rule"] for v in found] == ["max_cycles"] and n == 1
    assert cli.main(["scan", url, "--history", f"file://{saved}"], engine) == 0


def test_order_within_large_files_and_far_paths(spark):
    """Paths in any storage, and places in a file, never run into one another."""
    read = spark.createDataFrame([((1 << 62) + 5, f"p{i}.ts", "export function f() {}\nexport function g() {}\n") for i in range(3)], "ord long, path string, text string")
    assert tree.functions(tree.extracted(read)).orderBy("ord", "path").select("path", "name").collect()[0].name == "f"
    commits = spark.createDataFrame([((1 << 62), "c---FIELD_SEPARATOR---a---FIELD_SEPARATOR---2025-06-01T10:00:00Z\n1\t2\tx.ts")], "ord long, chunk string")
    assert parsed_log(commits).head().ord.pos == 1


def test_history_of_any_size(engine, project, monkeypatch):
    git(project, "init", "-q")
    git(project, "add", ".")
    git(project, "commit", "-qm", "a")
    (project / "src/index.ts").write_text("export const start = () => 2;\n")
    git(project, "commit", "-qam", "b")
    changes = git_changes(engine.spark, str(project))
    assert changes.filter("path = 'src/index.ts'").count() == 2 and changes.select("hash").distinct().count() == 2
    assert git_changes(engine.spark, str(project / ".."), 90) is None


def test_rules_drop_what_is_badly_typed(tmp_path):
    r = rules_of({"constraints": {"max_cycles": "x", "max_cc": 3, "no_god_files": 1}, "layers": [{"name": "a", "paths": ["p", 3], "order": 1}, {"name": 5}], "ignore": {"patterns": ["a", 1]}, "evolution": {"days": 30, "code_age_threshold_days": "x"}})
    assert r == Rules({"max_cc": 3}, (Layer("a", ("p",), 1),), None, ("a",), {"days": 30})
    assert load_rules(tmp_path) is None and rules_of({}) == Rules()
    (tmp_path / ".quoin").mkdir()
    (tmp_path / ".quoin" / "rules.toml").write_text("[[[")
    with pytest.raises(ValueError):
        load_rules(tmp_path)


def test_composite_and_numbers(spark):
    def composite(grades):
        return R.composite(spark.createDataFrame([(g,) for g in grades], "grade string")).head()["composite"]

    assert composite([]) == "A" and composite(["A"] * 23 + ["F"]) == "D" and composite(["A", "B"]) == "B"
    assert fixed(0.125) == "0.13" and fixed(2.675) == "2.67" and fixed(0.96043 * 100, 1) == "96.0"
    with pytest.raises(ValueError, match="table, json"):
        formatter("xml")


def test_constraints_without_details():
    raw = {n: {"rawValue": 0.0, "grade": "A", "details": None} for n in NAMES} | {"complexFn": {"rawValue": 0.5, "grade": "F", "details": None}}
    assert [v["rule"] for v in constraint_violations({"max_cc": 5, "no_god_files": True}, raw)] == ["max_cc"]


def test_tools(engine, project):
    tools = Tools(engine)
    path = str(project)
    assert tools.call("nothing", {"path": path}) == "Unknown tool: nothing" and tools.call("scan", {}) == "Unknown tool: scan"
    assert set(json.loads(tools.call("scan", {"path": path, "dimensions": ["cycles", "no"]}))["dimensions"]) == {"cycles"}
    assert "warning" in json.loads(tools.call("session_end", {"path": path}))
    assert json.loads(tools.call("session_start", {"path": path}))["baselineSaved"]
    shutil.rmtree(project / "src/core")
    end = json.loads(tools.call("session_end", {"path": path}))
    assert end["changes"]["cycles"] == {"from": "B", "to": "A"}
    sink = io.StringIO()
    serve(tools, io.StringIO('{"jsonrpc":"2.0","id":1,"method":"tools/list"}\n{"method":"x"}\n{"jsonrpc":"2.0","id":2,"method":"no"}\n'), sink)
    a, b = map(json.loads, sink.getvalue().splitlines())
    assert a["result"]["tools"] == TOOLS and b["error"]["code"] == -32601
