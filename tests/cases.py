"""Small tables of source text with what the reader must find in them."""

from __future__ import annotations

#: (body of a function, cyclomatic complexity, cognitive complexity)
BODIES = [
    ("", 1, 0),
    ("if (a) {}", 2, 1),
    ("if (a) { if (b) {} }", 3, 3),
    ("if (a) { for (const x of y) { while (z) {} } }", 4, 6),
    ("if (a) {} else {}", 2, 2),
    ("if (a) {} else if (b) {} else {}", 3, 3),
    ("switch (a) { case 1: break; case 2: break; case 3: }", 4, 1),
    ("if (a && b || c) {}", 4, 3),
    ("if (a && b && c) {}", 4, 2),
    ("try {} catch (e) { if (e) {} }", 3, 3),
    ("if (a) { return b ? 1 : 2; }", 3, 3),
    ("do { a() } while (b)", 2, 1),
    ("const s = 'if (a) {}'; // if (b) {}", 1, 0),
]

#: (path, text, functions, classes, abstract types, methods of classes, imports); abstract classes aren't read
DECLARED = [
    ("src/a.ts", "import a from './b';\nexport function f(x, y) { return x; }\nexport const g = async (z) => z;\n", 2, 0, 0, 0, 1),
    ("src/b.ts", "import './c'; export { c } from './d';\nexport class K extends B { constructor() { super(); } m() {} }\n", 2, 1, 0, 2, 2),
    ("src/c.ts", "export interface P { a: string; m(): void }\nexport type U = { a: string };\nabstract class N { z() {} }\n", 0, 0, 2, 0, 0),
    ("src/d.ts", "function outer() { function inner() {} }\nenum E { A }\n", 1, 0, 0, 0, 0),
    ("src/e.ts", "", 0, 0, 0, 0, 0),
]

#: (text, lines, logic, comments, blanks)
COUNTED = [
    ("", 0, 0, 0, 0),
    ("a();\n", 1, 1, 0, 0),
    ("// a\n\nb(); // c\n", 3, 1, 1, 1),
    ("/* a\n\n*/ b();\n", 3, 1, 2, 0),
    ("/* a */ b();\n/* c */\n", 2, 1, 1, 0),
    ("const s = '// no';\nconst t = \"/* no\";\n", 2, 2, 0, 0),
    ("const t = `\n\n// text\n`;\n", 4, 4, 0, 0),
    ("  \n\t\n", 2, 0, 0, 2),
]

#: Known files; (importer, specifier, what it means among them)
KNOWN = ["src/a.ts", "src/b/index.tsx", "src/c.tsx", "e.ts"]
ASKED = [
    ("src/x.ts", "./a", "src/a.ts"),
    ("src/x.ts", "./a.js", "src/a.ts"),
    ("src/x.ts", "./b", "src/b/index.tsx"),
    ("src/x.ts", "./c.jsx", "src/c.tsx"),
    ("src/x.ts", "../e", "e.ts"),
    ("src/x.ts", "../../e", None),
    ("src/x.ts", "react", None),
    ("src/x.ts", "./none", None),
    ("src/b/y.ts", "../a", "src/a.ts"),
    ("src/b/y.ts", ".", "src/b/index.tsx"),
]

#: A log, and (hash, author, path, added, deleted) of its changes.
LOG = """---COMMIT_SEPARATOR---
abc123---FIELD_SEPARATOR---alice---FIELD_SEPARATOR---2025-06-01T10:00:00Z

10\t5\tsrc/foo.ts
3\t1\tsrc/bar.ts
-\t-\tpic.png
1\t1\tsrc/{old => new}/a.ts
---COMMIT_SEPARATOR---
def456---FIELD_SEPARATOR---bob---FIELD_SEPARATOR---2025-05-15T10:00:00Z

20\t10\tsrc/foo.ts
---COMMIT_SEPARATOR---
ghi789---FIELD_SEPARATOR---carl---FIELD_SEPARATOR---no date

1\t1\tsrc/foo.ts
"""
CHANGED = [("abc123", "alice", "src/foo.ts", 10, 5), ("abc123", "alice", "src/bar.ts", 3, 1), ("def456", "bob", "src/foo.ts", 20, 10)]
