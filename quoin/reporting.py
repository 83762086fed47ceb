"""Reports as a table, as JSON, and as a page."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from quoin.functions.dimensions import CATEGORIES, DIMENSIONS
from quoin.session import Report, fixed, plain

WIDTHS = (24, 8, 5)
#: Details shown for a dimension that is graded C or worse.
SHOWN = 5
#: Colours of the grades on the page.
COLOURS = {"A": "#22c55e", "B": "#84cc16", "C": "#eab308", "D": "#f97316", "F": "#ef4444"}


def _calls(rows: list[dict], key: str, label: str) -> list[str]:
    return [f"{r['file']}:{r['name']} ({label}={r[key]})" for r in rows]


def detail_lines(name: str, d: dict) -> list[str]:
    """A line for each detail of a dimension."""
    if name == "cycles":
        return [" → ".join(c) for c in d["cycles"]]
    if name == "depth":
        return [" → ".join(d["deepestPath"])] if d["deepestPath"] else []
    if name in ("godFiles", "deadCode", "testCoverageGap"):
        return list(d["files"])
    if name == "duplication":
        return [", ".join(f"{f['file']}:{f['name']}" for f in g["functions"]) for g in d["groups"]]
    rows: dict[str, Callable[[], list[str]]] = {
        "coupling": lambda: [f"{d['crossModuleEdges']} cross-module edges ({d['crossModuleToUnstable']} to unstable)"],
        "cohesion": lambda: [f"{d['worstModule']} (cohesion={fixed(d['worstCohesion'])})"],
        "entropy": lambda: [f"normalized entropy: {fixed(d['normalizedEntropy'])}"],
        "complexFn": lambda: _calls(d["complexFunctions"], "cc", "CC"),
        "cognitiveComplexity": lambda: _calls(d["functions"], "cognitiveComplexity", "CC"),
        "highParams": lambda: _calls(d["functions"], "paramCount", "params"),
        "longFunctions": lambda: [f"{f['file']}:{f['name']} ({f['lineCount']} lines)" for f in d["functions"]],
        "largeFiles": lambda: [f"{f['file']} ({f['lines']} lines)" for f in d["files"]],
        "comments": lambda: [f"comment ratio: {fixed(d['commentRatio'] * 100, 1)}%"],
        "levelization": lambda: [f"{d['violations']} violations in {d['totalEdges']} edges"],
        "blastRadius": lambda: [f"{d['maxBlastRadiusFile']} (radius {d['maxBlastRadius']}/{d['totalFiles']})"],
        "distanceFromMainSeq": lambda: [f"{d['worstModule']} (D={fixed(d['distance'])})"],
        "attackSurface": lambda: [f"{d['reachableCount']}/{d['totalFiles']} files reachable"],
        "hotspots": lambda: [f"{f['file']} (score={fixed(f['score'], 1)})" for f in d["files"]],
        "codeChurn": lambda: [f"{f['file']} (churn={f['churn']})" for f in d["files"]],
        "changeCoupling": lambda: [f"{p['fileA']} <-> {p['fileB']} ({p['count']}x)" for p in d["pairs"]],
        "busFactor": lambda: [f"{f['file']} ({f['authorCount']} author(s))" for f in d["files"]],
        "codeAge": lambda: [f"{f['file']} ({f['daysSinceUpdate']} days)" for f in d["files"]],
    }
    return rows[name]()


def as_table(r: Report) -> str:
    a, b, c = WIDTHS
    row = lambda x, y, z: f"  {x:<{a}} {y:>{b}} {z:>{c}}"
    rule = "  " + "─" * (a + b + c + 2)
    lines = ["", "  quoin — Architecture Health Report", "", row("Dimension", "Value", "Grade"), rule]
    category = None
    for d in DIMENSIONS:
        if d.name not in r.dimensions:
            continue
        if d.category != category:
            category = d.category
            lines += ["", f"  {CATEGORIES[category]}"]
        x = r.dimensions[d.name]
        lines.append(row(d.label, str(math.floor(x["rawValue"] + 0.5)) if d.is_integer else fixed(x["rawValue"]), x["grade"]))
    lines += [rule, row("Composite", "", r.composite), "", f"  {r.file_count} files scanned in {r.duration_ms}ms", ""]
    return "\n".join([*lines, *problems(r)])


def problems(r: Report) -> list[str]:
    out: list[str] = []
    for d in DIMENSIONS:
        x = r.dimensions.get(d.name)
        if x is None or x["grade"] not in "CDF" or not x["details"]:
            continue
        items = detail_lines(d.name, x["details"])
        out += [] if out else ["  Problem Areas", ""]
        out += [f"  {d.label} [{x['grade']}]", *(f"    {i}" for i in items[:SHOWN])]
        if len(items) > SHOWN:
            out.append(f"    ...and {len(items) - SHOWN} more")
        out.append("")
    return out


def as_json(r: Report) -> str:
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    told = {n: {"rawValue": whole(d["rawValue"]), "grade": d["grade"], "details": d["details"] or {}} for n, d in r.dimensions.items()}
    return json.dumps({"dimensions": told, "compositeGrade": r.composite, "metadata": {"fileCount": r.file_count, "scanDurationMs": r.duration_ms}}, indent=2, ensure_ascii=False)


FORMATS: dict[str, Callable[[Report], str]] = {"table": as_table, "json": as_json}


def formatter(name: str) -> Callable[[Report], str]:
    if name not in FORMATS:
        raise ValueError(f'Unknown format "{name}". Available: {", ".join(FORMATS)}')
    return FORMATS[name]


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Architecture report</title>
<style>
body{font:14px system-ui,sans-serif;margin:0;background:#111827;color:#e5e7eb}
header{padding:12px 20px;display:flex;gap:24px;align-items:baseline}
main{padding:0 20px}section[hidden]{display:none}
button{background:#1f2937;color:inherit;border:1px solid #374151;padding:6px 14px;cursor:pointer}
svg text{font-size:11px;fill:#111}table{border-collapse:collapse;font-size:12px}
td,th{border:1px solid #374151;padding:3px 6px;text-align:center}.up{background:#7f1d1d}.down{background:#14532d}
</style></head><body>
<header><b>Architecture report</b><span>Grade <b id="grade"></b></span><span id="sum"></span>
<button data-tab="treemap">Treemap</button><button data-tab="dsm">Dependencies</button></header>
<main><section id="treemap"><svg id="map" width="1160" height="680"></svg></section><section id="dsm" hidden></section></main>
<script id="data" type="application/json">@DATA@</script>
<script>
const D = JSON.parse(document.getElementById("data").textContent), NS = "http://www.w3.org/2000/svg";
document.getElementById("grade").textContent = D.compositeGrade;
document.getElementById("sum").textContent = `${D.fileCount} files, ${D.totalLines} lines`;
const part = (items, x, y, w, h, draw) => {
  if (!items.length) return;
  if (items.length === 1) return draw(items[0], x, y, w, h);
  const all = items.reduce((s, i) => s + i.size, 0) || 1;
  let k = 1, sum = items[0].size;
  while (k < items.length - 1 && sum + items[k].size / 2 < all / 2) sum += items[k++].size;
  const f = sum / all;
  if (w > h) { part(items.slice(0, k), x, y, w * f, h, draw); part(items.slice(k), x + w * f, y, w * (1 - f), h, draw); }
  else { part(items.slice(0, k), x, y, w, h * f, draw); part(items.slice(k), x, y + h * f, w, h * (1 - f), draw); }
};
const tile = (f, x, y, w, h) => {
  const r = document.createElementNS(NS, "rect"), t = document.createElementNS(NS, "title");
  for (const [k, v] of Object.entries({x, y, width: Math.max(0, w - 1), height: Math.max(0, h - 1), fill: D.gradeColors[f.grade]})) r.setAttribute(k, v);
  t.textContent = `${f.path}: ${f.lines} lines, ${f.grade}`; r.append(t); document.getElementById("map").append(r);
};
part(D.treemapFiles.map(f => ({...f, size: Math.max(1, f.lines)})).sort((a, b) => b.size - a.size), 0, 0, 1160, 680, tile);
const M = D.dsmData.modules, n = new Map(D.dsmData.cells.map(c => [c.from + "\\u0000" + c.to, c.count])), table = document.createElement("table");
const cell = (row, text, kind, tag = "td") => { const c = document.createElement(tag); c.textContent = text; if (kind) c.className = kind; row.append(c); };
const top = table.insertRow(); cell(top, "", "", "th"); M.forEach(m => cell(top, m, "", "th"));
M.forEach((a, i) => { const row = table.insertRow(); cell(row, a, "", "th"); M.forEach((b, j) => { const c = n.get(a + "\\u0000" + b); cell(row, c ?? "", c ? (i > j ? "up" : "down") : ""); }); });
document.getElementById("dsm").append(table);
document.querySelectorAll("button").forEach(b => b.onclick = () => document.querySelectorAll("section").forEach(s => s.hidden = s.id !== b.dataset.tab));
</script></body></html>
"""


def as_page(data: dict) -> str:
    """A page that needs nothing else: files by lines and grade, and modules by what they import."""
    told = re.sub("</(script)", r"<\\/\1", json.dumps(data | {"gradeColors": COLOURS}), flags=re.I)
    return _PAGE.replace("@DATA@", told)


__all__ = ["FORMATS", "as_json", "as_page", "as_table", "detail_lines", "formatter", "plain"]
