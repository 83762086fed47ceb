"""Tools over JSON: by name from Python, or line by line over standard input and output (JSON-RPC)."""

from __future__ import annotations

import json
import sys

from quoin.functions.dimensions import NAMES
from quoin.operators.rules import grade_changes
from quoin.session import Engine, Report

_PATH = {"path": {"type": "string", "description": "Folder to scan"}, "include": {"type": "array", "items": {"type": "string"}, "description": "Folders to keep to"}}
_DIMENSIONS = {"dimensions": {"type": "array", "items": {"type": "string", "enum": list(NAMES)}}}


def _tool(name: str, text: str, **more) -> dict:
    return {"name": name, "description": text, "inputSchema": {"type": "object", "properties": _PATH | more, "required": ["path"]}}


TOOLS = [
    _tool("scan", "All dimensions of a project, or some of them, with details", **_DIMENSIONS),
    _tool("health", "Grades of all dimensions"),
    _tool("coupling_detail", "Coupling between modules"),
    _tool("cycles_detail", "Import cycles"),
    _tool("session_start", "Keep the current state to compare with"),
    _tool("session_end", "What changed since session_start"),
]


class Tools:
    def __init__(self, engine: Engine | None = None):
        self.engine = engine or Engine()
        self.kept: Report | None = None  # its rows are in the shared folder

    def call(self, name: str, args: dict) -> str:
        """The tool's text; errors are told as JSON, too."""
        if name not in {t["name"] for t in TOOLS} or not args.get("path"):
            return f"Unknown tool: {name}"
        try:
            return json.dumps(getattr(self, "_" + name)(args), indent=2, ensure_ascii=False)
        except Exception as e:  # noqa: BLE001  a tool's answer is its error
            return json.dumps({"error": str(e)})

    def _report(self, args: dict, names: tuple[str, ...] = NAMES, details: bool = False) -> Report:
        c, _ = self.engine.snapshot(args["path"], tuple(args.get("include") or ()))
        r = self.engine.health(c, NAMES, details=False)
        if details:
            from quoin.plans.details import details_of

            for n in names:
                r.dimensions[n]["details"] = details_of(c, n)
        return r

    def _scan(self, args: dict) -> dict:
        wanted = tuple(n for n in NAMES if n in args["dimensions"]) if args.get("dimensions") else NAMES
        r = self._report(args, wanted, details=True)
        shown = {n: {"name": n, **r.dimensions[n]} for n in wanted}
        return {"compositeGrade": r.composite, "fileCount": r.file_count, "scanDurationMs": r.duration_ms, "dimensions": shown}

    def _health(self, args: dict) -> dict:
        r = self._report(args)
        return {"compositeGrade": r.composite, "fileCount": r.file_count, "scanDurationMs": r.duration_ms, "dimensions": grades(r)}

    def _one(self, args: dict, name: str) -> dict:
        r = self._report(args, (name,), details=True)
        return r.dimensions[name]

    def _coupling_detail(self, args: dict) -> dict:
        d = self._one(args, "coupling")
        return {"grade": d["grade"], "rawValue": d["rawValue"], "details": d["details"]}

    def _cycles_detail(self, args: dict) -> dict:
        d = self._one(args, "cycles")
        return {"grade": d["grade"], "rawValue": d["rawValue"], "cycles": d["details"]["cycles"]}

    def _session_start(self, args: dict) -> dict:
        self.kept = r = self._report(args)
        return {"baselineSaved": True, "compositeGrade": r.composite, "fileCount": r.file_count, "dimensions": grades(r)}

    def _session_end(self, args: dict) -> dict:
        r = self._report(args)
        current = {"compositeGrade": r.composite, "fileCount": r.file_count, "dimensions": grades(r)}
        base, self.kept = self.kept, None
        if base is None:
            return {"warning": "No baseline found. Run session_start first. Returning current scan results.", "current": current}
        changed = {x["name"]: x for x in grade_changes(base.rows, r.rows).collect()}
        changes = {n: {"from": changed[n]["from_grade"], "to": changed[n]["to_grade"]} for n in NAMES if n in changed}
        return {"baseline": {"compositeGrade": base.composite, "dimensions": grades(base)}, "current": current, "changes": changes, "compositeGradeChanged": base.composite != r.composite}


def grades(r: Report) -> dict[str, str]:
    return {n: d["grade"] for n, d in r.dimensions.items()}


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one JSON-RPC message; None for notifications."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quoin", "version": "0.1.0"}}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        result = {"content": [{"type": "text", "text": tools.call(params.get("name", ""), params.get("arguments") or {})}]}
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"Method not found: {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools | None = None, source=sys.stdin, sink=sys.stdout) -> None:
    tools = tools or Tools()
    for line in source:
        if line.strip():
            reply = answer(tools, json.loads(line))
            if reply is not None:
                print(json.dumps(reply), file=sink, flush=True)
