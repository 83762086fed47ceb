"""Command line: scan, check, gate, visualize and serve."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quoin.reporting import as_page, formatter
from quoin.session import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quoin", description="Architecture quality of TypeScript projects")
    p.add_argument("--format", default="table", help="table or json")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("scan", "grade a project"), ("check", "check its rules"), ("gate", "compare with its baseline"), ("visualize", "write a page")):
        c = commands.add_parser(name, help=text)
        c.add_argument("path", nargs="?", default=".", help="a folder, or the URL of one in storage that Spark reads")
        c.add_argument("--include", nargs="+", default=[])
        c.add_argument("--history", help="the URL of a saved log, for a folder in shared storage")
        if name == "gate":
            c.add_argument("--save", action="store_true")
        if name == "visualize":
            c.add_argument("--output", default="quoin-report.html")
    commands.add_parser("serve", help="answer tool calls on standard input")
    return p


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    show = formatter(a.format)
    engine = engine or Engine()
    if a.command == "serve":
        from quoin.tools import Tools, serve

        serve(Tools(engine))
        return 0
    include, options = tuple(a.include), {"history_url": a.history} if a.history else {}
    if a.command == "scan":
        print(show(engine.scan(a.path, include, **options)))
    elif a.command == "visualize":
        Path(a.output).write_text(as_page(engine.visual(engine.scan(a.path, include, **options))), encoding="utf-8")
        print(f"Report written to {a.output}")
    elif a.command == "check":
        found = engine.check(a.path, include, **options)
        if found is None:
            print("No rules file found.", file=sys.stderr)
            return 1
        passed, violations, number = found
        if not passed:
            print(f"{len(violations)} violation(s) found:", file=sys.stderr)
            for v in violations:
                print(f"  [{v['severity']}] {v['rule']}: {v['message']}", *(f"    - {f}" for f in v["affectedFiles"]), sep="\n", file=sys.stderr)
            return 1
        print(f"All {number} rule(s) passed.")
    elif a.save:
        engine.save_baseline(a.path, include, **options)
    else:
        worse = engine.gate(a.path, include, **options)
        if worse:
            print("Quality gate FAILED - degradations detected:", *(f"  - {w}" for w in worse), sep="\n", file=sys.stderr)
            return 1
        print("Quality gate PASSED - no degradations detected.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
