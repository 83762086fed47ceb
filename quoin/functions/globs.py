"""Two dialects of path patterns: those of ignore lists, and those of layers and boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _braces(body: str, nested) -> str:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    if len(parts) == 1 and (m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body)):
        a, b = sorted(map(int, m.groups()))
        parts = [str(i) for i in range(a, b + 1)]
    return "(?:" + "|".join(map(nested, parts)) + ")" if len(parts) > 1 else r"\{" + nested(body) + r"\}"


def ignore_regex(pattern: str) -> str:
    """A whole-path regex; wildcards don't match a leading dot, ** spans folders only as a whole segment."""
    negated = False
    while pattern.startswith("!") and not pattern.startswith("!("):
        negated, pattern = not negated, pattern[1:]
    pattern = pattern.removeprefix("./")

    def translate(text: str, fresh: bool = True) -> str:
        out, i = "", 0
        while i < len(text):
            c = text[i]
            begins = (i == 0 and fresh) or (i > 0 and text[i - 1] == "/")
            dotless = r"(?!\.)" if begins else ""
            if c in "@?*+!(" and (group := text.find("(", i, i + 2)) >= 0 and (end := _closing(text, group, "()")) > 0:
                # one of some patterns: once, at most once, any number of times, at least once, or none of them
                either = "(?:" + "|".join(translate(p, begins) for p in _alternatives(text[group + 1 : end])) + ")"
                if c == "!":
                    alone = begins and (end + 1 == len(text) or text[end + 1] == "/")
                    out += f"(?!{either}{translate(text[end + 1 :], False)}$){dotless}[^/]{'+' if alone else '*'}?"
                else:
                    out += either + (c if c in "?*+" else "")
                i = end + 1
            elif c == "*":
                stars = len(text[i:]) - len(text[i:].lstrip("*"))
                ends = i + stars == len(text)
                if stars >= 2 and begins and (ends or text[i + stars] == "/"):
                    if ends:
                        out += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*/?)?" if i else r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*/?)"
                        i += stars
                    else:
                        out += r"(?:(?!\.)[^/]+/)*"
                        i += stars + 1
                    continue
                # a lone star takes at least one character of a segment that it makes up
                whole = begins and (ends or text[i + stars] == "/")
                out += dotless + ("[^/]+" if whole else "[^/]*")
                i += stars
            elif c == "?":
                out += dotless + "[^/]"
                i += 1
            elif c == "[" and (end := text.find("]", i + 2)) > 0:
                body = text[i + 1 : end]
                out += dotless + "[" + ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                i = end + 1
            elif c == "{" and (end := _closing(text, i)) > 0:
                out += _braces(text[i + 1 : end], lambda p, b=begins: translate(p, b))
                i = end + 1
            elif c == "\\" and i + 1 < len(text):
                out += re.escape(text[i + 1])
                i += 2
            else:
                out += re.escape(c)
                i += 1
        return out

    whole = "^" + translate(pattern) + "$"
    # a trailing /** also matches the folder itself
    if pattern.endswith("/**"):
        whole = "^" + translate(pattern[:-3]) + r"(?:/(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*/?)?)?$"
    return f"^(?!{whole[1:]}).*$" if negated else whole


def _alternatives(body: str) -> list[str]:
    """What stands between the bars that are in no inner group."""
    parts, depth = [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _closing(text: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if depth == 0:
            return i
    return -1


def is_ignored(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{ignore_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def matches(pattern: str, path: Column) -> Column:
    """Layer patterns: the path itself, one ** with a beginning and an end, * within a folder, or a folder's name."""
    same = path == pattern
    if "**" in pattern:
        pieces = pattern.split("**")
        if len(pieces) != 2:
            return same
        before, after = pieces
        begins = path.startswith(before)
        if after in ("", "/"):
            return same | begins
        after = after.removeprefix("/")
        rest = F.substring(path, len(before) + 1, 1 << 30)
        if "*" in after:
            return same | begins & F.element_at(F.split(rest, "/"), -1).rlike(star_regex(after))
        return same | begins & rest.endswith(after)
    if "*" in pattern:
        return same | path.rlike(star_regex(pattern))
    return same | path.startswith(pattern + "/")


def star_regex(pattern: str) -> str:
    return "^" + "[^/]*".join(re.escape(p) for p in pattern.split("*")) + "$"
