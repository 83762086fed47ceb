"""Lines of source text by what they hold: code, comment or nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.columns import JS_SPACE

SCHEMA = "lines int, logic int, comments int, blanks int"

#: What is of interest next: a comment's beginning, a quote, or any other visible character.
_TOKEN = re.compile(r"(?P<line>//)|(?P<block>/\*)|(?P<tick>`)|(?P<quote>[\"'])|(?P<code>[^ \t])")
_STRING = {q: re.compile(rf"(?:\\.|[^\\{q}])*(?P<end>{q})?", re.S) for q in "\"'`"}
#: White space as JavaScript's trim() sees it.
_SPACE = "\t\n\v\f\r                  　﻿"


def _string_end(text: str, at: int, quote: str) -> tuple[int, bool]:
    """Where a string that is open at a place ends, and whether it is closed there."""
    m = _STRING[quote].match(text, at)
    if m["end"]:
        return m.end(), True
    return len(text), False


def count_lines(source: str) -> tuple[int, int, int, int]:
    """(lines, logic, comments, blanks). A line with code and comment is code; templates may span lines, and are code."""
    if not source:
        return 0, 0, 0, 0
    lines = source.split("\n")
    if not lines[-1]:
        lines.pop()
    logic = comments = blanks = 0
    inside = ""  # "*" in a block comment, "`" in a template
    for line in lines:
        text = line.strip(_SPACE)
        if not text:
            comments += inside == "*"
            logic += inside == "`"
            blanks += not inside
            continue
        at, code, comment = 0, False, False
        if inside == "`":
            code = True
            at, closed = _string_end(text, 0, "`")
            inside = "" if closed else "`"
        while at < len(text):
            if inside == "*":
                comment = True
                end = text.find("*/", at)
                at, inside = (len(text), "*") if end < 0 else (end + 2, "")
                continue
            m = _TOKEN.search(text, at)
            if m is None:
                break
            at = m.end()
            if m["line"]:
                comment |= not code
                break
            if m["block"]:
                comment |= not code
                end = text.find("*/", at)
                at, inside = (len(text), "*") if end < 0 else (end + 2, "")
            elif m["tick"] or m["quote"]:
                code = True
                at, closed = _string_end(text, at, m[0])
                if m["tick"] and not closed:
                    inside = "`"
            else:
                code = True
        logic += code
        comments += comment and not code
    return len(lines), logic, comments, blanks


def _plain_counts(text: Column) -> Column:
    """The four numbers of a text without block comments and templates, where each line tells of itself what it is."""
    parts = F.split(text, "\n")
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    total = F.size(lines)
    blanks = F.size(F.filter(lines, lambda x: x.rlike(f"^{JS_SPACE}*+$")))
    comments = F.size(F.filter(lines, lambda x: x.rlike(f"^{JS_SPACE}*+//")))
    return F.struct(total.alias("lines"), (total - blanks - comments).alias("logic"), comments.alias("comments"), blanks.alias("blanks"))


def counted_lines(rows: DataFrame, text: str) -> DataFrame:
    """rows with counts, a struct of the four numbers; null counts as empty. Only texts with block comments or templates go to Python."""

    @F.pandas_udf(SCHEMA)
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_lines(t or "") for t in texts], columns=["lines", "logic", "comments", "blanks"])

    t = F.coalesce(F.col(text), F.lit(""))
    stateful = t.contains("`") | t.contains("/*")
    nothing = F.struct(*(F.lit(0).alias(c) for c in ("lines", "logic", "comments", "blanks")))
    plain = F.when(t == "", nothing).otherwise(_plain_counts(t))
    return rows.withColumn("counts", F.when(stateful, count(F.when(stateful, t))).otherwise(plain))
