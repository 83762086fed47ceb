"""Read declarations, imports and complexities from TypeScript text, without a grammar.

A tolerant scanner gives tokens; brackets are matched; statements and expressions are then walked by position. Broken
text gives what could be read of it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

_SPACE = re.compile(r"[\s﻿]+")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_WORD = re.compile(r"[#@]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_MARKS = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ++ -- << >> >>> & | ^ ! ~ && || ?? ? : = += -= *= /= %= <<= >>= >>>= &= |= ^= **= ** &&= ||= ??= => . ?. ... @ #".split(), key=len, reverse=True)
_MARK = re.compile("|".join(map(re.escape, _MARKS)))
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}$"}, {")", "]", "}", "}$"}
#: After these words an expression begins, so a slash opens a pattern and < may open markup.
_BEFORE_EXPRESSION = set("return typeof case in of delete void throw new else do await yield instanceof default extends".split())
_LOGICAL = {"&&", "||", "??"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "=>"}


@dataclass
class Token:
    kind: str  # word, number, string, text (of a template), pattern, mark
    text: str
    start: int
    end: int
    line: int


class Scanner:
    def __init__(self, source: str, markup: bool):
        self.s, self.markup, self.at, self.line = source, markup, 0, 1
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []

    def put(self, kind: str, end: int, text: str | None = None) -> None:
        end = min(end, len(self.s))
        raw = self.s[self.at : end]
        self.tokens.append(Token(kind, raw if text is None else text, self.at, end, self.line))
        self.line += raw.count("\n")
        self.at = end

    def skip(self, end: int) -> None:
        self.line += self.s.count("\n", self.at, end)
        self.at = end

    def expecting(self) -> bool:
        """Whether an expression may begin here."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "word":
            return t.text in _BEFORE_EXPRESSION
        return t.kind == "mark" and t.text not in {")", "]", "}", "}$", "++", "--"}

    def run(self, until: str | None = None) -> None:
        """Scan to the end, or to the bracket that closes what was open before."""
        depth = 0
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            if m := _SPACE.match(s, self.at):
                self.skip(m.end())
            elif s.startswith("//", self.at) or self.at == 0 and s.startswith("#!"):
                end = s.find("\n", self.at)
                self._comment(len(s) if end < 0 else end)
            elif s.startswith("/*", self.at):
                end = s.find("*/", self.at + 2)
                self._comment(len(s) if end < 0 else end + 2)
            elif c in "\"'":
                m = re.compile(rf"(?:\\.|[^\\\n{c}])*{c}?", re.S).match(s, self.at + 1)
                self.put("string", m.end())
            elif c == "`":
                self._template()
            elif c == "/" and self.expecting() and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(s, self.at)):
                self.put("pattern", m.end())
            elif c == "<" and self.markup and self.expecting() and re.compile(r"<(?:>|[A-Za-z_][\w.:-]*(?=[\s/>])(?!\s+extends\b)(?!\s*,))").match(s, self.at):
                self._markup()
            elif (m := _NUMBER.match(s, self.at)) and (c.isdigit() or c == "."):
                self.put("number", m.end())
            elif m := _WORD.match(s, self.at):
                self.put("word", m.end())
            elif m := _MARK.match(s, self.at):
                mark = m[0]
                if mark == "?." and s[self.at + 2 : self.at + 3].isdigit():
                    mark = "?"
                if mark in ("(", "[", "{"):
                    depth += 1
                elif mark in _CLOSE:
                    if depth == 0 and until == mark:
                        return
                    depth = max(0, depth - 1)
                self.put("mark", self.at + len(mark))
            else:
                self.skip(self.at + 1)

    def _comment(self, end: int) -> None:
        self.comments.append((self.at, end))
        self.skip(end)

    def _hole(self, opening: int) -> None:
        """Code in braces inside a template or markup."""
        self.put("mark", self.at + opening, "${")
        self.run("}")
        self.put("mark", self.at + 1, "}$")

    def _template(self) -> None:
        self.put("text", self.at + 1)
        plain = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)
        while self.at < len(self.s):
            self.skip(plain.match(self.s, self.at).end())
            if self.s.startswith("${", self.at):
                self._hole(2)
            else:
                self.skip(min(self.at + 1, len(self.s)))
                return

    def _markup(self) -> None:
        """An element: its tags and text are nothing, the code in braces counts."""
        self.tokens.append(Token("text", "<>", self.at, self.at, self.line))
        depth = 0
        tag = re.compile(r"<(/?)(?:[A-Za-z_][\w.:-]*)?")
        while self.at < len(self.s):
            m = tag.match(self.s, self.at)
            if m is None:
                if self.s[self.at] == "{":
                    self._hole(1)
                else:
                    self.skip(self.at + 1)
                continue
            self.skip(m.end())
            single = False
            while self.at < len(self.s) and self.s[self.at] != ">":
                c = self.s[self.at]
                if c in "\"'":
                    end = self.s.find(c, self.at + 1)
                    self.skip(len(self.s) if end < 0 else end + 1)
                elif c == "{":
                    self._hole(1)
                else:
                    single = c == "/"
                    self.skip(self.at + 1)
            self.skip(min(self.at + 1, len(self.s)))
            depth += -1 if m[1] else 0 if single else 1
            if depth <= 0:
                return


class Source:
    """Tokens with matched brackets."""

    def __init__(self, source: str, markup: bool = False):
        self.source = source
        scanner = Scanner(source, markup)
        scanner.run()
        self.t, self.comments = scanner.tokens, scanner.comments
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE and stack:
                while stack and _OPEN[self.t[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    self.pair[stack.pop()] = i
        for i in stack:
            self.pair.setdefault(i, len(self.t))
        self.back = {b: a for a, b in self.pair.items()}
        self.do_ends: set[int] = set()

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind in ("mark", "word")

    def word(self, i: int) -> str:
        """The word at a place where it isn't a member's name."""
        if not 0 <= i < len(self.t) or self.t[i].kind != "word" or self.is_(i - 1, ".", "?."):
            return ""
        return self.t[i].text

    def after(self, i: int) -> int:
        return self.pair[i] + 1 if i in self.pair else i + 1

    def angle(self, i: int) -> int:
        """The place after the type arguments that open at i; i if there are none."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.t):
            x = self.t[k].text if self.t[k].kind == "mark" else ""
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(x, 0)
            if depth <= 0:
                return k + 1
            if x in (";", ")", "}", "]"):
                return i
            k = self.after(k)
        return i

    def top(self, lo: int, hi: int):
        """Places of a range outside inner brackets."""
        i = lo
        while i < hi:
            yield i
            i = self.after(i)

    def statement_end(self, i: int, hi: int) -> int:
        """The place after the statement without a body of its own that begins at i."""
        start = i
        while i < hi:
            if self.is_(i, ";"):
                return i + 1
            last = self.after(i) - 1
            i = last + 1
            if i < hi and self.t[i].line > self._end_line(last) and self._breaks(last, i):
                return i
            if i < hi and self.is_(i, "}"):
                return i
        return max(hi, start + 1) if hi > start else hi

    def _end_line(self, i: int) -> int:
        t = self.t[min(i, len(self.t) - 1)]
        return t.line + t.text.count("\n")

    def _breaks(self, last: int, i: int) -> bool:
        a, b = self.t[min(last, len(self.t) - 1)], self.t[i]
        goes_on = a.kind == "mark" and a.text not in {")", "]", "}", "}$", "++", "--"} or a.kind == "word" and a.text in _BEFORE_EXPRESSION - {"default"} | {"const", "let", "var", "async", "type", "export", "import", "from", "as"}
        continues = b.kind == "mark" and b.text not in {"{", "++", "--", "!", "~", "@", "...", "#", "}"} or b.kind == "word" and b.text in {"in", "of", "instanceof", "as", "satisfies", "extends", "from"}
        if b.kind == "mark" and b.text == "{" and a.text == "=>":
            continues = True
        return not goes_on and not continues

    # cyclomatic

    def branches(self, lo: int, hi: int) -> int:
        """Branching statements, switch labels, catches, conditional expressions and logical operators in a range."""
        n, types = 0, self._type_ranges(lo, hi)
        for i in range(lo, hi):
            t = self.t[i]
            if any(a <= i < b for a, b in types):
                continue
            if t.kind == "mark":
                n += t.text in _LOGICAL or self.is_ternary(i)
                continue
            w = self.word(i)
            if w in ("if", "while", "for"):
                opens = self.is_(i + 1, "(") or w == "for" and self.is_(i + 2, "(")
                n += opens and not (w == "while" and self._closes_do(i)) and not self._method_name(i)
            elif w == "do":
                n += not self.is_(i + 1, ":", ",", ")", "=", "(")
            elif w == "case":
                n += not self.is_(i + 1, ":", ",", "}", "(", "=") or self.is_(i + 1, "(") and self._in_switch(i)
            elif w == "default":
                n += self.is_(i + 1, ":") and self._in_switch(i)
            elif w == "catch":
                n += self.is_(i - 1, "}") and self.is_(i + 1, "(", "{")
        return n

    def _type_ranges(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Type aliases and interfaces inside a function: their ? and : are of types."""
        out = []
        for i in range(lo, hi):
            if self.word(i) in ("type", "interface") and i + 1 < hi and self.t[i + 1].kind == "word" and self.is_(i + 2, "=", "<", "{", "extends") and not self.is_(i - 1, ":", "(", ","):
                out.append((i, self.statement_end(i, hi)))
        return out

    def _method_name(self, i: int) -> bool:
        return self.is_(i + 1, "(") and self.is_(self.after(i + 1), "{") and self.is_(i - 1, ",", "get", "set", "async", "static") and self.t[i].text != "if"

    def _closes_do(self, i: int) -> bool:
        """Whether the while at i ends a do statement."""
        if self.is_(i - 1, "}") and (i - 1) in self.back and self.word(self.back[i - 1] - 1) == "do":
            return True
        if self.is_(i - 1, ";"):
            k, line = i - 2, 0
            while k >= 0 and not self.is_(k, ";", "{", "}"):
                if self.word(k) == "do":
                    return True
                k, line = k - 1, line + 1
        return False

    def _in_switch(self, i: int) -> bool:
        """Whether the innermost open brace belongs to a switch."""
        k = i - 1
        while k >= 0:
            if k in self.back:
                k = self.back[k] - 1
                continue
            if self.t[k].kind == "mark" and self.t[k].text in _OPEN:
                return self.t[k].text == "{" and self.is_(k - 1, ")") and (k - 1) in self.back and self.word(self.back[k - 1] - 1) == "switch"
            k -= 1
        return False

    def is_ternary(self, i: int) -> bool:
        return self.is_(i, "?") and not self.is_(i + 1, ":", ")", ",", ";", "=", "]", "}", ">") and self._answered(i)

    def _answered(self, i: int) -> bool:
        """Whether a colon answers the question mark at i."""
        open_marks, k = 1, i + 1
        while k < len(self.t):
            if self.is_(k, "?") and not self.is_(k + 1, ":", ")", ",", "="):
                open_marks += 1
            elif self.is_(k, ":"):
                open_marks -= 1
                if open_marks == 0:
                    return True
            elif self.is_(k, ";") or self.t[k].kind == "mark" and self.t[k].text in _CLOSE:
                return False
            k = self.after(k)
        return False

    # cognitive

    def body_load(self, lo: int, hi: int, block: bool) -> int:
        """Cognitive complexity of a function's body: a block's inside, or an expression whose own head doesn't count."""
        return self.statements(lo, hi, 0) if block else self.expression(lo, hi, 0, own=False)

    def statements(self, lo: int, hi: int, nesting: int) -> int:
        n, i = 0, lo
        while i < hi:
            load, to = self.one(i, hi, nesting)
            n += load
            i = max(to, i + 1)
        return n

    def _head(self, i: int, hi: int, nesting: int) -> tuple[int, int]:
        """Load and end of the parentheses at i."""
        if not self.is_(i, "("):
            return 0, i
        return self.header(i + 1, min(self.pair.get(i, hi), hi), nesting), self.after(i)

    def header(self, lo: int, hi: int, nesting: int) -> int:
        n, start = 0, lo
        for i in [*(i for i in self.top(lo, hi) if self.is_(i, ";")), hi]:
            n += self.expression(start, i, nesting)
            start = i + 1
        return n

    def one(self, i: int, hi: int, nesting: int, own: bool = True) -> tuple[int, int]:
        """Load and end of the statement at i; without own, its head counts nothing and what is in it nests no deeper."""
        if i >= hi:
            return 0, hi
        w = self.word(i)
        if self.is_(i, "{"):
            return self.statements(i + 1, min(self.pair.get(i, hi), hi), nesting), self.after(i)
        if w == "if" and self.is_(i + 1, "("):
            return self._if(i, hi, nesting, 1 + nesting) if own else self._bare_if(i, hi, nesting)
        head, inner = (1 + nesting, nesting + 1) if own else (0, nesting)
        if w in ("for", "while") and (self.is_(i + 1, "(") or self.is_(i + 2, "(")):
            load, k = self._head(i + 1 + (not self.is_(i + 1, "(")), hi, inner)
            body, k = self.one(k, hi, inner)
            return head + load + body, k
        if w == "switch" and self.is_(i + 1, "("):
            load, k = self._head(i + 1, hi, inner)
            return head + load + (self.statements(k + 1, min(self.pair.get(k, hi), hi), inner) if self.is_(k, "{") else 0), self.after(k)
        if w == "do":
            body, k = self.one(i + 1, hi, inner)
            if self.word(k) == "while":
                load, k = self._head(k + 1, hi, inner)
                return head + body + load, k + self.is_(k, ";")
            return head + body, k
        if w == "try" and self.is_(i + 1, "{"):
            n, k = self.one(i + 1, hi, nesting)
            if self.word(k) == "catch":
                k = self.after(k + 1) if self.is_(k + 1, "(") else k + 1
                load, k = self.one(k, hi, nesting + 1)
                n += 1 + nesting + load
            if self.word(k) == "finally":
                load, k = self.one(k + 1, hi, nesting)
                n += load
            return n, k
        if w == "case" and not self.is_(i + 1, ":"):
            colon = self._label_end(i + 1, hi)
            return self.expression(i + 1, colon, nesting), colon + 1
        if w == "default" and self.is_(i + 1, ":"):
            return 0, i + 2
        if w in ("type", "interface") and i + 1 < hi and self.t[i + 1].kind == "word":
            return 0, self.statement_end(i, hi) if w == "type" else self._past_braces(i, hi)
        if w in ("function", "class") or w == "async" and self.word(i + 1) == "function":
            end = self._past_braces(i, hi)
            return self.expression(i, end, nesting), end
        if w and self.is_(i + 1, ":") and self.t[i].kind == "word":
            load, k = self.one(i + 2, hi, nesting)
            return load, k
        end = self.statement_end(i, hi)
        return self.expression(i, end, nesting), end

    def _label_end(self, i: int, hi: int) -> int:
        marks = 0
        for k in self.top(i, hi):
            if self.is_ternary(k):
                marks += 1
            elif self.is_(k, ":"):
                if marks == 0:
                    return k
                marks -= 1
        return hi

    def _past_braces(self, i: int, hi: int) -> int:
        for k in self.top(i, hi):
            if self.is_(k, "{") and not self.is_(k - 1, ":", "<", "|", "&", ",", "=>"):
                return self.after(k)
        return hi

    def _if(self, i: int, hi: int, nesting: int, head: int) -> tuple[int, int]:
        load, k = self._head(i + 1, hi, nesting)
        then, k = self.one(k, hi, nesting + 1, own=False)
        n = head + load + then
        if self.word(k) == "else":
            n += 1
            if self.word(k + 1) == "if" and self.is_(k + 2, "("):
                rest, k = self._if(k + 1, hi, nesting, 0)
            else:
                rest, k = self.one(k + 1, hi, nesting + 1, own=False)
            n += rest
        return n, k

    def _bare_if(self, i: int, hi: int, nesting: int) -> tuple[int, int]:
        load, k = self._head(i + 1, hi, nesting)
        then, k = self.one(k, hi, nesting)
        if self.word(k) == "else":
            rest, k = self.one(k + 1, hi, nesting)
            return load + then + rest, k
        return load + then, k

    def expression(self, lo: int, hi: int, nesting: int, own: bool = True) -> int:
        """Load of an expression in its place; without own, its outermost operator counts nothing."""
        if lo >= hi:
            return 0
        places = list(self.top(lo, hi))
        commas = [i for i in places if self.is_(i, ",")]
        if commas:
            return sum(self.expression(a, b, nesting) for a, b in zip([lo, *(i + 1 for i in commas)], [*commas, hi], strict=True))
        for i in places:
            # what follows an arrow or an assignment is a whole expression or a body
            if self.is_(i, *_ASSIGN) and i + 1 < hi:
                if self.is_(i, "=>") and self.is_(i + 1, "{"):
                    end = self.after(i + 1)
                    return self._groups(lo, i, nesting) + self.statements(i + 2, end - 1, nesting) + self._groups(end, hi, nesting)
                return self._groups(lo, i, nesting) + self.expression(i + 1, hi, nesting)
        question = next((i for i in places if self.is_ternary(i)), None)
        if question is not None:
            marks, colon = 0, hi
            for k in self.top(question + 1, hi):
                if self.is_ternary(k):
                    marks += 1
                elif self.is_(k, ":"):
                    if marks == 0:
                        colon = k
                        break
                    marks -= 1
            head, inner = (1 + nesting, nesting + 1) if own else (0, nesting)
            lo = self._past_prefix(lo)
            return head + self.expression(lo, question, inner) + self.expression(question + 1, colon, inner) + self.expression(colon + 1, hi, inner)
        logical = [i for i in places if self.t[i].kind == "mark" and self.t[i].text in _LOGICAL]
        if logical:
            ops = [self.t[i].text for i in logical]
            weakest = [i for i in logical if self.t[i].text != "&&"] or logical
            at = weakest[-1]
            if not own:
                return self.expression(lo, at, nesting) + self.expression(at + 1, hi, nesting)
            n = sum(1 for a, b in zip([None, *ops], ops, strict=False) if a != b)
            for a, b in ((lo, at), (at + 1, hi)):
                if not any(a <= i < b for i in logical):
                    n += self._groups(a, b, nesting)
            return n
        return self._groups(lo, hi, nesting)

    def _past_prefix(self, lo: int) -> int:
        while self.word(lo) in ("return", "throw", "yield", "await", "const", "let", "var"):
            lo += 1
        return lo

    def _groups(self, lo: int, hi: int, nesting: int) -> int:
        """Load of what stands in the brackets of a range."""
        n = 0
        for i in self.top(lo, hi):
            if i not in self.pair:
                continue
            inner = i + 1, min(self.pair[i], hi)
            if not self.is_(i, "{"):
                n += self.header(*inner, nesting)
            elif self._is_block(i, lo):
                n += self._class_body(*inner, nesting) if self._of_class(i, lo) else self.statements(*inner, nesting)
            else:
                n += self._object(*inner, nesting)
        return n

    def _is_block(self, i: int, lo: int) -> bool:
        return self.is_(i - 1, ")", "=>") or self._of_class(i, lo) or self._typed_body(i, lo)

    def _of_class(self, i: int, lo: int) -> bool:
        k = i - 1
        while k >= lo and not self.is_(k, ";", "{", "}", "=", "(", ",") or k >= lo and self.is_(k, ","):
            if self.word(k) == "class":
                return True
            k -= 1
        return False

    def _typed_body(self, i: int, lo: int) -> bool:
        """Whether the brace follows a result type: ) : type {"""
        k = i - 1
        while k > lo and not self.is_(k, ";", "{", "}", ",", "=", "("):
            if self.is_(k, ":") and self.is_(k - 1, ")"):
                return True
            k = self.back[k] - 1 if k in self.back else k - 1
        return False

    def _class_body(self, lo: int, hi: int, nesting: int) -> int:
        n, i = 0, lo
        while i < hi:
            if self.is_(i, "{"):
                n += self.statements(i + 1, min(self.pair.get(i, hi), hi), nesting)
                i = self.after(i)
            elif self.is_(i, "=") and i + 1 < hi:
                end = self.statement_end(i + 1, hi)
                n += self.expression(i + 1, end, nesting)
                i = end
            else:
                i = self.after(i)
        return n

    def _object(self, lo: int, hi: int, nesting: int) -> int:
        n, start = 0, lo
        for i in [*(i for i in self.top(lo, hi) if self.is_(i, ",")), hi]:
            colon = next((k for k in self.top(start, i) if self.is_(k, ":", "?", "(", "=>")), None)
            if colon is not None and self.is_(colon, ":"):
                n += self.expression(colon + 1, i, nesting)
            else:
                n += self.expression(start, i, nesting)
            start = i + 1
        return n

    # declarations

    def params(self, i: int) -> int:
        """Parameters (and comments among them) in the parentheses at i."""
        if not self.is_(i, "("):
            return 0
        hi = self.pair.get(i, len(self.t))
        n, k, fresh, depth = 0, i + 1, True, 0
        while k < hi:
            if self.t[k].kind == "mark":
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.t[k].text, 0)
            if self.is_(k, ",") and depth <= 0:
                fresh = True
            elif fresh:
                n, fresh, depth = n + 1, False, 0
            k = self.after(k)
        if hi < len(self.t):
            inner = [(self.t[a].start, self.t[b].start) for a, b in self.pair.items() if i < a < hi and b < len(self.t)]
            n += sum(1 for a, _ in self.comments if self.t[i].start < a < self.t[hi].start and not any(x < a < y for x, y in inner))
        return n

    def function(self, name: str, first: int, last: int, params: int, lo: int, hi: int, block: bool, node: tuple[int, int]) -> dict:
        """first and last: places of the node's span; lo, hi: of its body's inside, or expression; node: of what counts."""
        last = min(last, len(self.t) - 1)
        start, end = self.t[first].line, self._end_line(last)
        a, b = (lo - 1, min(hi, len(self.t) - 1)) if block else (lo, min(hi, len(self.t)) - 1)
        text = self.source[self.t[a].start : self.t[b].end] if lo <= len(self.t) and b >= a else ""
        return {"name": name, "start_line": start, "end_line": end, "line_count": end - start + 1, "cc": 1 + self.branches(*node), "cognitive": self.body_load(lo, hi, block), "param_count": params, "body_hash": hashed_body(text)}

    def result_type(self, i: int, hi: int) -> int:
        """The place after ': type' at i, where a body, arrow or end stands."""
        if not self.is_(i, ":"):
            return i
        k = i + 1
        while k < hi:
            if self.is_(k, "=>", ";", "="):
                # a function type in a result's place: its arrow is followed by a type, not by the body
                if self.is_(k, "=>") and self.is_(k - 1, ")") and self.is_(self.back.get(k - 1, 0) - 1, ":"):
                    k += 1
                    continue
                return k
            if self.is_(k, "{") and not self.is_(k - 1, ":", "|", "&", "<", ",", "=>"):
                return k
            k = self.after(k)
        return hi

    def declared_function(self, i: int, hi: int) -> tuple[list[dict], int]:
        first = i
        i += self.word(i) == "async"
        i += 1
        i += self.is_(i, "*")
        name = self.t[i].text if i < hi and self.t[i].kind == "word" else "<anonymous>"
        i += name != "<anonymous>"
        i = self.angle(i)
        params = i
        k = self.result_type(self.after(i), hi) if self.is_(i, "(") else i
        if not self.is_(k, "{"):
            return [], self.statement_end(first, hi)
        end = self.after(k)
        if name == "<anonymous>":  # a default export without a name is an expression
            return [], end
        return [self.function(name, first, end - 1, self.params(params), k + 1, end - 1, True, (first, end))], end

    def declared_variables(self, i: int, hi: int) -> tuple[list[dict], int]:
        end, first, out = self.statement_end(i, hi), i, []
        k = i + 1
        while k < end:
            name, depth = self.t[k].text, 0
            k = self.after(k)
            k += self.is_(k, "!")
            if self.is_(k, ":"):
                while k < end and not (self.is_(k, "=") and depth <= 0) and not (self.is_(k, ",") and depth <= 0):
                    depth += {"<": 1, ">": -1, ">>": -2}.get(self.t[k].text if self.t[k].kind == "mark" else "", 0)
                    k = self.after(k)
            if self.is_(k, "="):
                value = k + 1
                stop = next((j for j in self.top(value, end) if self.is_(j, ",")), None)
                arrow, lo = self._arrow(value, end)
                if arrow is not None:
                    stop = next((j for j in self.top(self.after(lo) if self.is_(lo, "{") else lo, end) if self.is_(j, ",")), None)
                    until = end if stop is None else stop
                    until -= self.is_(until - 1, ";")
                    block = self.is_(lo, "{")
                    body = (lo + 1, self.after(lo) - 1) if block else (lo, until)
                    out.append(self.function(name, first, end - 1, arrow, *body, block, (value, until)))
                k = end if stop is None else stop
            k += 1
        return out, end

    def _arrow(self, i: int, hi: int) -> tuple[int | None, int]:
        """Parameters and body of an arrow function at i."""
        i += self.word(i) == "async" and not self.is_(i + 1, "=>")
        if i < hi and self.t[i].kind == "word" and self.is_(i + 1, "=>"):
            return 0, i + 2
        i = self.angle(i)
        if self.is_(i, "("):
            k = self.result_type(self.after(i), hi)
            if self.is_(k, "=>"):
                return self.params(i), k + 1
        return None, i

    def bases(self, lo: int, hi: int, generic: bool) -> list[str]:
        """Plain names of a list of types."""
        out, i = [], lo
        while i < hi:
            end = next((k for k in self._outside_angles(i, hi) if self.is_(k, ",")), hi)
            if self.t[i].kind == "word" and (end == i + 1 or generic and self.is_(i + 1, "<")):
                out.append(self.t[i].text)
            i = end + 1
        return out

    def _outside_angles(self, lo: int, hi: int):
        i = lo
        while i < hi:
            j = self.angle(i)
            if j > i:
                i = j
                continue
            yield i
            i = self.after(i)

    def declared_class(self, i: int, hi: int) -> tuple[dict, list[dict], int]:
        name = self.t[i + 1].text if i + 1 < hi and self.t[i + 1].kind == "word" and self.t[i + 1].text not in ("extends", "implements") else "<anonymous>"
        brace = next((k for k in self._outside_angles(i + 1, hi) if self.is_(k, "{")), hi)
        marks = [k for k in range(i + 1, brace) if self.word(k) in ("extends", "implements")]
        bases = [b for a, z in zip(marks, [*marks[1:], brace], strict=False) for b in self.bases(a + 1, z, self.word(a) == "extends")]
        end = self.after(brace) if brace < hi else hi
        methods = self.methods(brace + 1, end - 1) if brace < hi else []
        return {"name": name, "kind": "class", "bases": bases, "methods": [m["name"] for m in methods]}, methods, end

    def methods(self, lo: int, hi: int) -> list[dict]:
        """Methods with a body among the members of a class."""
        out, i = [], lo
        while i < hi:
            first = i
            while i < hi and (self.t[i].text.startswith("@") or self.is_(i - 1, ".") and i > first):
                i = self.after(i) if not self.is_(i + 1, "(", ".") else i + 1
                i = self.after(i) if self.is_(i, "(") else i + self.is_(i, ".")
            first = i
            while i < hi and self.word(i) in ("public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "declare", "accessor", "abstract") and not self.is_(i + 1, "(", "=", ":", ";", "?", "!", "<"):
                i += 1
            i += self.is_(i, "*")
            if i >= hi:
                break
            name = self.source[self.t[i].start : self.t[min(self.after(i), len(self.t)) - 1].end]
            k = self.after(i)
            k += self.is_(k, "?")
            k = self.angle(k)
            if self.is_(k, "("):
                body = self.result_type(self.after(k), hi)
                if self.is_(body, "{"):
                    end = self.after(body)
                    out.append(self.function(name, first, end - 1, self.params(k), body + 1, end - 1, True, (first, end)))
                    i = end
                    continue
            i = self.after(first) if self.is_(first, ";", "{") else max(self.statement_end(first, hi), first + 1)
        return out

    def declared_interface(self, i: int, hi: int) -> tuple[dict, int]:
        brace = next((k for k in self._outside_angles(i + 1, hi) if self.is_(k, "{")), hi)
        mark = next((k for k in range(i + 1, brace) if self.word(k) == "extends"), brace)
        end = self.after(brace) if brace < hi else hi
        names, k = [], brace + 1
        while k < end - 1:
            start = k
            while self.word(k) in ("get", "set", "readonly") and not self.is_(k + 1, "(", ":", "?", "<"):
                k += 1
            j = self.angle(k + 1 + self.is_(k + 1, "?"))
            if self.t[k].kind in ("word", "string", "number") and self.is_(j, "(") and self.word(k) != "new":
                names.append(self.t[k].text)
            k = next((x + 1 for x in self.top(start, end - 1) if self.is_(x, ";", ",") or x + 1 < end - 1 and self.t[self.after(x)].line > self._end_line(self.after(x) - 1) and self._breaks(self.after(x) - 1, self.after(x))), end - 1)
            k = max(k, start + 1)
        return {"name": self.t[i + 1].text if i + 1 < hi else "<anonymous>", "kind": "interface", "bases": self.bases(mark + 1, brace, False) if mark < brace else [], "methods": names}, end

    def literal(self, i: int) -> str | None:
        return self.t[i].text[1:-1] if i < len(self.t) and self.t[i].kind == "string" and len(self.t[i].text) > 2 else None

    def read(self) -> dict:
        """functions, classes and imports (specifiers) of the file's top level."""
        functions, classes, seen = [], [], {}
        i, hi = 0, len(self.t)
        loose: list[tuple[int, int]] = []
        while i < hi:
            start = i
            exported = self.word(i) == "export"
            while self.t[i].text.startswith("@") and i + 1 < hi:
                i = self.after(i + 1) if self.is_(i + 1, "(") else i + 1
            if exported or self.word(i) == "export":
                exported = True
                i += 1
                i += self.word(i) == "default"
                i += self.word(i) == "declare"
            w, end = self.word(i), None
            if w == "function" or w == "async" and self.word(i + 1) == "function":
                got, end = self.declared_function(i, hi)
                functions += got
            elif w in ("const", "let", "var") and not (w == "const" and self.word(i + 1) == "enum"):
                got, end = self.declared_variables(i, hi)
                functions += got
            elif w == "class":
                info, got, end = self.declared_class(i, hi)
                classes.append(info)
                functions += got
            elif w == "interface" and i + 1 < hi and self.t[i + 1].kind == "word":
                info, end = self.declared_interface(i, hi)
                classes.append(info)
            elif w == "type" and i + 1 < hi and self.t[i + 1].kind == "word" and not self.is_(i + 1, "from") and self.is_(self.angle(i + 2), "="):
                classes.append({"name": self.t[i + 1].text, "kind": "type-alias", "bases": [], "methods": []})
                end = self.statement_end(i, hi)
            elif exported or w == "import" and not self.is_(i + 1, "(", "."):
                end = self._past_braces(i, hi) if w in ("abstract", "enum", "namespace", "module") else self.statement_end(i, hi)
                told = [k for k in self.top(start, end) if self.t[k].kind == "string" and (self.is_(k - 1, "from") or k == i + 1 and not exported)]
                if told and (spec := self.literal(told[0])):
                    seen.setdefault(spec, None)
                exported = exported or True
            if end is None:
                end = self.one(i, hi, 0)[1]
            end = max(end, start + 1)
            if not exported:
                loose.append((start, end))
            i = end
        for a, b in loose:
            for k in range(a, min(b, hi)):
                if self.word(k) in ("import", "require") and self.is_(k + 1, "(") and (spec := self.literal(k + 2)):
                    seen.setdefault(spec, None)
        by_row = {f["start_line"]: f for f in functions}
        # functions that begin in one row have the numbers of the last of them
        functions = [f | {k: by_row[f["start_line"]][k] for k in ("cc", "cognitive")} for f in functions]
        return {"functions": functions, "classes": classes, "imports": list(seen)}


def hashed_body(text: str) -> str:
    bare = re.sub(r"/\*.*?\*/", "", re.sub(r"//[^\n]*", "", text), flags=re.S)
    return hashlib.sha256(re.sub(r"[\s﻿]+", " ", bare).strip(" ").encode()).hexdigest()[:16]


def read_source(text: str, markup: bool = False) -> dict:
    return Source(text, markup).read()
