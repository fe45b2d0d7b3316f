"""Imports and semantics of JavaScript and TypeScript sources, by a tokenizer.

A scan gives tokens and comments; statements are then read off the tokens. Text
in strings, templates, comments and regular expressions can't become an import.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.paths import extension
from lattiq.schemas import PARSED
from lattiq.sources.statements import first_error

WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|#[\w$]+")
NUMBER = re.compile(r"\.?\d(?:[\w.]|(?<=[eE])[+-])*")
SPACE = re.compile(r"\s+")
#: What most of a source consists of, where one character or the next says what it is: words, space, signs, strings without
#: escapes, brackets, comments. All else, and all of these that do not end, is left to the steps of ``tokens_of``.
COMMON = re.compile(r"""[ \t\r\n]*(?:([A-Za-z_$][\w$\u0080-\U0010ffff]*)|([;,:=*+<>!?&|^%@~-]|\.(?!\d))|("[^"\\\n]*"|'[^'\\\n]*')|([(\[{])|([)\]}])|(//[^\n]*)|(/\*(?s:.*?)\*/))""")
KINDS = (None, "word", "punct", "string")
#: After these words a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
MARKERS = ("client-only", "server-only")


class ParseError(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


@dataclass(slots=True)
class Token:
    kind: str  # word, punct, string, template, number, regex
    text: str
    at: int
    plain: bool = True  # a template without substitution
    depth: int = 0


def tokens_of(source: str) -> tuple[list[Token], list[tuple[int, str]]]:
    """Tokens and comments; an unclosed literal or bracket is an error at its start."""
    out: list[Token] = []
    comments: list[tuple[int, str]] = []
    opened: list[tuple[str, int]] = []
    templates: list[tuple[int, int]] = []  # depth of brackets and start of templates whose substitution is open
    i, n = 0, len(source)
    if source.startswith("#!"):
        i = source.find("\n") if "\n" in source else n
    common = COMMON.match
    while i < n:
        if m := common(source, i):
            kind = m.lastindex
            text, at = m.group(kind), m.start(kind)
            if kind <= 3:
                out.append(Token(KINDS[kind], text, at, True, len(opened)))
                i = m.end()
                continue
            if kind == 4:
                out.append(Token("punct", text, at, True, len(opened)))
                opened.append((text, at))
                i = m.end()
                continue
            if kind == 5 and not templates and opened and PAIRS[opened[-1][0]] == text:
                opened.pop()
                out.append(Token("punct", text, at, True, len(opened)))
                i = m.end()
                continue
            if kind > 5:
                comments.append((at, text.rstrip("\r") if kind == 6 else text))
                i = m.end()
                continue
        c = source[i]
        if c.isspace() or c == "﻿":
            m = SPACE.match(source, i)
            i = m.end() if m else i + 1
        elif source.startswith("//", i):
            end = source.find("\n", i)
            end = n if end < 0 else end
            comments.append((i, source[i:end].rstrip("\r")))
            i = end
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            if end < 0:
                raise ParseError(i, "unterminated comment")
            comments.append((i, source[i : end + 2]))
            i = end + 2
        elif c in "\"'":
            j = i + 1
            while j < n and source[j] != c:
                if source[j] == "\n" and not _in_markup(out):
                    raise ParseError(i, "unterminated string")
                j += 2 if source[j] == "\\" else 1
            if j >= n:
                if _in_markup(out):  # an apostrophe in markup text
                    i += 1
                    continue
                raise ParseError(i, "unterminated string")
            out.append(Token("string", source[i : j + 1], i, depth=len(opened)))
            i = j + 1
        elif c == "`" or (c == "}" and templates and templates[-1][0] == len(opened)):
            first = c == "`"
            start = i if first else templates.pop()[1]
            j = i + 1
            while j < n and source[j] != "`" and not source.startswith("${", j):
                j += 2 if source[j] == "\\" else 1
            if j >= n:
                raise ParseError(start, "unterminated template")
            if source[j] == "`":
                out.append(Token("template", source[i : j + 1], i, first, len(opened)))
                i = j + 1
            else:
                templates.append((len(opened), start))
                out.append(Token("template", source[i:j], i, False, len(opened)))
                i = j + 2
        elif c == "/" and _regex_may_start(out):
            end = _regex_end(source, i)
            if end < 0:
                out.append(Token("punct", c, i, depth=len(opened)))
                i += 1
            else:
                out.append(Token("regex", source[i:end], i, depth=len(opened)))
                i = end
        elif m := WORD.match(source, i):
            out.append(Token("word", m.group(), i, depth=len(opened)))
            i = m.end()
        elif m := NUMBER.match(source, i):
            out.append(Token("number", m.group(), i, depth=len(opened)))
            i = m.end()
        else:
            if c in PAIRS:
                out.append(Token("punct", c, i, depth=len(opened)))
                opened.append((c, i))
            elif c in ")]}":
                if not opened or PAIRS[opened[-1][0]] != c:
                    raise ParseError(i, f"unexpected `{c}`")
                opened.pop()
                out.append(Token("punct", c, i, depth=len(opened)))
            else:
                out.append(Token("punct", c, i, depth=len(opened)))
            i += 1
    if templates:
        raise ParseError(templates[-1][1], "unterminated template")
    if opened:
        raise ParseError(opened[-1][1], f"unclosed `{opened[-1][0]}`")
    return out, comments


def _in_markup(out: list[Token]) -> bool:
    """Whether the last tokens look like text after a tag."""
    for t in reversed(out[-40:]):
        if t.text == ">":
            return True
        if t.text in (";", "=", "(", "{"):
            return False
    return False


def _regex_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    t = out[-1]
    if t.kind == "word":
        return t.text in BEFORE_REGEX
    return t.kind == "punct" and t.text not in ")]}" and not (t.text == "<")


def _regex_end(source: str, i: int) -> int:
    j, in_class = i + 1, False
    while j < len(source) and source[j] != "\n":
        c = source[j]
        if c == "\\":
            j += 1
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "/" and not in_class:
            j += 1
            while j < len(source) and source[j].isalpha():
                j += 1
            return j
        j += 1
    return -1


def cooked(raw: str) -> str | None:
    """The value of a quoted literal; None for a legacy octal or broken escape."""
    body, out, i = raw[1:-1], [], 0
    if "\\" not in body and body.isascii():
        return body
    while i < len(body):
        c = body[i]
        if c != "\\":
            out.append(c)
            i += 1
            continue
        i += 1
        if i >= len(body):
            return None
        c = body[i]
        if c == "\r" and body[i + 1 : i + 2] == "\n":
            i += 2
        elif c in "\n\r  ":
            i += 1
        elif c == "x":
            if not re.fullmatch("[0-9a-fA-F]{2}", digits := body[i + 1 : i + 3]):
                return None
            out.append(chr(int(digits, 16)))
            i += 3
        elif c == "u":
            m = re.compile(r"u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))").match(body, i)
            if not m or int(m.group(1) or m.group(2), 16) > 0x10FFFF:
                return None
            out.append(chr(int(m.group(1) or m.group(2), 16)))
            i = m.end()
        elif c in "01234567":
            if c != "0" or body[i + 1 : i + 2].isdigit():
                return None
            out.append("\0")
            i += 1
        else:
            out.append(ESCAPES.get(c, c))
            i += 1
    text = "".join(out)
    try:  # halves of a pair join, a half alone has no text
        return text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return None


def literal(t: Token | None) -> str | None:
    if t is None or (t.kind == "template" and not (t.plain and t.text.endswith("`"))):
        return None
    return cooked(t.text) if t.kind in ("string", "template") else None


END = Token("end", "", -1)
#: Words that a statement of interest begins with.
STARTS = frozenset("import export require new".split())


class Reader:
    """Statements read off the tokens of one source."""

    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.found: list[tuple[int, str, str]] = []  # place, specifier, kind
        self.runtime: str | None = None

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else END

    def add(self, t: Token, kind: str) -> None:
        value = literal(t)
        if value is not None:
            self.found.append((t.at + 1, value, kind))

    def closing(self, i: int) -> int:
        """The place of the bracket that closes the one at ``i``."""
        depth = self.at(i).depth
        j = i + 1
        while j < len(self.tokens) and not (self.tokens[j].depth == depth and self.tokens[j].text in ")]}"):
            j += 1
        return j

    def arguments(self, i: int) -> list[list[Token]]:
        """Tokens of each argument of the call whose bracket is at ``i``."""
        parts: list[list[Token]] = [[]]
        for t in self.tokens[i + 1 : self.closing(i)]:
            if t.text == "," and t.kind == "punct" and t.depth == self.at(i).depth + 1:
                parts.append([])
            else:
                parts[-1].append(t)
        return [p for p in parts if p]

    def read(self) -> None:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind != "word" or t.text not in STARTS:
                i += 1
                continue
            before = self.at(i - 1).text
            if before == ".":
                i += 1
            elif t.text == "import":
                i = self.imported(i)
            elif t.text == "export" and before != ".":
                i = self.exported(i)
            elif t.text == "require" and before != "function":
                i = self.required(i)
            elif t.text == "new" and self.at(i + 1).text == "URL" and self.at(i + 2).text == "(":
                args = self.arguments(i + 2)
                if len(args) == 2 and len(args[0]) == 1 and "".join(x.text for x in args[1]) == "import.meta.url":
                    self.add(args[0][0], "Static")
                i += 1
            else:
                i += 1

    def imported(self, i: int) -> int:
        nxt = self.at(i + 1)
        if nxt.text == "(" and nxt.kind == "punct":
            args = self.arguments(i + 1)
            if args and len(args[0]) == 1:
                self.add(args[0][0], "Dynamic")
            return i + 1
        if nxt.text == ".":
            return i + 1
        if nxt.kind == "string":
            self.add(nxt, "Static")
            return i + 2
        j = i + 1
        kind = "TypeOnly" if nxt.text == "type" and self.at(i + 2).text not in ("from", ",", "=") or (nxt.text == "type" and self.at(i + 2).text == "from" and self.at(i + 3).text == "from") else None
        names: list[Token] = []
        while j < len(self.tokens) and j - i < 5000:
            t = self.tokens[j]
            if t.text == "=" and t.kind == "punct":
                if self.at(j + 1).text == "require" and self.at(j + 2).text == "(" and self.at(j + 3).kind == "string":
                    self.add(self.at(j + 3), "Require")
                    return j + 4
                return j + 1
            if t.text == "from" and self.at(j + 1).kind == "string" and t.depth == self.at(i).depth:
                self.add(self.at(j + 1), kind or named_kind(names, "Static"))
                return j + 2
            if t.text == ";" or (t.kind == "word" and t.text == "import"):
                return j
            names.append(t)
            j += 1
        return j

    def exported(self, i: int) -> int:
        nxt = self.at(i + 1)
        typed = nxt.text == "type" and self.at(i + 2).text in ("{", "*")
        j = i + 2 if typed else i + 1
        head = self.at(j)
        if head.text == "*":
            while j < len(self.tokens) and self.at(j).text not in (";",) and self.at(j).kind != "string":
                j += 1
            if self.at(j).kind == "string" and self.at(j - 1).text == "from":
                self.add(self.at(j), "TypeOnly" if typed else "ReExport")
                return j + 1
            return j
        if head.text == "{":
            end = self.closing(j)
            if self.at(end + 1).text == "from" and self.at(end + 2).kind == "string":
                self.add(self.at(end + 2), "TypeOnly" if typed else named_kind(self.tokens[j : end + 1], "ReExport"))
                return end + 3
            return end + 1
        if head.text in ("const", "let", "var") and self.at(i).depth == 0 and self.runtime is None:
            k = j + 2
            if self.at(j + 1).text == "runtime":
                while self.at(k).text not in ("=", ";", "") and k < j + 30:
                    k += 1
                value = literal(self.at(k + 1)) if self.at(k).text == "=" and self.at(k + 1).kind == "string" else None
                # a value that goes on, such as a call or a cast, is no literal
                if value in ("edge", "nodejs") and (self.at(k + 2).text in (";", "", "export", "import", ",") or self.at(k + 2).kind == "word"):
                    self.runtime = None if self.at(k + 2).text == "as" else value
        return i + 1

    def required(self, i: int) -> int:
        if self.at(i - 1).text == ".":
            return i + 1
        j = i + 1
        if self.at(j).text == "." and self.at(j + 1).text == "resolve":
            j += 2
        if self.at(j).text == "(" and self.at(j).kind == "punct":
            args = self.arguments(j)
            if len(args) == 1 and len(args[0]) == 1:
                self.add(args[0][0], "Require")
        return i + 1


def named_kind(names: list[Token], usual: str) -> str:
    """TypeOnly if there are only named specifiers and each is marked as a type."""
    if not names or names[0].text != "{":
        return usual
    specs, part = [], []
    for t in names[1:]:
        if t.text in (",", "}"):
            if part:
                specs.append(part)
            part = []
        else:
            part.append(t)
    typed = lambda p: p[0].text == "type" and (len(p) == 2 or (len(p) == 4 and p[2].text == "as") or (len(p) == 3 and p[1].text != "as"))
    return "TypeOnly" if specs and all(map(typed, specs)) else usual


def parse(path: str, source: str | None) -> dict:
    """The row of a source: imports in order, directives, runtime, markers, comments, error."""
    row = {"path": path, "imports": [], "directives": [], "exported_runtime": None, "marker_imports": [], "comments": [], "error": None}
    if source is None:
        row["error"] = {"line": 1, "column": 1, "message": "source cannot be read"}
        return row
    starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def place(at: int) -> dict:
        line = bisect_right(starts, at)
        return {"line": line, "column": at - starts[line - 1] + 1}

    try:
        tokens, comments = tokens_of(source)
    except ParseError as e:
        row["error"] = place(e.at) | {"message": f"syntax error: {e.message}"}
        return row
    if wrong := first_error(tokens, source, path.rsplit(".", 1)[-1], _in_markup):
        row["error"] = place(wrong[0]) | {"message": f"syntax error: {wrong[1]}"}
        return row
    reader = Reader(tokens)
    reader.read()
    seen = set()
    for at, specifier, kind in sorted(reader.found, key=lambda f: (f[0], f[1])):
        where = place(at)
        key = (specifier, where["line"], where["column"], kind)
        if key not in seen:
            seen.add(key)
            row["imports"].append({"specifier": specifier, "kind": kind, "location": {"file": path} | where})
    row["directives"] = list(directives(tokens, source))
    row["exported_runtime"] = reader.runtime
    row["marker_imports"] = sorted({i["specifier"] for i in row["imports"]} & set(MARKERS))
    for at, text in comments:
        where = place(at)
        row["comments"].append({"text": text} | where | {"standalone": not source[starts[where["line"] - 1] : at].strip()})
    return row


def directives(tokens: list[Token], source: str) -> Iterator[str]:
    """Leading statements that are a string alone."""
    i = 0
    while i < len(tokens) and tokens[i].kind == "string":
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        ends = after is None or after.text in (";", "}") or ("\n" in source[tokens[i].at + len(tokens[i].text) : after.at] and (after.kind in ("word", "string") or after.text == "{"))
        value = cooked(tokens[i].text)
        if not ends or value is None:
            return
        yield value
        i += 2 if after is not None and after.text == ";" else 1


PLACE = [("line", pa.int32()), ("column", pa.int32())]
IMPORT = pa.struct([("specifier", pa.string()), ("kind", pa.string()), ("location", pa.struct([("file", pa.string()), *PLACE]))])
#: PARSED as Arrow has it.
ARROW = pa.schema([
    ("path", pa.string()), ("imports", pa.list_(IMPORT)), ("directives", pa.list_(pa.string())), ("exported_runtime", pa.string()), ("marker_imports", pa.list_(pa.string())),
    ("comments", pa.list_(pa.struct([("text", pa.string()), *PLACE, ("standalone", pa.bool_())]))), ("error", pa.struct([*PLACE, ("message", pa.string())])),
])

#: Parsers of other languages by extension: from (path, source) to PARSED rows. They come before this module's own.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED rows of (path, source), each by its extension's parser; the sources themselves are dropped here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p, s) for p, s in zip(*(batch.column(c).to_pylist() for c in ("path", "source")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)

    of, own = extension(F.col("path")), files.select("path", "source")
    out = own.where(~of.isin(*PARSERS)) if PARSERS else own
    out = out.mapInArrow(run, PARSED)
    for ext, parser in PARSERS.items():
        out = out.unionByName(parser(own.where(of == ext)).select(out.columns))
    return out
