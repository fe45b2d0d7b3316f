"""The grammar of import and export declarations, and of operands, over a source's tokens.

A descent over each declaration at the top of a module tells the first token that
does not fit. What may be markup is left alone: its text reads like anything.
"""

from __future__ import annotations

from typing import Protocol

#: What may come after ``export`` beside braces and a star (fixed values).
EXPORTED = frozenset("default const let var function class async abstract interface type enum declare namespace module global import as using await = @".split())
#: Words that go on with an expression or a declaration after a literal on its line (fixed values).
GO_ON = frozenset("in instanceof as satisfies of with assert extends is".split())
#: Sources without markup by extension, where operands are checked too.
PLAIN = ("ts", "mts", "cts")


class Token(Protocol):
    kind: str
    text: str
    at: int
    depth: int


class Unexpected(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Declarations:
    def __init__(self, tokens: list[Token], source: str):
        self.tokens, self.source, self.i = tokens, source, 0

    @property
    def now(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def is_(self, *texts: str) -> bool:
        now = self.now
        return now is not None and now.text in texts and now.kind in ("word", "punct")

    def fail(self, expected: str) -> None:
        at = len(self.source) if self.now is None else self.now.at
        raise Unexpected(at, f"expected {expected}" if self.now is None else f"expected {expected}, found `{self.now.text[:40]}`")

    def take(self, *texts: str) -> None:
        if not self.is_(*texts):
            self.fail(" or ".join(f"`{t}`" for t in texts))
        self.i += 1

    def kind(self, *kinds: str, expected: str) -> None:
        if self.now is None or self.now.kind not in kinds:
            self.fail(expected)
        self.i += 1

    def new_line(self) -> bool:
        """Whether a line ends between the token before and this one."""
        before = self.tokens[self.i - 1]
        return self.now is None or "\n" in self.source[before.at + len(before.text) : self.now.at]

    def source_of(self) -> None:
        self.kind("string", "template", expected="a module's name")
        if self.is_("with", "assert") and not self.new_line():
            self.i += 1
            self.skip_braces()

    def skip_braces(self) -> None:
        depth = self.now.depth if self.now else 0
        self.take("{")
        while self.now is not None and not (self.now.text == "}" and self.now.depth == depth):
            self.i += 1
        self.take("}")

    def end(self) -> None:
        if self.is_(";"):
            self.i += 1
        elif not self.new_line() and not self.is_("}"):
            self.fail("`;`")

    def names(self) -> None:
        """{ a, b as c, type d, "e" as f }: one or more specifiers, or none."""
        self.take("{")
        while not self.is_("}"):
            words = []
            while self.now is not None and self.now.kind in ("word", "string"):
                words.append(self.now.text)
                self.i += 1
            fits = len(words) == 1 or (len(words) == 2 and words[0] == "type") or (len(words) == 3 and words[1] == "as") or (len(words) == 4 and words[0] == "type" and words[2] == "as")
            if not fits:
                self.fail("a name")
            if not self.is_("}"):
                self.take(",")
        self.take("}")

    def import_(self) -> None:
        self.take("import")
        if self.is_("(", "."):
            return
        if self.now is not None and self.now.kind in ("string", "template"):
            self.source_of()
            return self.end()
        for word in ("type", "defer", "source"):
            # a binding may have such a word's name
            after = self.tokens[self.i + 1].text if self.i + 1 < len(self.tokens) else ""
            twice = after == "from" and self.i + 2 < len(self.tokens) and self.tokens[self.i + 2].text == "from"
            if self.is_(word) and (after not in ("from", ",", "=", "") or twice):
                self.i += 1
                break
        if self.now is not None and self.now.kind == "word":
            self.i += 1
            if self.is_("="):
                return None
            if self.is_(","):
                self.i += 1
                self.star_or_names()
        else:
            self.star_or_names()
        self.take("from")
        self.source_of()
        return self.end()

    def star_or_names(self) -> None:
        if self.is_("*"):
            self.i += 1
            self.take("as")
            self.kind("word", expected="a name")
        else:
            self.names()

    def export_(self) -> None:
        self.take("export")
        if self.is_("type") and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1].text in ("{", "*"):
            self.i += 1
        if self.is_("*"):
            self.i += 1
            if self.is_("as"):
                self.i += 1
                self.kind("word", "string", expected="a name")
            self.take("from")
            self.source_of()
            return self.end()
        if self.is_("{"):
            self.names()
            if self.is_("from"):
                self.i += 1
                self.source_of()
            return self.end()
        if not self.is_(*EXPORTED):
            self.fail("a declaration")
        return None


def first_error(tokens: list[Token], source: str, extension: str, in_markup) -> tuple[int, str] | None:
    """Where the first declaration or operand that no grammar has is, and what was expected; ``in_markup`` tells of tokens whether text of a tag may follow them."""
    own = Declarations(tokens, source)
    plain, last = extension in PLAIN, None
    for k, t in enumerate(tokens):
        before, last = last, t
        if plain and before is not None and before.depth == t.depth:
            if before.kind == "punct":
                if t.text == ";" and t.kind == "punct" and before.text == "=":
                    return t.at, "expected an expression, found `;`"
            elif before.kind in ("number", "string"):
                literal = t.kind in ("number", "string") or (t.kind == "word" and t.text not in GO_ON)
                if literal and "\n" not in source[before.at + len(before.text) : t.at] and before.at + len(before.text) < t.at:
                    return t.at, f"expected `;`, found `{t.text[:40]}`"
        if t.kind != "word" or t.depth or t.text not in ("import", "export"):
            continue
        starts = before is None or before.text in (";", "}") or "\n" in source[before.at + len(before.text) : t.at]
        if not starts or (before is not None and before.text in (".", "@", "=", ":", "?", "=>")) or in_markup(tokens[max(0, k - 40) : k]):
            continue
        own.i = k
        try:
            own.import_() if t.text == "import" else own.export_()
        except Unexpected as e:
            return e.at, e.message
    return None
