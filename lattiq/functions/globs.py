"""Globs as anchored regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a meaning of their own in a regular expression.
SPECIAL = frozenset(r"\.+()|^$[]{}*?")


@lru_cache(4096)
def regex_of(glob: str, crossing: bool = False) -> str:
    """``*`` and ``?`` stop at slashes unless ``crossing``; ``**`` between slashes is any
    number of folders; ``{a,b}`` are alternatives; ``[a-z]`` and ``[!a-z]`` are classes."""
    any_of, one = (".*", ".") if crossing else ("[^/]*", "[^/]")
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            starts = i == 0 or glob[i - 1] in "/{,"
            if j - i == 2 and starts and j < len(glob) and glob[j] == "/":
                out.append("(?:.*/)?")
                i = j + 1
                continue
            if j - i == 2 and starts and (j == len(glob) or glob[j] in "},"):
                out.append(".*" if i == 0 else ".+")
            else:
                out.append(any_of)
            i = j
            continue
        if c == "?":
            out.append(one)
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            inner = "".join("\\" + x if x in "\\[]^&" else x for x in body)
            out.append(f"[^/{inner}]" if negated and not crossing else f"[{'^' * negated}{inner}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(quote(glob[i]))
        else:
            out.append(quote(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob `{glob}`")
    return "^(?:" + "".join(out) + ")$"


def quote(c: str) -> str:
    return "\\" + c if c in SPECIAL else c


def matches(path: Column, globs: Iterable[str], crossing: bool = False) -> Column:
    """Whether any glob matches; all are literals, so each is compiled once."""
    return reduce(lambda a, b: a | b, (F.coalesce(path, F.lit("")).rlike(regex_of(g, crossing)) for g in globs), F.lit(False))


def match(path: str, globs: Iterable[str], crossing: bool = False) -> bool:
    """The same for one path on the driver."""
    return any(re.search(regex_of(g, crossing), path, re.S) for g in globs)
