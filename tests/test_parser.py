import pytest

from lattiq.sources.parser import cooked, parse

SOURCE = r"""'use client'
import type { A } from "a"; import b, { type C } from 'b'; import { type D, type E as F } from "d"; import * as g from `x`;
import "side"; import fs = require("fs"); export * from "re"; export type { Q } from "q"; export { type R } from "r";
export const runtime = "edge";
const x = import("dyn", { with: {} }); const y = require("req"); require("a","b"); require.resolve("rr"); new URL("./w.js", import.meta.url);
const s = "import 'no'"; /* import "no2" */ // import "no3"
const t = `a ${require("in-template")} b`; const r = /import "x"/; foo.require("no4"); export default function z() { return import("deep"); }
import { "a-b" as c2 } from "abc"; const j = <div>it's {require("jsx")}</div>;
import "server-only"; const n = 1 / 2; require(`bad ${n}`);
"""


def test_kinds_and_semantics():
    row = parse("t.tsx", SOURCE)
    assert [(i["specifier"], i["kind"]) for i in row["imports"]] == [
        ("a", "TypeOnly"), ("b", "Static"), ("d", "TypeOnly"), ("side", "Static"), ("fs", "Require"), ("re", "ReExport"), ("q", "TypeOnly"), ("r", "TypeOnly"),
        ("dyn", "Dynamic"), ("req", "Require"), ("rr", "Require"), ("./w.js", "Static"), ("in-template", "Require"), ("deep", "Dynamic"), ("abc", "Static"), ("jsx", "Require"), ("server-only", "Static"),
    ]
    assert (row["error"], row["exported_runtime"], row["directives"], row["marker_imports"]) == (None, "edge", ["use client"], ["server-only"])
    assert [c["standalone"] for c in row["comments"]] == [False, False]


def test_place_counts_characters():
    row = parse("a.ts", 'const é = "日本"; import x from "./b";\n')
    assert row["imports"][0]["location"] == {"file": "a.ts", "line": 1, "column": 32}


@pytest.mark.parametrize("source", ["import { a from 'x'\nfoo(", "const a = `x", "const s = 'a\n'", "/* open", "a)"])
def test_errors(source):
    assert parse("e.ts", source)["error"]["message"].startswith("syntax error")


def test_unreadable_and_empty():
    assert parse("e.ts", None)["error"]["line"] == 1
    assert parse("e.ts", "")["imports"] == []


@pytest.mark.parametrize(("raw", "value"), [(r"'\x41'", "A"), (r"'\u{1F600}'", "😀"), (r"'😀'", "😀"), (r"'\012'", None), (r"'\0'", "\0"), ("'a\\\nb'", "ab"), (r"'\q'", "q"), (r"'\xZZ'", None)])
def test_escapes(raw, value):
    assert cooked(raw) == value


def test_deep_nesting():
    assert parse("d.ts", "(" * 2000 + "require('x')" + ")" * 2000)["imports"][0]["specifier"] == "x"


BAD = [
    ("const x = ;", 1, 11), ("let let = 1 2 3", 1, 13), ("import x from", 1, 14), ("export { a as } from 'q'", 1, 15), ("import { a b } from 'x'", 1, 14), ("import a, from 'x'", 1, 11), ("import * from 'x'", 1, 10),
    ("import { a } form 'x'", 1, 14), ("export * as from 'x'", 1, 18), ("export foo;", 1, 8), ("a;\nimport x from 'y' z", 2, 19), ("export { a, , b }", 1, 13), ("import 'a' 'b'", 1, 12), ("import {a", 1, 8),
]
GOOD = [
    "import x, * as y from 'a'; import x, { default as z, type T, type U as V, 'a b' as w, } from 'b' with { type: 'json' }\nimport {} from 'c'",
    "import type from 'a'; import type, { x } from 'b'\nimport type from from 'c'\nimport type { x } from 'd'\nimport defer * as n from 'e'\nimport type = require('f')",
    "import x = require('a'); import y = A.B.C; export import z = A.B\nimport('x').then(); import.meta.url\nexport = x\nexport as namespace X",
    "export { a, b as c, type d, type e as f, default as 'g h' } from 'x'\nexport { a }\nexport {}\nexport type { T } from 'y'; export type * from 'z'; export * as ns from 'w' assert { type: 'json' }; export type X = 1",
    "export default class {}; export const a = 1, b = 2; export abstract class Q {} export enum E { a = 'x' } export declare const z: 'a' | 'b'\n@dec() export class D {}",
    "const o = { import: 1, export: 2 }; o.import; o.export; class K { import() {} export() {} }\nnamespace N { export { a } }",
    "type A = 'x' extends string ? 1 : 2; const b = 'a' as const; for (const c of 'abc') if ('a' in o) x = 1\n2\nconst t = 1 satisfies number; switch (a) { case 1: case 'x': break }",
    "const e = a\n  ? 'b'\n  : 'c'\nlet f = 'x'\n'use strict'\nconst g = [1, 'a']; const h = `a` + 1",
]


@pytest.mark.parametrize(("source", "line", "column"), BAD)
def test_declarations_that_no_grammar_has(source, line, column):
    error = parse("e.ts", source)["error"]
    assert error is not None and error["message"].startswith("syntax error") and (error["line"], error["column"]) == (line, column)


@pytest.mark.parametrize("source", GOOD)
@pytest.mark.parametrize("path", ["g.ts", "g.js"])
def test_declarations_that_are_right(source, path):
    assert parse(path, source)["error"] is None


def test_markup_reads_like_anything():
    text = "const a = <p>\nimport x from the shop\nexport what = ; 1 2\n</p>;\nimport b from 'b';\n"
    row = parse("m.tsx", text)
    assert row["error"] is None and [i["specifier"] for i in row["imports"]] == ["b"]


def test_common_tokens_agree_with_the_steps(monkeypatch):
    """The expression for most of a source only saves steps: without it tokens, comments and errors are the same."""
    from lattiq.sources import parser

    pieces = ["import", "{", "}", "(", ")", " ", "\n", "\r\n", '"a"', "'b'", '"a\\n"', "`t`", "`a${", "//c", "/*x*/", "/*", "/", "/re/g", ".5", ".", "#p", "<a>", "don't", "\u00a0", "\ufeff", "\u00e9", "=", ";"]
    texts = ["".join(pieces[(k * 7 + j * j * (k % 5 + 1)) % len(pieces)] for j in range(k % 9 + 1)) for k in range(3000)]
    calls = []

    class Never:
        def match(self, *_):
            calls.append(1)

    fast = [parser.parse("a.tsx", t) for t in texts]
    monkeypatch.setattr(parser, "COMMON", Never())
    assert [parser.parse("a.tsx", t) for t in texts] == fast
    assert len(calls) > 3000
