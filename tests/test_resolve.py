import json
import posixpath
import re

import pytest

from lattiq.config import from_dict
from lattiq.functions.globs import match
from lattiq.operators.resolve import Request, bases, candidate_paths, exported, package_name, plan, resolve, tables, trace
from lattiq.schemas import LOCATION, MANIFESTS, TSCONFIGS


def request(specifier, kind="Static", mode="nodenext", importer="src/a.ts", esm=False, **kw):
    return Request(importer, specifier, kind, mode, esm, **kw)


PACKAGE = {"root": "packages/ui", "manifest": {"name": "@s/ui", "exports": {".": {"types": "./src/index.d.ts", "import": "./src/index.ts", "require": "./src/index.cts"}, "./x/*": "./src/x/*.ts", "./x/deep/*": "./src/deep/*.ts", "./no": None}, "imports": {"#in": "./src/in.ts", "#out": "lodash"}}}


@pytest.mark.parametrize(
    ("specifier", "outcome", "value"),
    [("fs", "builtin", "node:fs"), ("node:fs/promises", "builtin", "node:fs/promises"), ("node:test", "builtin", "node:test"), ("test", "external", "test"), ("/abs", "invalid", None), ("lodash/fp", "external", "lodash"), ("@a/b/c", "external", "@a/b")],
)
def test_outcomes(specifier, outcome, value):
    p = plan(request(specifier))
    assert p.outcome == outcome
    assert value is None or p.value == value


def test_relative_candidates():
    assert plan(request("./b.js")).paths[:5] == ["src/b.js", "src/b.ts", "src/b.tsx", "src/b.js", "src/b.jsx"]
    assert plan(request("./b")).paths[:3] == ["src/b", "src/b.ts", "src/b.tsx"]
    assert "src/b/index.ts" in plan(request("./b")).paths
    assert plan(request("./b", esm=True)).paths == []  # a module asks for the extension
    assert plan(request("./b.js", esm=True)).paths == ["src/b.ts", "src/b.tsx", "src/b.js", "src/b.jsx"]
    assert plan(request("./b", mode="bundler", esm=True)).paths[1] == "src/b.ts"


def test_exports():
    active = {"default", "import"}
    e = {k: v for k, v in PACKAGE["manifest"]["exports"].items()}
    assert exported(e, ".", active) == "./src/index.ts"
    assert exported(e, ".", {"require"}) == "./src/index.cts"
    assert exported(e, "./x/a", active) == "./src/x/a.ts"
    assert exported(e, "./x/deep/b", active) == "./src/deep/b.ts"
    assert exported(e, "./no", active) is None
    assert exported(e, "./zz", active) is False
    assert exported({".": ["x", None]}, ".", active) == "x"


def test_workspace():
    p = plan(request("@s/ui", esm=True, package=PACKAGE))
    assert (p.paths[0], p.outcome) == ("packages/ui/src/index.ts", "unresolved")
    assert plan(request("@s/ui/no", package=PACKAGE)).paths == []
    old = {"root": "packages/old", "manifest": {"name": "old", "main": "lib/a.js", "types": "t.d.ts"}}
    assert plan(request("old", package=old)).paths[0] == "packages/old/lib/a.js"
    assert plan(request("old", kind="TypeOnly", package=old)).paths[0] == "packages/old/t.d.ts"
    assert plan(request("old/sub", package=old)).paths[0] == "packages/old/sub"
    assert plan(request("bare", package={"root": "p", "manifest": {"name": "bare"}})).paths[0] == "p/src/index"


def test_redirects_and_trace():
    own = PACKAGE
    assert plan(request("#out", own=own)).value == "lodash"
    assert trace(request("#out", own=own), set())[-1] == ("lodash", "external-package", "external:lodash")
    assert trace(request("#in", own=own), {"packages/ui/src/in.ts"})[-1][2] == "module:packages/ui/src/in.ts"
    loop = {"root": "p", "manifest": {"imports": {"#a": "#b", "#b": "#a"}}}
    assert trace(request("#a", own=loop), set())[-1][2].startswith("invalid")


def test_alias():
    alias = {"base_url": "", "resolve_bare": True, "aliases": [{"pattern": "@/*", "targets": ["src/*"]}]}
    assert plan(request("@/x", alias=alias)).paths[1] == "src/x.ts"
    p = plan(request("lib/x", alias=alias))
    assert (p.paths[0], p.outcome) == ("lib/x", "external")
    assert "src/x.ts" in candidate_paths(request("@/x", alias=alias))


def brute(row, files, manifests, tsconfigs, scopes, config):
    """One import by ``plan``, redirect by redirect."""
    importer, specifier, kind = row
    mode, conditions, virtual = (config["resolution"][k] for k in ("mode", "custom_conditions", "virtual_modules"))
    folder = posixpath.dirname(importer)
    above = lambda table: max((r for r in table if r[0] == "" or folder == r[0] or folder.startswith(r[0] + "/")), key=lambda r: (r[0] != "", r[0].count("/")), default=None)
    scope, ts, own = above(scopes), above(tsconfigs), above(manifests)
    ext = importer.rsplit(".", 1)[-1]
    esm = ext in ("mjs", "mts") or (ext not in ("cjs", "cts") and scope is not None and scope[1] == "module")
    alias = {"base_url": ts[1], "resolve_bare": ts[2], "aliases": [{"pattern": p, "targets": t} for p, t in ts[3]]} if ts else None
    opened = lambda m: {"root": m[0], "manifest": json.loads(m[2])} if m else None

    def request(s):
        named = next((m for m in manifests if m[1] == package_name(s)), None)
        return Request(importer, s, kind, mode, esm, tuple(conditions), tuple(virtual), alias, opened(named), opened(own))

    candidates, seen, s = candidate_paths(request(specifier)), set(), specifier
    while True:
        if s in seen:
            return "invalid", f"package resolution redirect loop at `{s}`", "none", candidates
        seen.add(s)
        p = plan(request(s))
        hit = next(((h, x) for h, x in zip(p.handlers, p.paths) if x in files), None)
        if hit:
            return "module", hit[1], hit[0], candidates
        if p.outcome != "redirect":
            if p.outcome == "unresolved" and virtual and match(specifier, virtual, True):
                return "external", f"virtual:{specifier}", "virtual-module", candidates
            return p.outcome, p.value, p.final, candidates
        s = p.value


def compare(spark, imports, files, manifests, tsconfigs, scopes, config):
    frame = spark.createDataFrame([(i, s, k, None, n) for n, (i, s, k) in enumerate(imports)], f"module_id string, specifier string, kind string, location {LOCATION}, ord long").repartition(3)
    given = [spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(manifests, MANIFESTS), spark.createDataFrame(tsconfigs, TSCONFIGS), spark.createDataFrame(scopes, "directory string, type string")]
    got = {r.ord: (r.outcome, r.value, r.handler, r.candidates) for r in resolve(frame, *given, config).collect()}
    assert len(got) == len(imports)
    for n, row in enumerate(imports):
        assert got[n] == brute(row, set(files), manifests, tsconfigs, scopes, config), row


MANIFEST_ROWS = [
    ("", "root", json.dumps({"name": "root", "imports": {"#r": "./lib/r.js", "#up": "../out", "#fs": "node:fs", "#ui": "@s/ui/x/a", "#p/*": "#q/*", "#q/*": "./lib/*.ts", "#q/deep/*": "lodash/*", "#no": None, "#rel": ".hidden"}})),
    ("packages/ui", "@s/ui", json.dumps(PACKAGE["manifest"] | {"type": "module"})),
    ("packages/old", "old", json.dumps({"name": "old", "main": "lib/a.js", "module": "../bad", "types": "t.d.ts"})),
    ("packages/old/inner", "inner", json.dumps({"name": "inner", "exports": [{"node": "./n.js", "browser": "./b.js"}, "./d.js"], "imports": {"#x": {"custom": "./c.js", "types": "./t.d.ts", "default": "#y"}, "#y": "#z", "#z": "old/sub"}})),
    ("packages/leak", "leak", json.dumps({"name": "leak", "exports": {"./*": "./../*", "./a/*/b": "./s/*/t/*.js"}})),
]
TS_ROWS = [("", "", False, [("@/*", ["src/*", "lib/*.js"]), ("exact", ["src/exact.ts"]), ("#al*", ["src/*"]), ("none/*", []), ("a*a", ["src/*"])]), ("packages/ui", "packages/ui/src", True, [("~*~", ["/abs/*"])])]
FILES = ["src/a.ts", "src/b.ts", "src/b/index.ts", "src/exact.ts", "lib/r.ts", "lib/a.js.js", "lib/deep.ts", "lib/z.ts", "packages/ui/src/index.ts", "packages/ui/src/index.cts", "packages/ui/src/x/a.ts", "packages/ui/src/lib.mts", "packages/ui/src/c.css", "packages/old/lib/a.ts", "packages/old/t.d.ts", "packages/old/sub/index.js", "packages/old/inner/n.js", "packages/old/inner/c.js", "packages/leak/s/q/t/q.js", ".hidden.ts", "out.ts", "index.ts"]
NAMES = "fs node:fs node:test test /abs ./b ./b.js ../lib/r.js . .. ./ ../../../x ./c.css ./.env ./x.mjs ./b.cjs @/a @/ @/zz exact exact/ #ala #al none/x aa a-a aXa ~q~ lib c.css lodash lodash/fp @a/b/c @s/ui @s/ui/ @s/ui/x/a @s/ui/x/deep/b @s/ui/no @s/ui/zz old old/sub old/../x inner inner/x leak/q leak/a/q/b #r #up #fs #ui #p/z #p/deep/x #q/deep #no #rel #x #y #in #out # #zz root root/lib/r".split()
IMPORTERS = ["src/a.ts", "lib/m.mjs", "main.cts", "packages/ui/src/lib.mts", "packages/ui/src/deep/k.ts", "packages/old/q.ts", "packages/old/inner/w.js", "packages/leak/l.js"]


@pytest.mark.parametrize(("mode", "more"), [("nodenext", {}), ("node16", {"custom_conditions": ["custom", "browser"]}), ("bundler", {"virtual_modules": ["@/zz", "#z*", "./x*"]}), ("node10", {})])
def test_bulk_equals_one_by_one(spark, mode, more):
    config = from_dict({"version": 1, "resolution": {"mode": mode, **more}})
    imports = [(i, s, k) for i in IMPORTERS for s in NAMES for k in ("Static", "Dynamic", "Require", "TypeOnly")]
    compare(spark, imports, FILES, MANIFEST_ROWS, TS_ROWS, [("", None), ("packages/ui", "module"), ("packages/old", "commonjs")], config)


def test_redirects_of_any_length(spark):
    chain = {f"#c{k}": f"#c{k + 1}" for k in range(50)} | {"#c50": "./end.ts"}
    loops = {"#a0": "#a1", "#a1": "#a0"} | {f"#n{k}": f"#n{(k + 1) % 9}" for k in range(9)} | {"#t0": "#t1", "#t1": "#t2", "#t2": "#n4", "#self": "#self", "#g/*": "#h/*", "#h/*": "#g/*", "#grow/*": "#grow/*x"}
    manifests = [("", "root", json.dumps({"name": "root", "imports": chain | loops})), ("p", "p", json.dumps({"name": "p", "imports": {"#a0": "#a1", "#a1": "lodash"}}))]
    names = ["#c0", "#c40", "#c50", "#a0", "#a1", *[f"#n{k}" for k in range(9)], "#t0", "#t2", "#self", "#g/q"]
    compare(spark, [(i, s, "Static") for i in ("a.ts", "p/b.ts") for s in names], ["end.ts"], manifests, [], [], from_dict({"version": 1}))


def test_names_that_grow_for_ever_end(spark):
    manifest = [("", "root", json.dumps({"name": "root", "imports": {"#g/*": "#g/*" + "x" * 2000}}))]
    frame = spark.createDataFrame([("a.ts", "#g/q", "Static", None, 0)], f"module_id string, specifier string, kind string, location {LOCATION}, ord long")
    rows = resolve(frame, spark.createDataFrame([("a.ts",)], "path string"), spark.createDataFrame(manifest, MANIFESTS), spark.createDataFrame([], TSCONFIGS), spark.createDataFrame([], "directory string, type string"), from_dict({"version": 1})).collect()
    assert [r.outcome for r in rows] == ["unresolved"]


def test_no_python_for_relative_and_builtin_imports(spark):
    names = spark.createDataFrame([(0, "src", "", "", "", False, False, "./b"), (1, "", "/", "", "import", False, False, "fs")], "id long, folder string, settings string, own string, syntax string, typed boolean, strict boolean, name string")
    none = [spark.createDataFrame([], s) for s in (MANIFESTS, TSCONFIGS)]
    plans = bases(names.where("name like '.%'"), tables(*none, from_dict({"version": 1})), "nodenext")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plans)
