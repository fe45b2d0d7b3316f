"""Module resolution: candidates in order of priority, then the first that is a file.

Equal requests are answered once: imports of one folder and of one way of importing,
or, where the folder does not matter, of one package or set of aliases. Each manifest
is parsed once, into a row for each of its entry points; requests meet entry points and
aliases in equi joins on the exact name or on how a pattern begins. Paths to probe are
column expressions; a file offers the few names it may be asked for by, which Spark joins
with those asked, so no probe is a row, and the lowest priority is taken.
``plan`` says the same of one request, for traces and as the measure in tests.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.config import Config
from lattiq.functions.globs import match, matches
from lattiq.functions.paths import normal, parent
from lattiq.functions.paths import package_name as package_column
from lattiq.operators.classify import module_format, nearest
from lattiq.schemas import LOCATION
from lattiq.storage import shuffled, sized, written

#: Extensions tried on a path without a file, and those that stand for an emitted one (fixed values).
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
MAPPED = {"js": ("ts", "tsx", "js", "jsx"), "mjs": ("mts", "mjs"), "cjs": ("cts", "cjs")}
#: Builtin modules of Node (fixed values): with or without the prefix, and with it only.
BUILTINS = frozenset("_http_agent _http_client _http_common _http_incoming _http_outgoing _http_server _stream_duplex _stream_passthrough _stream_readable _stream_transform _stream_wrap _stream_writable _tls_common _tls_wrap assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs fs/promises http http2 https inspector inspector/promises module net os path path/posix path/win32 perf_hooks process punycode querystring readline readline/promises repl stream stream/consumers stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib".split())
PREFIX_ONLY = frozenset("sea sqlite test test/reporters".split())
UNRESOLVED = "no resolver in the configured chain produced a module"
ABSOLUTE = "absolute module specifiers are outside the project analysis boundary"


@dataclass
class Request:
    importer: str
    specifier: str
    kind: str
    mode: str
    esm: bool
    conditions: tuple[str, ...] = ()
    virtual: tuple[str, ...] = ()
    alias: dict | None = None  # base_url, resolve_bare, aliases of the nearest compiler settings
    package: dict | None = None  # root and json of the package that the specifier names
    own: dict | None = None  # of the package that holds the importer

    @property
    def syntax(self) -> str:
        """import or require, as the mode and the importer's format have it."""
        if self.kind == "Require":
            return "require"
        if self.kind != "Dynamic" and self.mode in ("node16", "nodenext") and not self.esm:
            return "require"
        return "import"

    @property
    def active(self) -> set[str]:
        on = {"default", self.syntax, *self.conditions}
        on |= {"types"} if self.kind == "TypeOnly" else set()
        return on | ({"node"} if self.mode != "bundler" else set())


@dataclass
class Plan:
    """Candidates (handler, path) in order, and the outcome if none is a file."""

    handlers: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    outcome: str = "unresolved"
    value: str = ""
    final: str = "none"  # the handler of the outcome

    def add(self, handler: str, paths: list[str]) -> None:
        self.handlers += [handler] * len(paths)
        self.paths += paths

    def end(self, handler: str, outcome: str, value: str = "") -> Plan:
        self.final, self.outcome, self.value = handler, outcome, value
        return self


def clean(path: str) -> str:
    """Normal form relative to the project; above its root nothing is left to go up to."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def probes(base: str) -> list[str]:
    """Paths that may be meant by one without a known file, in order."""
    base = clean(base)
    stem, ext = os.path.splitext(base)
    mapped = MAPPED.get(ext[1:])
    tries = [f"{stem}.{e}" for e in mapped] if mapped else [f"{base}.{e}" for e in EXTENSIONS]
    return [base, *tries, *(f"{base}/index.{e}" if base else f"index.{e}" for e in EXTENSIONS)]


def possible(base: str) -> list[str]:
    """All paths whose appearance could satisfy an unresolved import."""
    base = clean(base)
    stem, ext = os.path.splitext(base)
    found = [base]
    for e in MAPPED.get(ext[1:], EXTENSIONS):
        found += [f"{stem}.{e}", f"{base}/index.{e}"]
    return found


def package_name(specifier: str) -> str:
    return "/".join(specifier.split("/")[: 2 if specifier.startswith("@") else 1])


def target(value, active: set[str]):
    """A path, a specifier or None (blocked) that a tree of conditions leads to; False if it leads nowhere."""
    if isinstance(value, str) or value is None:
        return value
    if isinstance(value, list):
        blocked = False
        for v in value:
            got = target(v, active)
            if isinstance(got, str):
                return got
            blocked = blocked or got is None
        return None if blocked else False
    if isinstance(value, dict):
        for k, v in value.items():
            if k in active and (got := target(v, active)) is not False:
                return got
    return False


def exported(entries: dict, key: str, active: set[str]):
    """What a map of entry points has for a key; of patterns the longest, then that with the longest beginning."""
    if key in entries:
        return target(entries[key], active)
    best = None
    for pattern, value in sorted(entries.items()):
        if "*" not in pattern:
            continue
        head, tail = pattern.split("*", 1)
        if key.startswith(head) and key.endswith(tail) and len(key) >= len(head) + len(tail):
            size = (len(head) + len(tail), len(head))
            if best is None or size >= best[0]:
                best = size, key[len(head) : len(key) - len(tail)], value
    if best is None:
        return False
    got = target(best[2], active)
    return got.replace("*", best[1]) if isinstance(got, str) else got


def entry_points(manifest: dict) -> dict:
    exports = manifest.get("exports", False)
    if isinstance(exports, dict):
        return {k: v for k, v in exports.items() if k.startswith(".")} if any(k.startswith(".") for k in exports) else {".": exports}
    return {} if exports is False else {".": exports}


def legacy(manifest: dict, kind: str) -> str | None:
    """main, module and types fields: relative paths that stay inside the package."""

    def one(name: str) -> str | None:
        value = manifest.get(name)
        if not isinstance(value, str) or not value.strip() or value.startswith("/"):
            return None
        depth = 0
        for p in value.split("/"):
            depth += -1 if p == ".." else p not in ("", ".")
            if depth < 0:
                return None
        return clean(value)

    runtime, types = one("module") or one("main"), one("types") or one("typings")
    return (types or runtime) if kind == "TypeOnly" else runtime


def inside(root: str, path: str) -> str | None:
    """A path below a package's root, None if it leaves it."""
    depth = 0
    for p in path.split("/"):
        depth += -1 if p == ".." else p not in ("", ".")
        if depth < 0:
            return None
    return posixpath.join(root, path)


def plan(r: Request) -> Plan:
    """Builtin, relative, alias, workspace, external: the first that has an answer."""
    p, s = Plan(), r.specifier
    bare = s.removeprefix("node:")
    if bare in BUILTINS or (s.startswith("node:") and bare in PREFIX_ONLY):
        return p.end("node-builtin", "builtin", f"node:{bare}")
    if s.startswith("/"):
        return p.end("relative", "invalid", ABSOLUTE)
    if s.startswith("."):
        base = clean(posixpath.join(posixpath.dirname(r.importer), s))
        if r.mode in ("node16", "nodenext") and r.esm and r.syntax == "import":
            stem, ext = os.path.splitext(base)  # Node's loader asks for the extension
            p.add("relative", [f"{stem}.{e}" for e in MAPPED.get(ext[1:], ())] if ext[1:] in MAPPED else [base] if ext else [])
        else:
            p.add("relative", probes(base))
        return p.end("relative", "unresolved")
    if r.alias:
        hit = False
        for a in r.alias["aliases"]:
            head, star, tail = a["pattern"].partition("*")
            if s == a["pattern"] if not star else s.startswith(head) and s.endswith(tail) and len(s) >= len(head) + len(tail):
                hit = True
                part = s[len(head) : len(s) - len(tail)] if star else ""
                for t in a["targets"]:
                    p.add("tsconfig-alias", probes(posixpath.join(r.alias["base_url"], t.replace("*", part))))
        if hit:
            return p.end("tsconfig-alias", "unresolved")
        if r.alias["resolve_bare"] and s[:1] != "#":
            p.add("tsconfig-alias", probes(posixpath.join(r.alias["base_url"], s)))
    if s.startswith("#") and r.own:
        if r.mode == "node10":
            return p.end("workspace-package", "unresolved")
        got = exported(r.own["manifest"].get("imports") or {}, s, r.active)
        if isinstance(got, str) and not got.startswith("./"):
            return p.end("workspace-package", "redirect", got)
        return within(p, r.own["root"], got)
    if r.package:
        m, root = r.package["manifest"], r.package["root"]
        sub = s[len(package_name(s)) :].lstrip("/")
        if "exports" in m and r.mode != "node10":
            got = exported(entry_points(m), f"./{sub}" if sub else ".", r.active)
            return within(p, root, got if isinstance(got, str) and got.startswith("./") else False)
        at = (legacy(m, r.kind) or "src/index") if not sub else sub
        p.add("workspace-package", probes(posixpath.join(root, at)))
        return p.end("workspace-package", "unresolved")
    return p.end("external-package", "external", package_name(s))


def within(p: Plan, root: str, got) -> Plan:
    at = inside(root, got) if isinstance(got, str) else None
    if at is not None:
        p.add("workspace-package", probes(at))
    return p.end("workspace-package", "unresolved")


def candidate_paths(r: Request) -> list[str]:
    """Paths that could satisfy a request, sorted, for reports on unresolved imports."""
    found: set[str] = set()
    s = r.specifier
    if s.startswith("."):
        found.update(possible(posixpath.join(posixpath.dirname(r.importer), s)))
    if r.alias and not s.startswith((".", "/")):
        for a in r.alias["aliases"]:
            head, star, tail = a["pattern"].partition("*")
            if s == a["pattern"] if not star else s.startswith(head) and s.endswith(tail) and len(s) >= len(head) + len(tail):
                for t in a["targets"]:
                    found.update(possible(posixpath.join(r.alias["base_url"], t.replace("*", s[len(head) : len(s) - len(tail)] if star else ""))))
        if not found and r.alias["resolve_bare"] and s[:1] != "#":
            found.update(possible(posixpath.join(r.alias["base_url"], s)))
    mine = s.startswith("#") and r.own
    at = r.own if mine else r.package
    if at and not s.startswith((".", "/")) and not (mine and r.mode == "node10"):
        m = at["manifest"]
        sub = s[len(package_name(s)) :].lstrip("/")
        if mine or ("exports" in m and r.mode != "node10"):
            got = exported(m.get("imports") or {}, s, r.active) if mine else exported(entry_points(m), f"./{sub}" if sub else ".", r.active)
            got = got if isinstance(got, str) and got.startswith("./") else False
        else:
            got = "./" + ((legacy(m, r.kind) or "src/index") if not sub else sub)
        if isinstance(got, str) and (not (mine or "exports" in m) or r.mode == "node10" or inside("", got) is not None):
            found.update(possible(posixpath.join(at["root"], got)))
    return sorted(found)


#: What a name's resolution depends on beside its own text: the importer's folder (of relative and # names), the folders of
#: compiler settings and of its own package ("/" before them, empty if there is none), and how it is imported.
CONTEXT = ("folder", "settings", "own", "syntax", "typed", "strict")
#: Names longer than this are not followed: a pattern that leads to an ever longer name has no end.
LONGEST_NAME = 4096
ENTRIES = "root string, map string, syntax string, typed boolean, head string, tail string, star boolean, leads string, value string"
PACKAGES = "root string, name string, has_exports boolean, runtime_entry string, types_entry string"


def opened(manifests: DataFrame, conditions: tuple[str, ...], mode: str) -> tuple[DataFrame, DataFrame]:
    """(entries, packages): each manifest parsed once. An entry point of ``exports`` or ``imports`` has a row
    for each way of importing, with where its conditions lead: to a path, another name, nothing."""

    def leads(got, kind: str) -> tuple[str, str]:
        if not isinstance(got, str):
            return "none", ""
        return ("path", got) if got.startswith("./") else ("name" if kind == "imports" else "none", got)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f.itertuples(index=False):
                manifest = json.loads(t.json)
                for kind, entries in (("exports", entry_points(manifest)), ("imports", manifest.get("imports") or {})):
                    for pattern, value in entries.items():
                        head, star, tail = pattern.partition("*")
                        for syntax in ("import", "require"):
                            for typed in (False, True):
                                active = {"default", syntax, *conditions} | ({"types"} if typed else set()) | ({"node"} if mode != "bundler" else set())
                                out.append((t.root, kind, syntax, typed, head, tail, bool(star), *leads(target(value, active), kind)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    def fields(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            loaded = [(t.root, t.name, json.loads(t.json)) for t in f[["root", "name", "json"]].itertuples(index=False)]
            yield pd.DataFrame([(root, name, "exports" in m, legacy(m, "Static"), legacy(m, "TypeOnly")) for root, name, m in loaded], columns=[c.split()[0] for c in PACKAGES.split(", ")])

    return written(manifests.mapInPandas(run, ENTRIES), "entries"), written(manifests.mapInPandas(fields, PACKAGES), "packages")


def matched(names: DataFrame, patterns: DataFrame, on: list[str]) -> DataFrame:
    """``names`` (.., name) with every row of ``patterns`` (*on, head, tail, star, ..) that fits, and ``part``, what the star stands for.

    A name meets the patterns that begin as it does in an equi join: its beginnings of those lengths that patterns have."""
    lengths = [r.n for r in patterns.select(F.length("head").alias("n")).distinct().where(F.col("n") <= LONGEST_NAME).collect()]
    if not lengths:
        lengths = [0]
    name = F.col("name")
    heads = F.array_distinct(F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in sorted(lengths)]))
    met = names.withColumn("head", F.explode(F.filter(heads, lambda h: h.isNotNull()))).join(sized(patterns), [*on, "head"])
    fits = F.when(F.col("star"), name.endswith(F.col("tail")) & (F.length(name) >= F.length("head") + F.length("tail"))).otherwise(name == F.col("head"))
    return met.where(fits).withColumn("part", F.when(F.col("star"), F.substr(name, F.length("head") + 1, F.length(name) - F.length("head") - F.length("tail"))).otherwise(""))


def starred(value: Column, part: Column) -> Column:
    return F.replace(value, F.lit("*"), part)


def entered(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``names`` (id, root, map, syntax, typed, name) with what leads on from their entry point: (id, leads, value).

    An equal name comes first, then the longest pattern, then that with the longest beginning."""
    order = F.struct(~F.col("star"), F.length("head") + F.length("tail"), F.length("head"))
    found = matched(names, entries, ["root", "map", "syntax", "typed"])
    return found.groupBy("id").agg(F.max_by(F.struct("leads", starred(F.col("value"), F.col("part")).alias("value")), order).alias("e")).select("id", "e.*")


def redirects(roots: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(settings, own, syntax, typed, name, to): where each of ``roots``, and each name that they lead to, is sent on to.

    Rounds take the names that are new, so they end when there are none; aliases come before packages and send nothing on.
    What a package's own entries lead to is there from the start, so only names that patterns make need more rounds."""
    context = ["settings", "own", "syntax", "typed"]
    ahead = entries.where("map = 'imports' and leads = 'name' and value like '#%' and not star").select(F.concat(F.lit("/"), "root").alias("own"), "syntax", "typed", F.col("value").alias("name"))
    new = roots.select(*context, "name").unionByName(roots.select(*context).distinct().join(sized(ahead), ["own", "syntax", "typed"]).select(*context, "name")).distinct()
    known = edges = None
    while True:
        rows = written(new.withColumn("id", F.monotonically_increasing_id()), "names")
        known = rows.select(*context, "name") if known is None else known.unionByName(rows.select(*context, "name"))
        free = rows.join(shuffled(matched(rows, aliases, ["settings"]).select("id").distinct()), "id", "left_anti")
        asked = free.select("id", "syntax", "typed", "name", F.substr("own", F.lit(2)).alias("root"), F.lit("imports").alias("map"))
        step = written(rows.join(shuffled(entered(asked, entries).where("leads = 'name'")), "id").select(*context, "name", F.col("value").alias("to")), "redirects")
        edges = step if edges is None else edges.unionByName(step)
        ahead = step.where(F.col("to").startswith("#") & (F.length("to") <= LONGEST_NAME)).select(*context, F.col("to").alias("name")).distinct()
        new = written(ahead.join(shuffled(known), [*context, "name"], "left_anti"), "ahead")
        if not new.limit(1).count():
            return edges


def followed(edges: DataFrame, on: list[str]) -> DataFrame:
    """(*on, name, last, loop): the last name that ``edges`` (*on, name, to) lead to, or the first that comes twice.

    Each round doubles how far a name has come. What is still under way after as many rounds as any chain can need
    goes round a loop; then all that it points to is in loops, and a name's own loop begins where it meets the first."""

    def doubled(at: DataFrame, rounds: int) -> DataFrame:
        for _ in range(rounds):
            on_to = at.select(*on, F.col("name").alias("to"), F.col("to").alias("__to"))
            step = at.join(shuffled(on_to), [*on, "to"], "left")
            if not step.where("__to is not null").limit(1).count():
                break
            at = written(step.select(*on, "name", F.coalesce("__to", "to").alias("to")), "followed")
        return at

    rounds = edges.count().bit_length() + 1
    at = doubled(edges, rounds)
    under_way = written(at.join(shuffled(at.select(*on, F.col("name").alias("to"))), [*on, "to"], "left_semi"), "loops")
    ended = at.join(shuffled(under_way), [*on, "name"], "left_anti").select(*on, "name", F.col("to").alias("last"), F.lit(False).alias("loop"))
    if not under_way.limit(1).count():
        return ended
    inside_loop = written(under_way.select(*on, F.col("to").alias("name")).distinct(), "inside")
    tails = edges.join(shuffled(under_way), [*on, "name"], "left_semi").join(shuffled(inside_loop), [*on, "name"], "left_anti")
    entered_at = doubled(tails, rounds).select(*on, "name", F.col("to").alias("last"))
    return ended.unionByName(inside_loop.withColumn("last", F.col("name")).unionByName(entered_at).withColumn("loop", F.lit(True)))


def joined(folder: Column, path: Column) -> Column:
    return normal(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path)))


def suffixed(base: Column, extensions) -> Column:
    return F.array(*[F.concat(base, F.lit(f".{e}")) for e in extensions])


def by_extension(base: Column, make) -> Column:
    """What ``make`` gives for the extensions that may stand for the one of ``base``, or for all."""
    ext = F.regexp_extract(base, r"(?:^|/)\.*[^./][^/]*\.(js|mjs|cjs)$", 1)
    out = F.when(ext == "js", make(MAPPED["js"]))
    for e in ("mjs", "cjs"):
        out = out.when(ext == e, make(MAPPED[e]))
    return out


def probe_columns(base: Column, strict: Column) -> Column:
    """``probes`` as a column of a normal path; ``strict``: what Node's loader allows."""
    stem = F.regexp_replace(base, r"\.(js|mjs|cjs)$", "")
    index = F.when(base == "", F.array(*[F.lit(f"index.{e}") for e in EXTENSIONS])).otherwise(F.array(*[F.concat(base, F.lit(f"/index.{e}")) for e in EXTENSIONS]))
    mapped = by_extension(base, lambda some: suffixed(stem, some))
    any_ext = base.rlike(r"(?:^|/)\.*[^./][^/]*\.[^./]*$")
    exact = F.coalesce(mapped, F.when(any_ext, F.array(base)), F.array().cast("array<string>"))
    return F.when(strict, exact).otherwise(F.concat(F.array(base), F.coalesce(mapped, suffixed(base, EXTENSIONS)), index))


def possible_columns(base: Column) -> Column:
    """``possible`` as a column of a normal path."""
    stem = F.regexp_replace(base, r"((?:^|/)\.*[^./][^/]*)\.[^./]*$", "$1")
    some = lambda ext: F.concat(suffixed(stem, ext), suffixed(F.concat(base, F.lit("/index")), ext))
    return F.concat(F.array(base), F.coalesce(by_extension(base, some), some(EXTENSIONS)))


def sought(base: Column) -> Column:
    """The names among those that a file offers by which one of ``probe_columns`` is found: the path, and its stem if its
    extension may stand for others."""
    stem = F.regexp_replace(base, r"\.(js|mjs|cjs)$", "")
    return F.array_distinct(F.array(base, stem))


def offered(files: DataFrame) -> DataFrame:
    """(key, path) of each of ``files`` (path): what a probe may have been made of, the path itself, without its extension, and
    the folder of an index file."""
    path, ends = F.col("path"), "|".join(EXTENSIONS)
    cut = F.when(path.rlike(rf"\.({ends})$"), F.regexp_replace(path, r"\.[^.]*$", ""))
    index = F.when(path.rlike(rf"(^|/)index\.({ends})$"), parent(path))
    return files.select(F.explode(F.array_compact(F.array(path, cut, index))).alias("key"), "path")


def tried(tries: DataFrame, files: DataFrame) -> DataFrame:
    """``tries`` with each of ``files`` (path) that is one of their probes, and ``k``, its place among them."""
    met = tries.join(files, "key").withColumn("k", F.array_position(probe_columns(F.col("base"), F.col("strict")), F.col("path")))
    return met.where("k > 0")


def stays_inside(path: Column) -> Column:
    """Whether a path below a package's root never leaves it."""
    deep = F.aggregate(F.split(path, "/"), F.array(F.lit(0), F.lit(0)), lambda a, p: F.array(a[0] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1), F.least(a[1], a[0] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))))
    return F.element_at(deep, 2) >= 0


@dataclass(frozen=True)
class Handler:
    """A plug-in of the chain: ``make`` goes from names (id, *CONTEXT, name) to the paths (id, a, b, base) that they may mean to
    it, in order of a and b. ``rank`` is its place among RANKS; after an alias that fits, none of a higher rank is asked."""

    name: str
    rank: int
    make: Callable[[DataFrame], DataFrame]


#: Places of the chain's own handlers.
RANKS = {"relative": 0, "tsconfig-alias": 10, "base-url": 20, "workspace-package": 30}


@dataclass
class Tables:
    """What resolution looks up: compiler settings, their aliases, packages and their entry points."""

    settings: DataFrame
    aliases: DataFrame
    entries: DataFrame
    packages: DataFrame
    handlers: tuple[Handler, ...] = ()


def tables(manifests: DataFrame, tsconfigs: DataFrame, config: Config, handlers: Sequence[Handler] = ()) -> Tables:
    entries, packages = opened(manifests, tuple(config["resolution"]["custom_conditions"]), config["resolution"]["mode"])
    at = F.concat(F.lit("/"), "directory").alias("settings")
    patterns = tsconfigs.select(at, "base_url", F.posexplode("aliases").alias("rank", "a")).select("settings", "base_url", "rank", F.substring_index("a.pattern", "*", 1).alias("head"), F.col("a.pattern").contains("*").alias("star"), F.col("a.pattern").alias("pattern"), F.col("a.targets").alias("targets"))
    aliases = patterns.withColumn("tail", F.when(F.col("star"), F.substr("pattern", F.length("head") + 2)).otherwise("")).drop("pattern")
    return Tables(written(tsconfigs.select(at, "base_url", "resolve_bare"), "settings"), written(aliases, "aliases"), entries, packages, tuple(handlers))


def contexts(imports: DataFrame, manifests: DataFrame, tsconfigs: DataFrame, scopes: DataFrame) -> DataFrame:
    """folder, type, settings and own of each folder that holds an importer."""
    rows = imports.select(parent(F.col("module_id")).alias("folder")).distinct().withColumn("at", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.lit("x")))
    rows = nearest(rows, "at", scopes.select(F.col("directory").alias("_scope"), "type"), "_scope").drop("_scope")
    rows = nearest(rows, "at", tsconfigs.select(F.col("directory").alias("_ts")), "_ts")
    rows = nearest(rows, "at", manifests.select(F.col("root").alias("_own")), "_own")
    mark = lambda c: F.coalesce(F.concat(F.lit("/"), c), F.lit(""))
    return rows.select("folder", "type", mark("_ts").alias("settings"), mark("_own").alias("own"))


def requested(imports: DataFrame, near: DataFrame, mode: str) -> DataFrame:
    """``imports`` with the columns of CONTEXT, empty where the specifier does not depend on them, so that equal requests are one."""
    modern = mode in ("node16", "nodenext")
    rows = imports.withColumn("folder", parent(F.col("module_id"))).join(sized(near), "folder")
    esm = module_format(F.col("module_id"), F.col("type")) == "esm"
    required = (F.col("kind") == "Require") | ((F.col("kind") != "Dynamic") & F.lit(modern) & ~esm)
    relative, hash_ = F.col("specifier").startswith("."), F.col("specifier").startswith("#")
    return rows.select(
        *imports.columns, F.when(relative | hash_, F.col("folder")).otherwise("").alias("folder"), F.when(relative, "").otherwise(F.col("settings")).alias("settings"), F.when(hash_, F.col("own")).otherwise("").alias("own"),
        F.when(relative, "").when(required, "require").otherwise("import").alias("syntax"), (~relative & (F.col("kind") == "TypeOnly")).alias("typed"), ((relative | hash_) & F.lit(modern) & esm & ~required).alias("strict"),
    )


def bases(names: DataFrame, t: Tables, mode: str) -> DataFrame:
    """(id, rank, a, b, handler, base): the paths that a name (id, *CONTEXT, name) may mean, in order of rank, a and b."""
    name = F.col("name")
    zero = F.lit(0)
    row = lambda rank, handler, base, a=zero, b=zero: [F.col("id"), F.lit(rank).alias("rank"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(handler).alias("handler"), base.alias("base")]
    near = names.where(name.startswith(".")).select(*row(0, "relative", normal(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), name))))
    far = names.where(~name.startswith(".") & ~name.startswith("/"))
    # an alias without targets still answers, with a row that has no path
    hits = matched(far.select("id", "settings", "name"), t.aliases, ["settings"]).select("id", "base_url", F.col("rank").alias("a"), "part", F.posexplode_outer("targets").alias("b", "to"))
    aliased = hits.select(*row(10, "tsconfig-alias", F.when(F.col("to").isNotNull(), joined(F.col("base_url"), starred(F.col("to"), F.col("part")))), F.col("a"), F.coalesce("b", zero)))
    bare = far.where(~name.startswith("#")).join(sized(t.settings.where("resolve_bare")), "settings").select(*row(20, "tsconfig-alias", joined(F.col("base_url"), name)))
    named = package_of(far, t, mode)
    through = entered(named.where("map is not null").select("id", "root", "map", "syntax", "typed", F.col("key").alias("name")), t.entries).where("leads = 'path'")
    to = named.where("map is not null").select("id", "root").join(shuffled(through), "id").select("id", "root", "value")
    entry = F.coalesce(F.when(F.col("typed"), F.col("types_entry")).otherwise(F.col("runtime_entry")), F.lit("src/index"))
    plain = named.where("map is null and key is not null").select("id", "root", F.when(F.col("sub") != "", F.col("sub")).otherwise(entry).alias("value"))
    packaged = to.where(stays_inside(F.col("value"))).unionByName(plain)
    more = [h.make(names).select(*row(h.rank, h.name, normal(F.col("base")), F.col("a"), F.col("b"))) for h in t.handlers]
    return reduce(DataFrame.unionByName, more, near).unionByName(aliased).unionByName(bare).unionByName(packaged.select(*row(30, "workspace-package", joined(F.when(F.col("root") != "", F.col("root")), F.col("value")))))


def package_of(names: DataFrame, t: Tables, mode: str) -> DataFrame:
    """``names`` that a workspace package answers for, with its root: map and key say which of its entry
    points is asked for, without map ``sub`` below its root; # names have neither in the oldest mode."""
    name, modern = F.col("name"), mode != "node10"
    mine = name.startswith("#") & (F.col("own") != "")
    none = F.lit(None).cast("string")
    own = names.where(mine).withColumn("root", F.substr("own", F.lit(2))).join(sized(t.packages.drop("name")), "root").select("id", "syntax", "typed", "root", (F.lit("imports") if modern else none).alias("map"), (name if modern else none).alias("key"), F.lit("").alias("sub"), "runtime_entry", "types_entry")
    other = names.where(~mine).withColumn("package", package_column(name)).join(sized(t.packages.withColumnRenamed("name", "package")), "package")
    other = other.withColumn("sub", F.regexp_replace(F.substr(name, F.length("package") + 1), "^/+", ""))
    key = F.when(F.col("sub") == "", ".").otherwise(F.concat(F.lit("./"), "sub"))
    return own.unionByName(other.select("id", "syntax", "typed", "root", F.when(F.col("has_exports") & F.lit(modern), "exports").alias("map"), key.alias("key"), "sub", "runtime_entry", "types_entry"))


@dataclass
class Answers:
    """Equal requests answered once: ``requests`` (request, *CONTEXT, specifier), ``tries`` (request, base and its
    order, strict, handler, key), the inverted index from what files offer to the requests that may mean them, and
    ``rest`` (request, what holds if no path is a file, the bases of candidates)."""

    requests: DataFrame
    tries: DataFrame
    rest: DataFrame


def is_builtin(name: Column) -> Column:
    bare = F.regexp_replace(name, "^node:", "")
    return bare.isin(*sorted(BUILTINS)) | (name.startswith("node:") & bare.isin(*sorted(PREFIX_ONLY)))


def prepared(requests: DataFrame, t: Tables, config: Config) -> Answers:
    """All that can be said of ``requests`` (request, *CONTEXT, specifier) without knowing which files there are.

    Joins on a request shuffle: files of numbers and flags are so small for their rows that Spark would broadcast them."""
    mode, context = config["resolution"]["mode"], ["settings", "own", "syntax", "typed"]
    asked = requests.withColumnRenamed("request", "id").withColumnRenamed("specifier", "name")
    aimed = asked.withColumn("loop", F.lit(False)).withColumn("redirected", F.lit(False))
    roots = asked.where(F.col("name").startswith("#") & (F.col("own") != ""))
    sent = redirects(roots, t.entries, t.aliases) if mode != "node10" and roots.limit(1).count() else None
    if sent is not None and sent.limit(1).count():
        last = written(followed(sent, context), "last")
        aimed = asked.join(sized(last), [*context, "name"], "left").select("id", *CONTEXT, F.coalesce("last", "name").alias("name"), F.coalesce("loop", F.lit(False)).alias("loop"), F.col("last").isNotNull().alias("redirected"))
        aimed = written(aimed, "aimed")
    own = written(bases(asked, t, mode), "bases")
    meant, listed = own, own
    if sent is not None:
        far = aimed.where("redirected")
        meant = written(own.join(shuffled(far.select("id")), "id", "left_anti").unionByName(bases(far.where("not loop").select("id", *CONTEXT, "name"), t, mode)), "meant")
    aliased = meant.where("rank = 10").select("id").distinct().withColumn("aliased", F.lit(True))
    packaged = package_of(aimed.where(~F.col("name").startswith(".") & ~F.col("name").startswith("/")), t, mode).select("id").distinct().withColumn("packaged", F.lit(True))
    name, bare = F.col("name"), F.regexp_replace("name", "^node:", "")
    rest = aimed.join(shuffled(aliased), "id", "left").join(shuffled(packaged), "id", "left")
    said = lambda outcome, value="", handler="none": F.struct(F.lit(outcome).alias("outcome"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(handler).alias("handler"))
    final = (
        F.when(F.col("loop"), said("invalid", F.format_string("package resolution redirect loop at `%s`", "name")))
        .when(is_builtin(name), said("builtin", F.concat(F.lit("node:"), bare), "node-builtin"))
        .when(name.startswith("/"), said("invalid", ABSOLUTE, "relative"))
        .when(name.startswith("."), said("unresolved", "", "relative"))
        .when(F.col("aliased"), said("unresolved", "", "tsconfig-alias"))
        .when(F.col("packaged"), said("unresolved", "", "workspace-package"))
        .otherwise(said("external", package_column(name), "external-package"))
    )
    rest = written(rest.select("id", "strict", F.coalesce("aliased", F.lit(False)).alias("aliased"), (F.col("loop") | is_builtin(name)).alias("settled"), final.alias("final")), "final")
    usable = meant.join(shuffled(rest), "id").where("base is not null and not settled and (rank <= 10 or not aliased)")
    tries = usable.select(F.col("id").alias("request"), F.struct("rank", "a", "b").alias("order"), "handler", "base", (F.col("strict") & (F.col("rank") == 0)).alias("strict"))
    tries = written(tries.withColumn("key", F.explode(sought(F.col("base")))), "tries")
    # without an alias the bare name below the settings' folder may be meant too
    first = listed.where("rank = 10 and base is not null").select("id").distinct()
    some = listed.where("rank != 20").unionByName(listed.where("rank = 20").join(shuffled(first), "id", "left_anti")).where("base is not null")
    rest = rest.join(shuffled(some.groupBy("id").agg(F.collect_set("base").alias("bases"))), "id", "left").select(F.col("id").alias("request"), "final.*", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"))
    return Answers(requests, tries, written(rest, "rest"))


def decided(answers: Answers, files: DataFrame) -> DataFrame:
    """(request, outcome, value, handler, bases): the first try that is one of ``files`` (path), else what holds without."""
    hit = tried(answers.tries, sized(offered(files))).groupBy("request").agg(F.min_by(F.struct("path", F.col("handler").alias("by")), F.struct("order", "k")).alias("hit"))
    done = answers.rest.join(shuffled(hit), "request", "left")
    known = F.col("hit").isNotNull()
    return done.select("request", F.when(known, "module").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("hit.path", "value").alias("value"), F.coalesce("hit.by", "handler").alias("handler"), "bases")


def numbered(asked: DataFrame) -> DataFrame:
    """The different requests of ``asked``, with a number each."""
    return written(asked.select(*CONTEXT, "specifier").distinct().withColumn("request", F.monotonically_increasing_id()), "requests")


def resolve(imports: DataFrame, files: DataFrame, manifests: DataFrame, tsconfigs: DataFrame, scopes: DataFrame, config: Config, handlers: Sequence[Handler] = ()) -> DataFrame:
    """imports with outcome (module, builtin, external, unresolved, invalid), value, handler and candidates.

    files: (path) of every file that exists, excluded ones too. Redirects are followed to their end.
    """
    asked = written(requested(imports, contexts(imports, manifests, tsconfigs, scopes), config["resolution"]["mode"]), "asked")
    answers = prepared(numbered(asked), tables(manifests, tsconfigs, config, handlers), config)
    return answered(asked, answers.requests, decided(answers, files), config)


def answered(asked: DataFrame, requests: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """Imports with the answers to their requests."""
    virtual = config["resolution"]["virtual_modules"]
    every = asked.join(shuffled(requests.join(shuffled(found), "request")), [*CONTEXT, "specifier"])
    if virtual:
        on = (F.col("outcome") == "unresolved") & matches(F.col("specifier"), virtual, crossing=True)
        every = every.withColumn("value", F.when(on, F.concat(F.lit("virtual:"), "specifier")).otherwise(F.col("value"))).withColumn("handler", F.when(on, "virtual-module").otherwise(F.col("handler"))).withColumn("outcome", F.when(on, "external").otherwise(F.col("outcome")))
    candidates = F.sort_array(F.array_distinct(F.flatten(F.transform("bases", possible_columns))))
    return every.select("module_id", "specifier", "kind", F.col("location").cast(LOCATION).alias("location"), "ord", "outcome", "value", "handler", candidates.alias("candidates"))


def trace(r: Request, files: set[str]) -> list[tuple[str, str, str]]:
    """(specifier, handler, outcome) of each attempt at one request, on the driver."""
    steps, seen = [], set()
    while r.specifier not in seen:
        seen.add(r.specifier)
        p = plan(r)
        hit = next(((h, x) for h, x in zip(p.handlers, p.paths, strict=True) if x in files), None)
        for h in ("node-builtin", "relative", "tsconfig-alias", "workspace-package", "external-package"):
            last = hit[0] if hit else p.final
            steps.append((r.specifier, h, "pass" if h != last else f"module:{hit[1]}" if hit else f"{p.outcome}:{p.value}".rstrip(":")))
            if h == last:
                break
        if hit or p.outcome != "redirect":
            if not hit and p.outcome == "unresolved" and match(r.specifier, r.virtual, True):
                steps.append((r.specifier, "virtual-module", f"external:virtual:{r.specifier}"))
            return steps
        r = Request(r.importer, p.value, r.kind, r.mode, r.esm, r.conditions, r.virtual, r.alias, r.package, r.own)
    return [*steps, (r.specifier, "none", "invalid:package resolution redirect loop")]
