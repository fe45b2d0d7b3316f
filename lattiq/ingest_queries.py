"""Ingestion and resolution over sources, specifiers and manifests made from the driver's tables, with DuckDB SQL.

Sources are one file for each order, a statement for each line item; manifests and
settings belong to brands. Texts come from expressions that both engines share, what
the operators should find in them from SQL alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.config import from_dict
from lattiq.functions.globs import matches
from lattiq.operators import classify, diagnostics, hygiene, resolve, rules, views
from lattiq.plans import analyze, incremental, restore
from lattiq.plans.store import Store
from lattiq.queries import ALLOWED, CONFIG, KIND, WITH, context, dependencies, modules, project, view
from lattiq.schemas import COMMENT, LOCATION, MANIFESTS, PARSED, TSCONFIGS, empty
from lattiq.sources import repository
from lattiq.sources.parser import parse_files
from lattiq.storage import shared_dir, sized, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Sources: what a statement is, of a kind with a specifier.
ITEM = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem) x WHERE rn = 1"
SPEC = "CASE l_partkey % 4 WHEN 0 THEN concat('./m', l_partkey) WHEN 1 THEN concat('../x/m', l_partkey, '.js') WHEN 2 THEN concat('pkg-', l_partkey % 7, '/sub') ELSE concat('@s/pkg', l_partkey % 5) END"
STATEMENT = (
    "concat(CASE WHEN l_linenumber % 2 = 0 THEN '/* import \"no\" */ ' ELSE '' END, "
    "CASE kind WHEN 'Static' THEN concat('import { a as b } from \"', spec, '\";') WHEN 'ReExport' THEN concat('export * from ', chr(39), spec, chr(39), ';') WHEN 'Require' THEN concat('const r = require(\"', spec, '\");') "
    "WHEN 'TypeOnly' THEN concat('import type T from \"', spec, '\";') ELSE concat('void import(\"', spec, '\");') END, ' // require(\"no\") ', kind)"
)
#: The first three lines of an order's file.
HEADS = (
    "CASE WHEN l_orderkey % 3 = 0 THEN '\"use client\";' ELSE '' END",
    "CASE l_orderkey % 5 WHEN 0 THEN 'export const runtime = \"edge\";' WHEN 1 THEN 'export const runtime = \"nodejs\";' ELSE '' END",
    "CASE l_orderkey % 4 WHEN 1 THEN 'import \"server-only\";' WHEN 2 THEN 'import \"client-only\";' ELSE '' END",
)
FILE = "concat('src/o', l_orderkey, '.ts')"
LINES = f"i AS ({ITEM}), k AS (SELECT *, {KIND.replace('a.', '')} AS kind, {SPEC} AS spec FROM i), l AS (SELECT l_orderkey, l_linenumber, kind, spec, {STATEMENT} AS line FROM k)"
#: What is put after the last line: nothing, or what never closes.
TAIL = "CASE l_orderkey % 7 WHEN 0 THEN 'const s = \"open' WHEN 1 THEN 'call(' ELSE '' END"


def lines(spark, d) -> DataFrame:
    view(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"WITH {LINES} SELECT * FROM l")


def sources(spark, d, tail: str = "''") -> DataFrame:
    """FILES, one for each order."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n")
    files = lines(spark, d).groupBy("l_orderkey").agg(body.alias("body"))
    text = F.concat_ws("\n", *map(F.expr, HEADS), "body", F.expr(tail))
    return files.select(F.expr(FILE).alias("path"), text.alias("source"), F.octet_length(text).cast("long").alias("length"))


@query(
    f"WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 3 AS place FROM l) "
    f"SELECT {FILE} AS path, kind, spec AS specifier, CAST(place AS BIGINT) AS line, CAST(strpos(line, concat(CASE WHEN kind = 'ReExport' THEN chr(39) ELSE '\"' END, spec)) + 1 AS BIGINT) AS col FROM n "
    f"UNION ALL SELECT DISTINCT {FILE}, 'Static', CASE l_orderkey % 4 WHEN 1 THEN 'server-only' ELSE 'client-only' END, 3, 9 FROM lineitem WHERE l_orderkey % 4 IN (1, 2)"
)
def parsed_imports(spark, d):
    """Every import of every source: kind, cooked specifier and place; comments and strings are none."""
    found = parse_files(sources(spark, d)).select("path", F.explode("imports").alias("i"))
    return found.select("path", "i.kind", "i.specifier", F.col("i.location.line").cast("long").alias("line"), F.col("i.location.column").cast("long").alias("col"))


@query(
    f"WITH {LINES} SELECT {FILE} AS path, CASE WHEN l_orderkey % 3 = 0 THEN 'use client' ELSE '' END AS directives, CASE l_orderkey % 5 WHEN 0 THEN 'edge' WHEN 1 THEN 'nodejs' END AS runtime, "
    "CASE l_orderkey % 4 WHEN 1 THEN 'server-only' WHEN 2 THEN 'client-only' ELSE '' END AS markers, count(*) + count(*) FILTER (l_linenumber % 2 = 0) AS comments, count(*) FILTER (l_linenumber % 2 = 0) AS standalone FROM l GROUP BY l_orderkey"
)
def parsed_facts(spark, d):
    """Directives, exported runtime, marker imports and comments of every source."""
    own = parse_files(sources(spark, d))
    return own.select("path", F.array_join("directives", ",").alias("directives"), F.col("exported_runtime").alias("runtime"), F.array_join("marker_imports", ",").alias("markers"), F.size("comments").cast("long").alias("comments"), F.size(F.filter("comments", lambda c: c["standalone"])).cast("long").alias("standalone"))


@query(
    f"WITH {LINES} SELECT {FILE} AS path, CASE WHEN l_orderkey % 7 < 2 THEN count(*) + 4 ELSE 0 END AS line, CASE l_orderkey % 7 WHEN 0 THEN 11 WHEN 1 THEN 5 ELSE 0 END AS col, "
    "CASE WHEN l_orderkey % 7 < 2 THEN 0 ELSE count(*) + CASE WHEN l_orderkey % 4 IN (1, 2) THEN 1 ELSE 0 END END AS imports FROM l GROUP BY l_orderkey"
)
def parse_failures(spark, d):
    """Sources with literals or brackets that never close: where they open, and no imports."""
    own = parse_files(sources(spark, d, TAIL))
    at = lambda c: F.coalesce(F.col(f"error.{c}"), F.lit(0))
    return own.select("path", at("line").cast("long").alias("line"), at("column").cast("int").alias("col"), F.size("imports").cast("long").alias("imports"))


# Resolution.
REST = "substr(t, 5, length(t) - 7)"  # a module's path after src/, without its extension
VARIANTS = "CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.css' ELSE '/index' END"
EDGES = f"{WITH}, e AS (SELECT *, line * 16 + col AS ord FROM deps)"


def asked(spark, d, specifier: str) -> DataFrame:
    """IMPORTS of the dependencies, by an expression of f, t and ord."""
    deps = dependencies(spark, d).select(F.col("from").alias("f"), F.col("to").alias("t"), "kind", "location", "ord")
    return deps.select(F.col("f").alias("module_id"), F.expr(specifier).alias("specifier"), "kind", "location", "ord")


def resolved(spark, d, imports: DataFrame, files: DataFrame | None = None, manifests: DataFrame | None = None, tsconfigs: DataFrame | None = None) -> DataFrame:
    none = lambda ddl: empty(spark, ddl)
    imports = written(imports, "imports")  # read for their folders and for themselves
    files = modules(spark, d).select("path") if files is None else files
    scopes = none("directory string, type string")
    return resolve.resolve(imports, files, none(MANIFESTS) if manifests is None else manifests, none(TSCONFIGS) if tsconfigs is None else tsconfigs, scopes, from_dict(CONFIG))


RELATIVE = f"concat('../../', {REST}, {VARIANTS})"


def told(found: DataFrame, *more) -> DataFrame:
    return found.select(F.col("module_id").alias("module"), "specifier", "ord", "outcome", "value", "handler", *more)


@query(
    f"{EDGES} SELECT f AS module, {RELATIVE} AS specifier, ord, CASE WHEN ord % 5 < 3 THEN 'module' ELSE 'unresolved' END AS outcome, CASE WHEN ord % 5 < 3 THEN t ELSE '' END AS value, 'relative' AS handler, "
    "CASE ord % 5 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 17 END AS candidates FROM e"
)
def relative_resolution(spark, d):
    """Relative specifiers: extensions tried, emitted ones mapped, index files, and the paths that could satisfy them."""
    return told(resolved(spark, d, asked(spark, d, RELATIVE)), F.size("candidates").alias("candidates"))


BARE = "CASE ord % 9 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'fs/promises' WHEN 2 THEN 'node:test' WHEN 3 THEN 'test' WHEN 4 THEN concat('@s/p', ord % 10, '/sub/x') WHEN 5 THEN concat('lib', ord % 10, '/sub') WHEN 6 THEN '/abs/x' WHEN 7 THEN 'node:sea' ELSE 'sea' END"


@query(
    f"{EDGES} SELECT f AS module, {BARE} AS specifier, ord, CASE WHEN ord % 9 IN (0, 1, 2, 7) THEN 'builtin' WHEN ord % 9 = 6 THEN 'invalid' ELSE 'external' END AS outcome, "
    "CASE ord % 9 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'node:fs/promises' WHEN 2 THEN 'node:test' WHEN 3 THEN 'test' WHEN 4 THEN concat('@s/p', ord % 10) WHEN 5 THEN concat('lib', ord % 10) WHEN 6 THEN 'absolute module specifiers are outside the project analysis boundary' WHEN 7 THEN 'node:sea' ELSE 'sea' END AS value, "
    "CASE WHEN ord % 9 IN (0, 1, 2, 7) THEN 'node-builtin' WHEN ord % 9 = 6 THEN 'relative' ELSE 'external-package' END AS handler FROM e"
)
def bare_resolution(spark, d):
    """Builtins with and without their prefix, external packages with scopes and subpaths, absolute paths."""
    return told(resolved(spark, d, asked(spark, d, BARE)))


ALIASED = f"CASE ord % 3 WHEN 0 THEN concat('@/', {REST}) WHEN 1 THEN concat('@b/', substr({REST}, strpos({REST}, '/') + 1)) ELSE '@zz/x' END"


@query(
    f"{EDGES} SELECT f AS module, {ALIASED} AS specifier, ord, CASE WHEN ord % 3 = 2 THEN 'external' WHEN ord % 3 = 0 OR tl = 'promo' THEN 'module' ELSE 'unresolved' END AS outcome, "
    "CASE WHEN ord % 3 = 2 THEN '@zz/x' WHEN ord % 3 = 0 OR tl = 'promo' THEN t ELSE '' END AS value, CASE WHEN ord % 3 = 2 THEN 'external-package' ELSE 'tsconfig-alias' END AS handler FROM e"
)
def alias_resolution(spark, d):
    """Path aliases of compiler settings: all targets in order, no fall through to packages once one matches."""
    text = '{ // settings\n "compilerOptions": {"paths": {"@/*": ["none/*", "src/*"], "@b/*": ["src/promo/*"], "@/promo/*": ["none/*"],},}, }'
    settings = repository.tsconfigs(spark, spark.createDataFrame([("tsconfig.json", text)], "path string, source string"))
    return told(resolved(spark, d, asked(spark, d, ALIASED.replace("strpos(", "instr(")), tsconfigs=settings))


BRAND = "replace(p_brand, '#', '-')"
NUMBER = "CAST(substr(p_brand, 7) AS INT)"
MANIFEST = (
    f"concat('{{\"name\":\"@w/', {BRAND}, '\"', CASE {NUMBER} % 3 WHEN 0 THEN ',\"exports\":{{\".\":\"./main.ts\",\"./lib/*\":{{\"import\":\"./lib/*.ts\",\"default\":\"./none.ts\"}},\"./hidden/*\":null}}' WHEN 1 THEN ',\"main\":\"./lib/entry.js\"' ELSE '' END, "
    f"CASE WHEN {NUMBER} % 5 = 0 THEN '' ELSE concat(',\"dependencies\":{{\"a', {NUMBER} % 4, '\":\"1\",\"next\":\"15\"}},\"devDependencies\":{{\"d\":\"*\"}},\"peerDependencies\":{{\"a', {NUMBER} % 4, '\":\"2\"}}') END, "
    f"CASE WHEN {NUMBER} % 2 = 0 THEN ',\"type\":\"module\"' ELSE '' END, '}}')"
)


def brands(spark, d) -> DataFrame:
    return view(spark, d, "part").select("p_brand").distinct()


def inputs(spark, d) -> DataFrame:
    """path and source of the workspace's manifests and settings."""
    own = brands(spark, d).select(F.expr(f"concat('packages/', {BRAND}, '/package.json')").alias("path"), F.expr(MANIFEST).alias("source"))
    more = [("package.json", '{"name":"root","workspaces":["packages/*","!packages/none"]}'), ("packages/none/package.json", '{"name":"none"}'), ("other/package.json", '{"name":"other"}'), ("packages/nameless/package.json", "{}"), ("tools/next.config.mjs", "")]
    return own.unionByName(spark.createDataFrame(more, "path string, source string"))


BRANDS = "b AS (SELECT DISTINCT p_brand FROM part)"


@query(f"WITH {BRANDS} SELECT concat('packages/', {BRAND}) AS root, concat('@w/', {BRAND}) AS name FROM b UNION ALL SELECT '', 'root'")
def workspace_manifests(spark, d):
    """Packages that the root's workspaces name."""
    return repository.manifests(spark, inputs(spark, d)).select("root", "name")


@query(
    f"WITH {BRANDS}, n AS (SELECT concat('@w/', {BRAND}) AS package, {NUMBER} AS k FROM b) SELECT package, unnest([concat('a', k % 4), 'd', 'next']) AS dependency FROM n WHERE k % 5 != 0 "
    "UNION ALL SELECT package, NULL FROM n WHERE k % 5 = 0 UNION ALL SELECT 'root', NULL"
)
def declared_dependencies(spark, d):
    """What manifests declare in any of their lists, each name once."""
    return repository.declared(repository.manifests(spark, inputs(spark, d)))


@query(f"WITH {BRANDS} SELECT concat('packages/', {BRAND}) AS directory, 100 AS score FROM b WHERE {NUMBER} % 5 != 0 UNION ALL SELECT 'tools', 90")
def framework_evidence(spark, d):
    return repository.frameworks(inputs(spark, d))


WORKSPACE = "concat('@w/', replace(tp, '#', '-'), CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN concat('/lib/', m) WHEN 2 THEN '/hidden/x' ELSE '/lib/zzz' END)"
TARGETS = f"{EDGES}, x AS (SELECT *, regexp_extract(t, '(m[0-9]+)[.]ts$', 1) AS m, CAST(substr(tp, 7) AS INT) % 3 AS style, concat('packages/', replace(tp, '#', '-')) AS root FROM e)"


@query(
    f"{TARGETS}, y AS (SELECT f, {WORKSPACE} AS specifier, ord, CASE ord % 4 WHEN 0 THEN concat(root, CASE style WHEN 0 THEN '/main.ts' WHEN 1 THEN '/lib/entry.ts' ELSE '/src/index.ts' END) WHEN 1 THEN CASE WHEN style != 0 OR kind = 'Dynamic' THEN concat(root, '/lib/', m, '.ts') END END AS hit FROM x) "
    "SELECT f AS module, specifier, ord, CASE WHEN hit IS NOT NULL THEN 'module' ELSE 'unresolved' END AS outcome, coalesce(hit, '') AS value, 'workspace-package' AS handler FROM y"
)
def workspace_resolution(spark, d):
    """Packages of the workspace by exports (patterns, conditions, blocked paths), by main, or by their sources."""
    view(spark, d, "part").createOrReplaceTempView("part")
    files = spark.sql(f"SELECT explode(array(concat('packages/', {BRAND}, '/lib/m', p_partkey, '.ts'), concat('packages/', {BRAND}, '/main.ts'), concat('packages/', {BRAND}, '/lib/entry.ts'), concat('packages/', {BRAND}, '/src/index.ts'))) AS path FROM part")
    deps = dependencies(spark, d).join(sized(modules(spark, d).select(F.col("id").alias("to"), F.col("package").alias("tp"))), "to")
    imports = deps.select(F.col("from").alias("module_id"), F.regexp_extract("to", "(m[0-9]+)[.]ts$", 1).alias("m"), "tp", "kind", "location", "ord").select("module_id", F.expr(WORKSPACE).alias("specifier"), "kind", "location", "ord")
    return told(resolved(spark, d, imports, files, repository.manifests(spark, inputs(spark, d))))


MODES = ("node10", "node16", "nodenext", "bundler")
ASKED = f"CASE ord % 5 WHEN 0 THEN concat('../../', {REST}) WHEN 1 THEN concat('../../', {REST}, '.js') WHEN 2 THEN '@w/c' WHEN 3 THEN concat('./virt-', ord) ELSE concat('../../', {REST}, '.ts') END"
STRICT = "mode IN ('node16', 'nodenext') AND kind != 'Require'"


@query(
    f"{EDGES}, m AS (SELECT unnest(['node10', 'node16', 'nodenext', 'bundler']) AS mode), x AS (SELECT *, {ASKED} AS specifier FROM e CROSS JOIN m), y AS (SELECT mode, f AS module, specifier, ord, kind, "
    f"CASE WHEN ord % 5 = 0 THEN CASE WHEN {STRICT} THEN NULL ELSE t END WHEN ord % 5 IN (1, 4) THEN t "
    "WHEN ord % 5 = 2 THEN concat('packages/c/', CASE mode WHEN 'node10' THEN 'main' WHEN 'node16' THEN 'n' WHEN 'nodenext' THEN 'c' ELSE CASE kind WHEN 'Require' THEN 'r' ELSE 'd' END END, '.ts') END AS hit FROM x) "
    "SELECT mode, module, specifier, ord, kind, CASE WHEN hit IS NOT NULL THEN 'module' WHEN ord % 5 = 3 AND mode = 'bundler' THEN 'external' ELSE 'unresolved' END AS outcome, "
    "CASE WHEN hit IS NOT NULL THEN hit WHEN ord % 5 = 3 AND mode = 'bundler' THEN concat('virtual:', specifier) ELSE '' END AS value, "
    "CASE WHEN ord % 5 = 2 THEN 'workspace-package' WHEN ord % 5 = 3 AND mode = 'bundler' THEN 'virtual-module' ELSE 'relative' END AS handler FROM y"
)
def resolution_modes(spark, d):
    """Every mode over importers that are ES modules: extensions that Node's loader asks for, conditions of
    exports and custom ones, the legacy entry of the oldest mode, virtual modules."""
    manifest = '{"name":"@w/c","main":"./main.ts","exports":{".":{"custom":"./c.ts","node":"./n.ts","require":"./r.ts","default":"./d.ts"}}}'
    manifests = spark.createDataFrame([("packages/c", "@w/c", manifest)], MANIFESTS)
    imports = written(asked(spark, d, ASKED), "asked")
    files = modules(spark, d).select("path").unionByName(spark.createDataFrame([(f"packages/c/{n}.ts",) for n in ("main", "c", "n", "r", "d")], "path string"))
    scopes = spark.createDataFrame([("", "module")], "directory string, type string")
    out = None
    for mode in MODES:
        own = {"mode": mode, "custom_conditions": ["custom"] if mode == "nodenext" else [], "virtual_modules": ["./virt*"] if mode == "bundler" else []}
        found = told(resolve.resolve(imports, files, manifests, empty(spark, TSCONFIGS), scopes, from_dict(CONFIG | {"resolution": own})), "kind").withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS INT) AS k, CASE WHEN n_nationkey + 3 <= 24 THEN CAST(n_nationkey + 3 AS INT) END AS nk, CAST((n_nationkey * n_nationkey + 1) % 25 AS INT) AS lk FROM nation), "
    "w(k, here) AS (SELECT k, k FROM n UNION ALL SELECT w.k, n.nk FROM w JOIN n ON w.here = n.k WHERE n.nk IS NOT NULL), ends AS (SELECT k, max(here) AS last FROM w GROUP BY k), "
    "r(k, here, seen) AS (SELECT k, k, [k] FROM n UNION ALL SELECT r.k, n.lk, list_append(r.seen, n.lk) FROM r JOIN n ON r.here = n.k WHERE NOT list_contains(r.seen, n.lk)), "
    "loops AS (SELECT r.k AS k, arg_max(n.lk, len(r.seen)) AS first FROM r JOIN n ON r.here = n.k GROUP BY r.k), "
    "o AS (SELECT o_orderkey, CAST(o_orderkey % 25 AS INT) AS k, CAST(o_orderkey % 3 AS INT) AS style FROM orders) "
    "SELECT concat('src/o', o_orderkey, '.ts') AS module, concat(CASE style WHEN 0 THEN '#l' ELSE '#n' END, o.k) AS specifier, CAST(o_orderkey AS BIGINT) AS ord, "
    "CASE WHEN style = 0 THEN 'invalid' WHEN last = 23 THEN 'unresolved' ELSE 'module' END AS outcome, "
    "CASE WHEN style = 0 THEN concat('package resolution redirect loop at `#l', first, '`') WHEN last = 23 THEN '' ELSE concat('lib/n', last, '.ts') END AS value, "
    "CASE WHEN style = 0 THEN 'none' ELSE 'workspace-package' END AS handler FROM o JOIN ends ON o.k = ends.k JOIN loops ON o.k = loops.k"
)
def redirect_chains(spark, d):
    """Package-internal names that lead to each other: chains of up to nine to their end, and loops with what leads into them."""
    nations = view(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    nations.createOrReplaceTempView("nations")
    entry = "concat('\"#n', k, '\":\"', CASE WHEN k + 3 <= 24 THEN concat('#n', k + 3) ELSE concat('./lib/n', k, '.ts') END, '\",\"#l', k, '\":\"#l', (k * k + 1) % 25, '\"')"
    manifests = spark.sql(f"SELECT '' AS root, 'root' AS name, concat('{{\"name\":\"root\",\"imports\":{{', concat_ws(',', collect_list({entry})), '}}}}') AS json FROM nations")
    orders = view(spark, d, "orders").select("o_orderkey")
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "#l").otherwise("#n"), F.col("o_orderkey") % 25)
    imports = orders.select(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".ts")).alias("module_id"), name.alias("specifier"), F.lit("Static").alias("kind"), F.lit(None).cast(LOCATION).alias("location"), F.col("o_orderkey").cast("long").alias("ord"))
    return told(resolved(spark, d, imports, spark.sql("SELECT concat('lib/n', k, '.ts') AS path FROM nations WHERE k != 23"), manifests))


@query(
    f"{EDGES}, p AS (SELECT DISTINCT id AS path FROM modules WHERE id NOT LIKE '%9.ts'), x AS (SELECT e.*, p.path IS NOT NULL AS there FROM e LEFT JOIN p ON e.t = p.path) "
    f"SELECT f AS module, {RELATIVE} AS specifier, ord, CASE WHEN ord % 5 < 3 AND there THEN 'module' ELSE 'unresolved' END AS outcome, CASE WHEN ord % 5 < 3 AND there THEN t ELSE '' END AS value, 'relative' AS handler FROM x"
)
def restored_resolutions(spark, d):
    """Answers after files came and went and imports were added, most of them restored from the run before."""
    store = Store(spark, f"{shared_dir(spark)}/resolutions-{uuid.uuid4().hex}")
    imports, files = written(asked(spark, d, RELATIVE), "asked"), modules(spark, d).select("path")
    none = [empty(spark, x) for x in (MANIFESTS, TSCONFIGS, "directory string, type string")]
    before = files.where("path NOT LIKE '%7.ts'"), imports.where("ord % 11 != 0")
    restore.restored(store, before[1], before[0], *none, from_dict(CONFIG), "e")
    found, _ = restore.restored(store, imports, files.where("path NOT LIKE '%9.ts'"), *none, from_dict(CONFIG), "e")
    return told(found)


EXT = "CASE p_partkey % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'mts' WHEN 2 THEN 'cts' WHEN 3 THEN 'js' ELSE 'cjs' END"


@query(
    f"SELECT concat('packages/', {BRAND}, '/lib/m', p_partkey, '.', {EXT}) AS path, concat('packages/', {BRAND}) AS directory, CASE WHEN p_partkey % 5 = 1 THEN 'esm' WHEN p_partkey % 5 IN (2, 4) THEN 'commonjs' WHEN {NUMBER} % 2 = 0 THEN 'esm' ELSE 'commonjs' END AS format FROM part"
)
def module_formats(spark, d):
    """The nearest manifest above each file, and the module format by extension or by its type."""
    files = view(spark, d, "part").select(F.expr(f"concat('packages/', {BRAND}, '/lib/m', p_partkey, '.', {EXT})").alias("path"))
    near = classify.nearest(files, "path", repository.scopes(inputs(spark, d)), "directory")
    return near.select("path", "directory", classify.module_format(F.col("path"), F.col("type")).alias("format"))


PLACE = f"CASE p_partkey % 5 WHEN 0 THEN concat('packages/', {BRAND}, '/a/m', p_partkey) WHEN 1 THEN concat('apps/site/m', p_partkey) WHEN 2 THEN concat('packages/unknown/m', p_partkey) WHEN 3 THEN concat('packages/', {BRAND}, 'x/m', p_partkey) ELSE concat('src/m', p_partkey) END"


@query(
    f"SELECT {PLACE} AS path, CASE p_partkey % 5 WHEN 0 THEN concat('@w/', {BRAND}) WHEN 1 THEN 'apps/site' WHEN 2 THEN 'packages/unknown' WHEN 3 THEN concat('packages/', {BRAND}, 'x') ELSE 'project' END AS package, "
    f"CASE p_partkey % 5 WHEN 0 THEN concat('packages/', {BRAND}) WHEN 1 THEN 'apps/site' WHEN 2 THEN 'packages/unknown' WHEN 3 THEN concat('packages/', {BRAND}, 'x') ELSE '' END AS package_root FROM part"
)
def package_inference(spark, d):
    """Packages by the deepest workspace root, by apps and packages folders, else the project's."""
    own = repository.manifests(spark, inputs(spark, d)).where("root != ''")
    return classify.packages_of(view(spark, d, "part").select(F.expr(PLACE).alias("path")), own, "project")


SPOT = "CASE p_partkey % 10 WHEN 0 THEN 'app/a/page.tsx' WHEN 1 THEN 'app/layout.tsx' WHEN 2 THEN 'app/api/route.ts' WHEN 3 THEN 'pages/api/x.ts' WHEN 4 THEN 'pages/_app.tsx' WHEN 5 THEN 'pages/index.tsx' WHEN 6 THEN 'middleware.ts' WHEN 7 THEN 'lib/util.ts' WHEN 8 THEN 'src/app/error.tsx' ELSE 'src/pages/_document.tsx' END"
FACTS = "p_size % 4 = 1 AS client, p_size % 4 = 2 AS server, CASE p_size % 7 WHEN 1 THEN 'edge' WHEN 2 THEN 'nodejs' END AS exported, p_size % 11 IN (1, 3) AS so, p_size % 11 IN (2, 3) AS co"


@query(
    f"WITH x AS (SELECT p_partkey, {SPOT} AS path, {FACTS} FROM part), y AS (SELECT *, CASE path WHEN 'app/a/page.tsx' THEN 'page' WHEN 'app/layout.tsx' THEN 'layout' WHEN 'app/api/route.ts' THEN 'route-handler' WHEN 'pages/api/x.ts' THEN 'api-route' WHEN 'pages/_app.tsx' THEN 'custom-app' "
    "WHEN 'pages/index.tsx' THEN 'page' WHEN 'middleware.ts' THEN 'middleware' WHEN 'src/app/error.tsx' THEN 'error-boundary' WHEN 'src/pages/_document.tsx' THEN 'custom-document' ELSE CASE WHEN server THEN 'server-action-module' ELSE 'module' END END AS role FROM x), "
    "z AS (SELECT *, CASE WHEN so AND co THEN 'conflicting-marker' WHEN so OR co THEN 'marker-package' WHEN exported IS NOT NULL THEN 'explicit' WHEN client THEN 'directive' WHEN role IN ('middleware', 'api-route', 'custom-document', 'server-action-module') OR path LIKE 'app/%' OR path LIKE 'src/app/%' THEN 'convention' ELSE 'default' END AS source FROM y) "
    "SELECT p_partkey AS id, role, source, CASE source WHEN 'conflicting-marker' THEN 'unknown' WHEN 'marker-package' THEN CASE WHEN so THEN 'server' ELSE 'browser' END WHEN 'explicit' THEN CASE exported WHEN 'edge' THEN 'edge' ELSE 'node' END WHEN 'directive' THEN 'browser' WHEN 'convention' THEN CASE role WHEN 'middleware' THEN 'edge' ELSE 'server' END ELSE 'universal' END AS runtime, "
    "CASE source WHEN 'conflicting-marker' THEN 'the module imports both `server-only` and `client-only`' WHEN 'marker-package' THEN concat('the module imports the `', CASE WHEN so THEN 'server' ELSE 'client' END, '-only` marker package') WHEN 'explicit' THEN 'the module exports an explicit `runtime` value' WHEN 'directive' THEN 'the module starts with the `\"use client\"` directive' "
    "WHEN 'convention' THEN concat('framework convention for role `', role, '`') ELSE 'no runtime evidence; the module is treated as universal' END AS reason FROM z"
)
def framework_roles(spark, d):
    """Role, runtime, the evidence for it and its explanation, by the conventions of both routers."""
    view(spark, d, "part").createOrReplaceTempView("part")
    part = spark.sql(f"SELECT p_partkey, {SPOT} AS path, {FACTS} FROM part")
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(F.col(c), F.lit(v)) for c, v in pairs]))
    own = part.select("p_partkey", "path", F.lit("").alias("package_root"), pick(("client", "use client"), ("server", "use server")).alias("directives"), F.col("exported").alias("exported_runtime"), pick(("so", "server-only"), ("co", "client-only")).alias("marker_imports"))
    made = classify.with_framework(own).select(F.col("p_partkey").alias("id"), F.lit("source").alias("kind"), "f.runtime", F.col("f").alias("framework"))
    return views.explain_runtime(made).select("id", F.col("framework.attributes")["role"].alias("role"), F.col("runtime_source").alias("source"), "runtime", F.col("runtime_reason").alias("reason"))


# Suppressions.
SAID = "CASE p_partkey % 7 WHEN 0 THEN concat('// lattiq-ignore ARCH-003 -- reason ', p_partkey) WHEN 1 THEN '// lattiq-ignore-file ARCH-001 -- old -- code' WHEN 2 THEN '// lattiq-ignore NOPE -- x' WHEN 3 THEN '// lattiq-ignore ARCH-003' WHEN 4 THEN '// lattiq-ignored ARCH-003 -- x' WHEN 5 THEN '/* lattiq-ignore ARCH-003 -- x */' ELSE '// plain' END"


@query(
    "SELECT p_partkey AS line, p_partkey % 7 = 1 AS file_scope, CASE p_partkey % 7 WHEN 1 THEN 'ARCH-001' ELSE 'ARCH-003' END AS rule, CASE p_partkey % 7 WHEN 0 THEN concat('reason ', p_partkey) ELSE 'old -- code' END AS said FROM part WHERE p_partkey % 7 < 2 AND p_size % 2 = 0 "
    "UNION ALL SELECT p_partkey, false, 'SUPPRESS-001', CASE p_partkey % 7 WHEN 2 THEN 'Suppression references unknown rule `NOPE`' ELSE 'Suppression for `ARCH-003` requires a reason after `--`' END FROM part WHERE p_partkey % 7 IN (2, 3) AND p_size % 2 = 0"
)
def suppression_directives(spark, d):
    """What comments suppress, and warnings on those with unknown rules or without a reason; only comments that stand alone count."""
    text = F.struct(F.expr(SAID).alias("text"), F.col("p_partkey").cast("int").alias("line"), F.lit(1).alias("column"), (F.col("p_size") % 2 == 0).alias("standalone")).cast(COMMENT)
    good, bad = diagnostics.directives(view(spark, d, "part").select(F.lit("src/a.ts").alias("path"), text.alias("comment")))
    wrong = bad.select(F.col("primary_location.line").cast("long").alias("line"), F.lit(False).alias("file_scope"), F.col("rule_id").alias("rule"), F.col("message").alias("said"))
    return good.select(F.col("line").cast("long").alias("line"), "file_scope", "rule", F.col("reason").alias("said")).unionByName(wrong)


SUPPRESSED = {"suppressions": {"require_reason": True, "report_unused": True, "fingerprints": [], "paths": [{"pattern": "src/promo/**", "rules": ["ARCH-003"], "reason": "moving"}, {"pattern": "src/*/Brand-1?/*.ts", "rules": ["ARCH-003"], "reason": "later"}, {"pattern": "none/**", "rules": ["ARCH-003"], "reason": "gone"}]}}
ENTRY = "CASE WHEN f LIKE 'src/promo/%' OR t LIKE 'src/promo/%' THEN 0 WHEN regexp_matches(f, '^src/.*/Brand-1[^/]/.*\\.ts$') OR regexp_matches(t, '^src/.*/Brand-1[^/]/.*\\.ts$') THEN 1 END"


@query(
    f"{WITH}, x AS (SELECT f, t, line, CAST(col AS BIGINT) AS col, {ENTRY} AS entry FROM deps WHERE NOT ({ALLOWED})), n AS (SELECT entry, count(*) AS n FROM x GROUP BY entry) "
    "SELECT 'ARCH-003' AS rule, f AS source, t AS target, line, col, x.entry IS NOT NULL AS suppressed, CASE x.entry WHEN 0 THEN 'moving' WHEN 1 THEN 'later' END AS reason, CASE WHEN x.entry IS NOT NULL THEN CAST(n.n AS VARCHAR) END AS matched FROM x LEFT JOIN n ON x.entry = n.entry "
    "UNION ALL SELECT 'SUPPRESS-001', NULL, NULL, 1, 1, false, NULL, '0'"
)
def config_suppressions(spark, d):
    """Configured suppressions: the first entry that covers a path counts, matches are counted, unused entries reported."""
    raw = diagnostics.fingerprinted(rules.layer_boundary(context(spark, d)))
    out = diagnostics.suppress_by_config(written(raw, "raw"), from_dict(CONFIG | SUPPRESSED))
    at = lambda c: F.col(f"primary_location.{c}").cast("long")
    return out.select(F.col("rule_id").alias("rule"), F.get("dependency_path", F.lit(0)).alias("source"), F.get("dependency_path", F.lit(1)).alias("target"), at("line").alias("line"), at("column").alias("col"), "suppressed", F.col("suppression_reason").alias("reason"), F.col("metadata")["suppression.matchedCount"].alias("matched"))


# Changes, views and small functions.
@query(f"{EDGES} SELECT f AS module, {RELATIVE} AS specifier, ord FROM e WHERE tp = 'Brand#5' AND ord % 5 IN (0, 2)")
def deleted_target_imports(spark, d):
    """Imports that meant a deleted file, by its path with or without extension."""
    gone = modules(spark, d).where("package = 'Brand#5'").select("path")
    return views.deleted_targets(asked(spark, d, RELATIVE), gone).select(F.col("module_id").alias("module"), "specifier", "ord")


@query(
    "WITH a AS (SELECT concat('d', doc_id) AS path, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS source FROM documents WHERE doc_id % 11 != 0 UNION ALL SELECT concat('p', page_id), html FROM pages), b AS (SELECT concat('d', doc_id) AS path, text AS source FROM documents) "
    "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'D' WHEN b.path IS NULL THEN 'A' ELSE 'M' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.source IS DISTINCT FROM b.source"
)
def overlay_changes(spark, d):
    """What differs between two states of all documents as files, one of them edited, cut and added to."""
    old = view(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("source"), "doc_id")
    new = old.where("doc_id % 11 != 0").select("path", F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(source, '!') ELSE source END").alias("source"))
    added = view(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("source"))
    return incremental.overlay_changes(new.unionByName(added), old.drop("doc_id"))


@query("SELECT concat('d', doc_id) AS path, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS digest, CAST(strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length FROM documents UNION ALL SELECT concat('p', page_id), md5(html), strlen(html) FROM pages")
def overlaid_files(spark, d):
    """Files with texts from an editor in place of those stored, and files that the editor adds."""
    disk = repository.from_table(view(spark, d, "documents").select(F.concat(F.lit("./d"), "doc_id").alias("path"), F.col("text").alias("source")))
    edits = view(spark, d, "documents").where("doc_id % 7 = 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.concat("text", F.lit("!")).alias("source"))
    added = view(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("source"))
    return repository.overlaid(disk, edits.unionByName(added)).select("path", F.md5("source").alias("digest"), "length")


@query(f"{EDGES}, o AS (SELECT f, t, min(ord) AS first FROM e GROUP BY f, t), g AS (SELECT f, t, count(*) AS n FROM e WHERE NOT ({ALLOWED}) GROUP BY f, t) SELECT g.f AS source, g.t AS target, g.n AS diagnostics, o.first // 16 AS line, o.first % 16 AS col FROM g JOIN o ON g.f = o.f AND g.t = o.t")
def path_locations(spark, d):
    """The first place of each step of each diagnostic's path."""
    c = context(spark, d)
    raw = rules.layer_boundary(c).withColumn("fingerprint", F.concat_ws("|", "dependency_path"))
    at = views.edge_locations(raw, c.frames.dependencies)
    return at.groupBy(F.col("from").alias("source"), F.col("to").alias("target"), F.col("location.line").cast("long").alias("line"), F.col("location.column").cast("long").alias("col")).agg(F.count(F.lit(1)).alias("diagnostics"))


@query(f"{WITH}, x AS (SELECT min(f) AS f FROM deps), y AS (SELECT f, t, {ALLOWED.replace('fl', 'd.fl').replace('tl', 'd.tl')} AS fine FROM deps d WHERE d.f = (SELECT f FROM x)) SELECT (SELECT f FROM x) AS source, min(t) AS target, CASE WHEN min_by(fine, t) THEN 'allowed' ELSE 'denied' END AS verdict FROM y")
def dependency_policy(spark, d):
    """The verdict on one dependency, with the rules that govern it."""
    p = project(spark, d, keep=True)
    ends = p.dependencies.agg(F.min(F.struct("from", "to")).alias("x")).first().x
    raw = diagnostics.fingerprinted(rules.layer_boundary(rules.Context(p, from_dict(CONFIG))))
    return views.dependency_policy(p, raw, ends["from"], ends["to"]).select(F.lit(ends["from"]).alias("source"), F.lit(ends["to"]).alias("target"), "verdict")


@query(
    f"{WITH}, own AS (SELECT id, runtime = 'browser' AS b, CASE WHEN p_partkey % 3 = 0 THEN 'directive' ELSE 'propagated' END AS source, kind FROM modules), s AS (SELECT DISTINCT f, t FROM deps WHERE f IN (SELECT id FROM own WHERE b) AND t IN (SELECT id FROM own WHERE b)), "
    "r(id, n) AS (SELECT id, 0 FROM own WHERE b AND kind != 'external' AND source = 'directive' UNION SELECT s.t, r.n + 1 FROM r JOIN s ON r.id = s.f WHERE r.n < 60) SELECT id AS node, CAST(min(n) AS BIGINT) AS hops FROM r GROUP BY id"
)
def browser_propagation(spark, d):
    """How browser modules got their runtime: the shortest ways from declared ones."""
    p = project(spark, d)
    source = F.create_map(F.lit("runtimeSource"), F.when(F.regexp_extract("id", "m([0-9]+)", 1).cast("long") % 3 == 0, "directive").otherwise("propagated"))
    p.modules = p.modules.withColumn("framework", F.struct(F.lit("nextjs").alias("adapter_id"), source.alias("attributes")))
    return views.propagation_paths(p).select("node", (F.size("path") - 1).cast("long").alias("hops"))


@query(f"{EDGES} SELECT 'RESOLVE-001' AS rule, f AS module, concat('Cannot resolve `', {RELATIVE}, '`') AS message, 'error' AS severity, line, CAST(col AS BIGINT) AS col FROM e WHERE ord % 5 >= 3 UNION ALL SELECT 'RESOLVE-002', f, 'absolute module specifiers are outside the project analysis boundary', 'error', line, CAST(col AS BIGINT) FROM e WHERE ord % 5 < 3 AND ord % 7 = 0")
def resolution_facts(spark, d):
    """Diagnostics of imports that don't resolve or mustn't."""
    spec = f"CASE WHEN ord % 5 < 3 AND ord % 7 = 0 THEN '/abs' ELSE {RELATIVE} END"
    found = written(resolved(spark, d, asked(spark, d, spec)), "found")
    out = analyze.facts(empty(spark, PARSED), found)
    at = lambda c: F.col(f"primary_location.{c}")
    return out.select(F.col("rule_id").alias("rule"), at("file").alias("module"), "message", "severity", at("line").cast("long").alias("line"), at("column").cast("long").alias("col"))


@query("SELECT id, regexp_matches(id, '^src/.*/Brand-1[^/]*/[^/]*$') OR regexp_matches(id, 'm[^/]*5\\.ts$') AS wide, regexp_matches(id, '^src/[^/]*/[^/]*/m[0-9]*[02]\\.ts$') AS narrow FROM (SELECT concat('src/', lower(p_type), '/', replace(p_brand, '#', '-'), '/m', p_partkey, '.ts') AS id FROM part)")
def glob_dialects(spark, d):
    """Globs whose stars cross folders, and globs with braces and sets whose stars don't."""
    own = modules(spark, d).select("id")
    return own.select("id", matches(F.col("id"), ["src/*/Brand-1*/*", "*m*5.ts"], crossing=True).alias("wide"), matches(F.col("id"), ["src/*/*/m*{0,2}.ts"]).alias("narrow"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS plain, md5(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS value, CAST(least(length(text), 40) AS INT) AS col FROM documents")
def report_texts(spark, d):
    """Texts escaped for annotations, and columns in UTF-16."""
    docs = view(spark, d, "documents")
    col = hygiene.utf16_column(F.col("text"), F.least(F.char_length("text"), F.lit(40)) + 1)
    return docs.select("doc_id", F.md5(hygiene.escape_annotation(F.col("text"))).alias("plain"), F.md5(hygiene.escape_annotation(F.col("text"), True)).alias("value"), col.alias("col"))


__all__ = ["LOCATION", "QUERIES", "SQL"]
