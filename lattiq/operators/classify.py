"""Derived columns of modules: layer, ownership, feature, package, format, framework."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.config import Config
from lattiq.functions.globs import matches
from lattiq.functions.paths import ancestors, depth, extension, stem
from lattiq.operators.graphs import reachable
from lattiq.storage import small


def layers_of(path: Column, config: Config) -> Column:
    """Names of the layers whose patterns match, in order of name."""
    names = [F.when(matches(path, layer["patterns"]), F.lit(name)) for name, layer in sorted(config.layers.items())]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def ownership(modules: DataFrame, config: Config) -> DataFrame:
    """module, status (assigned, exempt, unassigned, overlap) and layers of source modules."""
    own = modules.where("kind = 'source'").select(F.col("id").alias("module"), layers_of(F.col("id"), config).alias("layers"))
    exempt = matches(F.col("module"), config["architecture"]["coverage"]["allow_unassigned"])
    return own.select("module", F.when(F.size("layers") == 1, "assigned").when(F.size("layers") > 1, "overlap").when(exempt, "exempt").otherwise("unassigned").alias("status"), "layers")


def nearest(df: DataFrame, path: str, table: DataFrame, folder: str) -> DataFrame:
    """Rows of ``df`` with those of ``table`` for the deepest of its folders above ``path``, null if none.

    The folders above are exploded, so it is an equi join and no range join.
    """
    # a row's own key keeps rows with equal paths apart and needs no shuffle of its own
    keys = df.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias(folder))
    hits = keys.join(small(table), folder).withColumn("_depth", depth(F.col(folder)))
    best = hits.groupBy(path).agg(F.max_by(F.struct(*table.columns), "_depth").alias("_near"))
    return df.join(best, path, "left").select(*df.columns, *[F.col(f"_near.`{c}`").alias(c) for c in table.columns])


def packages_of(paths: DataFrame, manifests: DataFrame, project: str) -> DataFrame:
    """path, package and package_root: the deepest workspace root above, else apps/x or packages/x, else the project."""
    table = manifests.select(F.col("root").alias("_root"), F.col("name").alias("_name"))
    near = nearest(paths.select("path").distinct(), "path", table, "_root")
    top = F.regexp_extract("path", "^((?:apps|packages)/[^/]+)(?:/|$)", 1)
    return near.select("path", F.coalesce("_name", F.when(top != "", top), F.lit(project)).alias("package"), F.coalesce("_root", F.when(top != "", top), F.lit("")).alias("package_root"))


def features(modules: DataFrame, config: Config) -> DataFrame:
    """module, package, feature and root: the first configured root (below the package's) that prefixes the path.

    modules: (id, package, package_root).
    """
    own = config["architecture"]["features"]
    roots = [r.strip("/") for r in own["roots"] or [own["root"]]]
    full = lambda r: F.when(F.col("package_root") == "", F.lit(r)).otherwise(F.concat("package_root", F.lit(f"/{r}")))

    def one(r: str) -> Column:
        rest = F.when(F.col("id").startswith(F.concat(full(r), F.lit("/"))), F.substring_index(F.substring(F.col("id"), F.length(full(r)) + 2, F.length("id")), "/", 1))
        return F.when(rest != "", F.struct(rest.alias("feature"), full(r).alias("root")))

    found = modules.select(F.col("id").alias("module"), "package", F.coalesce(*map(one, roots)).alias("f"))
    return found.where("f is not null").select("module", "package", "f.feature", "f.root")


def module_format(path: Column, scope_type: Column) -> Column:
    """esm or commonjs by extension, else by the nearest manifest's type."""
    ext = extension(path)
    return F.when(ext.isin("mjs", "mts"), "esm").when(ext.isin("cjs", "cts"), "commonjs").when(scope_type == "module", "esm").otherwise("commonjs")


#: Adapters of other frameworks: from modules (path, package_root, directives, exported_runtime, marker_imports, kind) to a column of
#: (adapter_id, attributes, runtime) structs, null where an adapter has no say. The first that has one is taken.
ADAPTERS: list[Callable[[DataFrame], Column]] = []


def with_framework(df: DataFrame) -> DataFrame:
    """``df`` with f (adapter_id, attributes, runtime) by the conventions of the app and pages routers.

    df: path, package_root, directives, exported_runtime, marker_imports. What later
    steps use more than once is a column of its own, so no expression is repeated.
    """
    path, clean = F.col("path"), F.trim(F.col("package_root"), F.lit("/"))
    relative = F.when((clean == "") | (clean == "."), F.regexp_replace(path, r"^(\./)+", "")).when(path.startswith(F.concat(clean, F.lit("/"))), F.substring(path, F.length(clean) + 2, F.length(path))).otherwise(path)
    part = lambda i: F.get("_parts", i if not isinstance(i, int) else F.lit(i))
    at = lambda router: F.when(part(0) == router, 0).when((part(0) == "src") & (part(1) == router), 1)
    d = df.withColumn("_parts", F.split(relative, "/")).withColumn("_name", stem(path))
    d = d.withColumn("_app", at("app").isNotNull()).withColumn("_at", at("pages"))
    d = d.withColumn("_pages", ~F.col("_app") & F.col("_at").isNotNull())
    d = d.withColumn("_client", F.array_contains("directives", "use client")).withColumn("_server", F.array_contains("directives", "use server"))
    name = F.col("_name")
    pick = lambda names, rest: reduce(lambda c, kv: c.when(name == kv[0], kv[1]), list(names.items())[1:], F.when(name == next(iter(names)), next(iter(names.values())))).otherwise(rest)
    action = F.when(F.col("_server"), "server-action-module").otherwise("module")
    middleware = (name == "middleware") & ((F.size("_parts") == 1) | ((F.size("_parts") == 2) & (part(0) == "src")))
    app_role = pick({"page": "page", "layout": "layout", "route": "route-handler", "loading": "loading", "error": "error-boundary", "not-found": "not-found", "template": "template"}, action)
    page_role = F.when(part(F.col("_at") + 1) == "api", "api-route").otherwise(pick({"_app": "custom-app", "_document": "custom-document", "_error": "custom-error"}, F.lit("page")))
    d = d.withColumn("_role", F.when(middleware, "middleware").when(F.col("_app"), app_role).when(F.col("_pages"), page_role).otherwise(action))
    so, co = F.array_contains("marker_imports", "server-only"), F.array_contains("marker_imports", "client-only")
    explicit = F.when(F.col("exported_runtime") == "edge", "edge").when(F.col("exported_runtime") == "nodejs", "node")
    served = F.col("_app") | F.col("_role").isin("api-route", "custom-document", "server-action-module")
    ladder = [(so & co, "unknown", "conflicting-marker"), (so, "server", "marker-package"), (co, "browser", "marker-package"), (explicit.isNotNull(), explicit, "explicit"), (F.col("_client"), "browser", "directive"), (F.col("_role") == "middleware", "edge", "convention"), (served, "server", "convention")]
    step = reduce(lambda c, x: c.when(x[0], x[2]), ladder[1:], F.when(ladder[0][0], ladder[0][2])).otherwise("default")
    d = d.withColumn("_source", step)
    runtime = F.when(F.col("_source") == "explicit", explicit).when(F.col("_source") == "marker-package", F.when(so, "server").otherwise("browser"))
    runtime = runtime.when(F.col("_source") == "conflicting-marker", "unknown").when(F.col("_source") == "directive", "browser").when(F.col("_source") == "convention", F.when(F.col("_role") == "middleware", "edge").otherwise("server")).otherwise("universal")
    d = d.withColumn("_runtime", runtime)
    yes = lambda c: c.cast("string")
    attributes = F.create_map(
        F.lit("router"), F.when(F.col("_app"), "app").when(F.col("_pages"), "pages").otherwise("none"), F.lit("role"), F.col("_role"), F.lit("component"), F.when(F.col("_client"), "client").when(F.col("_app"), "server").otherwise("none"),
        F.lit("runtime"), F.col("_runtime"), F.lit("runtimeSource"), F.col("_source"), F.lit("useClient"), yes(F.col("_client")), F.lit("useServer"), yes(F.col("_server")),
        F.lit("rpcBoundary"), yes(F.col("_server")), F.lit("serverOnly"), yes(so), F.lit("clientOnly"), yes(co),
    )
    return d.withColumn("f", F.struct(F.lit("nextjs").alias("adapter_id"), attributes.alias("attributes"), F.col("_runtime").alias("runtime"))).select(*df.columns, "f")


def propagate_client(modules: DataFrame, dependencies: DataFrame, mode: str = "auto") -> DataFrame:
    """Modules that browser modules reach through universal ones become browser modules, over edges of every kind."""
    attrs = F.col("framework.attributes")
    source, role = F.coalesce(attrs["runtimeSource"], F.lit("")), F.coalesce(attrs["role"], F.lit(""))
    may = (F.col("runtime") == "universal") | ((F.col("runtime") == "server") & (source == "convention") & (role == "module"))
    roots = modules.where((F.col("kind") != "external") & (F.col("runtime") == "browser")).select(F.col("id").alias("node"))
    if not roots.limit(1).count():
        return modules
    shut = modules.where((~may & (F.col("runtime") != "browser")) | F.coalesce(attrs["rpcBoundary"] == "true", F.lit(False))).select(F.col("id").alias("node"))
    hit = reachable(dependencies.select("from", "to"), roots, shut, mode).withColumnsRenamed({"node": "id"}).withColumn("hit", F.lit(True))
    on = F.coalesce(F.col("hit"), F.lit(False)) & may & (F.col("kind") != "external")
    marks = F.create_map(*[F.lit(x) for x in ("runtime", "browser", "runtimeSource", "propagated", "component", "client")])
    kept = F.map_filter(F.coalesce(attrs, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("runtime", "runtimeSource", "component"))
    joined = modules.join(hit, "id", "left").withColumn("on", on)
    return joined.withColumn("framework", F.when(F.col("on"), F.struct(F.col("framework.adapter_id").alias("adapter_id"), F.map_concat(kept, marks).alias("attributes"))).otherwise(F.col("framework"))).withColumn("runtime", F.when(F.col("on"), "browser").otherwise(F.col("runtime"))).select(modules.columns)
