"""The configurable rules: each a query from a project's relations to diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.config import Config
from lattiq.functions.globs import matches
from lattiq.operators import diagnostics as D
from lattiq.operators import graphs
from lattiq.schemas import DIAGNOSTICS, Frames, empty
from lattiq.storage import small, written

#: Messages and suggestions as reports carry them (fixed values).
CYCLE = "Circular dependency detected", "Break the cycle by extracting a lower-level module or dependency port."
FORBIDDEN = "Dependency is forbidden by architecture policy", "Remove the dependency or explicitly revise the policy."
LAYER = "Layer `%s` cannot import `%s`", "Depend on an allowed lower layer or introduce an application facade."
FEATURE = "Importer `%s` accesses internals of feature `%s` in package `%s`", "Import the target feature's public index entrypoint."
PRIVATE = "Private module imported outside its public API", "Import from the module's public entrypoint."
DEPTH = "Dependency depth %d exceeds configured maximum %d", "Introduce a facade or split the dependency chain at a stable boundary."
COUPLING = "%s %d exceeds configured maximum %d", "Split responsibilities or introduce a stable facade to reduce direct coupling."
ORPHAN = "Source module is unreachable from every configured architecture entrypoint", "Remove the orphan, export it from a reachable module, or add an intentional entrypoint."
UNASSIGNED = "Source module is not assigned to any architecture layer", "Anchor the module under a configured layer pattern or explicitly exempt it in architecture.coverage.allow_unassigned."
COVERAGE = "Architecture layer coverage %d%% is below the configured minimum %d%%", "Assign unowned modules to layers, lower the intentional threshold, or explicitly exempt support paths."
PACKAGE_CYCLE = "Circular workspace package dependency detected", "Move the shared contract into a lower-level package or invert one dependency through a port."
PACKAGE_FORBIDDEN = "Package dependency is forbidden by architecture policy", "Remove the dependency or revise the explicit package policy."
UNDECLARED = "Workspace package `%s` is not declared by `%s`", "Add the workspace package to dependencies, devDependencies, peerDependencies, or optionalDependencies."
CROSS_PACKAGE = "Relative import crosses package boundary from `%s` to `%s`", "Import the target package by its declared package name and public entrypoint."
TO_SERVER = "Browser module transitively depends on server-only code", "Move the server operation behind a Server Action or another explicit RPC boundary."
TO_NODE = "Browser module transitively depends on Node-only code", "Split the Node implementation from its browser-safe contract."
TO_PACKAGE = "Browser module reaches a browser-incompatible package", "Replace the package with a browser-safe adapter or keep it behind a server boundary."
EDGE = "Edge module reaches a dependency unavailable in the Edge runtime", "Use an Edge-compatible implementation or move this operation to the Node runtime."
AMBIGUOUS = "Universal module combines incompatible browser and server requirements", "Split the shared contract from browser and server implementations."
RUNTIME_CYCLE = "Dependency cycle crosses incompatible runtime domains", "Break the cycle at a runtime-neutral contract or an explicit transport boundary."
ARROW = " -> "


@dataclass
class Context:
    """A project with its configuration; what several rules need is computed once.

    affected (path), if given, limits rules on edges to those that touch it. together: many rules are asked, so what leads
    to any target is found in one loop.
    """

    frames: Frames
    config: Config
    mode: str = "auto"
    affected: DataFrame | None = None
    cache: dict[str, DataFrame] = field(default_factory=dict)
    together: bool = False

    @cached_property
    def edges(self) -> DataFrame:
        """Known edges, one for each pair and kind."""
        return written(graphs.build(self.frames.dependencies, self.frames.modules), "edges")

    @cached_property
    def places(self) -> DataFrame:
        """The first location of each pair of modules."""
        return self.frames.dependencies.groupBy("from", "to").agg(F.min_by("location", "ord").alias("location"))

    @cached_property
    def packages(self) -> DataFrame:
        return graphs.package_edges(self.frames.dependencies, self.frames.modules)

    @property
    def dependencies(self) -> DataFrame:
        deps = self.frames.dependencies
        if self.affected is None:
            return deps
        hit = lambda end: deps.join(self.affected.select(F.col("path").alias(end)), end, "left_semi")
        return hit("from").unionByName(hit("to")).dropDuplicates(["ord"])

    @property
    def sources(self) -> DataFrame:
        own = self.frames.modules.where("kind = 'source'")
        return own if self.affected is None else own.join(self.affected.withColumnRenamed("path", "id"), "id", "left_semi")

    def option(self, rule: str, name: str):
        return self.config.rule(rule).get(name)

    @cached_property
    def runtime_edges(self) -> DataFrame:
        return self.edges.where("kind != 'TypeOnly'").select("from", "to").distinct()

    @cached_property
    def boundaries(self) -> DataFrame:
        return self.frames.modules.where(F.col("framework.attributes")["rpcBoundary"] == "true").select(F.col("id").alias("node"))

    def with_runtime(self, runtime: str) -> DataFrame:
        """Modules that declare a runtime: not external, and no browser by propagation."""
        own = (F.col("kind") != "external") & (F.col("runtime") == runtime)
        if runtime == "browser":
            own = own & ~F.coalesce(F.col("framework.attributes")["runtimeSource"] == "propagated", F.lit(False))
        return self.frames.modules.where(own).select(F.col("id").alias("node"))

    def incompatible(self, globs: list[str]) -> DataFrame:
        return self.frames.modules.where((F.col("kind") == "external") & matches(F.col("package"), globs)).select(F.col("id").alias("node"))

    def targets(self) -> dict[str, DataFrame]:
        """The sets of targets that runtime rules lead to, by label."""
        mods, runtime = self.frames.modules, self.config["runtime"]
        with_runtimes = lambda *rs: mods.where(F.col("runtime").isin(*rs)).select(F.col("id").alias("node"))
        found = {"server": with_runtimes("server"), "node": with_runtimes("node"), "server+node": with_runtimes("server", "node"), "declared": self.with_runtime("browser")}
        return found | {f"{k}-packages": self.incompatible(runtime[f"{k}_incompatible_packages"]) for k in ("browser", "edge") if runtime[f"{k}_incompatible_packages"]}

    def reach(self, *labels: str) -> DataFrame:
        """label, node, dist, path to the nearest target of these sets; of all sets in one loop where several rules ask."""
        targets = self.targets()
        own = tuple(x for x in targets if self.together or x in labels)
        key = "reach " + " ".join(own)
        if key not in self.cache:
            seeds = [targets[x].select(F.lit(x).alias("label"), "node") for x in own]
            self.cache[key] = written(graphs.spread(self.runtime_edges, reduce(DataFrame.unionByName, seeds), self.boundaries, back=True, mode=self.mode), "reach")
        return self.cache[key].where(F.col("label").isin(*labels))

    def paths_to(self, label: str) -> DataFrame:
        return self.reach(label).select("node", "dist", "path")


def edge_diagnostics(df: DataFrame, rule: str, message, suggestion: str, policy: str = "dependency-policy") -> DataFrame:
    return D.of(df, rule, message, F.array("from", "to"), F.col("location"), suggestion, {"dependencyKind": F.col("kind"), "policy": policy})


def at_module(module: Column) -> Column:
    return F.struct(module.alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"))


def circular(c: Context) -> DataFrame:
    edges = c.edges if c.option("ARCH-001", "include_type_only") else c.edges.where("kind != 'TypeOnly'")
    return D.of(with_place(c, graphs.cycles(edges, c.mode), "cycle"), "ARCH-001", CYCLE[0], F.col("cycle"), F.col("location"), CYCLE[1])


def with_place(c: Context, df: DataFrame, path: str) -> DataFrame:
    """The location of the first edge of a path."""
    return df.withColumn("from", F.get(path, F.lit(0))).withColumn("to", F.get(path, F.lit(1))).join(c.places, ["from", "to"], "left")


def forbidden(c: Context) -> DataFrame:
    arch = c.config["architecture"]
    a, b = F.translate("from", "\\", "/"), F.translate("to", "\\", "/")
    hit = reduce(lambda x, y: x | y, (matches(a, [p["from"]]) & matches(b, [p["to"]]) for p in arch["forbidden_dependencies"]), F.lit(False))
    if arch["presets"]["monorepo_boundaries"]:
        below = lambda x, name: x.startswith(f"{name}/") | x.contains(f"/{name}/")
        hit = hit | (below(a, "packages") & below(b, "apps"))
    return edge_diagnostics(c.dependencies.where(hit), "ARCH-002", *FORBIDDEN)


def layer_boundary(c: Context) -> DataFrame:
    of = c.frames.modules.where("layer is not null").select("id", "layer")
    both = c.dependencies.join(of.toDF("from", "from_layer"), "from").join(of.toDF("to", "to_layer"), "to").where("from_layer != to_layer")
    allowed = [(a, b) for a, layer in c.config.layers.items() for b in layer.get("can_import", [])]
    known = F.col("from_layer").isin(*c.config.layers) if c.config.layers else F.lit(False)
    fine = reduce(lambda x, y: x | y, ((F.col("from_layer") == a) & (F.col("to_layer") == b) for a, b in allowed), F.lit(False))
    return edge_diagnostics(both.where(known & ~fine), "ARCH-003", F.format_string(LAYER[0], "from_layer", "to_layer"), LAYER[1])


def with_features(c: Context) -> DataFrame:
    of = c.frames.features.select("module", F.struct("package", "feature").alias("f"), "root")
    target = of.select(F.col("module").alias("to"), F.col("f").alias("target"), F.col("root").alias("target_root"))
    return c.dependencies.join(target, "to").join(of.select(F.col("module").alias("from"), F.col("f").alias("own")), "from", "left")


def feature_boundary(c: Context) -> DataFrame:
    entries = c.config["architecture"]["features"]["public_entrypoints"]
    prefix = F.concat(F.trim(F.col("target_root"), F.lit("/")), F.lit("/"), F.col("target.feature"), F.lit("/"))
    path = F.translate("to", "\\", "/")
    public = path.startswith(prefix) & matches(F.substring(path, F.length(prefix) + 1, F.length(path)), entries)
    bad = with_features(c).where(~F.col("own").eqNullSafe(F.col("target")) & ~public)
    message = F.format_string(FEATURE[0], F.coalesce("own.feature", F.lit("outside")), "target.feature", "target.package")
    return edge_diagnostics(bad, "ARCH-004", message, FEATURE[1], "feature-public-boundary")


def private_import(c: Context) -> DataFrame:
    segments = c.config["architecture"]["features"]["private_segments"]
    private = F.arrays_overlap(F.split(F.translate("to", "\\", "/"), "/"), F.array(*map(F.lit, segments)).cast("array<string>"))
    bad = with_features(c).where(private & ~F.col("own").eqNullSafe(F.col("target")))
    return edge_diagnostics(bad, "ARCH-005", *PRIVATE, "explicit-private-segment")


def entrypoints(c: Context, rule: str) -> DataFrame:
    own = c.frames.modules.where("kind = 'source'")
    return own.where(matches(F.col("id"), c.option(rule, "entrypoints") or [])).select(F.lit("entry").alias("label"), F.col("id").alias("node"))


def depth(c: Context) -> DataFrame:
    most = c.option("ARCH-006", "max_depth")
    if most is None:
        return none(c)
    far = graphs.spread(c.edges, entrypoints(c, "ARCH-006"), mode=c.mode).where(F.col("dist") > most)
    return D.of(far, "ARCH-006", F.format_string(DEPTH[0], "dist", F.lit(most)), F.col("path"), at_module(F.col("node")), DEPTH[1], {"depth": F.col("dist"), "maximum": most})


def coupling(c: Context, rule: str, option: str, out: bool, label: str) -> DataFrame:
    most = c.option(rule, option)
    if most is None:
        return none(c)
    over = graphs.degrees(c.edges, out).where(F.col("degree") > most).join(c.sources.select(F.col("id").alias("node")), "node", "left_semi")
    return D.of(over, rule, F.format_string(COUPLING[0], F.lit(label), "degree", F.lit(most)), F.array("node"), at_module(F.col("node")), COUPLING[1], {"actual": F.col("degree"), "maximum": most})


def outgoing(c: Context) -> DataFrame:
    return coupling(c, "ARCH-007", "max_fan_out", True, "Outgoing coupling")


def incoming(c: Context) -> DataFrame:
    return coupling(c, "ARCH-008", "max_fan_in", False, "Incoming coupling")


def orphan(c: Context) -> DataFrame:
    if not c.option("ARCH-009", "entrypoints"):
        return none(c)
    reached = graphs.spread(c.edges, entrypoints(c, "ARCH-009"), mode=c.mode, paths=False).select(F.col("node").alias("id"))
    left = c.frames.modules.where("kind = 'source'").join(reached, "id", "left_anti")
    return D.of(left, "ARCH-009", ORPHAN[0], F.array("id"), at_module(F.col("id")), ORPHAN[1])


def unassigned(c: Context) -> DataFrame:
    if not c.config.layers:
        return none(c)
    own = c.frames.ownership.where("status = 'unassigned'")
    own = own if c.affected is None else own.join(c.affected.withColumnRenamed("path", "module"), "module", "left_semi")
    return D.of(own, "ARCH-010", UNASSIGNED[0], F.array("module"), at_module(F.col("module")), UNASSIGNED[1], {"ownership": "unassigned"})


def coverage_of(ownership: DataFrame) -> DataFrame:
    """total, assigned, exempt, unassigned and percent (whole, 100 where nothing counts), one row."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = ownership.agg(F.count(F.lit(1)).alias("total"), n("assigned").alias("assigned"), n("exempt").alias("exempt"), n("unassigned").alias("unassigned"))
    return counts.withColumn("percent", F.expr("CASE WHEN total - exempt = 0 THEN 100 ELSE assigned * 100 div (total - exempt) END"))


def coverage(c: Context) -> DataFrame:
    least = c.config["architecture"]["coverage"]["minimum"]
    if least is None:
        return none(c)
    low = coverage_of(c.frames.ownership).where(F.col("percent") < least)
    # one row by definition holds the list of all unassigned modules
    listed = c.frames.ownership.where("status = 'unassigned'").agg(F.array_sort(F.collect_list("module")).alias("modules"))
    row = low.join(listed)
    first = F.get("modules", F.lit(0))
    return D.of(row, "ARCH-011", F.format_string(COVERAGE[0], "percent", F.lit(least)), F.col("modules"), F.when(first.isNotNull(), at_module(first)), COVERAGE[1], {"coverageStatus": "belowMinimum", "actualPercent": F.col("percent"), "minimumPercent": least, "assignedModules": F.col("assigned"), "exemptedModules": F.col("exempt"), "unassignedModules": F.col("unassigned")})


def prefixed(path: Column) -> Column:
    return F.transform(path, lambda p: F.concat(F.lit("package:"), p))


def package_cycle(c: Context) -> DataFrame:
    found = graphs.cycles(c.packages, c.mode).withColumn("from", F.get("cycle", F.lit(0))).withColumn("to", F.get("cycle", F.lit(1))).join(c.packages.select("from", "to", "location"), ["from", "to"], "left")
    return D.of(found, "PACKAGE-001", PACKAGE_CYCLE[0], prefixed(F.col("cycle")), F.col("location"), PACKAGE_CYCLE[1], {"packages": F.array_join("cycle", ARROW)})


def forbidden_package(c: Context) -> DataFrame:
    policies = c.config["architecture"]["forbidden_package_dependencies"]
    hit = reduce(lambda x, y: x | y, (matches(F.col("from"), [p["from"]]) & matches(F.col("to"), [p["to"]]) for p in policies), F.lit(False))
    return D.of(c.packages.where(hit), "PACKAGE-002", PACKAGE_FORBIDDEN[0], prefixed(F.array("from", "to")), F.col("location"), PACKAGE_FORBIDDEN[1])


def resolved_in_scope(c: Context) -> DataFrame:
    rows = c.frames.resolved.where("target_kind in ('internal', 'workspace')").select("from", F.col("target_module").alias("to"), "target_kind", "target_package", "specifier", "location", "ord")
    if c.affected is None:
        return rows
    hit = lambda end: rows.join(c.affected.select(F.col("path").alias(end)), end, "left_semi")
    return hit("from").unionByName(hit("to")).dropDuplicates(["ord"])


def undeclared(c: Context) -> DataFrame:
    of = c.frames.modules.select(F.col("id").alias("from"), F.col("package").alias("importer"))
    used = resolved_in_scope(c).where("target_kind = 'workspace'").join(of, "from").where("importer != target_package")
    # declared has a row without a dependency for each package that has a manifest
    known = c.frames.declared.select(F.col("package").alias("importer")).distinct()
    said = c.frames.declared.select(F.col("package").alias("importer"), F.col("dependency").alias("target_package"))
    bad = used.join(known, "importer", "left_semi").join(said, ["importer", "target_package"], "left_anti")
    return D.of(bad, "PACKAGE-003", F.format_string(UNDECLARED[0], "target_package", "importer"), F.array("from", "to"), F.col("location"), UNDECLARED[1], {"importerPackage": F.col("importer"), "targetPackage": F.col("target_package")})


def cross_package(c: Context) -> DataFrame:
    of = c.frames.modules.select("id", "package")
    near = resolved_in_scope(c).where(F.col("specifier").startswith("."))
    both = near.join(of.toDF("from", "pf"), "from").join(of.toDF("to", "pt"), "to").where("pf != pt")
    return D.of(both, "PACKAGE-004", F.format_string(CROSS_PACKAGE[0], "pf", "pt"), F.array("from", "to"), F.col("location"), CROSS_PACKAGE[1])


def runtime_diagnostics(c: Context, df: DataFrame, rule: str, words: tuple[str, str], metadata: dict | None = None) -> DataFrame:
    return D.of(with_place(c, df, "path"), rule, words[0], F.col("path"), F.col("location"), words[1], {"runtimePath": F.array_join("path", ARROW)} | (metadata or {}))


def browser_to(c: Context, rule: str, label: str, words: tuple[str, str]) -> DataFrame:
    return runtime_diagnostics(c, c.with_runtime("browser").join(c.paths_to(label), "node"), rule, words)


def browser_to_server(c: Context) -> DataFrame:
    return browser_to(c, "RUNTIME-001", "server", TO_SERVER)


def browser_to_node(c: Context) -> DataFrame:
    return browser_to(c, "RUNTIME-002", "node", TO_NODE)


def browser_package(c: Context) -> DataFrame:
    if not c.config["runtime"]["browser_incompatible_packages"]:
        return none(c)
    found = c.with_runtime("browser").join(c.paths_to("browser-packages"), "node")
    return runtime_diagnostics(c, found, "RUNTIME-003", TO_PACKAGE, {"package": F.regexp_replace(F.element_at("path", -1), "^external:", "")})


def edge_runtime(c: Context) -> DataFrame:
    own = c.with_runtime("edge")
    ways = c.reach("node", "edge-packages").join(own, "node", "left_semi")
    # the shorter way, of equal ones that to a Node module
    best = ways.groupBy("node").agg(F.min_by("path", F.struct("dist", F.col("label") != "node")).alias("path"))
    return runtime_diagnostics(c, best, "RUNTIME-004", EDGE)


def ambiguous(c: Context) -> DataFrame:
    browser = c.paths_to("declared").select("node", F.col("path").alias("browser_path"))
    both = c.with_runtime("universal").join(browser, "node").join(c.paths_to("server+node"), "node")
    return runtime_diagnostics(c, both, "RUNTIME-005", AMBIGUOUS, {"browserPath": F.array_join("browser_path", ARROW)})


def runtime_cycle(c: Context) -> DataFrame:
    found = graphs.cycles(c.runtime_edges, c.mode).withColumn("key", F.array_join("cycle", ARROW))
    of = c.frames.modules.select(F.col("id").alias("module"), "runtime", F.coalesce(F.col("framework.attributes")["rpcBoundary"] == "true", F.lit(False)).alias("rpc"))
    seen = found.select("key", F.explode("cycle").alias("module")).join(of, "module").groupBy("key").agg(F.collect_set("runtime").alias("rs"), F.max("rpc").alias("rpc"))
    has = lambda r: F.array_contains("rs", r)
    bad = seen.where(~F.col("rpc") & ((has("browser") & (has("server") | has("node"))) | (has("edge") & has("node"))))
    return runtime_diagnostics(c, found.join(bad, "key").withColumnRenamed("cycle", "path"), "RUNTIME-006", RUNTIME_CYCLE)


def none(c: Context) -> DataFrame:
    return empty(c.frames.spark, DIAGNOSTICS)


#: Rules by id; a plug-in adds its own function from a Context to diagnostics.
EVALUATORS: dict[str, Callable[[Context], DataFrame]] = {
    "ARCH-001": circular, "ARCH-002": forbidden, "ARCH-003": layer_boundary, "ARCH-004": feature_boundary, "ARCH-005": private_import, "ARCH-006": depth, "ARCH-007": outgoing, "ARCH-008": incoming, "ARCH-009": orphan, "ARCH-010": unassigned, "ARCH-011": coverage,
    "PACKAGE-001": package_cycle, "PACKAGE-002": forbidden_package, "PACKAGE-003": undeclared, "PACKAGE-004": cross_package,
    "RUNTIME-001": browser_to_server, "RUNTIME-002": browser_to_node, "RUNTIME-003": browser_package, "RUNTIME-004": edge_runtime, "RUNTIME-005": ambiguous, "RUNTIME-006": runtime_cycle,
}


def evaluate(c: Context, only: set[str] | None = None) -> DataFrame:
    """Diagnostics of all rules that are on, with severity and fingerprint."""
    c.together = True
    made = [D.with_severity(EVALUATORS[r](c), r, c.config) for r in c.config.enabled_rules(only) if r in EVALUATORS]
    return D.fingerprinted(reduce(DataFrame.unionByName, made, none(c)))


__all__ = ["EVALUATORS", "Context", "coverage_of", "evaluate", "small"]
