"""What a caller can ask of an analysis: inspection, overview, explanations, paths, policies, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators import graphs
from lattiq.operators.diagnostics import FIELDS, in_baseline
from lattiq.registry import RULES
from lattiq.schemas import Frames

#: Extensions and index files that a deleted path may have been imported by (fixed values).
TAILS = r"(?:/index)?\.[cm]?[jt]sx?$"


def counts_by_kind(modules: DataFrame) -> DataFrame:
    return modules.groupBy("kind").agg(F.count(F.lit(1)).alias("modules"))


def find_module(modules: DataFrame, query: str) -> DataFrame:
    """The module that a path as typed means."""
    text = query.replace("\\", "/")
    while text.startswith("./"):
        text = text[2:]
    return modules.where(F.col("id").isin(text, query))


def edges_of(dependencies: DataFrame, module: str) -> DataFrame:
    """direction, module, kind, file, line, column of a module's edges, sorted."""
    one = lambda own, other, name: dependencies.where(F.col(own) == module).select(F.lit(name).alias("direction"), F.col(other).alias("module"), "kind", F.col("location.file").alias("file"), F.col("location.line").alias("line"), F.col("location.column").alias("column"))
    return one("from", "to", "dependency").unionByName(one("to", "from", "dependent")).orderBy("direction", "module", "line", "column", "kind")


def touching(diags: DataFrame, module: str) -> DataFrame:
    return diags.where((F.col("primary_location.file") == module) | F.array_contains("dependency_path", module))


def inspect(frames: Frames, diags: DataFrame, module: str) -> dict[str, DataFrame]:
    """module (with ownership, feature and runtime explained), edges and diagnostics."""
    own = explain_runtime(frames.modules.where(F.col("id") == module))
    own = own.join(frames.ownership.withColumnRenamed("module", "id"), "id", "left").join(frames.features.select(F.col("module").alias("id"), "feature"), "id", "left")
    return {"module": own, "edges": edges_of(frames.dependencies, module), "diagnostics": touching(diags, module)}


def explain_runtime(modules: DataFrame) -> DataFrame:
    """``modules`` with runtime_source and runtime_reason."""
    attrs = F.col("framework.attributes")
    source = F.coalesce(attrs["runtimeSource"], F.when((F.col("kind") == "external") & (F.col("runtime") == "node"), "builtin").otherwise("none"))
    said = F.col("runtime_source")
    reason = (
        F.when(said == "explicit", "the module exports an explicit `runtime` value")
        .when((said == "marker-package") & (F.col("runtime") == "server"), "the module imports the `server-only` marker package")
        .when(said == "marker-package", "the module imports the `client-only` marker package")
        .when(said == "conflicting-marker", "the module imports both `server-only` and `client-only`")
        .when(said == "directive", 'the module starts with the `"use client"` directive')
        .when(said == "convention", F.format_string("framework convention for role `%s`", F.coalesce(attrs["role"], F.lit("module"))))
        .when(said == "propagated", "imported (transitively) by a browser boundary, so it is bundled for the browser")
        .when(said == "default", "no runtime evidence; the module is treated as universal")
        .when(said == "builtin", "Node.js builtin module")
        .when(F.col("kind") == "external", "external package")
        .otherwise("no framework adapter classified this module")
    )
    return modules.withColumn("runtime_source", source).withColumn("runtime_reason", reason)


def propagation_paths(frames: Frames, mode: str = "auto") -> DataFrame:
    """node and path of browser modules from declared ones, through browser modules only."""
    browser = frames.modules.where("runtime = 'browser'")
    ids = browser.select("id")
    edges = frames.dependencies.select("from", "to").join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    roots = browser.where((F.col("kind") != "external") & ~F.coalesce(F.col("framework.attributes")["runtimeSource"] == "propagated", F.lit(False)))
    return graphs.spread(edges, roots.select(F.lit("browser").alias("label"), F.col("id").alias("node")), mode=mode).select("node", "path")


def overview(frames: Frames, diags: DataFrame) -> DataFrame:
    """section, name and members (sorted): modules by package, layer, feature and runtime, open diagnostics by rule."""
    source = frames.modules.where("kind = 'source'")
    groups = {"package": F.col("package"), "layer": F.coalesce("layer", F.lit("(unassigned)")), "runtime": F.col("runtime")}
    rows = [source.select(F.lit(k).alias("section"), v.alias("name"), F.col("id").alias("member")) for k, v in groups.items()]
    rows.append(frames.features.select(F.lit("feature").alias("section"), F.format_string("%s (%s)", "feature", "package").alias("name"), F.col("module").alias("member")))
    rows.append(diags.where("not suppressed").select(F.lit("rule").alias("section"), F.col("rule_id").alias("name"), F.col("fingerprint").alias("member")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("section", "name").agg(F.sort_array(F.collect_list("member")).alias("members"))


def governs(start: Column, end: Column) -> Column:
    """Whether a diagnostic's path has the edge, or the edge of its packages."""
    steps = F.zip_with(F.col("dependency_path"), F.expr("slice(dependency_path, 2, size(dependency_path))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(steps, lambda s: (s["a"] == start) & (s["b"] == end))


def dependency_policy(frames: Frames, diags: DataFrame, start: str, end: str) -> DataFrame:
    """verdict (allowed, denied, indeterminate) on a dependency, with the rules that govern it; one row."""
    of = {r.id: r.package for r in frames.modules.where(F.col("id").isin(start, end)).select("id", "package").collect()}
    pair = governs(F.lit(start), F.lit(end)) | governs(F.lit(f"package:{of.get(start)}"), F.lit(f"package:{of.get(end)}"))
    rules = diags.where(pair & ~F.col("suppressed")).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    exists = frames.dependencies.where((F.col("from") == start) & (F.col("to") == end)).agg((F.count(F.lit(1)) > 0).alias("exists"))
    return rules.join(exists).select(F.when(F.size("rules") > 0, "denied").when(F.col("exists"), "allowed").otherwise("indeterminate").alias("verdict"), "rules", "exists")


def dependency_path(frames: Frames, start: str, end: str, mode: str = "auto") -> DataFrame:
    return graphs.shortest_path(frames.dependencies, start, end, mode)


def impact(frames: Frames, changes: DataFrame, mode: str = "auto") -> DataFrame:
    """path of all that depends on a change: changed modules, importers of deleted ones, and what reaches them."""
    edges = frames.dependencies.select("from", "to")
    seeds = changes.select(F.col("path").alias("node")).join(frames.modules.select(F.col("id").alias("node")), "node", "left_semi")
    deleted = changes.where("status = 'D'").select("path")
    if frames.facts is not None:
        lost = frames.facts.where("rule_id = 'RESOLVE-001'").select(F.get("dependency_path", F.lit(0)).alias("node"), F.explode(F.from_json(F.coalesce(F.col("metadata")["candidatePaths"], F.lit("[]")), "array<string>")).alias("path"))
        seeds = seeds.unionByName(lost.join(deleted, "path", "left_semi").select("node")).distinct()
    return graphs.spread(edges, seeds.select(F.lit("change").alias("label"), "node"), back=True, mode=mode, paths=False).select(F.col("node").alias("path"))


def edge_region(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """path of seeds (path) and their direct neighbours on both sides."""
    out = edges.join(seeds.withColumnRenamed("path", "from"), "from", "left_semi").select(F.col("to").alias("path"))
    into = edges.join(seeds.withColumnRenamed("path", "to"), "to", "left_semi").select(F.col("from").alias("path"))
    return seeds.select("path").unionByName(out).unionByName(into).distinct()


def deleted_targets(imports: DataFrame, deleted: DataFrame) -> DataFrame:
    """Imports of relative paths that meant a deleted file, by its path without extension or index."""
    from lattiq.functions.paths import normal, parent

    base = normal(F.concat(parent(F.col("module_id")), F.lit("/"), F.col("specifier")))
    gone = deleted.select(F.explode(F.array(F.regexp_replace("path", TAILS, ""), F.regexp_replace("path", r"\.[cm]?[jt]sx?$", ""), "path")).alias("base")).distinct()
    return imports.where(F.col("specifier").startswith(".")).withColumn("base", base).join(gone, "base", "left_semi").drop("base")


def changed_only(diags: DataFrame, direct: DataFrame, affected: DataFrame) -> DataFrame:
    """Diagnostics that a change can concern: of rules on edges those in changed files, of closures those in what is affected, of others all if anything changed."""
    scope = F.create_map(*[F.lit(x) for r in RULES.values() for x in (r.id, r.scope)])[F.col("rule_id")]
    d = diags.withColumn("scope", scope)
    places = F.array_union(F.array(F.coalesce("primary_location.file", F.lit(""))), "dependency_path")
    hit = lambda rows, paths: rows.withColumn("p", F.explode(places)).join(paths.select(F.col("path").alias("p")).distinct(), "p", "left_semi").drop("p").dropDuplicates(["fingerprint"])
    some = direct.limit(1).count() > 0
    out = hit(d.where("scope = 'edge'"), direct).unionByName(hit(d.where("scope = 'closure'"), affected)).unionByName(d.where((F.col("scope") == "global") & F.lit(some)))
    return out.select(FIELDS)


def introduced(diags: DataFrame, baseline: DataFrame) -> DataFrame:
    return in_baseline(diags.where("not suppressed"), baseline, False)


def edge_locations(diags: DataFrame, dependencies: DataFrame) -> DataFrame:
    """fingerprint, hop, from, to and location of each step of each path."""
    steps = diags.select("fingerprint", F.posexplode("dependency_path").alias("hop", "from"), F.expr("dependency_path").alias("p")).withColumn("to", F.get("p", F.col("hop") + 1)).where("`to` is not null").drop("p")
    first = dependencies.groupBy("from", "to").agg(F.min_by("location", "ord").alias("location"))
    return steps.join(first, ["from", "to"])


def rules_table(spark) -> DataFrame:
    """The registry as a table."""
    return spark.createDataFrame([(r.id, r.title, r.description, r.category, r.scope, r.configurable) for r in RULES.values()], "rule_id string, title string, description string, category string, scope string, configurable boolean")
