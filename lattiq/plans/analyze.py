"""From files to diagnostics: scan, parse, resolve, classify, rules, post-processing."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.config import Config, ConfigError
from lattiq.operators import classify, diagnostics, graphs, resolve, rules
from lattiq.operators.hygiene import candidate_text
from lattiq.schemas import MODULES, Frames, empty
from lattiq.sources import repository
from lattiq.sources.parser import parse_files
from lattiq.storage import sized, written

MAPS = "map<string,string>"


@dataclass
class Inputs:
    """The relations that a project is made from; any source can fill them."""

    files: DataFrame  # FILES to analyse
    inputs: DataFrame  # path, source of manifests and settings
    every: DataFrame  # path of all files that exist
    name: str = "project"


@dataclass
class Analysis:
    frames: Frames
    config: Config
    diagnostics: DataFrame
    context: rules.Context
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.frames.spark


def read_project(spark: SparkSession, root: str, config: Config) -> Inputs:
    files, inputs = repository.discover(spark, root, config)
    every = repository.scan(spark, root).select("path")
    return Inputs(files, inputs, written(every, "every"), os.path.basename(root.rstrip("/")) or "project")


def materialise(spark: SparkSession, given: Inputs, config: Config, mode: str = "auto", overlays: DataFrame | None = None, parse=parse_files, resolver=resolve.resolve) -> Frames:
    """All relations of a project, up to the client runtime's propagation; ``parse`` and ``resolver`` may keep what they find."""
    files = repository.overlaid(given.files, overlays) if overlays is not None else given.files
    every = given.every.select("path").unionByName(files.select("path")).distinct()
    manifests = repository.manifests(spark, given.inputs)
    parsed = written(parse(files), "parsed")
    imports = parsed.where("error is null").select(F.col("path").alias("module_id"), F.posexplode("imports").alias("k", "i")).select("module_id", "i.specifier", "i.kind", "i.location", F.struct("module_id", "k").alias("o"))
    imports = written(imports.orderBy("o").withColumn("ord", F.monotonically_increasing_id()).drop("o"), "imports")
    found = written(resolver(imports, every, manifests, repository.tsconfigs(spark, given.inputs), repository.scopes(given.inputs), config), "found")
    to = F.when(F.col("outcome") == "module", F.col("value")).when(F.col("outcome").isin("external", "builtin"), F.concat("outcome", F.lit(":"), "value"))
    dependencies = found.where(to.isNotNull()).select(F.col("module_id").alias("from"), to.alias("to"), "kind", "location", "ord")
    modules = modules_of(given, parsed, found, manifests, config)
    features = written(classify.features(modules.where("kind != 'external'"), config), "features")
    modules = written(modules.drop("package_root"), "modules")
    ownership = classify.ownership(modules, config)
    twice = ownership.where("status = 'overlap'").orderBy("module").limit(1).collect()
    if twice:
        raise ConfigError(f"module `{twice[0].module}` matches multiple architecture layers: {', '.join(twice[0].layers)}")
    modules = written(classify.propagate_client(modules, dependencies, mode), "modules")
    inner = manifests.select(F.col("root").alias("_root"), F.col("name").alias("_name"))
    targets = classify.nearest(found.where("outcome = 'module'").select("value").distinct(), "value", inner, "_root").select("value", F.col("_name").alias("target_package"))
    kind = F.when(F.col("outcome") == "module", F.when(F.col("target_package").isNotNull(), "workspace").otherwise("internal")).when(F.col("outcome").isin("external", "builtin"), F.col("outcome")).otherwise("unresolved")
    module = F.when(F.col("outcome") == "module", F.col("value"))
    name = F.when(F.col("outcome").isin("external", "builtin"), F.col("value"))
    reason = F.when(F.col("outcome") == "unresolved", F.lit(resolve.UNRESOLVED)).when(F.col("outcome") == "invalid", F.col("value"))
    resolved = found.join(targets, "value", "left").select(F.col("module_id").alias("from"), "specifier", "kind", kind.alias("target_kind"), "target_package", module.alias("target_module"), name.alias("target_name"), reason.alias("reason"), "location", "ord")
    packages = modules.where("kind = 'external'").select(F.col("package").alias("name"), F.lit("").alias("root_path")).unionByName(classify.packages_of(modules.where("kind != 'external'").select("path"), manifests, given.name).select(F.col("package").alias("name"), F.col("package_root").alias("root_path"))).dropDuplicates(["name"])
    return Frames(
        modules=modules, dependencies=written(dependencies, "dependencies"), resolved=written(resolved, "resolved"), packages=packages, declared=repository.declared(manifests), ownership=ownership, features=features,
        facts=facts(parsed, found), comments=parsed.where("error is null").select("path", F.explode("comments").alias("comment")), files=files, extra={"parsed": parsed, "found": found, "imports": imports, "inputs": given.inputs, "every": every},
    )


def modules_of(given: Inputs, parsed: DataFrame, found: DataFrame, manifests: DataFrame, config: Config) -> DataFrame:
    """Source modules, and those that imports bring in: excluded files, externals, builtins."""
    source = parsed.select("path", "directives", "exported_runtime", "marker_imports", F.lit("source").alias("kind"))
    none = F.array().cast("array<string>")
    excluded = found.where("outcome = 'module'").select(F.col("value").alias("path")).distinct().join(source.select("path"), "path", "left_anti").select("path", none.alias("directives"), F.lit(None).cast("string").alias("exported_runtime"), none.alias("marker_imports"), F.lit("excluded").alias("kind"))
    own = source.unionByName(excluded)
    own = own.join(classify.packages_of(own.select("path"), manifests, given.name), "path")
    framework = config["framework"]
    forced = F.lit("nextjs" in framework["enabled"])
    if framework["auto_detect"]:
        scores = repository.frameworks(given.inputs).where("score > 0").select(F.col("directory").alias("package_root"), F.lit(True).alias("detected"))
        own = own.join(scores, "package_root", "left")
        forced = forced | F.coalesce("detected", F.lit(False))
    layers = classify.layers_of(F.col("path"), config)
    # sources outside a framework keep no runtime of their own
    own = written(classify.with_framework(own.withColumn("forced", forced)), "classified")
    own = own.withColumn("f", F.coalesce(*[make(own).cast(own.schema["f"].dataType) for make in classify.ADAPTERS], F.when(F.col("forced"), F.col("f")))).withColumn("layer", F.get(layers, F.lit(0)))
    plain = F.struct(F.lit(None).cast("string").alias("adapter_id"), F.create_map().cast(MAPS).alias("attributes"))
    own = own.select(F.col("path").alias("id"), "path", "package", "kind", F.coalesce("f.runtime", F.lit("unknown")).alias("runtime"), "layer", F.when(F.col("f").isNotNull(), F.struct("f.adapter_id", "f.attributes")).otherwise(plain).alias("framework"), "package_root")
    outer = found.where("outcome in ('external', 'builtin')").select("outcome", "value").distinct()
    ext = outer.select(F.concat("outcome", F.lit(":"), "value").alias("id"), F.concat("outcome", F.lit(":"), "value").alias("path"), F.when(F.col("outcome") == "builtin", "node").otherwise(F.col("value")).alias("package"), F.lit("external").alias("kind"), F.when(F.col("outcome") == "builtin", "node").otherwise("unknown").alias("runtime"), F.lit(None).cast("string").alias("layer"), plain.alias("framework"), F.lit("").alias("package_root"))
    return own.unionByName(ext)


def facts(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """PARSE-001, RESOLVE-001 and RESOLVE-002."""
    bad = parsed.where("error is not null")
    at = F.struct(F.col("path").alias("file"), F.col("error.line").alias("line"), F.col("error.column").alias("column"))
    none = F.array().cast("array<string>")
    parse = diagnostics.of(bad, "PARSE-001", F.col("error.message"), none, at)
    lost = found.where("outcome = 'unresolved'")
    miss = diagnostics.of(lost, "RESOLVE-001", F.format_string("Cannot resolve `%s`", "specifier"), F.array("module_id"), F.col("location"), metadata={"specifier": F.col("specifier")}, target=F.concat(F.lit("unresolved:"), "specifier"))
    listed = diagnostics.of(lost, "RESOLVE-001", F.format_string("Cannot resolve `%s`", "specifier"), F.array("module_id"), F.col("location"), metadata={"specifier": F.col("specifier"), "candidatePaths": candidate_text(F.col("candidates"))}, target=F.concat(F.lit("unresolved:"), "specifier"))
    miss = listed.where("metadata['candidatePaths'] != '[]'").unionByName(miss.join(sized(lost.where("size(candidates) = 0").select(F.col("location").alias("primary_location")).distinct()), "primary_location", "left_semi").select(miss.columns))
    wrong = diagnostics.of(found.where("outcome = 'invalid'"), "RESOLVE-002", F.col("value"), none, F.col("location"))
    return diagnostics.fingerprinted(parse.unionByName(miss).unionByName(wrong))


def post_process(raw: DataFrame, frames: Frames, config: Config, directive: str = "lattiq-ignore", file: str = "lattiq.yaml") -> DataFrame:
    """Arbitrate, then suppressions of sources, then those configured."""
    diags = diagnostics.arbitrate(raw)
    supp = config["suppressions"]
    if frames.comments is not None:
        declared, wrong = diagnostics.directives(frames.comments, supp["require_reason"], directive)
        diags = diagnostics.suppress_by_source(diags.unionByName(wrong), written(declared, "directives"), supp["report_unused"])
    return diagnostics.suppress_by_config(written(diags, "diagnostics"), config, file)


def analyze(spark: SparkSession, frames: Frames, config: Config, mode: str = "auto", only: set[str] | None = None, affected: DataFrame | None = None, directive: str = "lattiq-ignore", file: str = "lattiq.yaml") -> Analysis:
    """Rules and post-processing over a project's relations."""
    began = time.time()
    context = rules.Context(frames, config, mode, affected)
    raw = rules.evaluate(context, only)
    raw = raw.unionByName(frames.facts) if frames.facts is not None else raw
    diags = written(post_process(written(raw, "raw"), frames, config, directive, file), "final")
    return Analysis(frames, config, diags, context, {"rules_s": time.time() - began})


def check(spark: SparkSession, root: str, config: Config, mode: str = "auto", overlays: DataFrame | None = None, cache: str | None = None, **kw) -> Analysis:
    """A source tree from end to end; parsed facts and resolutions are kept in tables below ``cache`` where one is named."""
    began = time.time()
    given = read_project(spark, root, config)
    scanned = time.time()
    parse, resolver, again = parse_files, resolve.resolve, []
    if cache:
        from lattiq.plans import incremental, restore
        from lattiq.plans.store import Store

        parse = incremental.cached_parser(Store(spark, f"{cache}/parsed"))
        answers = Store(spark, f"{cache}/resolutions")

        def resolver(*relations):
            found, done = restore.restored(answers, *relations, restore.settings_hash(given.inputs, config))
            again.append(done)
            return found

    frames = materialise(spark, given, config, mode, overlays, parse, resolver)
    built = time.time()
    out = analyze(spark, frames, config, mode, **kw)
    out.timings |= {"scan_s": scanned - began, "facts_s": built - scanned}
    if again:
        out.timings |= {"requests": again[0].requests, "resolved_again": again[0].resolved}
    return out


def union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark, MODULES)


__all__ = ["Analysis", "Inputs", "analyze", "check", "graphs", "materialise", "read_project"]
