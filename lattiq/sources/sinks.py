"""Reports of an analysis: text, JSON, JSON Lines, SARIF, HTML, CI annotations, graph.

Rows are made by Spark expressions; ``write_*`` stay distributed, and a text for a
terminal or one document is put together on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.diagnostics import failure_policy, sorted_by_place
from lattiq.operators.hygiene import escape_annotation
from lattiq.operators.rules import coverage_of
from lattiq.operators.views import counts_by_kind
from lattiq.plans.analyze import Analysis
from lattiq.registry import RULES

SCHEMA_VERSION = 1
#: Most annotations and summary rows that a CI run shows.
ANNOTATIONS, SUMMARY_ROWS = 50, 100
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def record() -> Column:
    """A diagnostic as reports carry it; absent fields are left out."""
    return F.struct(
        "fingerprint", F.col("rule_id").alias("ruleId"), "severity", "message", F.col("primary_location").alias("primaryLocation"), F.col("secondary_locations").alias("secondaryLocations"),
        F.col("dependency_path").alias("dependencyPath"), "suggestion", F.map_from_entries(F.array_sort(F.map_entries("metadata"))).alias("metadata"), "suppressed", F.col("suppression_reason").alias("suppressionReason"),
    )


def json_rows(diags: DataFrame) -> DataFrame:
    return sorted_by_place(diags).select(F.to_json(record()).alias("value"))


def write_jsonl(diags: DataFrame, path: str) -> None:
    """One diagnostic a line, in parts."""
    diags.select(F.to_json(record()).alias("value")).write.mode("overwrite").text(path)


def summary(a: Analysis, fail_on: str | None = None, max_warnings: int | None = None) -> dict:
    """Counts, coverage and the failure policy's result."""
    out = a.config["output"]
    fail_on, most = fail_on or out["fail_on"], out["max_warnings"] if max_warnings is None else max_warnings
    kinds = {r.kind: r.modules for r in counts_by_kind(a.frames.modules).collect()}
    policy = failure_policy(a.diagnostics, fail_on, most).first()
    cover = coverage_of(a.frames.ownership).first()
    return {
        "schemaVersion": SCHEMA_VERSION,
        "modules": {"source": kinds.get("source", 0), "excluded": kinds.get("excluded", 0), "external": kinds.get("external", 0)},
        "dependencies": a.frames.dependencies.count(),
        "coverage": {k: cover[k] for k in ("total", "assigned", "exempt", "unassigned", "percent")},
        "policy": {"failOn": fail_on, "maxWarnings": most, "failures": policy.failures, "warnings": policy.warnings, "warningExcess": policy.warning_excess, "failed": policy.failed},
    }


def to_json(a: Analysis, regression: dict | None = None) -> str:
    rows = [json.loads(r.value) for r in json_rows(a.diagnostics).collect()]
    extra = {"regression": regression} if regression else {}
    return json.dumps(summary(a) | extra | {"diagnostics": rows}, indent=2, ensure_ascii=False)


def to_jsonl(a: Analysis, regression: dict | None = None) -> str:
    head = {"event": "analysis"} | summary(a) | ({"regression": regression} if regression else {})
    lines = [json.dumps({"event": "diagnostic"} | json.loads(r.value), ensure_ascii=False) for r in json_rows(a.diagnostics).collect()]
    return "\n".join([json.dumps(head, ensure_ascii=False), *lines])


def sarif_results(diags: DataFrame) -> DataFrame:
    """One SARIF result a row."""
    at = F.col("primary_location")
    region = F.struct(at["line"].alias("startLine"), at["column"].alias("startColumn"))
    place = F.struct(F.struct(F.struct(at["file"].alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    kind = F.when(F.col("metadata")["suppression.kind"] == "source", "inSource").otherwise("external")
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.when(F.col("severity") == "info", "note").otherwise(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.when(at.isNotNull(), F.array(place)).otherwise(F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>")).alias("locations"),
        F.create_map(F.lit("stable/v1"), F.col("fingerprint")).alias("partialFingerprints"),
        F.when(F.col("suppressed"), F.array(F.struct(kind.alias("kind"), F.col("suppression_reason").alias("justification")))).alias("suppressions"),
        F.struct("dependency_path", "metadata").alias("properties"),
    )
    return sorted_by_place(diags).select(F.to_json(result).alias("value"))


def to_sarif(a: Analysis, tool: str = "lattiq") -> str:
    first = a.diagnostics.groupBy("rule_id").agg(F.first("severity").alias("severity")).orderBy("rule_id").collect()
    rules = [{"id": r.rule_id, "name": RULES[r.rule_id].title, "shortDescription": {"text": RULES[r.rule_id].description}, "defaultConfiguration": {"level": LEVELS[r.severity]}} for r in first if r.rule_id in RULES]
    results = [json.loads(r.value) for r in sarif_results(a.diagnostics).collect()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=2, ensure_ascii=False)


def human_lines(diags: DataFrame) -> DataFrame:
    """Text of each diagnostic, sorted."""
    at = F.col("primary_location")
    place = F.when(at.isNotNull(), F.format_string("%s:%d:%d", at["file"], at["line"], at["column"])).otherwise("(project)")
    mark = F.when(F.col("suppressed"), F.concat(F.lit(" [suppressed: "), F.coalesce("suppression_reason", F.lit("")), F.lit("]"))).otherwise("")
    head = F.format_string("%s %s %s\n  %s", F.upper("severity"), "rule_id", place, "message")
    path = F.when(F.size("dependency_path") > 1, F.concat(F.lit("\n  path: "), F.array_join("dependency_path", " -> "))).otherwise("")
    hint = F.coalesce(F.concat(F.lit("\n  fix: "), "suggestion"), F.lit(""))
    return sorted_by_place(diags).select(F.concat(head, mark, path, hint).alias("value"))


def to_text(a: Analysis, verbose: bool = False, regression: dict | None = None) -> str:
    s = summary(a)
    lines = [r.value for r in human_lines(a.diagnostics).collect()]
    lines.append(f"{s['modules']['source']} modules, {s['dependencies']} dependencies, {s['policy']['failures']} failures, {s['policy']['warnings']} warnings")
    if regression:
        lines.append(", ".join(f"{v} {k}" for k, v in regression.items()))
    if verbose:
        lines += [f"{k}: {v:.2f}" for k, v in a.timings.items()]
    return "\n".join(lines)


def graph_json(a: Analysis) -> str:
    """Nodes and edges."""
    nodes = [r.asDict() for r in a.frames.modules.select("id", "kind", "package", "runtime", "layer").orderBy("id").collect()]
    edges = [r.asDict() for r in a.frames.dependencies.select("from", "to", "kind").distinct().orderBy("from", "to", "kind").collect()]
    return json.dumps({"nodes": nodes, "edges": edges}, indent=2, ensure_ascii=False)


def write_graph(a: Analysis, path: str) -> None:
    """The same as two tables, for graphs of any size."""
    a.frames.modules.write.mode("overwrite").parquet(f"{path}/nodes")
    a.frames.dependencies.write.mode("overwrite").parquet(f"{path}/edges")


def annotations(diags: DataFrame, most: int = ANNOTATIONS) -> DataFrame:
    """Workflow commands of open diagnostics, the first ``most``."""
    at = F.col("primary_location")
    level = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    text = F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", level, escape_annotation(at["file"], True), at["line"], at["column"], escape_annotation(F.col("rule_id"), True), escape_annotation(F.col("message")))
    return sorted_by_place(diags.where(~F.col("suppressed") & at.isNotNull())).limit(most).select(text.alias("value"))


def summary_table(diags: DataFrame, most: int = SUMMARY_ROWS) -> str:
    """A Markdown table of the first open diagnostics."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = sorted_by_place(diags.where("not suppressed")).limit(most).select(F.format_string("| %s | %s | %s | %s |", "severity", "rule_id", safe(F.col("primary_location.file")), safe(F.col("message"))).alias("v")).collect()
    return "\n".join(["| Severity | Rule | File | Message |", "|-|-|-|-|", *(r.v for r in rows)])


def to_html(a: Analysis, title: str = "Dependencies") -> str:
    """A page that holds the model as JSON; ``<`` is escaped so that no text ends the script."""
    model = {"summary": summary(a), "graph": json.loads(graph_json(a)), "diagnostics": [json.loads(r.value) for r in json_rows(a.diagnostics).collect()]}
    data = json.dumps(model, ensure_ascii=False).replace("<", "\\u003c")
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>
<input id="q" placeholder="filter"><table id="d"></table><script id="model" type="application/json">{data}</script><script>
const m = JSON.parse(document.getElementById("model").textContent), t = document.getElementById("d"), q = document.getElementById("q");
function show() {{ t.textContent = ""; for (const d of m.diagnostics) {{ const s = [d.severity, d.ruleId, (d.primaryLocation || {{}}).file || "", d.message, (d.dependencyPath || []).join(" -> ")];
if (s.join(" ").includes(q.value)) {{ const r = t.insertRow(); for (const x of s) r.insertCell().textContent = x; }} }} }}
q.oninput = show; show();</script></body></html>"""
