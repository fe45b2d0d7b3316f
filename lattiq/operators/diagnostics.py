"""The diagnostics relation: builders, severity, arbitration, suppression, baseline, failure."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.config import Config, expired
from lattiq.functions.globs import matches
from lattiq.functions.hashes import fnv1a, identity, legacy_identities
from lattiq.registry import RULES
from lattiq.schemas import LOCATION, empty

FIELDS = ["fingerprint", "rule_id", "severity", "message", "primary_location", "secondary_locations", "dependency_path", "suggestion", "metadata", "identity_target", "suppressed", "suppression_reason"]
STRINGS = "map<string,string>"


def text(x) -> Column:
    return F.lit(x) if isinstance(x, (str, int)) or x is None else x


def of(df: DataFrame, rule: str, message, path: Column, location: Column | None, suggestion: str | None = None, metadata: dict | None = None, target: Column | None = None, severity: str = "error") -> DataFrame:
    """Diagnostics of one rule from the rows of ``df``, not yet fingerprinted."""
    items = [c for k, v in (metadata or {}).items() for c in (F.lit(k), text(v).cast("string"))]
    data = F.create_map(*items) if items else F.create_map().cast(STRINGS)
    none = F.lit(None)
    return df.select(
        none.cast("string").alias("fingerprint"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), text(message).alias("message"),
        (location if location is not None else none).cast(LOCATION).alias("primary_location"), F.array().cast(f"array<{LOCATION}>").alias("secondary_locations"),
        path.cast("array<string>").alias("dependency_path"), text(suggestion).cast("string").alias("suggestion"), data.cast(STRINGS).alias("metadata"),
        (target if target is not None else none).cast("string").alias("identity_target"), F.lit(False).alias("suppressed"), none.cast("string").alias("suppression_reason"),
    )


def fingerprinted(diags: DataFrame) -> DataFrame:
    file = F.col("primary_location.file")
    with_file = F.when((F.size("dependency_path") == 0) & file.isNotNull(), file)
    return diags.withColumn("fingerprint", fnv1a(identity(F.col("rule_id"), F.col("dependency_path"), F.col("identity_target"), with_file)))


def aliases() -> Column:
    """Older fingerprints of a diagnostic, distinct and in order."""
    texts = legacy_identities(F.col("rule_id"), F.col("dependency_path"), F.col("primary_location.file"), F.col("metadata"))
    return F.array_sort(F.array_distinct(F.array(fnv1a(F.get(texts, F.lit(0))), fnv1a(F.get(texts, F.lit(1))))))


def with_severity(diags: DataFrame, rule: str, config: Config) -> DataFrame:
    """Severity by rule and overrides at the primary file, the last match first; off drops the row."""
    path = F.coalesce("primary_location.file", F.lit(""))
    own = config.rule(rule)
    found = F.lit(own["severity"] if own["enabled"] else "off")
    for o in config["overrides"]:
        if rule in o.get("rules", {}):
            value = o["rules"][rule]
            change = {"enabled": value is not False and value != "off"} | ({"severity": value} if value in ("error", "warning", "info") else dict(value) if isinstance(value, dict) else {})
            # a map may change one of the two alone: an earlier severity then stays
            kept = F.when(found == "off", F.lit(own["severity"])).otherwise(found)
            new = F.lit("off") if not change["enabled"] else F.lit(change["severity"]) if "severity" in change else kept
            found = F.when(matches(path, o["files"]) & ~matches(path, o.get("excluded_files", [])), new).otherwise(found)
    return diags.withColumn("severity", found).where("severity != 'off'")


def arbitrate(diags: DataFrame) -> DataFrame:
    """Of feature rules on the same path one stays: the severest, the most specific, the lowest id; the others are named in it."""
    overlap = F.col("rule_id").isin("ARCH-004", "ARCH-005") & (F.size("dependency_path") > 0)
    rank = F.struct((-F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)).alias("s"), F.when(F.col("rule_id") == "ARCH-005", -2).otherwise(-1).alias("p"), "rule_id", F.col("primary_location.line").alias("line"), F.col("primary_location.column").alias("column"))
    groups = diags.where(overlap).groupBy("dependency_path").agg(F.min_by(F.struct(*FIELDS), rank).alias("d"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    named = F.when(F.size("rules") > 1, F.map_concat("d.metadata", F.create_map(F.lit("related_rules"), F.array_join("rules", ",")))).otherwise(F.col("d.metadata"))
    chosen = groups.select(*[named.alias(c) if c == "metadata" else F.col(f"d.{c}").alias(c) for c in FIELDS])
    return diags.where(~overlap).select(FIELDS).unionByName(chosen)


def directives(comments: DataFrame, require_reason: bool = True, word: str = "lattiq-ignore") -> tuple[DataFrame, DataFrame]:
    """Suppressions that comments declare, and warnings on wrong ones.

    comments: (path, comment). A standalone ``// word RULE -- reason`` counts for its
    line and the next, ``// word-file RULE -- reason`` for the file.
    """
    body = F.ltrim(F.regexp_replace("comment.text", "^//", ""))
    own = comments.where(F.col("comment.standalone") & F.col("comment.text").startswith("//")).select("path", F.col("comment.line").alias("line"), body.alias("body"))
    own = own.select("path", "line", F.regexp_extract("body", rf"^{word}(-file)?(?:\s.*)?$", 1).alias("scope"), F.regexp_extract("body", rf"^{word}(?:-file)?(\s.*)?$", 1).alias("rest"), F.col("body").rlike(rf"^{word}(-file)?(\s|$)").alias("is")).where("is")
    rule, reason = F.trim(F.substring_index("rest", "--", 1)), F.when(F.instr("rest", "--") > 0, F.trim(F.expr("substring(rest, instr(rest, '--') + 2)"))).otherwise("")
    own = own.select("path", "line", (F.col("scope") != "").alias("file_scope"), rule.alias("rule"), reason.alias("reason"))
    problem = F.when(~F.col("rule").isin(*RULES), F.format_string("Suppression references unknown rule `%s`", "rule"))
    if require_reason:
        problem = problem.when(F.col("reason") == "", F.format_string("Suppression for `%s` requires a reason after `--`", "rule"))
    own = own.withColumn("problem", problem)
    return own.where("problem is null").drop("problem"), warnings(own.where("problem is not null"), F.col("problem"), F.col("path"), F.col("line"))


def warnings(df: DataFrame, message: Column, file: Column, line: Column, metadata: dict | None = None) -> DataFrame:
    at = F.struct(file.alias("file"), line.cast("int").alias("line"), F.lit(1).alias("column"))
    return fingerprinted(of(df, "SUPPRESS-001", message, F.array().cast("array<string>"), at, metadata=metadata, severity="warning"))


def suppress_by_source(diags: DataFrame, declared: DataFrame, report_unused: bool = True) -> DataFrame:
    """Mark what directives cover: a file's before a line's, its own line before the one above."""
    key = ["path", "rule"]
    files = declared.where("file_scope").groupBy(*key).agg(F.min("line").alias("fl"), F.min_by("reason", "line").alias("fr"))
    lines = declared.where("not file_scope").groupBy(*key, "line").agg(F.first("reason").alias("reason"))
    d = diags.withColumn("path", F.col("primary_location.file")).withColumn("at", F.col("primary_location.line")).withColumnRenamed("rule_id", "rule")
    d = d.join(files, key, "left")
    d = d.join(lines.withColumnRenamed("line", "at").withColumn("sl", F.col("at")).withColumnRenamed("reason", "sr"), [*key, "at"], "left")
    d = d.join(lines.withColumn("at", F.col("line") + 1).withColumnRenamed("line", "al").withColumnRenamed("reason", "ar"), [*key, "at"], "left")
    d = d.withColumn("hit", F.when(F.col("fl").isNotNull(), F.struct(F.col("fl").alias("line"), F.col("fr").alias("reason"), F.lit(True).alias("file_scope"))).when(F.col("sl").isNotNull(), F.struct(F.col("sl").alias("line"), F.col("sr").alias("reason"), F.lit(False).alias("file_scope"))).when(F.col("al").isNotNull(), F.struct(F.col("al").alias("line"), F.col("ar").alias("reason"), F.lit(False).alias("file_scope"))))
    used = d.where("hit is not null").groupBy("path", "rule", F.col("hit.line").alias("line"), F.col("hit.file_scope").alias("file_scope")).agg(F.count(F.lit(1)).alias("n"))
    d = d.join(used.select("path", "rule", F.col("line").alias("hl"), F.col("file_scope").alias("hs"), "n").withColumnsRenamed({"path": "hp", "rule": "hr"}), (F.col("path") == F.col("hp")) & (F.col("rule") == F.col("hr")) & (F.col("hit.line") == F.col("hl")) & (F.col("hit.file_scope") == F.col("hs")), "left")
    noted = F.create_map(F.lit("suppression.kind"), F.lit("source"), F.lit("suppression.status"), F.lit("active"), F.lit("suppression.definedIn"), F.format_string("%s:%d", "path", "hit.line"), F.lit("suppression.matchedCount"), F.col("n").cast("string"))
    hit = F.col("hit").isNotNull()
    out = d.withColumn("metadata", F.when(hit, F.map_concat("metadata", noted)).otherwise(F.col("metadata"))).withColumn("suppressed", F.col("suppressed") | hit).withColumn("suppression_reason", F.when(hit, F.col("hit.reason")).otherwise(F.col("suppression_reason"))).withColumnRenamed("rule", "rule_id").select(FIELDS)
    if report_unused:
        unused = declared.join(used, ["path", "rule", "line", "file_scope"], "left_anti")
        out = out.unionByName(warnings(unused, F.format_string("Unused suppression for `%s`", "rule"), F.col("path"), F.col("line")))
    return out


def suppress_by_config(diags: DataFrame, config: Config, file: str = "lattiq.yaml", today: datetime.date | None = None) -> DataFrame:
    """Mark what configured entries cover: fingerprints (or older ones) before paths, the first entry each."""
    supp = config["suppressions"]
    kinds = [("fingerprint", i, e) for i, e in enumerate(supp["fingerprints"])] + [("path", i, e) for i, e in enumerate(supp["paths"])]
    if not kinds:
        return diags
    open_ = F.lit(None).cast("string")
    named = F.array_union(F.array("fingerprint"), aliases())
    places = F.concat(F.array(F.coalesce("primary_location.file", F.lit(""))), "dependency_path")
    # the entries are configuration: their number is fixed, so they are a CASE and not a join
    case = open_
    for kind, i, e in reversed(kinds):
        if expired(e, today):
            continue
        if kind == "fingerprint":
            on = F.array_contains(named, e["fingerprint"])
        else:
            on = F.col("rule_id").isin(*e["rules"]) & F.exists(places, crossing_match(e["pattern"]))
        case = F.when(on, F.lit(f"{kind}:{i}")).otherwise(case)
    d = diags.withColumn("entry", F.when(~F.col("suppressed"), case))
    counts = {r.entry: r["n"] for r in d.where("entry is not null").groupBy("entry").agg(F.count(F.lit(1)).alias("n")).collect()}
    notes, reasons = [], []
    for kind, i, e in kinds:
        notes += [F.lit(f"{kind}:{i}"), F.create_map(*[F.lit(x) for kv in note(kind, i, e, file, counts.get(f"{kind}:{i}", 0), False).items() for x in kv])]
        reasons += [F.lit(f"{kind}:{i}"), F.lit(e.get("reason", ""))]
    hit = F.col("entry").isNotNull()
    out = d.withColumn("metadata", F.when(hit, F.map_concat("metadata", F.create_map(*notes)[F.col("entry")])).otherwise(F.col("metadata"))).withColumn("suppression_reason", F.when(hit, F.create_map(*reasons)[F.col("entry")]).otherwise(F.col("suppression_reason"))).withColumn("suppressed", F.col("suppressed") | hit).select(FIELDS)
    if supp["report_unused"]:
        one = diags.sparkSession.range(1)
        for kind, i, e in sorted(kinds, key=lambda k: k[0] == "fingerprint"):
            n, old = counts.get(f"{kind}:{i}", 0), expired(e, today)
            if old or not n:
                what = e["pattern"] if kind == "path" else e["fingerprint"]
                message = f"{'Expired' if old else 'Unused'} {kind} suppression `{what}`"
                out = out.unionByName(warnings(one, F.lit(message), F.lit(file), F.lit(1), note(kind, i, e, file, n, old)))
    return out


def crossing_match(pattern: str):
    return lambda p: matches(p, [pattern], crossing=True)


def note(kind: str, i: int, e: dict, file: str, n: int, old: bool) -> dict[str, str]:
    """Metadata of a configured suppression."""
    made = {"suppression.kind": kind, "suppression.status": "expired" if old else "active" if n else "unused", "suppression.definedIn": e.get("_defined_in") or f"{file}:suppressions.{kind}s[{i}]", "suppression.matchedCount": str(n)}
    made |= {f"suppression.{name}": str(e[k]) for k, name in (("owner", "owner"), ("ticket", "ticket"), ("expires_at", "expiresAt")) if e.get(k)}
    return made | ({"suppression.inherited": "true"} if e.get("_inherited") else {})


def sorted_by_place(diags: DataFrame) -> DataFrame:
    """By rule, file, line, column, fingerprint; for sinks only."""
    at = "primary_location"
    return diags.orderBy("rule_id", F.coalesce(f"{at}.file", F.lit("")), F.coalesce(f"{at}.line", F.lit(0)), F.coalesce(f"{at}.column", F.lit(0)), "fingerprint")


def is_failure(fail_on: str = "error") -> Column:
    return ~F.col("suppressed") & ((F.col("severity") == "error") | (F.lit(fail_on == "warning") & (F.col("severity") == "warning")))


def failure_policy(diags: DataFrame, fail_on: str = "error", max_warnings: int | None = None) -> DataFrame:
    """failures, warnings, warning_excess and failed, one row."""
    warned = F.count(F.when(~F.col("suppressed") & (F.col("severity") == "warning"), 1))
    excess = F.greatest(warned - F.lit(max_warnings), F.lit(0)).cast("long") if max_warnings is not None else F.lit(0).cast("long")
    out = diags.agg(F.count(F.when(is_failure(fail_on), 1)).alias("failures"), warned.alias("warnings"), excess.alias("warning_excess"))
    return out.withColumn("failed", (F.col("failures") > 0) | (F.col("warning_excess") > 0))


def to_baseline(diags: DataFrame, reason: str = "", expires_at: int | None = None) -> DataFrame:
    """Entries for what is not suppressed, one a fingerprint."""
    source, target = F.coalesce(F.get("dependency_path", F.lit(0)), "primary_location.file"), F.coalesce("identity_target", F.get("dependency_path", F.lit(1)))
    own = diags.where("not suppressed").select("fingerprint", "rule_id", source.alias("source"), target.alias("target"), F.lit(reason).alias("reason"), F.lit(expires_at).cast("long").alias("expires_at"))
    return own.dropDuplicates(["fingerprint"])


def in_baseline(diags: DataFrame, baseline: DataFrame, known: bool = True) -> DataFrame:
    """The diagnostics that a baseline has, by fingerprint or an older one (or those it doesn't have)."""
    keyed = diags.withColumn("key", F.explode(F.array_union(F.array("fingerprint"), aliases())))
    hit = keyed.join(baseline.select(F.col("fingerprint").alias("key")).distinct(), "key", "left_semi").select("fingerprint").distinct()
    return diags.join(hit, "fingerprint", "left_semi" if known else "left_anti").select(FIELDS)


def stale_entries(baseline: DataFrame, diags: DataFrame) -> DataFrame:
    """Baseline entries that no diagnostic matches any more."""
    live = diags.select(F.explode(F.array_union(F.array("fingerprint"), aliases())).alias("fingerprint")).distinct()
    return baseline.join(live, "fingerprint", "left_anti")


def expired_entries(baseline: DataFrame, now: int | None = None) -> DataFrame:
    return baseline.where(F.col("expires_at") <= F.lit(int(time.time()) if now is None else now))


def regression_summary(diags: DataFrame, baseline: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """existing, introduced, fixed and affected, one row."""
    live = diags.where("not suppressed")
    known = in_baseline(live, baseline).agg(F.count(F.lit(1)).alias("existing"))
    new = in_baseline(live, baseline, False).agg(F.count(F.lit(1)).alias("introduced"))
    fixed = stale_entries(baseline, diags).agg(F.count(F.lit(1)).alias("fixed"))
    touched = (affected if affected is not None else empty(diags.sparkSession, "path string")).agg(F.count(F.lit(1)).alias("affected"))
    return known.join(new).join(fixed).join(touched)  # four single rows
