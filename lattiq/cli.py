"""Commands: check, scan, graph, inspect, explain, resolve, impact, baseline, suppressions, discover, config, rules, doctor, explore.

Exit codes: 0 fine, 1 violations, 2 wrong usage or configuration, 3 internal error, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattiq import config as C
from lattiq.operators import diagnostics, views
from lattiq.operators.classify import layers_of
from lattiq.plans.analyze import Analysis, check, read_project
from lattiq.registry import RULES
from lattiq.schemas import BASELINE
from lattiq.sources import repository, sinks

OK, VIOLATIONS, USAGE, INTERNAL, INTERRUPTED = 0, 1, 2, 3, 130
CONFIG_NAMES = ("lattiq.yaml", "lattiq.yml", "lattiq.json")


def session() -> SparkSession:
    return SparkSession.builder.appName("lattiq").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def config_path(args) -> str | None:
    return args.config or next((p for n in CONFIG_NAMES if os.path.exists(p := os.path.join(args.root, n))), None)


def config_of(args) -> C.Config:
    return C.load(config_path(args))


def replace_text(path: str, text: str) -> None:
    """A file's new text in one step: a reader sees the old or the new one."""
    temp = path + ".tmp"
    with open(temp, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temp, path)


def git_changes(root: str, base: str | None) -> list[str]:
    """Lines of status and path: the range from a base, the working tree, the index, and untracked files."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.splitlines()
    if base is None:
        for guess in ("origin/HEAD", "origin/main", "origin/master", "main", "master"):
            if subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", guess], capture_output=True).returncode == 0:
                base = git("merge-base", "HEAD", guess)[0]
                break
    lines = git("diff", "--name-status", "-M", f"{base}...HEAD") if base else []
    return [*lines, *git("diff", "--name-status", "-M"), *git("diff", "--name-status", "-M", "--cached"), *git("ls-files", "--others", "--exclude-standard")]


def read_baseline(spark: SparkSession, path: str):
    """Baselines of version 1 (fingerprints), 2 and 3 (entries)."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    entries = doc.get("entries") or [{"fingerprint": x} for x in doc.get("fingerprints", [])]
    rows = [tuple(e.get(k) for k in ("fingerprint", "rule_id", "source", "target", "reason", "expires_at")) for e in entries]
    return spark.createDataFrame(rows, BASELINE)


def write_baseline(df, path: str) -> int:
    rows = [r.asDict() for r in df.orderBy("fingerprint").collect()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    replace_text(path, json.dumps({"schemaVersion": 3, "entries": rows}, indent=2, ensure_ascii=False))
    return len(rows)


def render(a: Analysis, form: str, verbose: bool, regression: dict | None) -> str:
    if form == "json":
        return sinks.to_json(a, regression)
    if form == "jsonl":
        return sinks.to_jsonl(a, regression)
    return sinks.to_sarif(a) if form == "sarif" else sinks.to_text(a, verbose, regression)


def cmd_check(args, spark: SparkSession) -> int:
    config = config_of(args)
    a = check(spark, args.root, config, cache=args.cache)
    regression = None
    path = os.path.join(args.root, args.baseline or config["baseline"]["file"])
    if args.changed or args.baseline:
        if os.path.exists(path):
            known = read_baseline(spark, path)
            if diagnostics.expired_entries(known).limit(1).count():
                raise C.ConfigError(f"{path}: has expired entries")
        else:
            known = spark.createDataFrame([], BASELINE)
        affected = None
        if args.changed:
            changes = repository.changes(spark, git_changes(args.root, args.base))
            affected = views.impact(a.frames, changes)
            a.diagnostics = views.changed_only(a.diagnostics, changes.select("path"), affected)
        regression = diagnostics.regression_summary(a.diagnostics, known, affected).first().asDict()
        a.diagnostics = views.introduced(a.diagnostics, known)
    print(render(a, args.format or config["output"]["format"], args.verbose, regression))
    policy = sinks.summary(a, args.fail_on, args.max_warnings)["policy"]
    return VIOLATIONS if policy["failed"] else OK


def cmd_scan(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args), only=set())
    print(json.dumps({k: v for k, v in sinks.summary(a).items() if k in ("modules", "dependencies")}))
    return OK


def cmd_graph(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args), only=set())
    if args.module:
        found = views.find_module(a.frames.modules, args.module).first()
        if found is None:
            raise C.ConfigError(f"no module `{args.module}`")
        print(json.dumps([r.asDict() for r in views.edges_of(a.frames.dependencies, found.id).collect()], indent=2))
    else:
        print(sinks.graph_json(a))
    return OK


def cmd_inspect(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args))
    found = views.find_module(a.frames.modules, args.module).first()
    if found is None:
        raise C.ConfigError(f"no module `{args.module}`")
    print(json.dumps({k: [r.asDict(True) for r in df.collect()] for k, df in views.inspect(a.frames, a.diagnostics, found.id).items()}, indent=2))
    return OK


def cmd_path(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args), only=set())
    row = views.dependency_path(a.frames, args.start, args.end).first()
    print(json.dumps({"path": row.path if row else None}))
    return OK if row else VIOLATIONS


def cmd_policy(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args))
    print(json.dumps(views.dependency_policy(a.frames, a.diagnostics, args.start, args.end).first().asDict()))
    return OK


def cmd_overview(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args))
    print(json.dumps([r.asDict() for r in views.overview(a.frames, a.diagnostics).orderBy("section", "name").collect()], indent=2))
    return OK


def cmd_impact(args, spark: SparkSession) -> int:
    a = check(spark, args.root, config_of(args), only=set())
    changes = repository.changes(spark, [f"M\t{p}" for p in args.paths] or git_changes(args.root, args.base))
    print("\n".join(r.path for r in views.impact(a.frames, changes).orderBy("path").collect()))
    return OK


def cmd_baseline(args, spark: SparkSession) -> int:
    config = config_of(args)
    path = os.path.join(args.root, args.file or config["baseline"]["file"])
    if args.action == "list":
        for r in read_baseline(spark, path).orderBy("fingerprint").collect():
            print(r.fingerprint, r.rule_id or "-", r.source or "-", r.reason or "")
        return OK
    a = check(spark, args.root, config)
    if args.action == "create":
        print(write_baseline(diagnostics.to_baseline(a.diagnostics, args.reason or ""), path))
    else:
        known = read_baseline(spark, path)
        stale = diagnostics.stale_entries(known, a.diagnostics)
        print(write_baseline(known.join(stale.select("fingerprint"), "fingerprint", "left_anti"), path))
    return OK


def cmd_suppressions(args, spark: SparkSession) -> int:
    config = config_of(args)
    entries = [(k, i, e) for k in C.ENTRY_KEYS for i, e in enumerate(config["suppressions"][k])]
    if args.action == "validate":
        old = [e for _, _, e in entries if C.expired(e)]
        print(f"{len(entries)} entries, {len(old)} expired")
        return VIOLATIONS if old else OK
    if args.action == "prune":
        path = config_path(args)
        with open(path, encoding="utf-8", newline="") as f:
            text, gone = C.pruned_text(f.read())
        if gone:
            replace_text(path, text)
        print(f"{gone} removed")
        return OK
    for kind, i, e in entries:
        print(f"{kind}[{i}]", e.get("pattern") or e.get("fingerprint"), e.get("reason", ""), "expired" if C.expired(e) else "active")
    return OK


def cmd_discover(args, spark: SparkSession) -> int:
    """What kind of project it is, with a document to start from and how much of it that would cover."""
    given = read_project(spark, args.root, C.load(None))
    names = {r.path for r in given.inputs.select("path").collect()}
    tops = [r.top for r in given.files.select(F.regexp_extract("path", "^src/([^/]+)/", 1).alias("top")).distinct().collect() if r.top]
    layered = sorted(set(tops) & {"app", "processes", "pages", "widgets", "features", "entities", "shared"})
    every = {os.path.basename(r.path) for r in given.every.collect()}
    score = given.inputs.transform(repository.frameworks).agg(F.max("score")).first()[0] or 0
    kind, sure = ("nx", 100) if "nx.json" in every else ("turbo", 100) if "turbo.json" in every else ("next", score) if score else ("fsd", min(80, 20 * len(layered))) if len(layered) >= 2 else ("generic", 0)
    document = C.preset({"turbo": "nx", "generic": "blank"}.get(kind, kind), layered if kind == "fsd" else None)
    proposal = C.from_dict(document)
    hit = given.files.agg(F.count(F.when(F.size(layers_of(F.col("path"), proposal)) > 0, 1)).alias("n"), F.count(F.lit(1)).alias("all")).first()
    print(json.dumps({"kind": kind, "confidence": sure, "manifests": len(names), "coveragePercent": hit.n * 100 // hit.all if hit["all"] else 100, "config": document}, indent=2))
    return OK


def cmd_config(args, spark: SparkSession) -> int:
    config = config_of(args)
    if args.action == "print":
        print(C.to_yaml(config))
        return OK
    given = read_project(spark, args.root, config)
    layers = given.files.select("path", layers_of(F.col("path"), config).alias("layers"))
    twice = layers.where(F.size("layers") > 1).orderBy("path").limit(1).collect()
    if twice:
        print(f"{twice[0].path}: {', '.join(twice[0].layers)}")
        return VIOLATIONS
    print("valid")
    return OK


def cmd_init(args, spark: SparkSession) -> int:
    path = os.path.join(args.root, "lattiq.json")
    if os.path.exists(path) and not args.force:
        raise C.ConfigError(f"{path} exists")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(C.preset(args.preset), f, indent=2)
    print(path)
    return OK


def cmd_rules(args, spark: SparkSession) -> int:
    for r in RULES.values():
        if args.rule in (None, r.id):
            print(f"{r.id}  {r.title}: {r.description} ({r.category}, {r.scope})")
    return OK if args.rule is None or args.rule in RULES else USAGE


def cmd_doctor(args, spark: SparkSession) -> int:
    print(f"spark {spark.version}, partitions {spark.conf.get('spark.sql.shuffle.partitions')}, shared folder {spark.sparkContext.getConf().get('spark.checkpoint.dir', 'unset: one machine only')}")
    config = config_of(args)
    print("configuration: " + ("valid" if config.configured else "none, cycles only"))
    return OK


def cmd_explore(args, spark: SparkSession) -> int:
    with open(args.out, "w", encoding="utf-8") as f:
        f.write(sinks.to_html(check(spark, args.root, config_of(args))))
    print(args.out)
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lattiq")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options: tuple) -> None:
        s = sub.add_parser(name)
        s.add_argument("--root", default=".")
        s.add_argument("--config")
        s.add_argument("--cache")
        for flags, kw in options:
            s.add_argument(*flags, **kw)
        s.set_defaults(run=run)

    opt = lambda *flags, **kw: (flags, kw)
    base = opt("--base")
    add("check", cmd_check, opt("--format", choices=C.FORMATS), opt("--fail-on", dest="fail_on", choices=("error", "warning")), opt("--max-warnings", dest="max_warnings", type=int), opt("--changed", action="store_true"), opt("--baseline"), base, opt("--verbose", action="store_true"))
    add("scan", cmd_scan)
    add("graph", cmd_graph, opt("--module"))
    add("inspect", cmd_inspect, opt("module"))
    add("path", cmd_path, opt("start"), opt("end"))
    add("policy", cmd_policy, opt("start"), opt("end"))
    add("overview", cmd_overview)
    add("impact", cmd_impact, opt("paths", nargs="*"), base)
    add("baseline", cmd_baseline, opt("action", choices=("create", "list", "prune")), opt("--file"), opt("--reason"))
    add("suppressions", cmd_suppressions, opt("action", choices=("list", "validate", "prune")))
    add("discover", cmd_discover)
    add("config", cmd_config, opt("action", choices=("validate", "print")))
    add("init", cmd_init, opt("--preset", default="blank"), opt("--force", action="store_true"))
    add("rules", cmd_rules, opt("rule", nargs="?"))
    add("doctor", cmd_doctor)
    add("explore", cmd_explore, opt("--out", default="dependencies.html"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        return args.run(args, spark or session())
    except C.ConfigError as e:
        print(e, file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:  # noqa: BLE001  the command's last word
        print(f"internal error: {e}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
