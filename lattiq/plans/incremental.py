"""Incremental recomputation: cached facts by content hash, rule partitions by scope, sessions."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.config import Config
from lattiq.functions.hashes import fnv1a
from lattiq.operators import rules, views
from lattiq.operators.diagnostics import FIELDS
from lattiq.plans.analyze import Analysis, Inputs, post_process
from lattiq.plans.store import Store
from lattiq.registry import RULES
from lattiq.schemas import Frames
from lattiq.sources.parser import parse_files
from lattiq.storage import written

#: The cache's layout; a table of another one is not read.
CACHE_VERSION, SHARDS = 2, 256
PARSED_COLUMNS = ("path", "imports", "directives", "exported_runtime", "marker_imports", "comments", "error")


def with_hashes(files: DataFrame) -> DataFrame:
    """path, source, hash of the content and shard of the path."""
    return files.select("path", "source", F.sha2("source", 256).alias("hash"), F.pmod(F.xxhash64("path"), F.lit(SHARDS)).cast("int").alias("shard"))


def environment_hash(inputs: DataFrame, config: Config) -> str:
    """One hash of the configuration and of all manifests and settings, in order of path."""
    own = inputs.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", F.sha2("source", 256).alias("h"))))), 256).alias("h")).first().h
    return fnv_of(json.dumps(config.data, sort_keys=True) + (own or ""))


def fnv_of(text: str) -> str:
    from lattiq.functions.hashes import fnv1a_text

    return fnv1a_text(text)


def reusable(cache: DataFrame | None, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(parsed, todo): cached rows of files whose content is the same, and the files without one.

    What a file says depends on its own text alone, so no setting makes a row worthless."""
    if cache is None:
        return None, files
    kept = cache.where(F.col("version") == CACHE_VERSION).join(with_hashes(files).select("path", "hash"), ["path", "hash"], "left_semi").dropDuplicates(["path"])
    return kept, files.join(kept.select("path"), "path", "left_anti")


def cached_parser(store: Store) -> Callable[[DataFrame], DataFrame]:
    """A parser of files that keeps its rows in ``store`` and parses only what isn't there.

    New rows are appended; when half of what is kept is of files or texts that are gone, the rest is written anew."""

    def parse(files: DataFrame) -> DataFrame:
        files = written(files.select("path", "source"), "sources")
        cache = store.table("parsed")
        kept, todo = reusable(cache, files)
        todo = written(todo, "todo")
        n = todo.count()
        if not n and kept is not None:
            return kept.select(*PARSED_COLUMNS)
        fresh = parse_files(todo).join(with_hashes(todo).drop("source", "shard"), "path").withColumn("version", F.lit(CACHE_VERSION))
        if kept is None or cache.count() > 2 * max(1, kept.count()):
            store.commit({"parsed": fresh if kept is None else kept.unionByName(fresh)})
        else:
            store.commit({}, {"parsed": fresh})
        return reusable(store.table("parsed"), files)[0].select(*PARSED_COLUMNS)

    return parse


def overlay_changes(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """CHANGES between two states of files."""
    a, b = with_hashes(files).select("path", F.col("hash").alias("new")), with_hashes(snapshot).select("path", F.col("hash").alias("old"))
    both = a.join(b, "path", "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select("path", F.when(F.col("new").isNull(), "D").when(F.col("old").isNull(), "A").otherwise("M").alias("status"))


def relation_hash(df: DataFrame | None) -> int:
    """A hash of a relation's rows that doesn't depend on their order; repeated rows count. 0 for none."""
    if df is None:
        return 0
    row = F.xxhash64(F.to_json(F.struct(*df.columns)))
    # two sums of halves, which don't overflow below two thousand million rows
    halves = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.shiftrightunsigned(row, 32), "a"), (row.bitwiseAND(F.lit(0xFFFFFFFF)), "b"))]
    return df.agg(*halves, F.count(F.lit(1)).alias("n")).select(F.xxhash64("a", "b", "n").alias("h")).first().h


@dataclass
class Stats:
    """What a run reused and what it did anew."""

    affected_modules: int = 0
    rules_reused: int = 0
    rules_scoped: int = 0
    rules_full: int = 0
    added: int = 0
    removed: int = 0


#: Relations that rules read beside modules and dependencies.
READS = {"ARCH-002": ("resolved",), "ARCH-004": ("features",), "ARCH-005": ("features",), "ARCH-010": ("ownership",), "ARCH-011": ("ownership",), "PACKAGE-003": ("resolved", "declared"), "PACKAGE-004": ("resolved",)}


@dataclass
class RuleCache:
    """Diagnostics of each rule with the hashes of the graph and of what else the rule reads."""

    partitions: dict[str, tuple[tuple[int, str], DataFrame]] = field(default_factory=dict)


def rule_hashes(frames: Frames, config: Config) -> dict[str, tuple[int, str]]:
    """For each rule a hash of modules and dependencies, and one of its other relations and the configuration."""
    own = fnv_of(json.dumps(config.data, sort_keys=True, default=str))
    graph = relation_hash(frames.dependencies.select("from", "to", "kind", "location", "ord")), relation_hash(frames.modules)
    more = {n: relation_hash(getattr(frames, n)) for n in sorted({n for ns in READS.values() for n in ns})}
    return {r: (fnv_of(str(graph)), fnv_of(str([own, *(more[n] for n in READS.get(r, ()))]))) for r in RULES}


def reanalyze(frames: Frames, config: Config, cache: RuleCache, affected: DataFrame | None = None, mode: str = "auto") -> tuple[Analysis, Stats]:
    """Rules over a changed project: partitions of which nothing read has changed are reused. Where
    the graph alone has changed, rules on edges run over the affected region (path) and keep
    their other diagnostics; others run in full."""
    stats, hashes = Stats(), rule_hashes(frames, config)
    full = rules.Context(frames, config, mode)
    near = None
    if affected is not None:
        region = written(views.edge_region(frames.dependencies.select("from", "to"), affected.select("path")), "region")
        stats.affected_modules = region.count()
        near = rules.Context(frames, config, mode, region)
    parts: list[DataFrame] = []
    for rule in config.enabled_rules():
        scope = RULES[rule].scope
        old = cache.partitions.get(rule)
        if old and old[0] == hashes[rule]:
            stats.rules_reused += 1
            parts.append(old[1])
            continue
        if old and near is not None and scope == "edge" and old[0][1] == hashes[rule][1] and rule not in ("ARCH-007", "ARCH-008", "PACKAGE-002"):
            stats.rules_scoped += 1
            touched = near.affected.select(F.col("path").alias("p"))
            ends = old[1].withColumn("p", F.explode("dependency_path")).join(touched, "p", "left_semi").select("fingerprint").distinct()
            fresh = rules.evaluate(near, {rule}).unionByName(old[1].join(ends, "fingerprint", "left_anti").select(FIELDS))
        else:
            stats.rules_full += 1
            fresh = rules.evaluate(full, {rule})
        fresh = written(fresh, "partition")
        if old:
            stats.added += fresh.join(old[1], "fingerprint", "left_anti").count()
            stats.removed += old[1].join(fresh, "fingerprint", "left_anti").count()
        cache.partitions[rule] = (hashes[rule], fresh)
        parts.append(fresh)
    raw = parts[0] if parts else rules.none(full)
    for p in parts[1:]:
        raw = raw.unionByName(p)
    raw = raw.unionByName(frames.facts) if frames.facts is not None else raw
    final = written(post_process(written(raw, "raw"), frames, config), "final")
    return Analysis(frames, config, final, full), stats


@dataclass
class Sessions:
    """Analyses kept by key: those too old go first, then the least recently used."""

    most: int = 4
    ttl_s: float = 900.0
    kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str, make, now: float | None = None):
        now = time.time() if now is None else now
        for k in [k for k, (t, _) in self.kept.items() if now - t > self.ttl_s]:
            del self.kept[k]
        value = self.kept[key][1] if key in self.kept else make()
        self.kept[key] = (now, value)
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return value


class Cancelled(Exception):
    """A newer generation has begun."""


@dataclass
class Tickets:
    """Generations: a newer one cancels the jobs of those before, whose results are not published."""

    spark: SparkSession
    current: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def tag(self, ticket: int) -> str:
        return f"lattiq-{id(self)}-{ticket}"

    def begin(self) -> int:
        with self.lock:
            self.current += 1
            older, ticket = self.current - 1, self.current
        if older:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(older))
        return ticket

    def valid(self, ticket: int) -> bool:
        return ticket == self.current

    def run(self, ticket: int, work: Callable[[], object], publish: Callable[[object], None]) -> None:
        """``work`` in this thread under the ticket's tag, then ``publish`` of what it gives, if no newer generation has begun by then."""
        self.spark.sparkContext.addJobTag(self.tag(ticket))
        try:
            if not self.valid(ticket):
                raise Cancelled
            done = work()
        except Exception as e:
            if not self.valid(ticket):
                raise Cancelled from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag(ticket))
        with self.lock:  # no newer one can begin while this one is published
            if not self.valid(ticket):
                raise Cancelled
            publish(done)


def content_hash(given: Inputs, config: Config) -> str:
    """One hash of all that an analysis reads: files, manifests and settings by content, which files there are, the configuration."""
    own = [relation_hash(d.select("path", F.sha2("source", 256).alias("h"))) for d in (given.files, given.inputs)]
    return fnv_of(str([*own, relation_hash(given.every.select("path")), json.dumps(config.data, sort_keys=True, default=str)]))


@dataclass
class Project:
    """The latest analysis of a project. Updates run one after the other or at once in threads of their own: the newest
    wins, and one whose content is that of the analysis published last is that analysis."""

    spark: SparkSession
    analyse: Callable[[Inputs, Config], Analysis]
    content: str = ""
    analysis: Analysis | None = None
    generation: int = 0
    reused: int = 0
    tickets: Tickets | None = None

    def __post_init__(self):
        self.tickets = self.tickets or Tickets(self.spark)

    def update(self, given: Inputs, config: Config, ticket: int | None = None) -> Analysis:
        """The analysis of ``given``; Cancelled if a newer update has begun meanwhile."""
        ticket = self.tickets.begin() if ticket is None else ticket

        def work():
            content = content_hash(given, config)
            known = self.analysis
            return (content, known, True) if known is not None and content == self.content else (content, self.analyse(given, config), False)

        def publish(done):
            self.content, self.analysis, same = done
            self.generation, self.reused = ticket, self.reused + same

        self.tickets.run(ticket, work, publish)
        return self.analysis

    def submit(self, given: Inputs, config: Config) -> Future:
        """``update`` in a thread of its own; the generation begins at once."""
        ticket, out = self.tickets.begin(), Future()

        def run():
            try:
                out.set_result(self.update(given, config, ticket))
            except BaseException as e:  # noqa: BLE001  the future's own
                out.set_exception(e)

        InheritableThread(target=run, daemon=True).start()
        return out


__all__ = ["Cancelled", "Project", "RuleCache", "Sessions", "Stats", "Tickets", "content_hash", "cached_parser", "environment_hash", "fnv1a", "overlay_changes", "reanalyze", "relation_hash", "reusable", "rule_hashes", "with_hashes"]
