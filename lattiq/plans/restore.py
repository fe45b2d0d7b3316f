"""Resolutions kept between runs: only imports whose answer can have changed are resolved again.

A request's answer depends on its settings, which the environment's hash stands for, and on
which of the paths that it may mean are files. The table of what those paths are made of is
an inverted index: files that came or went lead to the requests that name them, by an equi
join that reads the index's shards of what these files offer alone. New requests are prepared and resolved, all
other answers are restored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.config import Config
from lattiq.functions.hashes import fnv1a_text
from lattiq.operators import resolve
from lattiq.plans.store import Store
from lattiq.storage import shuffled, sized, written

#: The tables' layout; those of another one are not read.
LAYOUT, SHARDS = 2, 64
#: Changed paths up to which their shards are listed, to skip the others.
LISTED = 1000


@dataclass
class Restored:
    """What a run resolved again."""

    requests: int = 0
    new: int = 0
    affected: int = 0
    changed_files: int = 0

    @property
    def resolved(self) -> int:
        return self.new + self.affected


def shard():
    return F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int")


def settings_hash(inputs: DataFrame, config: Config) -> str:
    """What answers depend on beside files: the resolution's options, manifests and compiler settings."""
    own = inputs.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", F.sha2("source", 256).alias("h"))))), 256).alias("h")).first().h
    return fnv1a_text(f"{LAYOUT}{json.dumps(config.data['resolution'], sort_keys=True, default=str)}{own or ''}")


def indexed(tries: DataFrame) -> DataFrame:
    return tries.withColumn("shard", shard())


def restored(store: Store, imports: DataFrame, files: DataFrame, manifests: DataFrame, tsconfigs: DataFrame, scopes: DataFrame, config: Config, environment: str) -> tuple[DataFrame, Restored]:
    """``resolve.resolve``'s rows, with what the store has of them, and what was resolved again; the store is brought up to date."""
    asked = written(resolve.requested(imports, resolve.contexts(imports, manifests, tsconfigs, scopes), config["resolution"]["mode"]), "asked")
    key = [*resolve.CONTEXT, "specifier"]
    live = written(files.select("path").distinct(), "live")
    if store.facts.get("environment") != environment:
        answers = resolve.prepared(resolve.numbered(asked), resolve.tables(manifests, tsconfigs, config), config)
        found = written(resolve.decided(answers, live), "answers")
        store.commit({"requests": answers.requests, "tries": indexed(answers.tries), "rest": answers.rest, "found": found, "live": live}, by={"tries": "shard"}, environment=environment)
        n = answers.requests.count()
        return resolve.answered(asked, store.table("requests"), store.table("found"), config), Restored(n, n)
    requests, tries, rest, found, old = (store.table(t) for t in ("requests", "tries", "rest", "found", "live"))
    came, went = live.join(shuffled(old), "path", "left_anti"), old.join(shuffled(live), "path", "left_anti")
    changed = written(came.unionByName(went), "changed")
    fresh = written(asked.select(*key).distinct().join(shuffled(requests), key, "left_anti"), "fresh")
    done = Restored(requests.count(), fresh.count(), 0, changed.count())
    more = None
    if done.new:
        first = requests.agg(F.max("request").alias("m")).first().m
        numbers = written(fresh.withColumn("request", F.monotonically_increasing_id() + F.lit(first + 1)).select(*requests.columns), "requests")
        more = resolve.prepared(numbers, resolve.tables(manifests, tsconfigs, config), config)
    again = None
    if done.changed_files:
        index, offers = tries, resolve.offered(changed)
        if done.changed_files <= LISTED:
            index = index.where(F.col("shard").isin(*sorted({r.shard for r in offers.select(shard().alias("shard")).distinct().collect()})))
        again = written(resolve.tried(index, sized(offers)).select("request").distinct(), "affected")
        done.affected = again.count()
    if not done.resolved and not done.changed_files:
        return resolve.answered(asked, requests, found, config), done
    parts = [found]
    if done.affected:
        near = sized(again)
        parts = [found.join(near, "request", "left_anti"), resolve.decided(resolve.Answers(requests, tries.join(near, "request", "left_semi").drop("shard"), rest.join(near, "request", "left_semi")), live)]
    if more is not None:
        parts.append(resolve.decided(more, live))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    replaced = {"live": live} | ({"found": every} if len(parts) > 1 else {})
    store.commit(replaced, {"requests": more.requests, "tries": indexed(more.tries), "rest": more.rest} if more is not None else None, by={"tries": "shard"})
    return resolve.answered(asked, store.table("requests"), store.table("found"), config), done
