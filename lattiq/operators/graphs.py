"""Graph operators: traversal, strongly connected components, cycles.

Each has two ways with the same answers, but for the path that ``cycles`` shows. ``local`` runs in one task and is taken
only where a count shows the graph to be small. ``distributed`` is a loop over
frontiers, each a written table; ranks that order a level come from a range
sort, so no step gathers a level in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.storage import BROADCAST_ROWS, written

#: Edges up to which one task holds a graph.
LOCAL_EDGES = 500_000
#: Levels of a traversal after which what it has found is written as one table.
LEVELS = 8
#: Rounds in which nodes without an edge in or out go, before chains are sought again.
TRIMMED = 3


class Graph:
    """Adjacency of a graph in one process; nodes and neighbours in ascending order."""

    def __init__(self, nodes: Iterable[str], edges: Iterable[tuple[str, str]]):
        pairs = sorted(set(edges))
        self.nodes = sorted({*nodes, *(x for p in pairs for x in p)})
        self.out: dict[str, list[str]] = {n: [] for n in self.nodes}
        self.into: dict[str, list[str]] = {n: [] for n in self.nodes}
        for a, b in pairs:
            self.out[a].append(b)
            self.into[b].append(a)

    def spread(self, seeds: Iterable[str], closed: frozenset | set = frozenset(), back: bool = False) -> dict[str, tuple[int, str | None]]:
        """First in, first out from the sorted seeds: node -> (distance, the node it was found from).
        Closed nodes are found but not passed."""
        step = self.into if back else self.out
        found: dict[str, tuple[int, str | None]] = {s: (0, None) for s in sorted(set(seeds)) if s in step}
        queue = deque(found)
        while queue:
            at = queue.popleft()
            if at in closed:
                continue
            for to in step[at]:
                if to not in found:
                    found[to] = (found[at][0] + 1, at)
                    queue.append(to)
        return found

    @staticmethod
    def chain(found: dict[str, tuple[int, str | None]], node: str) -> list[str]:
        """From a node back to its seed."""
        path = [node]
        while (before := found[path[-1]][1]) is not None:
            path.append(before)
        return path

    def components(self) -> list[list[str]]:
        """Strongly connected components, each with its first node in depth-first order first."""
        number: dict[str, int] = {}
        low: dict[str, int] = {}
        place: dict[str, int] = {}
        held: list[str] = []
        on: set[str] = set()
        found: list[list[str]] = []
        for root in self.nodes:
            if root in number:
                continue
            number[root] = low[root] = len(number)
            place[root] = len(held)
            held.append(root)
            on.add(root)
            walk = [(root, iter(self.out[root]))]
            while walk:
                node, rest = walk[-1]
                for to in rest:
                    if to not in number:
                        number[to] = low[to] = len(number)
                        place[to] = len(held)
                        held.append(to)
                        on.add(to)
                        walk.append((to, iter(self.out[to])))
                        break
                    if to in on:
                        low[node] = min(low[node], number[to])
                else:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                    if low[node] == number[node]:
                        cut = place[node]
                        found.append(held[cut:])
                        on.difference_update(held[cut:])
                        del held[cut:]
        return sorted(found, key=lambda c: -number[c[0]])

    def cycles(self) -> list[list[str]]:
        """One closed path for each component that has a cycle: its first node, that node's
        first neighbour inside, and the shortest way back."""
        made = []
        for part in self.components():
            start, inside = part[0], set(part)
            if len(part) == 1:
                if start in self.out[start]:
                    made.append([start, start])
                continue
            first = next(n for n in self.out[start] if n in inside)
            within = Graph(inside, ((a, b) for a in inside for b in self.out[a] if b in inside))
            made.append([start, *reversed(within.chain(within.spread([first]), start))])
        return made


def is_small(edges: DataFrame, limit: int = LOCAL_EDGES) -> bool:
    return edges.limit(limit + 1).count() <= limit


def once(edges: DataFrame, mode: str) -> tuple[DataFrame, bool]:
    """Distinct ``edges`` and whether one task holds them. They are made once, before they are counted."""
    edges = edges.select("from", "to").distinct()
    if mode == "local":
        return edges, True
    edges = written(edges, "edges")
    return edges, mode == "auto" and is_small(edges)


def in_one_task(parts: dict[str, DataFrame], work: Callable[[dict[str, pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` on frames of up to two string columns, tagged by name, in one task."""
    union, names = None, list(parts)
    for name, df in parts.items():
        cols = [F.col(f"`{c}`").cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (2 - len(df.columns))
        own = df.select(F.lit(name).alias("tag"), cols[0].alias("a"), cols[1].alias("b"))
        union = own if union is None else union.unionByName(own)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return work({name: frame.loc[frame["tag"] == name, ["a", "b"]] for name in names})

    return union.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(run, schema)


def pairs(frame: pd.DataFrame) -> list[tuple[str, str]]:
    return list(zip(frame["a"], frame["b"], strict=True))


def coded(edges: DataFrame, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, edges): a number for each node of ``edges`` and of ``more`` (node), in the order of their names, and the
    edges by number, so that what loops send again and again are longs."""
    nodes = reduce(DataFrame.unionByName, more, edges.select(F.explode(F.array("from", "to")).alias("node"))).distinct()
    ids = written(nodes.orderBy("node").withColumn("id", F.monotonically_increasing_id()), "ids").hint("merge")
    return ids, written(numbers(numbers(edges, ids, "from"), ids, "to").select("from", "to"), "coded")


def numbers(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with the number in place of the name in ``column``."""
    return df.join(ids.withColumnsRenamed({"node": column, "id": "__id"}), column).drop(column).withColumnRenamed("__id", column)


def names(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with the name in place of the number in ``column``, null where there is none."""
    return df.join(ids.withColumnsRenamed({"node": "__name", "id": column}), column, "left").drop(column).withColumnRenamed("__name", column)


def held(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows to be looked up in: its files may be far smaller than its rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


SPREAD = "label string, node string, dist int, via string, path array<string>"


def spread(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None = None, back: bool = False, mode: str = "auto", paths: bool = True) -> DataFrame:
    """label, node, dist, via, path of every node that a label's seeds reach.

    edges: (from, to). seeds: (label, node). Several sets of seeds spread in one
    loop. ``back`` follows edges backwards, and the path leads from the node to its
    seed, else from the seed to the node. Of equal ways the one first in, first
    out search finds is taken. Seeds are reached at distance 0. closed: (node) are
    reached but not passed.
    """
    edges, local = once(edges, mode)
    if local:
        parts = {"edge": edges, "seed": seeds.select("label", "node").distinct()} | ({"closed": closed.select("node")} if closed is not None else {})

        def work(p: dict[str, pd.DataFrame]) -> pd.DataFrame:
            graph = Graph([], pairs(p["edge"]))
            shut = frozenset(p["closed"]["a"]) if "closed" in p else frozenset()
            rows = []
            for label, own in p["seed"].groupby("a"):
                alone = [s for s in own["b"] if s not in graph.out]
                found = graph.spread(own["b"], shut, back) | {s: (0, None) for s in alone}
                for node, (dist, via) in found.items():
                    chain = graph.chain(found, node) if paths else []
                    rows.append((label, node, dist, via, chain if back else chain[::-1]))
            return pd.DataFrame(rows, columns=["label", "node", "dist", "via", "path"])

        return in_one_task(parts, work, SPREAD)
    ids, step = coded(edges, seeds.select("node"))
    shut = numbers(closed.select("node").distinct(), ids, "node") if closed is not None else None
    found, level = frontiers(step, numbers(seeds.select("label", "node").distinct(), ids, "node"), shut, back)
    found = names(names(found, ids, "node"), ids, "via").select("label", "node", "dist", "via")
    if not paths:
        return found.withColumn("path", F.array().cast("array<string>"))
    return with_paths(written(found, "found"), level, back)


def frontiers(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None = None, back: bool = False) -> tuple[DataFrame, int]:
    """label, node, dist, via of all that is reached, by number, and how many levels there are."""
    step = edges.select(F.col("to" if back else "from").alias("at"), F.col("from" if back else "to").alias("next"))
    first = seeds.select("label", "node", F.lit(0).alias("dist"), F.lit(None).cast("long").alias("via"))
    shut = written(closed, "closed") if closed is not None else None
    shut = held(shut, shut.count()) if shut is not None else None
    frontier = ranked(first, ["label", "node"])
    tables, level, rows = [frontier], 0, frontier.count()
    known = rows
    while rows:
        level += 1
        active = frontier if shut is None else frontier.join(shut, "node", "left_anti")
        reached = step.join(held(active, rows), F.col("node") == F.col("at")).groupBy("label", "next").agg(F.min(F.struct("rank", F.col("node").alias("via"))).alias("x"))
        fresh = reached.select("label", F.col("next").alias("node"), F.lit(level).alias("dist"), F.col("x.via").alias("via"), F.col("x.rank").alias("before"))
        fresh = fresh.join(held(reduce(DataFrame.unionByName, tables).select("label", "node"), known), ["label", "node"], "left_anti")
        frontier = ranked(fresh, ["label", "before", "node"]).select("label", "node", "dist", "via", "rank")
        rows = frontier.count()
        known += rows
        tables.append(frontier)
        if len(tables) > LEVELS:  # so the plan of a level stays as long as it is
            tables = [written(reduce(DataFrame.unionByName, tables), "found")]
    return reduce(DataFrame.unionByName, tables).drop("rank"), level


def with_paths(found: DataFrame, deepest: int, back: bool) -> DataFrame:
    """``found`` (label, node, dist, via) with the path of each node, put together by doubling: a part of a path is
    joined with the part that goes on where it ends, so what is sent is at most twice what comes out."""
    parts = found.select("label", "node", F.col("via").alias("on"), F.array("node").alias("path"))
    for _ in range(deepest.bit_length()):
        rest = parts.select("label", F.col("node").alias("on"), F.col("on").alias("__on"), F.col("path").alias("__path"))
        longer = parts.where("on is not null").join(rest, ["label", "on"]).select("label", "node", F.col("__on").alias("on"), F.concat("path", "__path").alias("path"))
        parts = written(parts.where("on is null").unionByName(longer), "paths")
    path = F.col("path") if back else F.reverse("path")
    return found.join(parts.select("label", "node", path.alias("path")), ["label", "node"])


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with a rank that ascends in the order of ``by``: range partitions are sorted
    each for itself, and ids ascend over partitions and rows."""
    return written(df.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "frontier")


def shortest_path(edges: DataFrame, start: str, end: str, mode: str = "auto") -> DataFrame:
    """path from ``start`` to ``end``, no row if there is none."""
    seed = edges.sparkSession.createDataFrame([("s", start)], "label string, node string")
    return spread(edges, seed, mode=mode).where(F.col("node") == end).select("path", "dist")


def reachable(edges: DataFrame, seeds: DataFrame, closed: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """node of all that seeds (node) reach, themselves included."""
    return spread(edges, seeds.select(F.lit("s").alias("label"), "node"), closed, mode=mode, paths=False).select("node")


def reachable_from(edges: DataFrame, start: str, mode: str = "auto") -> DataFrame:
    """node of all that ``start`` reaches, itself left out."""
    seed = edges.sparkSession.createDataFrame([(start,)], "node string")
    return reachable(edges, seed, mode=mode).where(F.col("node") != start)


def has_path(edges: DataFrame, nodes: DataFrame, start: str, end: str, mode: str = "auto") -> bool:
    """Whether ``end`` can be reached; a node reaches itself if it is one of ``nodes`` (node)."""
    if start == end:
        return nodes.where(F.col("node") == start).limit(1).count() > 0
    return shortest_path(edges, start, end, mode).limit(1).count() > 0


def cycles(edges: DataFrame, mode: str = "auto") -> DataFrame:
    """cycle (closed path) of each strongly connected component that has one, and its size.

    Locally the path begins at the component's first node in depth-first order; in
    the distributed way at its lowest node, which may give another path through
    the same component.
    """
    edges, local = once(edges, mode)
    if local:

        def work(p: dict[str, pd.DataFrame]) -> pd.DataFrame:
            graph = Graph([], pairs(p["edge"]))
            sizes = {c[0]: len(c) for c in graph.components()}
            rows = [(c, sizes[c[0]]) for c in graph.cycles()]
            return pd.DataFrame(rows, columns=["cycle", "size"])

        return in_one_task({"edge": edges}, work, "cycle array<string>, size int")
    ids, edges = coded(edges)
    loops = edges.where("`from` = `to`").select(F.col("from").alias("node"))
    members = written(joined_up(edges), "members").hint("merge")
    many = written(members.groupBy("scc").agg(F.count(F.lit(1)).cast("int").alias("size")).where("size > 1"), "many")
    inner = edges.join(members.select(F.col("node").alias("from"), F.col("scc").alias("label")), "from").join(members.select(F.col("node").alias("to"), F.col("scc").alias("other")), "to").where("label = other").select("label", "from", "to")
    inner = written(inner.join(held(many.select(F.col("scc").alias("label")), many.count()), "label", "left_semi"), "inner")
    # edges stay inside their component, so components spread side by side
    starts = inner.where("label = `from` and `from` != `to`").groupBy("label").agg(F.min("to").alias("node"))
    found, level = frontiers(inner, starts)
    back = with_paths(written(found, "found"), level, False).where("node = label")
    at = written(back.withColumn("nodes", F.concat(F.array("label"), "path")).select("label", F.posexplode("nodes").alias("k", "node")), "at")
    named = names(at, ids, "node").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("cycle"))
    closed = named.join(held(many.withColumnRenamed("scc", "label"), many.count()), "label").select("cycle", "size")
    alone = loops.join(members.join(held(many, many.count()), "scc", "left_semi"), "node", "left_anti")
    return closed.unionByName(names(alone, ids, "node").select(F.array("node", "node").alias("cycle"), F.lit(1).alias("size")))


def components(edges: DataFrame, mode: str = "auto") -> DataFrame:
    """node, scc (the lowest node of its strongly connected component) of every node of ``edges``."""
    edges, local = once(edges, mode)
    if local:

        def work(p: dict[str, pd.DataFrame]) -> pd.DataFrame:
            rows = [(n, min(c)) for c in Graph([], pairs(p["edge"])).components() for n in c]
            return pd.DataFrame(rows, columns=["node", "scc"])

        return in_one_task({"edge": edges}, work, "node string, scc string")
    ids, edges = coded(edges)
    return names(names(joined_up(edges), ids, "node"), ids, "scc").select("node", "scc")


def joined_up(edges: DataFrame) -> DataFrame:
    """node, scc of distinct edges by number, in loops over tables."""
    every = edges.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    rest = written(edges.where("`from` != `to`"), "rest")
    done, between = None, []
    while True:
        # chains become one edge each and rings are done, however long; then nodes without an edge in or out go, alone
        rest, rings, inside = contracted(rest)
        if rings is not None:
            done = rings if done is None else done.unionByName(rings)
        if inside is not None:
            between.append(inside)
        for _ in range(TRIMMED):
            if not rest.limit(1).count():
                break
            ends = rest.select(F.col("from").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(rest.select(F.col("to").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
            lone = written(ends.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in")).where("out + `in` = 1").select("node"), "lone")
            n = lone.count()
            if not n:
                break
            rest = written(without(rest, lone, n), "rest")
        if not rest.limit(1).count():
            break
        if inside is not None:
            continue
        # each node takes the lowest node that reaches it; one that is its own is a root
        colour = written(rest.select(F.explode(F.array("from", "to")).alias("node")).distinct().withColumn("low", F.col("node")), "colour").hint("merge")
        while True:
            told = rest.join(colour.withColumnRenamed("node", "from"), "from").groupBy("to").agg(F.min("low").alias("sent"))
            after = written(colour.join(told.withColumnRenamed("to", "node"), "node", "left").select("node", F.least("low", F.coalesce("sent", "low")).alias("low")), "colour").hint("merge")
            same = after.join(colour, ["node", "low"], "left_anti").limit(1).count() == 0
            colour = after
            if same:
                break
        # what reaches a root within its colour is the root's component
        tinted = rest.join(colour.select(F.col("node").alias("from"), F.col("low").alias("label")), "from").join(colour.select(F.col("node").alias("to"), F.col("low").alias("other")), "to").where("label = other").select("label", "from", "to")
        tinted = written(tinted, "tinted")
        roots = colour.where("node = low").select(F.col("low").alias("label"), "node")
        part = written(frontiers(tinted, roots, back=True)[0].select("node", F.col("label").alias("scc")), "part")
        done = part if done is None else done.unionByName(part)
        rest = written(without(rest, part.select("node"), part.count()), "rest")
    named = every if done is None else every.join(done, "node", "left")
    named = written(every.select("node", F.col("node").alias("scc")) if done is None else named.select("node", F.coalesce("scc", "node").alias("scc")), "named")
    if not between:
        return named
    # the last chains were made of edges that earlier ones had become, so they are looked up first
    for inside in reversed(between):
        end = lambda c: named.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))  # noqa: E731, B023
        held = inside.join(end("before"), "before").join(end("after"), "after").where("before_scc = after_scc").select("node", F.col("before_scc").alias("__scc"))
        named = written(named.join(held, "node", "left").select("node", F.coalesce("__scc", "scc").alias("scc")), "named")
    low = named.groupBy("scc").agg(F.min("node").alias("low"))
    return named.join(low, "scc").select("node", F.col("low").alias("scc"))


def without(edges: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """``edges`` that touch none of so many nodes; edges stay where they are if these are few."""
    for end in ("from", "to"):
        edges = edges.join(held(gone.select(F.col("node").alias(end)), rows), end, "left_anti")
    return edges.select("from", "to")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``edges`` without the nodes that have one edge in and one out; (node, scc) of rings of such nodes; and (node,
    before, after) of the others, each with the ends of its chain, which has become an edge between them.

    What one end reaches stays the same, and a chain is in a component if both its ends are in it.
    Pointers double how far they lead, so a chain of any length takes a logarithm of rounds."""
    one = lambda a, b: edges.groupBy(F.col(a).alias("node")).agg(F.count("*").alias("n"), F.min(b).alias(b)).where("n = 1").select("node", b)
    thin = written(one("from", "to").join(one("to", "from"), "node").select("node", F.col("to").alias("after"), F.col("from").alias("before")), "thin")
    n = thin.count()
    if not n:
        return edges, None, None
    # from each thin node on: the last thin node that the pointer has come to, what comes after it, the lowest passed
    at = thin.select("node", F.col("node").alias("last"), "after", F.col("node").alias("low"))
    for _ in range(n.bit_length() + 1):
        on = at.select(F.col("node").alias("after"), F.col("last").alias("__last"), F.col("after").alias("__after"), F.col("low").alias("__low"))
        step = at.join(on, "after", "left")
        at = written(step.select("node", F.coalesce("__last", "last").alias("last"), F.coalesce("__after", "after").alias("after"), F.least("low", F.coalesce("__low", "low")).alias("low")), "chains")
        if not at.join(thin.select(F.col("node").alias("after")), "after", "left_semi").limit(1).count():
            break
    ring = at.join(thin.select(F.col("node").alias("after")), "after", "left_semi")
    open_ = written(at.join(ring.select("node"), "node", "left_anti"), "open")
    # the first of a chain is the one that no thin node leads to
    first = open_.join(thin.select("node", "before"), "node").join(thin.select(F.col("node").alias("before")), "before", "left_anti").select("last", "before")
    inside = written(open_.join(first, "last").select("node", "before", "after"), "inside")
    left = without(edges, thin.select("node"), n)
    new = inside.select(F.col("before").alias("from"), F.col("after").alias("to")).where("`from` != `to`")
    rest = written(left.unionByName(new).distinct(), "rest")
    return rest, written(ring.select("node", F.col("low").alias("scc")), "rings"), inside


def degrees(edges: DataFrame, out: bool = True) -> DataFrame:
    """node, degree: distinct neighbours, itself and externals included."""
    own, other = ("from", "to") if out else ("to", "from")
    return edges.groupBy(F.col(own).alias("node")).agg(F.countDistinct(other).alias("degree"))


def build(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with both ends known, one for each (from, to, kind), the first one kept."""
    known = modules.select("id")
    both = dependencies.join(known.withColumnRenamed("id", "from"), "from", "left_semi").join(known.withColumnRenamed("id", "to"), "to", "left_semi")
    return both.groupBy("from", "to", "kind").agg(F.min_by("location", "ord").alias("location"), F.min("ord").alias("ord"))


def package_edges(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """from, to, location, ord: distinct pairs of different packages, with the first module edge between them."""
    of = modules.select("id", "package")
    joined = dependencies.join(of.toDF("from", "pf"), "from").join(of.toDF("to", "pt"), "to").where("pf != pt")
    return joined.groupBy(F.col("pf").alias("from"), F.col("pt").alias("to")).agg(F.min_by("location", "ord").alias("location"), F.min("ord").alias("ord"))
