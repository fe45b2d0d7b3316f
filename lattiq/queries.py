"""The engine's operators over a module graph seen in the driver's tables, with DuckDB SQL beside.

Modules are parts; dependencies join consecutive line items of one order. Pages
give imports by their links, events a feed of changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.config import from_dict
from lattiq.functions.hashes import fnv1a
from lattiq.operators import classify, diagnostics, graphs, rules, views
from lattiq.schemas import LOCATION, Frames
from lattiq.storage import sized, written

LAYERS = ["economy", "large", "medium", "promo", "small", "standard"]
#: Each layer may import those after it.
CONFIG = {
    "version": 1,
    "architecture": {
        "layers": {x: {"patterns": [f"src/{x}/**"], "can_import": LAYERS[i + 1 : -1]} for i, x in enumerate(LAYERS[:-1])},
        "coverage": {"minimum": 90, "allow_unassigned": ["src/standard/Brand-1/**"]},
        "features": {"root": "src/promo", "roots": ["src/promo", "src/large"], "public_entrypoints": ["m*0.ts"], "private_segments": ["Brand-7", "Brand-11"]},
        "forbidden_dependencies": [{"from": "src/small/**", "to": "src/*/Brand-1?/*.ts"}],
        "forbidden_package_dependencies": [{"from": "Brand#1", "to": "Brand#{2,3}"}],
    },
    "runtime": {"browser_incompatible_packages": ["Brand#2*"], "edge_incompatible_packages": ["Brand#1?"]},
    "rules": {"ARCH-006": {"max_depth": 2, "entrypoints": ["src/*/Brand-3/*.ts"]}, "ARCH-007": {"max_fan_out": 15}, "ARCH-008": {"max_fan_in": 15}, "ARCH-009": {"entrypoints": ["src/*/Brand-3/*.ts"]}},
    "overrides": [{"files": ["src/promo/**"], "rules": {"ARCH-003": "warning"}}, {"files": ["src/promo/Brand-5/**"], "rules": {"ARCH-003": "off"}}],
}
RUNTIME = "CASE p_size % 6 WHEN 0 THEN 'browser' WHEN 1 THEN 'server' WHEN 2 THEN 'edge' WHEN 3 THEN 'node' WHEN 4 THEN 'universal' ELSE 'unknown' END"
KIND = "CASE WHEN a.l_returnflag = 'A' THEN 'Static' WHEN a.l_returnflag = 'N' AND a.l_linestatus = 'O' THEN 'ReExport' WHEN a.l_returnflag = 'N' THEN 'Require' WHEN a.l_discount >= 0.08 THEN 'TypeOnly' ELSE 'Dynamic' END"
MODULE_SQL = f"SELECT p_partkey, concat('src/', lower(p_type), '/', replace(p_brand, '#', '-'), '/m', p_partkey, '.ts') AS id, p_brand AS package, lower(p_type) AS layer, {RUNTIME} AS runtime, p_size % 10 = 0 AND p_size != 50 AS rpc, CASE WHEN p_size = 50 THEN 'external' ELSE 'source' END AS kind FROM part"
ITEM_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem) x WHERE rn = 1"
EDGE_SQL = f"SELECT a.l_partkey AS f, b.l_partkey AS t, {KIND} AS kind, a.l_orderkey AS line, a.l_linenumber AS col, a.l_returnflag AS flag, a.l_discount AS discount FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
WITH = f"WITH RECURSIVE modules AS ({MODULE_SQL}), items AS ({ITEM_SQL}), edges AS ({EDGE_SQL}), deps AS (SELECT m.id AS f, n.id AS t, e.kind, e.line, e.col, e.flag, e.discount, m.layer AS fl, n.layer AS tl, m.package AS fp, n.package AS tp FROM edges e JOIN modules m ON e.f = m.p_partkey JOIN modules n ON e.t = n.p_partkey)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = view(spark, sf_dir, "part").selectExpr("p_partkey", "concat('src/', lower(p_type), '/', replace(p_brand, '#', '-'), '/m', p_partkey, '.ts') AS id", "p_brand AS package", "lower(p_type) AS layer", f"{RUNTIME} AS runtime", "p_size % 10 = 0 AND p_size != 50 AS rpc", "CASE WHEN p_size = 50 THEN 'external' ELSE 'source' END AS kind")
    attrs = F.create_map(F.lit("rpcBoundary"), F.col("rpc").cast("string"))
    return part.select("p_partkey", "id", F.col("id").alias("path"), "package", "kind", "runtime", F.when(F.col("layer") != "standard", F.col("layer")).alias("layer"), F.struct(F.lit("nextjs").alias("adapter_id"), attrs.alias("attributes")).alias("framework"))


def dependencies(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    # one shuffle by order serves both: the first of equal line numbers stays, then each line is followed by the next one
    line, order = F.col("l_linenumber"), Window.partitionBy("l_orderkey")
    rows = view(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_linenumber is not null")
    items = rows.withColumn("again", F.lag(line).over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")).eqNullSafe(line))
    items = items.where("not again").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount")
    next_ = lambda c: F.lead(c).over(order.orderBy("l_linenumber"))
    a = items.withColumns({"t": next_("l_partkey"), "after": next_("l_linenumber")}).where("after = l_linenumber + 1").alias("a")
    e = a.selectExpr("l_partkey AS f", "t", f"{KIND} AS kind", "l_orderkey AS line", "l_linenumber AS col", "l_returnflag AS flag", "l_discount AS discount")
    if where:
        e = e.where(where)
    ids = sized(modules(spark, sf_dir).select("p_partkey", "id"))
    e = e.join(ids.toDF("f", "from"), "f").join(ids.toDF("t", "to"), "t")
    at = F.struct(F.col("from").alias("file"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("column"))
    return e.select("from", "to", "kind", at.cast(LOCATION).alias("location"), (F.col("line") * 16 + F.col("col")).cast("long").alias("ord"))


def project(spark: SparkSession, sf_dir: str, where: str | None = None, keep: bool = False) -> Frames:
    """All relations; ``keep`` writes the dependencies once where many rules read them."""
    mods, config = modules(spark, sf_dir).drop("p_partkey"), from_dict(CONFIG)
    deps = dependencies(spark, sf_dir, where)
    deps = written(deps, "dependencies") if keep else deps
    resolved = deps.select("from", F.when(F.col("ord") % 3 == 0, "./x").otherwise("pkg").alias("specifier"), "kind", F.lit("workspace").alias("target_kind"), F.lit(None).cast("string").alias("target_package"), F.col("to").alias("target_module"), F.lit(None).cast("string").alias("target_name"), F.lit(None).cast("string").alias("reason"), "location", "ord")
    resolved = resolved.drop("target_package").join(mods.select(F.col("id").alias("target_module"), F.col("package").alias("target_package")), "target_module")
    brands = mods.select("package").distinct()
    # a manifest declares the brands of the same last digit
    digit = lambda c: F.substring(c, -1, 1)
    declared = brands.select(F.col("package"), digit("package").alias("d")).join(brands.select(F.col("package").alias("dependency"), digit("package").alias("d")), "d").select("package", "dependency")
    features = classify.features(mods.select("id", "package", F.lit("").alias("package_root")), config)
    return Frames(mods, deps, resolved, None, declared, classify.ownership(mods, config), features)


def context(spark: SparkSession, sf_dir: str, where: str | None = None, keep: bool = False) -> rules.Context:
    return rules.Context(project(spark, sf_dir, where, keep), from_dict(CONFIG))


def pair(df: DataFrame) -> DataFrame:
    at = "primary_location"
    return df.select(F.element_at("dependency_path", 1).alias("source"), F.element_at("dependency_path", 2).alias("target"), "message", F.col(f"{at}.line").cast("long").alias("line"), F.col(f"{at}.column").cast("long").alias("col"))


def single(df: DataFrame) -> DataFrame:
    return df.select(F.element_at("dependency_path", 1).alias("module"), "message")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{WITH} {sql}"
        return f

    return add


@query("SELECT kind, count(*) AS modules FROM modules GROUP BY kind")
def module_counts_by_kind(spark, d):
    return views.counts_by_kind(modules(spark, d))


@query("SELECT f AS module, concat('Outgoing coupling ', count(DISTINCT t), ' exceeds configured maximum 15') AS message FROM deps WHERE f IN (SELECT id FROM modules WHERE kind = 'source') GROUP BY f HAVING count(DISTINCT t) > 15")
def fan_out_violations(spark, d):
    return single(rules.outgoing(context(spark, d)))


@query("SELECT t AS module, concat('Incoming coupling ', count(DISTINCT f), ' exceeds configured maximum 15') AS message FROM deps WHERE t IN (SELECT id FROM modules WHERE kind = 'source') GROUP BY t HAVING count(DISTINCT f) > 15")
def fan_in_violations(spark, d):
    return single(rules.incoming(context(spark, d)))


ALLOWED = "fl = tl OR fl = 'standard' OR tl = 'standard' OR fl < tl"


@query(f"SELECT f AS source, t AS target, concat('Layer `', fl, '` cannot import `', tl, '`') AS message, line, CAST(col AS BIGINT) AS col FROM deps WHERE NOT ({ALLOWED})")
def layer_boundary_violations(spark, d):
    return pair(rules.layer_boundary(context(spark, d)))


@query(f"SELECT f AS source, t AS target, CASE WHEN fl = 'promo' THEN 'warning' ELSE 'error' END AS severity FROM deps WHERE NOT ({ALLOWED}) AND NOT (fl = 'promo' AND fp = 'Brand#5')")
def severity_overrides(spark, d):
    c = context(spark, d)
    return diagnostics.with_severity(rules.layer_boundary(c), "ARCH-003", c.config).select(F.element_at("dependency_path", 1).alias("source"), F.element_at("dependency_path", 2).alias("target"), "severity")


FEATURES = "feats AS (SELECT id, layer, replace(package, '#', '-') AS feature, package FROM modules WHERE layer IN ('promo', 'large'))"


@query(
    f", {FEATURES} SELECT d.f AS source, d.t AS target, concat('Importer `', coalesce(a.feature, 'outside'), '` accesses internals of feature `', b.feature, '` in package `', b.package, '`') AS message, line, CAST(col AS BIGINT) AS col "
    "FROM deps d JOIN feats b ON d.t = b.id LEFT JOIN feats a ON d.f = a.id WHERE (a.feature, a.package) IS DISTINCT FROM (b.feature, b.package) AND NOT regexp_matches(d.t, '/m[^/]*0\\.ts$')"
)
def feature_boundary_violations(spark, d):
    return pair(rules.feature_boundary(context(spark, d)))


@query(
    f", {FEATURES} SELECT d.f AS source, d.t AS target, 'Private module imported outside its public API' AS message, line, CAST(col AS BIGINT) AS col "
    "FROM deps d JOIN feats b ON d.t = b.id LEFT JOIN feats a ON d.f = a.id WHERE b.feature IN ('Brand-7', 'Brand-11') AND (a.feature, a.package) IS DISTINCT FROM (b.feature, b.package)"
)
def private_import_violations(spark, d):
    return pair(rules.private_import(context(spark, d)))


@query("SELECT f AS source, t AS target, 'Dependency is forbidden by architecture policy' AS message, line, CAST(col AS BIGINT) AS col FROM deps WHERE f LIKE 'src/small/%' AND regexp_matches(t, '^src/[^/]*/Brand-1[^/]/[^/]*\\.ts$')")
def forbidden_dependency_violations(spark, d):
    return pair(rules.forbidden(context(spark, d)))


@query("SELECT id AS module, 'Source module is not assigned to any architecture layer' AS message FROM modules WHERE kind = 'source' AND layer = 'standard' AND package != 'Brand#1'")
def unassigned_modules(spark, d):
    return single(rules.unassigned(context(spark, d)))


COVER = "SELECT count(*) AS total, count(*) FILTER (layer != 'standard') AS assigned, count(*) FILTER (layer = 'standard' AND package = 'Brand#1') AS exempt, count(*) FILTER (layer = 'standard' AND package != 'Brand#1') AS unassigned FROM modules WHERE kind = 'source'"


@query(f"SELECT *, CAST(assigned * 100 // (total - exempt) AS BIGINT) AS percent FROM ({COVER})")
def architecture_coverage(spark, d):
    c = context(spark, d)
    return rules.coverage_of(c.frames.ownership)


@query(f"SELECT concat('Architecture layer coverage ', assigned * 100 // (total - exempt), '% is below the configured minimum 90%') AS message, unassigned AS listed FROM ({COVER}) WHERE assigned * 100 // (total - exempt) < 90")
def coverage_threshold(spark, d):
    return rules.coverage(context(spark, d)).select("message", F.size("dependency_path").cast("long").alias("listed"))


@query("SELECT fp AS source, tp AS target, min(line * 16 + col) AS first FROM deps WHERE fp != tp GROUP BY fp, tp")
def package_edges(spark, d):
    c = context(spark, d)
    return c.packages.select(F.col("from").alias("source"), F.col("to").alias("target"), F.col("ord").alias("first"))


@query("SELECT concat('package:', fp) AS source, concat('package:', tp) AS target, min(line * 16 + col) // 16 AS line FROM deps WHERE fp = 'Brand#1' AND tp IN ('Brand#2', 'Brand#3') GROUP BY fp, tp")
def forbidden_package_dependency(spark, d):
    return pair(rules.forbidden_package(context(spark, d))).select("source", "target", "line")


@query("SELECT f AS source, t AS target, concat('Workspace package `', tp, '` is not declared by `', fp, '`') AS message, line, CAST(col AS BIGINT) AS col FROM deps WHERE fp != tp AND right(fp, 1) != right(tp, 1)")
def undeclared_workspace_dependency(spark, d):
    return pair(rules.undeclared(context(spark, d)))


@query("SELECT f AS source, t AS target, concat('Relative import crosses package boundary from `', fp, '` to `', tp, '`') AS message, line, CAST(col AS BIGINT) AS col FROM deps WHERE fp != tp AND (line * 16 + col) % 3 = 0")
def cross_package_relative(spark, d):
    return pair(rules.cross_package(context(spark, d)))


SEEDS = "SELECT id FROM modules WHERE package = 'Brand#3' AND kind = 'source'"


def seeds(spark, d) -> DataFrame:
    return modules(spark, d).where("package = 'Brand#3' AND kind = 'source'").select(F.lit("entry").alias("label"), F.col("id").alias("node"))


REACH = f", s AS (SELECT DISTINCT f, t FROM deps), r(id) AS ({SEEDS} UNION SELECT s.t FROM r JOIN s ON r.id = s.f)"


@query(f"{REACH} SELECT id AS node FROM r")
def reachable_set(spark, d):
    return graphs.reachable(dependencies(spark, d), seeds(spark, d).select("node"), mode="distributed")


@query(f"{REACH} SELECT id AS module, 'Source module is unreachable from every configured architecture entrypoint' AS message FROM modules WHERE kind = 'source' AND id NOT IN (SELECT id FROM r)")
def orphan_modules(spark, d):
    return single(rules.orphan(context(spark, d)))


DEPTH = f", s AS (SELECT DISTINCT f, t FROM deps), r(id, n) AS (SELECT id, 0 FROM modules WHERE package = 'Brand#3' AND kind = 'source' UNION SELECT s.t, r.n + 1 FROM r JOIN s ON r.id = s.f WHERE r.n < 60), best AS (SELECT id, min(n) AS n FROM r GROUP BY id)"


@query(f"{DEPTH} SELECT id AS node, CAST(n AS BIGINT) AS depth FROM best")
def dependency_depth(spark, d):
    return graphs.spread(dependencies(spark, d), seeds(spark, d), mode="distributed").select("node", F.col("dist").cast("long").alias("depth"))


@query(f"{DEPTH} SELECT id AS module, concat('Dependency depth ', n, ' exceeds configured maximum 2') AS message, CAST(n + 1 AS BIGINT) AS path_length FROM best WHERE n > 2")
def depth_violations(spark, d):
    return rules.depth(context(spark, d)).select(F.element_at("dependency_path", -1).alias("module"), "message", F.size("dependency_path").cast("long").alias("path_length"))


CHANGED = "SELECT concat('src/', lower(p_type), '/', replace(p_brand, '#', '-'), '/m', p_partkey, '.ts') AS id FROM part WHERE p_partkey IN (SELECT user_id FROM events WHERE event_type = 'error')"


def changed(spark, d) -> DataFrame:
    users = view(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("p_partkey")).distinct()
    return modules(spark, d).join(users, "p_partkey", "left_semi").select(F.col("id").alias("path"), F.lit("M").alias("status"))


@query(f", s AS (SELECT DISTINCT f, t FROM deps), r(id) AS ({CHANGED} UNION SELECT s.f FROM r JOIN s ON r.id = s.t) SELECT id AS path FROM r")
def impact_closure(spark, d):
    return views.impact(project(spark, d), changed(spark, d))


@query(f", c AS ({CHANGED}) SELECT id AS path FROM c UNION SELECT t FROM deps WHERE f IN (SELECT id FROM c) UNION SELECT f FROM deps WHERE t IN (SELECT id FROM c)")
def edge_affected_region(spark, d):
    return views.edge_region(dependencies(spark, d), changed(spark, d).select("path"))


def reach_sql(targets: str, sources: str) -> str:
    """Sources that reach targets over edges that run, not through boundaries (but from them), and the fewest steps."""
    return (
        f", s AS (SELECT DISTINCT f, t FROM deps WHERE kind != 'TypeOnly'), r(id, n) AS (SELECT id, 0 FROM modules WHERE {targets} UNION SELECT s.f, r.n + 1 FROM r JOIN s ON r.id = s.t WHERE r.n < 60 AND r.id NOT IN (SELECT id FROM modules WHERE rpc)) "
        f"SELECT id AS module, CAST(min(n) AS BIGINT) AS hops FROM r WHERE id IN (SELECT id FROM modules WHERE kind != 'external' AND {sources}) GROUP BY id"
    )


def first_of(df: DataFrame) -> DataFrame:
    """Where the path that a rule shows begins, and its steps, the fewest there are."""
    return df.select(F.element_at("dependency_path", 1).alias("module"), (F.size("dependency_path") - 1).cast("long").alias("hops"))


@query(reach_sql("runtime = 'server'", "runtime = 'browser'"))
def runtime_reach_server(spark, d):
    return first_of(rules.browser_to_server(context(spark, d)))


@query(reach_sql("runtime = 'node'", "runtime = 'browser'"))
def runtime_reach_node(spark, d):
    return first_of(rules.browser_to_node(context(spark, d)))


@query(reach_sql("kind = 'external' AND regexp_matches(package, '^Brand#2[^/]*$')", "runtime = 'browser'"))
def browser_incompatible_package(spark, d):
    return first_of(rules.browser_package(context(spark, d)))


@query(reach_sql("(runtime = 'node' OR (kind = 'external' AND regexp_matches(package, '^Brand#1[^/]$')))", "runtime = 'edge'"))
def edge_incompatible(spark, d):
    return first_of(rules.edge_runtime(context(spark, d)))


@query(
    f", s AS (SELECT DISTINCT f, t FROM deps WHERE kind != 'TypeOnly'), shut AS (SELECT id FROM modules WHERE rpc), "
    "b(id) AS (SELECT id FROM modules WHERE runtime = 'browser' AND kind != 'external' UNION SELECT s.f FROM b JOIN s ON b.id = s.t WHERE b.id NOT IN (SELECT id FROM shut)), "
    "n(id) AS (SELECT id FROM modules WHERE runtime IN ('server', 'node') UNION SELECT s.f FROM n JOIN s ON n.id = s.t WHERE n.id NOT IN (SELECT id FROM shut)) "
    "SELECT id AS module FROM modules WHERE runtime = 'universal' AND kind != 'external' AND id IN (SELECT id FROM b) AND id IN (SELECT id FROM n)"
)
def universal_ambiguous(spark, d):
    return first_of(rules.ambiguous(context(spark, d))).select("module")


@query(
    f", s AS (SELECT DISTINCT f, t FROM deps), may AS (SELECT id FROM modules WHERE runtime = 'universal'), shut AS (SELECT id FROM modules WHERE rpc OR runtime NOT IN ('universal', 'browser')), "
    "r(id) AS (SELECT id FROM modules WHERE runtime = 'browser' AND kind != 'external' UNION SELECT s.t FROM r JOIN s ON r.id = s.f WHERE r.id NOT IN (SELECT id FROM shut)) "
    "SELECT runtime_after AS runtime, count(*) AS modules FROM (SELECT CASE WHEN kind != 'external' AND id IN (SELECT id FROM may) AND id IN (SELECT id FROM r) THEN 'browser' ELSE runtime END AS runtime_after FROM modules) GROUP BY 1"
)
def runtime_propagation(spark, d):
    out = classify.propagate_client(modules(spark, d), dependencies(spark, d))
    return out.groupBy("runtime").agg(F.count(F.lit(1)).alias("modules"))


CLOSURE = "s AS (SELECT DISTINCT f, t FROM deps{}), c(f, t) AS (SELECT f, t FROM s UNION SELECT c.f, s.t FROM c JOIN s ON c.t = s.f)"


@query(f", {CLOSURE.format('')} SELECT a.f AS node, least(a.f, min(a.t)) AS scc FROM c a JOIN c b ON a.f = b.t AND a.t = b.f GROUP BY a.f")
def scc_members(spark, d):
    """Nodes on a cycle with the lowest node of their component, found by distributed loops."""
    e = written(dependencies(spark, d).select("from", "to"), "edges")
    found = written(graphs.components(e, "distributed"), "scc")
    many = found.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scc")
    loops = e.where("`from` = `to`").select(F.col("from").alias("node"), F.col("from").alias("scc")).distinct()
    return found.join(many, "scc", "left_semi").select("node", "scc").unionByName(loops.join(found.join(many, "scc", "left_semi"), "node", "left_anti"))


@query(f", {CLOSURE.format('')}, m AS (SELECT a.f AS node, least(a.f, min(a.t)) AS scc FROM c a JOIN c b ON a.f = b.t AND a.t = b.f GROUP BY a.f) SELECT count(*) AS size FROM m GROUP BY scc")
def cyclic_modules(spark, d):
    """Sizes of the components that rule ARCH-001 reports."""
    found = graphs.cycles(dependencies(spark, d))
    return found.select(F.col("size").cast("long").alias("size"))


@query(f", {CLOSURE.format(' WHERE fp != tp').replace('SELECT DISTINCT f, t', 'SELECT DISTINCT fp AS f, tp AS t')}, m AS (SELECT a.f AS node, least(a.f, min(a.t)) AS scc FROM c a JOIN c b ON a.f = b.t AND a.t = b.f GROUP BY a.f) SELECT count(*) AS packages FROM m GROUP BY scc")
def package_cycles(spark, d):
    return graphs.cycles(context(spark, d).packages).select(F.col("size").cast("long").alias("packages"))


@query()
def circular_dependencies(spark, d):
    """ARCH-001 with evidence paths, which SQL can't choose."""
    c = context(spark, d, keep=True)
    return rules.circular(c).select(F.array_join("dependency_path", " -> ").alias("path"), "message")


@query()
def runtime_cycles(spark, d):
    return rules.runtime_cycle(context(spark, d, keep=True)).select(F.array_join("dependency_path", " -> ").alias("path"), "message")


@query(f", s AS (SELECT DISTINCT f, t FROM deps), a AS (SELECT min(f) AS id FROM s), r(id, n) AS (SELECT id, 0 FROM a UNION SELECT s.t, r.n + 1 FROM r JOIN s ON r.id = s.f WHERE r.n < 60) SELECT id AS target, CAST(min(n) AS BIGINT) AS hops FROM r GROUP BY id")
def shortest_path_pairs(spark, d):
    e = dependencies(spark, d)
    start = e.agg(F.min("from").alias("node")).select(F.lit("s").alias("label"), "node")
    return graphs.spread(e, start).select(F.col("node").alias("target"), (F.size("path") - 1).cast("long").alias("hops"))


RAW = f"{FEATURES}, raw AS (SELECT d.f, d.t, line, col, 'ARCH-004' AS rule, 1 AS spec FROM deps d JOIN feats b ON d.t = b.id LEFT JOIN feats a ON d.f = a.id WHERE (a.feature, a.package) IS DISTINCT FROM (b.feature, b.package) AND NOT regexp_matches(d.t, '/m[^/]*0\\.ts$') UNION ALL SELECT d.f, d.t, line, col, 'ARCH-005', 2 FROM deps d JOIN feats b ON d.t = b.id LEFT JOIN feats a ON d.f = a.id WHERE b.feature IN ('Brand-7', 'Brand-11') AND (a.feature, a.package) IS DISTINCT FROM (b.feature, b.package)), top AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY spec DESC, rule, line, col) AS rn FROM raw)"


def feature_rules(spark, d) -> DataFrame:
    c = context(spark, d)
    return diagnostics.fingerprinted(rules.feature_boundary(c).unionByName(rules.private_import(c)))


@query(f", {RAW} SELECT x.f AS source, x.t AS target, x.rule, CASE WHEN y.n > 1 THEN y.names END AS related FROM top x JOIN (SELECT f, t, count(DISTINCT rule) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS names FROM raw GROUP BY f, t) y ON x.f = y.f AND x.t = y.t WHERE rn = 1")
def arbitrated_diagnostics(spark, d):
    return diagnostics.arbitrate(feature_rules(spark, d)).select(F.element_at("dependency_path", 1).alias("source"), F.element_at("dependency_path", 2).alias("target"), F.col("rule_id").alias("rule"), F.col("metadata")["related_rules"].alias("related"))


def directives(spark, d) -> DataFrame:
    """Directives on lines divisible by seven of layer diagnostics, and for whole files of Brand#9."""
    deps = dependencies(spark, d)
    lines = deps.where("location.line % 7 = 0").select(F.col("from").alias("path"), F.col("location.line").alias("line"), F.lit(False).alias("file_scope")).distinct()
    files = modules(spark, d).where("package = 'Brand#9'").select(F.col("id").alias("path"), F.lit(1).alias("line"), F.lit(True).alias("file_scope"))
    return lines.unionByName(files).select("path", "line", "file_scope", F.lit("ARCH-003").alias("rule"), F.lit("accepted").alias("reason"))


DIRECTIVES = "dirs AS (SELECT DISTINCT f AS path, line, false AS file_scope FROM deps WHERE line % 7 = 0 UNION ALL SELECT id, 1, true FROM modules WHERE package = 'Brand#9')"
LAYER_DIAGS = f"diags AS (SELECT f, t, fp, line, col FROM deps WHERE NOT ({ALLOWED}))"
HIT = "CASE WHEN fp = 'Brand#9' THEN 'file' WHEN line % 7 = 0 THEN 'line' WHEN EXISTS (SELECT 1 FROM dirs x WHERE x.path = diags.f AND NOT x.file_scope AND x.line = diags.line - 1) THEN 'above' END"


@query(f", {DIRECTIVES}, {LAYER_DIAGS} SELECT f AS source, t AS target, line, CAST(col AS BIGINT) AS col, ({HIT}) IS NOT NULL AS suppressed FROM diags")
def suppressed_diagnostics(spark, d):
    raw = diagnostics.fingerprinted(rules.layer_boundary(context(spark, d)))
    out = diagnostics.suppress_by_source(raw, directives(spark, d), False)
    return pair(out.select("*")).drop("message").join(out.select(F.element_at("dependency_path", 1).alias("source"), F.element_at("dependency_path", 2).alias("target"), F.col("primary_location.line").cast("long").alias("line"), F.col("primary_location.column").cast("long").alias("col"), "suppressed"), ["source", "target", "line", "col"])


@query(f", {DIRECTIVES}, {LAYER_DIAGS}, hits AS (SELECT f, line, {HIT} AS how FROM diags) SELECT path AS file, CAST(line AS BIGINT) AS line, 'Unused suppression for `ARCH-003`' AS message FROM dirs WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.f = dirs.path AND ((dirs.file_scope AND h.how = 'file') OR (NOT dirs.file_scope AND ((h.how = 'line' AND h.line = dirs.line) OR (h.how = 'above' AND h.line = dirs.line + 1)))))")
def unused_suppressions(spark, d):
    raw = diagnostics.fingerprinted(rules.layer_boundary(context(spark, d)))
    out = diagnostics.suppress_by_source(raw, directives(spark, d), True).where("rule_id = 'SUPPRESS-001'")
    return out.select(F.col("primary_location.file").alias("file"), F.col("primary_location.line").cast("long").alias("line"), "message")


def baseline(spark, d) -> DataFrame:
    """Fingerprints of what was reported on edges of even orders, and one that is gone."""
    old = diagnostics.fingerprinted(rules.forbidden(context(spark, d))).where("primary_location.line % 2 = 0")
    gone = spark.createDataFrame([("0000000000000000",)], "fingerprint string")
    return written(diagnostics.to_baseline(old).select("fingerprint").unionByName(gone), "baseline")


POLICY = "p AS (SELECT f, t, line, concat(f, '|', t) AS fp_ FROM deps WHERE f LIKE 'src/small/%' AND regexp_matches(t, '^src/[^/]*/Brand-1[^/]/[^/]*\\.ts$'))"


@query(f", {POLICY} SELECT f AS source, t AS target, CAST(line AS BIGINT) AS line FROM p WHERE fp_ NOT IN (SELECT fp_ FROM p WHERE line % 2 = 0)")
def baseline_new(spark, d):
    live = diagnostics.fingerprinted(rules.forbidden(context(spark, d)))
    return pair(views.introduced(live, baseline(spark, d))).select("source", "target", "line")


@query(f", {POLICY} SELECT count(*) FILTER (fp_ IN (SELECT fp_ FROM p WHERE line % 2 = 0)) AS existing, count(*) FILTER (fp_ NOT IN (SELECT fp_ FROM p WHERE line % 2 = 0)) AS introduced, 1 AS fixed, (SELECT count(*) FROM ({CHANGED})) AS affected FROM p")
def regression_summary(spark, d):
    live = written(diagnostics.fingerprinted(rules.forbidden(context(spark, d))), "live")
    return diagnostics.regression_summary(live, baseline(spark, d), changed(spark, d))


@query("SELECT id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(id) + 1), lambda x: ascii(substr(id, CAST(x AS INTEGER), 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR AS hash FROM modules")
def fingerprints(spark, d):
    text = fnv1a(F.col("id"))
    return modules(spark, d).select("id", F.conv(text, 16, 10).alias("hash"))


@query("SELECT 'package' AS section, package AS name, string_agg(id, ',' ORDER BY id) AS members FROM modules WHERE kind = 'source' GROUP BY package UNION ALL SELECT 'layer', CASE WHEN layer = 'standard' THEN '(unassigned)' ELSE layer END, string_agg(id, ',' ORDER BY id) FROM modules WHERE kind = 'source' GROUP BY 2 UNION ALL SELECT 'runtime', runtime, string_agg(id, ',' ORDER BY id) FROM modules WHERE kind = 'source' GROUP BY 2")
def architecture_overview(spark, d):
    p = project(spark, d)
    none = rules.none(rules.Context(p, from_dict(CONFIG)))
    return views.overview(p, none).where("section in ('package', 'layer', 'runtime')").select("section", "name", F.array_join("members", ",").alias("members"))


@query(", x AS (SELECT min(f) AS id FROM deps) SELECT 'dependency' AS direction, t AS module, kind, line, CAST(col AS BIGINT) AS col FROM deps WHERE f = (SELECT id FROM x) UNION ALL SELECT 'dependent', f, kind, line, CAST(col AS BIGINT) FROM deps WHERE t = (SELECT id FROM x)")
def inspect_module(spark, d):
    deps = dependencies(spark, d)
    return views.edges_of(deps, deps.agg(F.min("from")).first()[0]).select("direction", "module", "kind", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"))


LINKS = "links AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS specifier FROM pages)"


def page_links(spark, d) -> DataFrame:
    pages = view(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("specifier"))


@query(f", {LINKS} SELECT page_id, specifier, count(*) AS n FROM links GROUP BY page_id, specifier")
def page_link_extraction(spark, d):
    return page_links(spark, d).groupBy("page_id", "specifier").agg(F.count(F.lit(1)).alias("n"))


@query(f", {LINKS}, known AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS name FROM pages) SELECT CASE WHEN k.name IS NOT NULL THEN 'module' WHEN specifier LIKE '/%' THEN 'unresolved' ELSE 'external' END AS outcome, count(*) AS n FROM links l LEFT JOIN known k ON l.host = k.host AND l.specifier = concat('/', k.name) GROUP BY 1")
def page_link_resolution(spark, d):
    known = view(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1)).alias("specifier"), F.lit(True).alias("hit")).distinct()
    outcome = F.when(F.col("hit"), "module").when(F.col("specifier").startswith("/"), "unresolved").otherwise("external")
    return page_links(spark, d).join(known, ["host", "specifier"], "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f", x AS (SELECT CASE WHEN fl = 'promo' THEN 'warning' ELSE 'error' END AS severity FROM deps WHERE NOT ({ALLOWED}) AND NOT (fl = 'promo' AND fp = 'Brand#5')) SELECT count(*) FILTER (severity = 'error') AS failures, count(*) FILTER (severity = 'warning') AS warnings, greatest(count(*) FILTER (severity = 'warning') - 10, 0) AS warning_excess, count(*) > 0 AS failed FROM x")
def failure_policy_count(spark, d):
    c = context(spark, d)
    return diagnostics.failure_policy(diagnostics.with_severity(rules.layer_boundary(c), "ARCH-003", c.config), "error", 10)


@query("SELECT f AS node, count(DISTINCT t) AS fan_out FROM deps GROUP BY f")
def out_degrees(spark, d):
    return graphs.degrees(dependencies(spark, d)).select("node", F.col("degree").alias("fan_out"))


@query("SELECT f AS source, t AS target, kind, min(line * 16 + col) AS first FROM deps GROUP BY f, t, kind")
def graph_build(spark, d):
    return graphs.build(dependencies(spark, d), modules(spark, d)).select(F.col("from").alias("source"), F.col("to").alias("target"), "kind", F.col("ord").alias("first"))


@query("SELECT (SELECT count(*) FROM modules) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT f, t, kind FROM deps)) AS typed_edges")
def graph_counts(spark, d):
    e = graphs.build(dependencies(spark, d), modules(spark, d))
    return modules(spark, d).agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("typed_edges")))


@query("SELECT id AS module, CASE WHEN layer != 'standard' THEN 'assigned' WHEN package = 'Brand#1' THEN 'exempt' ELSE 'unassigned' END AS status FROM modules WHERE kind = 'source'")
def layer_ownership(spark, d):
    return project(spark, d).ownership.select("module", "status")


@query(f", {FEATURES} SELECT id AS module, package, feature, concat('src/', layer) AS root FROM feats")
def module_features(spark, d):
    return project(spark, d).features


@query("SELECT id, lower(regexp_extract(id, '[^/]*$')) AS file, concat('src/', split_part(id, '/', 2)) AS top FROM modules")
def path_functions(spark, d):
    from lattiq.functions.paths import file_name, normal, parent

    twisted = F.regexp_replace("id", "^src/([^/]*)/", "./src/x/../$1/./")
    return modules(spark, d).select(normal(twisted).alias("id"), F.lower(file_name(F.col("id"))).alias("file"), parent(parent(normal(twisted))).alias("top"))


@query(", x AS (SELECT DISTINCT f, t FROM deps WHERE fp = 'Brand#1' AND tp = 'Brand#2') SELECT f AS source, t AS target, 'denied' AS verdict FROM x")
def governed_edges(spark, d):
    """Edges that a package policy's diagnostic governs."""
    c = context(spark, d)
    hit = rules.forbidden_package(c).where(F.element_at("dependency_path", 2) == "package:Brand#2").select(F.regexp_replace(F.element_at("dependency_path", 1), "^package:", "").alias("pf"), F.regexp_replace(F.element_at("dependency_path", 2), "^package:", "").alias("pt"))
    return c.frames.dependencies.select("from", "to").distinct().join(c.frames.modules.select(F.col("id").alias("from"), F.col("package").alias("pf")), "from").join(c.frames.modules.select(F.col("id").alias("to"), F.col("package").alias("pt")), "to").join(hit, ["pf", "pt"]).select(F.col("from").alias("source"), F.col("to").alias("target"), F.lit("denied").alias("verdict"))


@query()
def rule_catalogue(spark, d):
    return views.rules_table(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, those on cycles, depth, reach and runtimes too, arbitrated, with fingerprints."""
    own = rules.Context(project(spark, sf_dir, keep=True), from_dict(CONFIG))
    found = diagnostics.arbitrate(rules.evaluate(own))
    return found.select("rule_id", "fingerprint", "severity", "message", F.array_join("dependency_path", " -> ").alias("path"), F.col("primary_location.file").alias("file"), F.col("primary_location.line").alias("line"))


@query()
def all_diagnostics(spark, d):
    return flagship(spark, d)
