"""One of each kind of plug-in, added without touching library code."""

import pytest
from pyspark.sql import functions as F

from lattiq import config
from lattiq.operators import classify, resolve
from lattiq.plans import analyze, incremental
from lattiq.schemas import LOCATION, MANIFESTS, TSCONFIGS
from lattiq.sources import parser, repository


def test_resolution_handler(spark):
    """A handler for ``virtual:x`` names, asked before packages and after aliases."""
    names = lambda rows: rows.where(F.col("name").startswith("virtual:")).select("id", F.lit(0).alias("a"), F.posexplode(F.transform(F.array(F.lit("gen/"), F.lit("lib/")), lambda p: F.concat(p, F.substring("name", 9, 99)))).alias("b", "base"))
    handler = resolve.Handler("virtual-files", 15, names)
    rows = [("a.ts", s, "Static", None, k) for k, s in enumerate(("virtual:x", "virtual:y", "virtual:none", "./b"))]
    imports = spark.createDataFrame(rows, f"module_id string, specifier string, kind string, location {LOCATION}, ord long")
    files = spark.createDataFrame([("gen/x.ts",), ("lib/x.ts",), ("lib/y.ts",), ("b.ts",)], "path string")
    none = [spark.createDataFrame([], s) for s in (MANIFESTS, TSCONFIGS, "directory string, type string")]
    found = resolve.resolve(imports, files, *none, config.from_dict({}), [handler]).orderBy("ord").collect()
    assert [(r.outcome, r.value, r.handler) for r in found] == [("module", "gen/x.ts", "virtual-files"), ("module", "lib/y.ts", "virtual-files"), ("external", "virtual:none", "external-package"), ("module", "b.ts", "relative")]
    assert found[2].candidates[:2] == ["gen/none", "gen/none.cjs"]


@pytest.fixture
def hooks():
    yield
    parser.PARSERS.clear()
    classify.ADAPTERS.clear()


def test_parser_and_adapter(spark, hooks):
    """A language of ``use path`` lines, and a framework whose folder is for the browser."""

    def lines(files):
        place = lambda k: F.struct(F.col("path").alias("file"), k.cast("int").alias("line"), F.lit(1).alias("column"))
        all_lines = F.transform(F.split("source", "\n"), lambda x, k: F.when(x.startswith("use "), F.struct(F.substring(x, 5, 99).alias("specifier"), F.lit("Static").alias("kind"), place(k + 1).alias("location"))))
        uses = F.filter(all_lines, lambda u: u.isNotNull())
        none = F.array().cast("array<string>")
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], parser.PARSED).schema}
        own = files.select("path", uses.alias("imports"), none.alias("directives"), F.lit(None).alias("exported_runtime"), none.alias("marker_imports"), F.array().alias("comments"), F.lit(None).alias("error"))
        return own.select(*[F.col(c).cast(kinds[c]).alias(c) for c in own.columns])

    parser.PARSERS["use"] = lines
    classify.ADAPTERS.append(lambda df: F.when(F.col("path").startswith("web/"), F.struct(F.lit("webby").alias("adapter_id"), F.create_map(F.lit("role"), F.lit("view")).alias("attributes"), F.lit("browser").alias("runtime"))))
    files = spark.createDataFrame([("web/a.use", "use ../b\nnothing"), ("b.ts", "export const b = 1;")], "path string, source string").withColumn("length", F.lit(1).cast("long"))
    given = analyze.Inputs(files, spark.createDataFrame([], "path string, source string"), files.select("path"))
    frames = analyze.materialise(spark, given, config.from_dict({}))
    assert [tuple(r) for r in frames.dependencies.select("from", "to", "kind").collect()] == [("web/a.use", "b.ts", "Static")]
    assert {(r.id, r.runtime, r.framework.adapter_id) for r in frames.modules.collect()} >= {("web/a.use", "browser", "webby")}


def test_large_ignore_file_and_hidden_sources(spark, tmp_path):
    for path, text in {"src/gen.ts": "1", "src/kept.ts": "2", ".config/x.ts": "3", "sub/.gitignore": "only.ts\n", "sub/only.ts": "4", "only.ts": "5"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("# " + "x" * 3_000_000 + "\nsrc/gen.ts\n")
    files, _ = repository.discover(spark, str(tmp_path), config.from_dict({}))
    assert {r.path: r.source for r in files.collect()} == {"src/kept.ts": "2", ".config/x.ts": "3", "only.ts": "5"}


def test_newer_generations_cancel_older_ones(spark):
    """A slow update is interrupted when a newer one begins; nothing stale is published, equal content is not analysed again."""
    import time

    calls = []

    def analyse(given, c):
        calls.append(c["version"])
        if given.name == "slow":
            slow = F.udf(lambda x: time.sleep(60) or x, "long")
            spark.range(8).select(slow("id")).collect()
        return given.name

    def inputs(name, text):
        files = spark.createDataFrame([("a.ts", text)], "path string, source string")
        return analyze.Inputs(files, files.limit(0), files.select("path"), name)

    project, c = incremental.Project(spark, analyse), config.from_dict({})
    began = time.time()
    late = project.submit(inputs("slow", "1"), c)
    while not calls:
        time.sleep(0.1)
    time.sleep(1)
    assert project.submit(inputs("fast", "2"), c).result(120) == "fast"
    with pytest.raises(incremental.Cancelled):
        late.result(120)
    assert time.time() - began < 55 and (project.analysis, project.generation, project.reused) == ("fast", 2, 0)
    assert project.update(inputs("other", "2"), c) == "fast" and project.reused == 1 and len(calls) == 2
    assert project.update(inputs("new", "3"), c) == "new"
    with pytest.raises(incremental.Cancelled):
        project.update(inputs("stale", "4"), c, ticket=1)
    assert project.analysis == "new"
    with pytest.raises(ValueError, match="broken"):
        incremental.Project(spark, lambda *_: (_ for _ in ()).throw(ValueError("broken"))).update(inputs("x", "5"), c)
