"""Scans of a source tree into relations, through Spark's readers."""

from __future__ import annotations

import json
import os
import re
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.config import Config, ConfigError, parse
from lattiq.functions.globs import match, matches, regex_of
from lattiq.functions.paths import normal, slashes
from lattiq.schemas import CHANGES, FILES, MANIFESTS, TSCONFIGS
from lattiq.storage import written

#: Files beside sources that an analysis depends on (fixed values).
INPUTS = r"(?:^|/)(?:package\.json|pnpm-workspace\.yaml|[tj]sconfig[^/]*\.json|next\.config\.[cm]?[jt]s)$"

IGNORE_FILE = ".gitignore"

#: One entry of a folder's listing as the store's client prints it.
ENTRY = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?")


def hidden(spark: SparkSession, root: str, most: int | None) -> list[tuple[str, int, bytearray | None]]:
    """(path, length, content) of all files with hidden names, which Spark's readers pass over.

    Folders are listed through the store's own client, one call for each; a source tree has
    few hidden files. Content is read up to ``most`` bytes (None: any), else it is null; that of
    ignore files is read at any size.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/")
    rows, todo = [], [top]
    while todo:
        folder = todo.pop()
        entries = jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(fs.listStatusIterator(jvm.org.apache.hadoop.fs.Path(folder)))
        for path, is_folder, length in ENTRY.findall(entries.toString()):
            parts = path[len(top) + 1 :].split("/")
            if is_folder == "true":
                if parts[-1] not in (".git", "node_modules"):
                    todo.append(path)
            elif any(p[:1] in (".", "_") for p in parts):
                content = None
                if most is None or int(length) <= most or parts[-1] == IGNORE_FILE:
                    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
                    content = bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                    stream.close()
                rows.append(("/".join(parts), int(length), content))
    return rows


def scan(spark: SparkSession, root: str, most: int | None = 0, rows: list | None = None) -> DataFrame:
    """path (relative, with slashes), length and content of all files below a folder of any store Spark reads.

    Files with hidden names (``rows``, if they were listed before) are all there; of those up to ``most`` bytes the content is too.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    at = re.sub("^[a-z]+:/*", "/", top)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    strip = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(at) + "/", "")
    seen = raw.select(slashes(strip).alias("path"), "length", "content")
    own = spark.createDataFrame(hidden(spark, root, most) if rows is None else rows, "path string, length bigint, content binary")
    return seen.join(F.broadcast(own.select("path")), "path", "left_anti").unionByName(own)


def ignored(rules: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """Patterns of ignore files as (regular expression, whether it ignores); later ones win."""
    found = []
    for folder, text in sorted(rules):
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].lstrip("\\")
            fixed = "/" in line.rstrip("/")
            body = line.strip("/")
            prefix = (folder + "/" if folder else "") + ("" if fixed else "**/")
            for tail in ("/**",) if line.endswith("/") else ("", "/**"):
                found.append((regex_of(prefix + body + tail), not keep))
    return found


def discover(spark: SparkSession, root: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """Source files to analyse (FILES), and the other inputs (path, source).

    Exclusion goes before inclusion, files over the size limit are left out; the
    filters stand before the contents are decoded.
    """
    project = config["project"]
    for r in project["roots"]:
        if ".." in r.split("/") or os.path.isabs(r):
            raise ConfigError(f"project.roots: `{r}` leaves the project")
    rows = hidden(spark, root, project["max_file_size_kb"] * 1024)
    every = scan(spark, root, rows=rows).where(~F.col("path").rlike(r"(^|/)\.git/"))
    lists = [(os.path.dirname(path), bytes(content or b"").decode("utf-8", "replace")) for path, _, content in rows if os.path.basename(path) == IGNORE_FILE]
    # one expression for each run of lines with the same verdict
    for drop, run in groupby(ignored(lists), key=lambda x: x[1]):
        pattern = "|".join(f"(?:{p})" for p, _ in run)
        every = every.withColumn("gone", F.when(F.col("path").rlike(pattern), drop).otherwise(F.col("gone") if "gone" in every.columns else F.lit(False)))
    if "gone" in every.columns:
        every = every.where("not gone").drop("gone")
    roots = [r.strip("./") for r in project["roots"]]
    below = F.lit(False)
    for r in roots:
        below = below | (F.lit(True) if not r else F.col("path").startswith(r + "/"))
    is_source = below & ~matches(F.col("path"), project["exclude"]) & matches(F.col("path"), project["include"]) & (F.col("length") <= project["max_file_size_kb"] * 1024)
    is_input = F.col("path").rlike(INPUTS) & ~F.col("path").rlike(r"(^|/)node_modules/")
    # contents are read once for both
    some = every.select("path", "length", "content", is_source.alias("own"), is_input.alias("input")).where("own or input")
    some = written(some.select("path", F.decode("content", "UTF-8").alias("source"), "length", "own", "input"), "scanned")
    return some.where("own").select("path", "source", "length"), some.where("input").select("path", "source")


def overlaid(files: DataFrame, overlays: DataFrame) -> DataFrame:
    """Files with texts from an editor in place of those on disk; overlays (path, source) may add files."""
    over = overlays.select("path", F.col("source").alias("new"))
    joined = files.join(over, "path", "full_outer")
    source = F.coalesce("new", "source")
    return joined.select("path", source.alias("source"), F.octet_length(source).cast("long").alias("length"))


def manifests(spark: SparkSession, inputs: DataFrame) -> DataFrame:
    """MANIFESTS of the workspace: the root's and those its workspaces name; nameless ones are left out.

    Manifests and compiler settings are few and read on the driver.
    """
    texts = {r.path: r.source for r in inputs.where(F.col("path").rlike(r"(^|/)(package\.json|pnpm-workspace\.yaml)$")).collect()}
    root = _json(texts.get("package.json"))
    globs = root.get("workspaces") or []
    globs = list(globs.get("packages", []) if isinstance(globs, dict) else globs)
    if "pnpm-workspace.yaml" in texts:
        globs += (parse(texts["pnpm-workspace.yaml"]) or {}).get("packages") or []
    rows, seen = [], {}
    for path, text in sorted(texts.items()):
        if not path.endswith("package.json"):
            continue
        folder = os.path.dirname(path)
        wanted = folder == "" or (match(folder, [g.strip("/") for g in globs if not g.startswith("!")]) and not match(folder, [g[1:].strip("/") for g in globs if g.startswith("!")]))
        name = _json(text).get("name")
        if not wanted or not name:
            continue
        if name in seen:
            raise ConfigError(f"workspace package `{name}` is declared in `{seen[name]}` and `{folder}`")
        seen[name] = folder
        rows.append((folder, name, text))
    return spark.createDataFrame(rows, MANIFESTS)


def _json(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def declared(packages: DataFrame) -> DataFrame:
    """package and dependency; a package without any has one row with null."""
    one = lambda k: F.map_keys(F.coalesce(F.from_json(F.get_json_object("json", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.flatten(F.array(*[one(k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])))
    return packages.select(F.col("name").alias("package"), F.explode_outer(names).alias("dependency"))


def scopes(inputs: DataFrame) -> DataFrame:
    """directory and type (module, commonjs or null) of every manifest."""
    own = inputs.where(F.col("path").rlike(r"(^|/)package\.json$"))
    return own.select(F.regexp_replace("path", "/?package.json$", "").alias("directory"), F.get_json_object("source", "$.type").alias("type"))


def strip_json(text: str) -> str:
    """JSON from JSON with comments and trailing commas."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"'
            continue
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
        else:
            quoted = c == '"'
            out.append(c)
            i += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def tsconfigs(spark: SparkSession, inputs: DataFrame) -> DataFrame:
    """TSCONFIGS by folder (tsconfig before jsconfig), with what they extend; a cycle is an error."""
    texts = {r.path: r.source for r in inputs.where(F.col("path").rlike(r"(^|/)[tj]sconfig[^/]*\.json$")).collect()}

    def load(path: str, seen: tuple[str, ...] = ()) -> dict:
        if path in seen:
            raise ConfigError(f"circular extends of `{path}`")
        doc = json.loads(strip_json(texts[path]) or "{}")
        above = doc.get("extends")
        if isinstance(above, list):
            raise ConfigError(f"`{path}`: extends must be one path")
        found = {"base": None, "paths": None}
        if isinstance(above, str) and above.startswith("."):
            to = os.path.normpath(os.path.join(os.path.dirname(path), above))
            to = to if to in texts else to + ".json"
            if to in texts:
                found = load(to, (*seen, path))
        options, here = doc.get("compilerOptions") or {}, os.path.dirname(path)
        if "baseUrl" in options:
            found["base"] = os.path.normpath(os.path.join(here, options["baseUrl"])).removeprefix(".").lstrip("/")
        if "paths" in options:
            found["paths"] = (options["paths"], here)
        return found

    rows: dict[str, tuple] = {}
    for name in ("jsconfig.json", "tsconfig.json"):
        for path in sorted(texts):
            if os.path.basename(path) == name:
                c = load(path)
                paths, at = c["paths"] or ({}, os.path.dirname(path))
                base = c["base"] if c["base"] is not None else at
                # exact patterns first, then by longest prefix, then suffix
                order = sorted(paths.items(), key=lambda p: ("*" in p[0], -len(p[0].split("*")[0]), -len(p[0].split("*")[-1]), p[0]))
                rows[os.path.dirname(path)] = (os.path.dirname(path), base, c["base"] is not None, [(k, v) for k, v in order])
    return spark.createDataFrame(list(rows.values()), TSCONFIGS)


def frameworks(inputs: DataFrame) -> DataFrame:
    """directory and score of framework evidence: a dependency 100, a config file 90."""
    own = inputs.where(F.col("path").rlike(r"(^|/)package\.json$"))
    has = F.lit(False)
    for k in ("dependencies", "devDependencies", "peerDependencies"):
        has = has | F.get_json_object("source", f"$.{k}.next").isNotNull()
    a = own.where(has).select(F.regexp_replace("path", "/?package.json$", "").alias("directory"), F.lit(100).alias("score"))
    b = inputs.where(F.col("path").rlike(r"(^|/)next\.config\.[cm]?[jt]s$")).select(F.regexp_replace("path", r"/?next\.config\.[cm]?[jt]s$", "").alias("directory"), F.lit(90).alias("score"))
    return a.unionByName(b).groupBy("directory").agg(F.max("score").alias("score"))


def changes(spark: SparkSession, lines: list[str]) -> DataFrame:
    """CHANGES from lines of name and status: renames and copies give the old and the new path."""
    rows = []
    for line in lines:
        status, *paths = line.rstrip("\n").split("\t")
        if not paths:
            rows.append((status, "A"))  # untracked files come as paths alone
        elif status[:1] in "RC" and len(paths) == 2:
            rows += [(paths[0], "D" if status[0] == "R" else "M"), (paths[1], "A")]
        else:
            rows.append((paths[0], status[:1]))
    return spark.createDataFrame(rows, CHANGES).distinct()


def from_table(df: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """FILES from any table of paths and texts."""
    return df.select(normal(F.col(path)).alias("path"), F.col(source).alias("source"), F.octet_length(source).cast("long").alias("length"))


__all__ = ["FILES", "changes", "declared", "discover", "frameworks", "from_table", "manifests", "overlaid", "scan", "scopes", "tsconfigs"]
