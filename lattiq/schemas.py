"""The relations of the engine, one explicit schema each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LOCATION = "struct<file:string,line:int,column:int>"
FILES = "path string, source string, length bigint"
COMMENT = "struct<text:string,line:int,column:int,standalone:boolean>"
PARSED = f"path string, imports array<struct<specifier:string,kind:string,location:{LOCATION}>>, directives array<string>, exported_runtime string, marker_imports array<string>, comments array<{COMMENT}>, error struct<line:int,column:int,message:string>"
MANIFESTS = "root string, name string, json string"
TSCONFIGS = "directory string, base_url string, resolve_bare boolean, aliases array<struct<pattern:string,targets:array<string>>>"
MODULES = "id string, path string, package string, kind string, runtime string, layer string, framework struct<adapter_id:string,attributes:map<string,string>>"
PACKAGES = "name string, root_path string"
IMPORTS = f"module_id string, specifier string, kind string, location {LOCATION}, ord bigint"
DEPENDENCIES = f"`from` string, `to` string, kind string, location {LOCATION}, ord bigint"
RESOLVED = f"`from` string, specifier string, kind string, target_kind string, target_package string, target_module string, target_name string, reason string, location {LOCATION}, ord bigint"
DECLARED = "package string, dependency string"
OWNERSHIP = "module string, status string, layers array<string>"
FEATURES = "module string, package string, feature string, root string"
DIAGNOSTICS = f"fingerprint string, rule_id string, severity string, message string, primary_location {LOCATION}, secondary_locations array<{LOCATION}>, dependency_path array<string>, suggestion string, metadata map<string,string>, identity_target string, suppressed boolean, suppression_reason string"
CHANGES = "path string, status string"
BASELINE = "fingerprint string, rule_id string, source string, target string, reason string, expires_at bigint"

RUNTIMES = ("browser", "server", "edge", "node", "universal", "unknown")
MODULE_KINDS = ("source", "excluded", "external")
DEPENDENCY_KINDS = ("Static", "Dynamic", "TypeOnly", "ReExport", "Require")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


@dataclass
class Frames:
    """A project: named relations, lazily computed."""

    modules: DataFrame
    dependencies: DataFrame
    resolved: DataFrame | None = None
    packages: DataFrame | None = None
    declared: DataFrame | None = None
    ownership: DataFrame | None = None
    features: DataFrame | None = None
    facts: DataFrame | None = None  # diagnostics that no rule makes: parsing, resolution
    comments: DataFrame | None = None  # path and comment
    files: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.modules.sparkSession
