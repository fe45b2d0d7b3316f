"""Paths and module specifiers as column expressions (``/`` parts folders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    """Backslashes as slashes, without the long-path prefix."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^//\?/", "")


def normal(path: Column) -> Column:
    """``.`` and ``..`` resolved by name; ``..`` at the top is dropped."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(slashes(path), "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def within(path: Column, folder: Column) -> Column:
    """Equal, or below the folder."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/"))) | (folder == "")


def ancestors(path: Column) -> Column:
    """All folders above a path, the root ``''`` first."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))
    return F.array_distinct(below)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def package_name(specifier: Column) -> Column:
    """Two segments of a scoped name, else one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1)
