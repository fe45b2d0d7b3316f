"""Small text helpers of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def candidate_text(paths: Column) -> Column:
    """A sorted list of paths as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(paths)))


def escape_annotation(text: Column, value: bool = False) -> Column:
    """Text for a CI annotation: percent and line ends escaped, in properties colon and comma too."""
    out = F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if value else out


def utf16_column(line: Column, column: Column) -> Column:
    """A 1-based character column of a line as a 0-based UTF-16 one."""
    head = F.substring(line, F.lit(1), column - 1)
    return (F.octet_length(F.encode(head, "UTF-16LE")) / 2).cast("int")
