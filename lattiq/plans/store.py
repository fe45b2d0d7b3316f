"""Tables that outlive a run: generations in a folder, each whole or not there at all.

A generation names the folders that its tables consist of. Its list is written last, by
Spark's own commit, so a run that fails leaves the generation before it as it was, and two
runs that write the same one can't both succeed. Rows are appended as folders of their
own; a table of many is written anew as one. Folders that no kept generation names go.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Generations that stay, and folders of a table beyond which it is written as one.
KEPT, PARTS = 2, 8


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.refresh()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at)] if self.fs.exists(self.at) else []

    def refresh(self) -> "Store":
        """Read the newest whole generation again."""
        whole = sorted(n for n in self._names() if n.startswith("generation-") and self.fs.exists(self._path(f"{n}/_SUCCESS")))
        self.state = self._read(whole[-1]) if whole else {"generation": 0, "tables": {}, "facts": {}}
        return self

    def _read(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect()))

    @property
    def facts(self) -> dict:
        return self.state["facts"]

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table, with the folders' columns; None where there is none."""
        known = self.state["tables"].get(name)
        if not known:
            return None
        # folders that a column parts are read one by one, each with its own root
        return reduce(DataFrame.unionByName, [self.spark.read.schema(known["schema"]).parquet(f"{self.path}/{p}") for p in known["parts"]])

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, by: dict[str, str] | None = None, **facts) -> None:
        """The next generation: ``replaced`` tables anew, rows ``appended`` to others, all else as it is.

        by: a column of a table by which its folders are parted, so that readers of few values skip the rest."""
        tables = {n: {**t, "parts": list(t["parts"])} for n, t in self.state["tables"].items()}

        def put(name: str, df: DataFrame) -> str:
            part = f"{name}-{uuid.uuid4().hex}"
            out = df.write.partitionBy(by[name]) if by and name in by else df.write
            out.parquet(f"{self.path}/{part}")
            return part

        for name, df in replaced.items():
            tables[name] = {"schema": df._jdf.schema().toDDL(), "parts": [put(name, df)]}
        for name, df in (appended or {}).items():
            if name not in tables:
                tables[name] = {"schema": df._jdf.schema().toDDL(), "parts": [put(name, df)]}
            elif len(tables[name]["parts"]) >= PARTS:
                tables[name]["parts"] = [put(name, self.table(name).unionByName(df))]
            else:
                tables[name]["parts"].append(put(name, df))
        state = {"generation": self.state["generation"] + 1, "tables": tables, "facts": {**self.state["facts"], **facts}}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/generation-{state['generation']:012d}")
        self.state = state
        self._clear()

    def _clear(self) -> None:
        names = self._names()
        whole = sorted(n for n in names if n.startswith("generation-"))
        kept = whole[-KEPT:]
        used = {p for n in kept for t in self._read(n)["tables"].values() for p in t["parts"]}
        for n in names:
            if n not in kept and n not in used:
                self.fs.delete(self._path(n), True)
