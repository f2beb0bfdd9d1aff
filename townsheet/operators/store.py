"""Published snapshots: tables written beside each other, and one small manifest that makes them current.

A store is a folder on any Hadoop file system::

    data/<run>/<table>/[<column>=<value>/]part-*.parquet    written first, read by nobody yet
    manifests/<version>.json                                what a version consists of

``publish`` writes data, then the manifest under a passing name, and renames it to the next version.
The rename is the commit: before it every reader sees the version before, after it the new one, and a
run that dies in between leaves data that no manifest names (``sweep`` deletes it). Two runs that build
on the same version race for one name, and the later one gets :class:`Conflict`. (Where renames are not
atomic, as in plain object stores, publish from one process.)

A partitioned table is replaced by partition: those that the run wrote are new, the others stay where an
earlier run left them, as long as the run says so (``replace=False``). A reader opens each run's folders
by their paths, so a filter on the partition column still prunes.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another run published the version that this one was to be."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; local mode, which is one machine, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there, and later steps read columns."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Files:
    """The few calls on a Hadoop file system that a manifest needs."""

    spark: SparkSession

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        if not self.system(folder).exists(self.path(folder)):
            return []
        return sorted(f.getPath().getName() for f in self.system(folder).listStatus(self.path(folder)))

    def write(self, name: str, text: str) -> None:
        out = self.system(name).create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        return self.spark.read.text(name, wholetext=True).first()[0]

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is taken."""
        system = self.system(new)
        return not system.exists(self.path(new)) and system.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)


@dataclass
class Table:
    """One table of a run: rows, the column that parts it, and whether parts that it lacks go."""

    rows: DataFrame
    by: str | None = None
    replace: bool = True


@dataclass
class Store:
    spark: SparkSession
    path: str
    files: Files = field(init=False)

    def __post_init__(self):
        self.files = Files(self.spark)

    # ---- versions ----

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or of the last one; of version 0, which has no tables, if nothing was published."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "parent": None, "tables": {}, "counters": {}}
        return json.loads(self.files.read(self._manifest(version)))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    # ---- writing ----

    def write(self, tables: dict[str, Table]) -> dict:
        """Data of a run; nothing shows before :meth:`commit`. Returns what the manifest is to say."""
        run, said = uuid.uuid4().hex, {}
        for name, table in tables.items():
            folder = f"{self.path}/data/{run}/{name}"
            writer = table.rows.write.partitionBy(table.by) if table.by else table.rows.write
            writer.parquet(folder)
            parts = {p: run for p in self.files.names(folder) if "=" in p} if table.by else {"": run}
            kinds = table.rows.schema.jsonValue()
            for f in kinds["fields"]:
                f["nullable"] = True
            said[name] = {"parts": parts, "by": table.by, "replace": table.replace, "schema": kinds}
        return said

    def commit(self, said: dict, parent: int | None = None, counters: dict | None = None) -> int:
        """Make a written run current, on top of ``parent`` (the last version). Tables it lacks stay as they were."""
        before = self.manifest(parent)
        tables = dict(before["tables"])
        for name, new in said.items():
            old = tables.get(name)
            kept = old["parts"] if old and not new["replace"] else {}
            tables[name] = {"parts": kept | new["parts"], "by": new["by"], "schema": new["schema"]}
        version = before["version"] + 1
        text = json.dumps({"version": version, "parent": before["version"], "tables": tables, "counters": counters or {}})
        passing = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        self.files.write(passing, text)
        if not self.files.rename(passing, self._manifest(version)):
            self.files.delete(passing)
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def publish(self, tables: dict[str, Table], parent: int | None = None, counters: dict | None = None) -> int:
        parent = self.manifest()["version"] if parent is None else parent
        return self.commit(self.write(tables), parent, counters)

    # ---- reading ----

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; the last one if none is named."""
        return self._open(name, self.manifest(version))

    def now_and_before(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The last version's table and its parent's, which is empty if there was none."""
        now = self.manifest()
        if not now["parent"]:
            empty = self.spark.createDataFrame([], T.StructType.fromJson(now["tables"][name]["schema"]))
            return self._open(name, now), empty
        return self._open(name, now), self._open(name, self.manifest(now["parent"]))

    def _open(self, name: str, manifest: dict) -> DataFrame:
        if name not in manifest["tables"]:
            raise KeyError(f"{name} is not in version {manifest['version']}")
        table = manifest["tables"][name]
        schema = T.StructType.fromJson(table["schema"])
        runs = defaultdict(list)
        for part, run in table["parts"].items():
            runs[run].append(part)
        frames = []
        for run, parts in sorted(runs.items()):
            base = f"{self.path}/data/{run}/{name}"
            frames.append(self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" if p else base for p in sorted(parts)]))
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames).select(*schema.names)

    # ---- space ----

    def sweep(self, keep: int = 2) -> list[str]:
        """Forget all but the last versions, and delete data that no kept one names. Not while a run is writing."""
        versions = self.versions()
        for old in versions[: max(0, len(versions) - keep)]:
            self.files.delete(self._manifest(old))
        used = {run for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for run in t["parts"].values()}
        gone = [run for run in self.files.names(f"{self.path}/data") if run not in used]
        for run in gone:
            self.files.delete(f"{self.path}/data/{run}")
        return gone


def observed(rows: DataFrame, /, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows that are counted by whichever job first passes over all of them."""
    seen = Observation(uuid.uuid4().hex)
    return rows.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def part_of(outcome: Column) -> Column:
    """Which table a built row belongs to."""
    return F.when(outcome == "kept", "events").when(outcome.isin("deduped", "collapsed", "dropped_incomplete"), "dropped").otherwise("rejected")
