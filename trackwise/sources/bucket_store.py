"""Tables in key buckets under one manifest (SNK-04 for large tables, the state of SM-08).

A row's bucket is a hash of its key. A commit writes the changed buckets of any number of tables into folders of its own
and then, last, a manifest that says which folder holds each live bucket. Buckets that did not change are not
touched, readers see the tables of one version, and a commit that dies leaves the version before it as it was. The
manifest is written where none may stand yet, so of two writers from one version the second fails.

``append`` adds a folder to a bucket; a bucket with ``COMPACT_AFTER`` of them is written anew as one.

SNK-06: a table may be given more columns later. The manifest has the columns that each folder was written with; older folders
are read by the present schema, with nulls or the table's defaults in the columns they lack. A schema that lacks or changes a
column of a live folder is refused, before anything is read or written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_AFTER = 8
MANIFEST = "table string, bucket int, at string, columns string"


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


class Narrowed(ValueError):
    """A table's schema lacks or changes columns that its files have."""


@dataclass
class Table:
    schema: str
    key: str
    defaults: dict = field(default_factory=dict)  # of columns that older files lack


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int | None = None):
        self.spark, self.root, self.tables = spark, root, tables
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.kinds = {name: spark.createDataFrame([], t.schema).schema for name, t in tables.items()}
        self.seen = self.version()
        self._check(self._entries(self.seen))

    # -- the manifest --------------------------------------------------------

    def _children(self, path: str) -> list[str]:
        """Names of the folders in a folder, none if it isn't there."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        found = [int(n.split("=")[1]) for n in self._children(f"{self.root}/_manifest") if n.startswith("version=")]
        done = [v for v in sorted(found, reverse=True) if "_SUCCESS" in self._children(f"{self.root}/_manifest/version={v}")]
        return done[0] if done else 0

    def _entries(self, version: int) -> list[tuple[str, int, str, str]]:
        """(table, bucket, folder, columns): as many as there are buckets, a few times over."""
        if not version:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/version={version}").collect()
        return [tuple(r) for r in rows]

    def live(self, version: int | None = None) -> list[tuple[str, int, str]]:
        """(table, bucket, folder) of a version."""
        return [e[:3] for e in self._entries(self.version() if version is None else version)]

    def _columns(self, name: str) -> str:
        return ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in self.kinds[name]))

    def _check(self, entries: list[tuple[str, int, str, str]]) -> None:
        for name, columns in {(e[0], e[3]) for e in entries if e[0] in self.tables}:
            wide = {f.name: f.dataType.simpleString() for f in self.kinds[name]}
            had = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in _split(columns)}
            lost = sorted(c for c, kind in had.items() if wide.get(c) != kind)
            if lost:
                raise Narrowed(f"{name}: its files have other columns: {', '.join(lost)}")

    # -- reading -------------------------------------------------------------

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets that the keys fall into, at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket_of(column)).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version; with ``buckets`` only those buckets' files are listed and read."""
        t = self.tables[name]
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.root}/{name}/{at}/bucket={b}" for n, b, at in self.live(version) if n == name and (wanted is None or b in wanted)
        ]
        if not paths:
            return self.spark.createDataFrame([], self.kinds[name])
        rows = self.spark.read.schema(self.kinds[name]).parquet(*paths)
        for column, value in t.defaults.items():
            rows = rows.withColumn(column, F.coalesce(column, F.lit(value)))
        return rows

    # -- writing -------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, at: str) -> set[int]:
        t = self.tables[name]
        columns = self.kinds[name].names
        path = f"{self.root}/{name}/{at}"
        rows = rows.select(*columns, self.bucket_of(t.key).alias("bucket"))
        # a rebalance by bucket gathers small buckets and splits the one that a hot key fills
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)
        return {int(n.split("=")[1]) for n in self._children(path) if n.startswith("bucket=")}

    def commit(self, replace: dict[str, tuple[DataFrame, list[int]]], append: dict[str, DataFrame] | None = None) -> int:
        """``replace``: all rows that the given buckets of a table are to hold. ``append``: rows that are added to a table.
        Returns the new version."""
        version, entries = self.seen + 1, self._entries(self.seen)
        self._check(entries)
        at = f"{version}-{uuid.uuid4().hex}"  # a writer that loses leaves the winner's files alone
        for name, (rows, buckets) in replace.items():
            written = self._write(name, rows, at) if buckets else set()
            entries = [e for e in entries if e[0] != name or e[1] not in set(buckets)] + [(name, b, at, self._columns(name)) for b in sorted(written)]
        for name, rows in (append or {}).items():
            full = [b for b in range(self.buckets) if sum(e[0] == name and e[1] == b for e in entries) >= COMPACT_AFTER]
            if full:
                rows = rows.select(*self.kinds[name].names).unionByName(self.read(name, full, self.seen))
            written = self._write(name, rows, at)
            entries = [e for e in entries if e[0] != name or e[1] not in set(full)] + [(name, b, at, self._columns(name)) for b in sorted(written)]
        manifest = self.spark.createDataFrame(entries, MANIFEST).coalesce(1)
        try:
            manifest.write.mode("error").parquet(f"{self.root}/_manifest/version={version}")
        except AnalysisException as e:
            raise Conflict(f"version {version} was committed by another writer") from e
        self.seen = version
        return version

    def refresh(self) -> None:
        """Go on from the last committed version, whoever wrote it."""
        self.seen = self.version()


def _split(columns: str) -> list[str]:
    """The fields of a column list; commas inside a type don't count."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out if c.strip()]
