"""What an engine has committed: a small JSON document that is replaced as a whole.

Data files are written before the manifest names them, so a crash leaves files that nothing refers to, never a manifest
that refers to missing ones. A rollback rewrites no file: segments get a limit, the highest block that still counts.
Through Hadoop's file system the same code works on local folders and on shared stores.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Segment:
    """A Parquet folder; rows with ``block`` above ``limit`` don't count any more. ``level``: how often its rows were merged."""

    path: str
    limit: int | None = None
    level: int = 0


@dataclass
class Manifest:
    latest: int = 0
    latest_hash: str | None = None
    finalized: int = 0
    finalized_hash: str | None = None
    hashes: dict[str, str] = field(default_factory=dict)
    next_sequence: int = 1
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    #: By rolling view, (block, time): the blocks up to it with an earlier time had expired when a fork came, and stay so.
    expired: dict[str, list[list[int]]] = field(default_factory=dict)

    def copy(self) -> Manifest:
        return Manifest.load(self.dump())

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> Manifest:
        raw = json.loads(text)
        raw["segments"] = {k: [Segment(**s) for s in v] for k, v in raw["segments"].items()}
        return Manifest(**raw)

    def cut(self, fork: int) -> None:
        """Forget what comes after block ``fork``."""
        for parts in self.segments.values():
            for s in parts:
                s.limit = fork if s.limit is None else min(s.limit, fork)
        self.latest = min(self.latest, fork)
        self.hashes = {k: v for k, v in self.hashes.items() if int(k) <= fork}
        self.latest_hash = self.hashes.get(str(self.latest))
        self.expired = {v: [[min(b, fork), t] for b, t in marks] for v, marks in self.expired.items()}

    def expire(self, view: str, block: int, time: int) -> None:
        """Blocks of ``view`` up to ``block`` with a time before ``time`` don't come back."""
        marks = [*self.expired.get(view, []), [block, time]]
        self.expired[view] = [m for m in marks if not any(o != m and o[0] >= m[0] and o[1] >= m[1] for o in marks)]


class Store:
    """Segments and the manifest under one folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.home).toUri() if "://" in self.home else self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def read_manifest(self) -> Manifest:
        path = self._path(f"{self.home}/manifest.json")
        if not self._fs.exists(path):
            return Manifest()
        return Manifest.load("".join(self.spark.sparkContext.wholeTextFiles(path.toString()).values().collect()))

    def write_manifest(self, manifest: Manifest) -> None:
        """Write beside it, then rename over it in one step."""
        new = self._path(f"{self.home}/manifest.json.new")
        out = self._fs.create(new, True)
        out.write(bytearray(manifest.dump().encode()))
        out.close()
        names = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        names[0] = self._overwrite
        self._context.rename(new, self._path(f"{self.home}/manifest.json"), names)

    def write(self, df: DataFrame, name: str, tag: str) -> Segment:
        path = f"{self.home}/{name}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return Segment(path)

    def write_parts(self, df: DataFrame, kind: Column, kinds: tuple[str, ...], name: str, tag: str) -> dict[str, Segment]:
        """One write of rows of several kinds; a segment for each of ``kinds``."""
        path, empty = f"{self.home}/folds/{name}/{tag}", df.sparkSession.createDataFrame([], df.schema)
        df.withColumn("_kind", kind).write.mode("overwrite").partitionBy("_kind").parquet(path)
        for k in kinds:
            if not self._fs.exists(self._path(f"{path}/_kind={k}")):
                empty.write.parquet(f"{path}/_kind={k}")
        return {k: Segment(f"{path}/_kind={k}") for k in kinds}

    def read(self, segments: list[Segment], block: str) -> DataFrame | None:
        """All rows of segments that count. Segments with the same limit are one scan."""
        by_limit: dict[int | None, list[str]] = {}
        for s in segments:
            by_limit.setdefault(s.limit, []).append(s.path)
        out = None
        for limit, paths in by_limit.items():
            part = self.spark.read.parquet(*paths)
            part = part if limit is None else part.where(F.col(block) <= limit)
            out = part if out is None else out.unionByName(part)
        return out
