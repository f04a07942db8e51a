"""A log of commits below a folder, for sinks that write by micro-batch.

A commit is one file, written by one task, that names what a batch has written: it is there or not. Lines carry the query's id, which a
new checkpoint renews, and the batch id, so a repeated batch is known. Every ``every`` commits the log is folded into a snapshot;
readers start at the newest one, so a batch reads a bounded number of files whatever came before. One query at a time writes to a log.
The folder of the log, ``log/commit=<sequence>``, is a table that Spark reads as it is; logs of plain ``log/<sequence>`` go on.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "query_id STRING, batch_id BIGINT, sequence BIGINT, name STRING, path STRING, rows BIGINT, high BIGINT"


class _Folder:
    """Listing and removal by the file system that the path belongs to; driver only."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.path = self.make(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> dict[str, int]:
        """{name: time of modification in milliseconds}."""
        at = self.make(self.path, below)
        return {s.getPath().getName(): s.getModificationTime() for s in self.files.listStatus(at)} if self.files.exists(at) else {}

    def remove(self, below: str) -> None:
        self.files.delete(self.make(self.path, below), True)


def _sequence(commit: str) -> str:
    return commit.removeprefix("commit=")


@dataclass(frozen=True)
class CommitLog:
    """``latest``: a name's newest path counts (a table of versions); else all its paths do (a table that grows).

    ``called``: a second column of the log's files with the names, called by what they are.
    """

    spark: SparkSession
    folder: str
    latest: bool = True
    every: int = 20
    keep_seconds: float = 86_400
    called: str | None = None

    def lines(self) -> DataFrame:
        """What counts now: the newest snapshot and the commits after it."""
        _, snapshot, commits = self._open()
        paths = ([f"{self.folder}/snapshot/{snapshot}"] if snapshot else []) + [f"{self.folder}/log/{n}" for n in commits]
        if not paths:
            return self.spark.createDataFrame([], LINE)
        return self._counting(self.spark.read.schema(LINE).parquet(*paths))

    def _open(self) -> tuple[_Folder, str, list[str]]:
        """The folder, its newest whole snapshot ("" if none), and the whole commits after it."""
        files = _Folder(self.spark, self.folder)
        whole = lambda at: "_SUCCESS" in files.names(at)
        snapshot = next((n for n in sorted(files.names("snapshot"), reverse=True) if whole(f"snapshot/{n}")), "")
        return files, snapshot, [n for n in sorted(files.names("log"), key=_sequence) if _sequence(n) > snapshot and whole(f"log/{n}")]

    def _counting(self, lines: DataFrame) -> DataFrame:
        """Lines that still count, and the last of every query, which tells its repeated batches."""
        last = F.struct("batch_id", "sequence", "name", "path", "rows", "high")
        marks = lines.groupBy("query_id").agg(F.max(last).alias("m"), F.max("high").alias("high")).select(
            "query_id", "m.batch_id", "m.sequence", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("rows"), "high")
        named = lines.filter("name IS NOT NULL")
        if self.latest:
            row = F.max_by(F.struct("query_id", "batch_id", "sequence", "path", "rows", "high"), "sequence").alias("r")
            named = named.groupBy("name").agg(row).select("r.query_id", "r.batch_id", "r.sequence", "name", "r.path", "r.rows", "r.high")
        return named.unionByName(marks)

    def paths(self, name: str | None = None) -> list[str]:
        """Committed paths, of one name or of all."""
        named = self.lines().filter(F.col("name").isNotNull() if name is None else F.col("name") == name)
        return [r[0] for r in named.filter("path IS NOT NULL").select("path").collect()]

    def last_batch(self, lines: DataFrame, query_id: str) -> int | None:
        return lines.filter(F.col("query_id") == query_id).agg(F.max("batch_id")).first()[0]

    def new_data(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def commit(self, query_id: str, batch_id: int, entries: list[tuple[str, str | None, int | None]], high: int | None = None) -> None:
        """One file with a line (name, path, rows) for each of ``entries``; ``high`` is the batch's own mark, such as its latest time."""
        _, snapshot, commits = self._open()
        sequence = int(_sequence(commits[-1]) if commits else snapshot or 0) + 1
        lines = [(query_id, batch_id, sequence, *e, high) for e in entries or [(None, None, None)]]
        # left over from a commit that was killed: without _SUCCESS it does not count
        written = self.spark.createDataFrame(lines, LINE).withColumns({self.called: F.col("name")} if self.called else {})
        written.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/commit={sequence:020d}")
        if sequence % self.every == 0:
            self.fold(f"{sequence:020d}")

    def fold(self, at: str) -> None:
        """A snapshot of all commits up to ``at``, then removal of what nobody can read any more."""
        self.lines().coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/snapshot/{at}")
        self.clean()

    def clean(self) -> None:
        """Removes commits and snapshots before the newest snapshot, and data that no commit names, older than ``keep_seconds``."""
        files, newest, _ = self._open()
        before = time.time() * 1000 - self.keep_seconds * 1000
        for below in ("log", "snapshot"):
            for name, modified in files.names(below).items():
                if _sequence(name) < newest and modified < before:
                    files.remove(f"{below}/{name}")
        named = {p[len(self.folder):].split("/")[2] for p in self.paths()}
        for name, modified in files.names("data").items():
            if name not in named and modified < before:
                files.remove(f"data/{name}")
