"""Published trees that readers never find missing or mixed.

A tree is written into a folder of its own under ``<path>/versions``. Only then one small file is
added to ``<path>/commits``; its name is a number, and the highest number names the folder that
readers take. Nothing that a reader may hold is renamed or overwritten: before the commit
appears readers take the old folder, after it the new one, and a job that fails leaves folders
that no commit names. The commit is the only rename, of one file of a few bytes, onto a name
that must be free; of two writers that publish at once, one fails and its tree is not seen.

``expire_versions`` deletes what readers had time to leave: folders replaced more than
``grace`` seconds ago beyond the newest ``keep``, and folders of that age that no commit names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS, COMMITS = "versions", "commits"


class PublishConflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    written: float


class _Files:
    """The few file-system calls on the driver that publishing needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def listed(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds of its last change) of what lies in a folder."""
        where = self.at(path)
        if not self.fs.exists(where):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(where)]

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def _numbers(files: _Files, path: str) -> list[tuple[int, float]]:
    """Numbers of the commits, newest first, with their times."""
    found = [(n.removesuffix(".json"), t) for n, t in files.listed(f"{path}/{COMMITS}") if n.endswith(".json") and not n.startswith(".")]
    return sorted(((int(n), t) for n, t in found if n.isdigit()), reverse=True)


def _commit_file(path: str, number: int) -> str:
    return f"{path}/{COMMITS}/{number:012d}.json"


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The commits of a tree, newest first; none where nothing was published."""
    files = _Files(spark, path)
    return [Commit(n, json.loads(files.read(_commit_file(path, n)))["folder"], t) for n, t in _numbers(files, path)]


def published_folder(spark: SparkSession, path: str) -> str | None:
    """The folder to read now, or None where nothing was published."""
    files = _Files(spark, path)
    for number, _ in _numbers(files, path)[:1]:
        return f"{path}/{VERSIONS}/{json.loads(files.read(_commit_file(path, number)))['folder']}"
    return None


def publish(df: DataFrame, path: str, key: str, keep: int = 2, grace: float = 3600.0) -> str:
    """Write ``df`` partitioned by ``key`` as the next version of a tree, and return its folder.

    Rows are rebalanced on the key first, so a small partition is one file and not one per
    task, while one that holds a third of the table is split into tasks of the advisory size.
    """
    spark = df.sparkSession
    files = _Files(spark, path)
    newest = next((n for n, _ in _numbers(files, path)), 0)
    folder = uuid.uuid4().hex
    target = f"{path}/{VERSIONS}/{folder}"
    df.hint("rebalance", F.col(f"`{key}`")).write.partitionBy(key).parquet(target)
    pending, final = f"{path}/{COMMITS}/.{folder}", _commit_file(path, newest + 1)
    files.write(pending, json.dumps({"folder": folder}))
    taken = files.fs.exists(files.at(final)) or not files.fs.rename(files.at(pending), files.at(final))
    if taken or json.loads(files.read(final))["folder"] != folder:
        files.delete(pending)
        files.delete(target)
        raise PublishConflict(f"version {newest + 1} of {path} was published by another writer")
    expire_versions(spark, path, keep, grace)
    return target


def expire_versions(spark: SparkSession, path: str, keep: int = 2, grace: float = 3600.0) -> list[str]:
    """Delete what was replaced or abandoned more than ``grace`` seconds ago; returns the folders' names."""
    files, known, before = _Files(spark, path), commits(spark, path), time.time() - grace
    gone = []
    for newer, old in zip(known, known[1:], strict=False):
        if old.number <= known[0].number - max(1, keep) and newer.written <= before:
            # The commit goes last: a folder never outlives its name unnoticed.
            files.delete(f"{path}/{VERSIONS}/{old.folder}")
            files.delete(_commit_file(path, old.number))
            gone.append(old.folder)
    named = {c.folder for c in known}
    for folder, changed in files.listed(f"{path}/{VERSIONS}"):
        if folder not in named and changed <= before:
            files.delete(f"{path}/{VERSIONS}/{folder}")
            gone.append(folder)
    return gone
