"""Session settings the plans rely on, and where lineage may be cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot never compiles a method above 8000 bytecodes. A wide projection fused into one
    # such method runs interpreted; below the limit Spark splits it into compiled pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Hive-style partition keys such as state=02 must stay text.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(app_name: str = "plumbline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path every executor can reach, for tables written during a run.

    It lies in the cluster's ``spark.checkpoint.dir``. A session in one local process (a test)
    may name none and gets a temporary folder; anywhere else that would be a folder of one
    machine, so it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_on_workers_path(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


class Scratch:
    """The folders that ``materialise`` writes inside a ``with`` block, to be deleted when nothing reads them any more.

    A frame that was made in the block and not yet written may read any of them.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self)

    def release(self, *keep: str) -> None:
        """Delete the folders but the newest one of each name in ``keep``."""
        newest = {next((f for f in reversed(self.folders) if re.search(rf"/{re.escape(name)}-[0-9a-f]{{32}}$", f)), None) for name in keep}
        delete_folders(self.spark, [f for f in self.folders if f not in newest])
        self.folders = [f for f in self.folders if f in newest]


def delete_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later plans start from its files: a lost executor loses nothing, the table is not
    computed once per use, and its measured size tells the optimizer whether to broadcast it.
    """
    folder = shared_folder(df.sparkSession, name)
    for scope in Scratch._open:
        scope.folders.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
