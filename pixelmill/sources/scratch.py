"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, for drivers and tasks, and the path in it. A path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, endings: tuple[str, ...] = ("",)) -> list[str]:
    """``path`` if it is a file; else the files below it, in order, that aren't hidden and have one of the endings."""
    fs, root = file_system(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [path]
    before = path[: len(path) - len(root)] if path.endswith(root) else ""
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(before + f.path for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(endings) and not f.base_name.startswith(("_", ".")))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session as a path with its scheme.

    Where it is unset, a local session (tests, one machine) gets a temporary folder; on a cluster that is an error, since
    a folder of one machine is none of the others'.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="pixelmill-")
        context.setCheckpointDir(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return str(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path)).rstrip("/")


class Scratch:
    """Written tables of one query run: they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pixelmill/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Deletes all tables but those that the result still reads."""
        self.drop(*self.names.difference(names))
