"""Small files in any file system that Spark reaches: read, write once, and claim a name that must not exist."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local session may do without and gets one of this machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Bytes of input files to a partition of ``spread``.
PIECE = 2_000_000


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` in partitions by ``keys``, as many as its input files have pieces of ``PIECE`` bytes, so that what a task holds does not grow with the input.

    An input of fewer pieces than the session's shuffles have partitions, or none in files, leaves the number to the session.
    """
    n = _pieces(df)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def spread_for(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` as ``spread`` deals it by ``key``, for a join with ``other``, which Spark then deals alike.

    It stays as it is where that number is the session's, or where ``other`` is small enough for Spark to broadcast it.
    """
    spark = df.sparkSession
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    most = -1 if most.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)
    n = _pieces(df) if _size(other) > most else 0
    return df.repartition(n, key) if n else df


def _size(df: DataFrame) -> int:
    """Bytes of the input files."""
    size = 0
    for name in df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size


def _pieces(df: DataFrame) -> int:
    """Pieces of the input, or 0 where the session's shuffles have as many partitions."""
    n = -(-_size(df) // PIECE)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


class Conflict(RuntimeError):
    """Another writer took the name first."""


class Files:
    """The files below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path().getFileSystem(self._conf)

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def sizes(self, folder: str) -> list[tuple[str, int]]:
        """Full paths and lengths of what is in a folder."""
        p = self.path(folder)
        return sorted((s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str):
        """The JSON value in a file."""
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value) -> None:
        out = self._fs.create(self.path(name), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def claim(self, name: str, value) -> None:
        """Writes ``name`` in one step that fails with ``Conflict`` if it exists: readers never see half of it.

        A local file system links, any other one renames without overwriting.
        """
        temp = f".{uuid.uuid4().hex}"
        self.write(temp, value)
        try:
            self._fs.mkdirs(self.path(name).getParent())
            if self._fs.getScheme() == "file":
                local = lambda n: self._jvm.java.nio.file.Paths.get(self.path(n).toUri().getPath(), self._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(name), local(temp))
            else:
                kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self._gateway.new_array(kinds, 1)
                how[0] = kinds.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self._conf).rename(self.path(temp), self.path(name), how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(name) from None
            raise
        finally:
            self._fs.delete(self.path(temp), False)

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self.path(name), True)
