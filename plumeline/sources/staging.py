"""Tables written on the way, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may leave it unset, and then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumeline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows, retries too, sees one content, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/plumeline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files of a folder in whatever store it is in."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def text(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that appears whole or not at all; one that is there already is replaced."""
        part = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(part, self._at(name)):  # some stores do not rename onto a file
            self._fs.delete(self._at(name), False)
            if not self._fs.rename(part, self._at(name)):
                raise OSError(f"{self.path}/{name} could not be written")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
