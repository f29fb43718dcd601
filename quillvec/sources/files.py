"""Small driver-side files in whatever file system Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, which only a local master can share with its tasks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillvec-")
        where = _OWN_DIRS[context.applicationId]
    return where.rstrip("/")


class Files:
    """A folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.Path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.Path(self.at(name))) if not s.getPath().getName().startswith((".", "_")))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.Path(self.at(name))).getLength() if self.exists(name) else 0

    def read(self, name: str) -> object:
        stream = self.fs.open(self.Path(self.at(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: object) -> None:
        """Readers see the old content or the new one, whole."""
        target, temporary = self.Path(self.at(name)), self.Path(self.at(f"{name}.{uuid.uuid4().hex}.tmp"))
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, target, how)

    def delete(self, name: str) -> None:
        self.fs.delete(self.Path(self.at(name)), True)
