"""Files of a database, on any file system that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(*parts))

    def names(self, *parts: str) -> list[str]:
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(*parts)))

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, text: str, *parts: str) -> bool:
        """Writes a file that doesn't exist yet; False if it does. The creation itself is exclusive."""
        try:
            out = self._fs.create(self._path(*parts), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
            if hasattr(out, "hsync"):
                out.hsync()
        finally:
            out.close()
        return True

    def rename_new(self, source: tuple[str, ...], target: tuple[str, ...]) -> bool:
        if self.exists(*target):
            return False
        return bool(self._fs.rename(self._path(*source), self._path(*target)))

    def make(self, *parts: str) -> None:
        self._fs.mkdirs(self._path(*parts))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(*parts), True)
