"""Small files and folders in whatever file system Spark's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder reached by Spark's own file system classes, so that it may lie anywhere a
    Spark path may."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def names(self, pattern: str) -> list[str]:
        """Paths below the folder that a glob pattern finds, sorted."""
        root = self._files.makeQualified(self._at("")).toUri().getPath().rstrip("/")
        found = self._files.globStatus(self._at(pattern)) or []
        return sorted(s.getPath().toUri().getPath()[len(root) + 1 :] for s in found)

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written under another name, then renamed."""
        aside = self._at(f"{name.rpartition('/')[0]}/_writing-{name.rpartition('/')[2]}".lstrip("/"))
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._files.rename(aside, self._at(name)):  # some file systems rename over nothing only
            self._files.delete(self._at(name), False)
            if not self._files.rename(aside, self._at(name)):
                raise OSError(f"cannot write {self.path}/{name}")

    def remove(self, name: str = "") -> None:
        self._files.delete(self._at(name), True)

    def size(self, name: str = "") -> int:
        """Bytes of the files in it."""
        return self._files.getContentSummary(self._at(name)).getLength()
