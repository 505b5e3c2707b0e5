"""Small text files in whatever file system Spark can reach, through Spark's own file layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file as a whole; ``False`` if it is there already."""
        temporary = self._path(f"{path}.{self._jvm.java.util.UUID.randomUUID()}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(path)
        # A rename onto a file that exists fails, so of two writers of one version one loses.
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            return False
        return True

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self._path(new).getParent())
        return self._fs.rename(self._path(old), self._path(new))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))
