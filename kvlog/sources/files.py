"""Files by Spark's own file systems, so that a store can be wherever Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        """Sorted, without the writer's own hidden files."""
        if not self.exists(name):
            return []
        return sorted(x for x in (s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if x[0] not in "._")

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """All or nothing: to a hidden file, then renamed. Fails if the name is taken."""
        folder, _, last = name.rpartition("/")
        hidden = self._path(f"{folder}/.{last}.tmp")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(hidden, self._path(name)):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
