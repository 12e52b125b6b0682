"""The few file-system calls that the catalog needs, on whatever file system Spark has."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def is_directory(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> str:
        """The folder, made if it isn't there."""
        p, fs = self._at(path)
        fs.mkdirs(p)
        return path

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        p, fs = self._at(path)
        target = self._at(to)[0]
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"{path} can't be moved to {to}")

    def write(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
