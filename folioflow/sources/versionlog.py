"""Records of versions: small files, each made only if there is none of its number."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionLog:
    """The records in one folder, on any file system Spark knows. What no record names is not visible."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self.hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> dict[int, object]:
        folder = self.hadoop(self.path)
        if not self.fs.exists(folder):
            return {}
        paths = [status.getPath() for status in self.fs.listStatus(folder)]
        return {int(p.getName()): p for p in paths if p.getName().isdigit()}

    def all(self) -> dict[int, str]:
        """The line of every record, by number."""
        read = {number: self._read(path) for number, path in self._numbers().items()}
        # A record that is still being written has no line end yet.
        return {number: line.strip() for number, line in sorted(read.items()) if line.endswith("\n")}

    def last(self) -> int | None:
        """The highest number with a whole record; only the newest records are read."""
        for number, path in sorted(self._numbers().items(), reverse=True):
            if self._read(path).endswith("\n"):
                return number
        return None

    def line(self, number: int) -> str | None:
        """The line of one record; None if it is not there or not whole."""
        path = self.hadoop(f"{self.path}/{number:012d}")
        text = self._read(path) if self.fs.exists(path) else ""
        return text.strip() if text.endswith("\n") else None

    def _read(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def add(self, number: int, line: str) -> bool:
        """Make a record; False if there is one of its number already."""
        return self._write(number, line, False)

    def put(self, number: int, line: str) -> None:
        """Make a record where only one writer can be; what a lost writer left of it is replaced."""
        self._write(number, line, True)

    def _write(self, number: int, line: str, replace: bool) -> bool:
        try:
            stream = self.fs.create(self.hadoop(f"{self.path}/{number:012d}"), replace)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(f"{line}\n".encode())
        finally:
            stream.close()
        return True
