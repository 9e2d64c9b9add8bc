"""Versions of a folder: which one is live, changed by one rename that never replaces a file.

``root/commits/<number>`` holds the name of a version; the highest number is
live. A commit renames a finished file to the next number and fails where that
number is taken, so of two writers that began from one version the second is
told, and at no time is there a folder without its live version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Commits that are kept, for readers that are under way.
KEPT = 20


class ConcurrentChange(RuntimeError):
    """Another writer has committed since the version that this one began from."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(self._conf)

    def path(self, where: str):
        return self._path(f"{self.root}/{where}")

    def read_text(self, where: str) -> str | None:
        p = self.path(where)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, where: str, text: str) -> None:
        out = self.fs.create(self.path(where), True)
        out.write(bytearray(text.encode()))
        out.close()

    def numbers(self) -> list[int]:
        at = self.path("commits")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(at) if x.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def current(self) -> tuple[int, str | None]:
        """Number and name of the live version; 0 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read_text(f"commits/{numbers[-1]:020d}")) if numbers else (0, None)

    def commit(self, name: str, base: int) -> int:
        """Makes version ``name``, complete by now, the live one after ``base``."""
        self.fs.mkdirs(self.path("commits"))
        new, to = f"commits/_{uuid.uuid4().hex}", f"commits/{base + 1:020d}"
        self.write_text(new, name)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self._conf)
        try:
            files.rename(self.path(new), self.path(to), self._gateway.new_array(rename, 0))
        except Exception as e:
            self.fs.delete(self.path(new), False)
            if self.fs.exists(self.path(to)):
                raise ConcurrentChange(f"{self.root} has changed since version {base}") from e
            raise
        for n in self.numbers()[:-KEPT]:
            self.fs.delete(self.path(f"commits/{n:020d}"), False)
        return base + 1
