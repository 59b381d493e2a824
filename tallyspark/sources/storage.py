"""Small files in a folder of any store that Spark reaches: listed, read, created once, removed."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Metadata only: tables are written by Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self._gateway, self._jvm, self.path = spark.sparkContext._gateway, spark._jvm, path.rstrip("/")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        root = self._at("")
        self._files = root.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        if not self._files.exists(at):
            return []
        return sorted(n for x in self._files.listStatus(at) if not (n := x.getPath().getName()).startswith((".", "_")))

    def age(self, name: str) -> float:
        """Seconds since it was written."""
        return (self._jvm.System.currentTimeMillis() - self._files.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one already: of two writers one wins."""
        head, _, tail = name.rpartition("/")
        draft = self._at(f"{head}/_{tail}-{uuid.uuid4().hex}" if head else f"_{tail}-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._files.exists(self._at(name)):
            options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                self._context.rename(draft, self._at(name), options)
                return True
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
        self._files.delete(draft, False)
        return False

    def remove(self, name: str) -> None:
        self._files.delete(self._at(name), True)
