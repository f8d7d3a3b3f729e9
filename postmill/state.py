"""Versioned Parquet tables: every write is a new directory, and one small file names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer was faster."""


class Marks:
    """Numbered small files in a shared folder. A number is given once: the file is written under another name
    and renamed, which fails if the number is there already.
    """

    def __init__(self, spark: SparkSession, folder: str, prefix: str):
        sc = spark.sparkContext
        self.folder, self.prefix = folder.rstrip("/"), prefix
        self._jvm, self._gateway = sc._jvm, sc._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = sc._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._fs.mkdirs(self._path(self.folder))
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, n: int):
        return self._path(f"{self.folder}/{self.prefix}-{n:012d}")

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(x[len(self.prefix) + 1 :]) for x in names if x.startswith(self.prefix + "-"))

    def last(self) -> int:
        return max(self.numbers(), default=0)

    def content(self, n: int) -> str:
        stream = self._fs.open(self._at(n))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, n: int, content: str) -> None:
        made = self._path(f"{self.folder}/_{self.prefix}-{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(content.encode()))
        out.close()
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(made, self._at(n), options)  # without the option to overwrite
        except Exception as e:
            self._fs.delete(made, False)
            if self._fs.exists(self._at(n)):
                raise Conflict(f"{self.prefix} {n} was made by another writer") from e
            raise

    def delete(self, n: int) -> None:
        self._fs.delete(self._at(n), False)

    def delete_folder(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def folders(self, prefix: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith(prefix)]


class VersionedTable:
    """A table in a shared folder. A version becomes visible by one rename, so readers see the old or the new
    table, a job that dies leaves the old one in place, and of two writers of one version the second fails.
    Older versions stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._marks = Marks(spark, folder, "commit")

    def version(self) -> int:
        return self._marks.last()

    def read(self, version: int | None = None) -> DataFrame:
        n = version or self.version()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self._marks.content(n)}")

    def write(self, df: DataFrame, *, expect: int | None = None) -> int:
        """Writes the version after ``expect`` (the current one) and returns its number; ``Conflict`` if it is taken."""
        base = self.version() if expect is None else expect
        name = f"data{uuid.uuid4().hex}"
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(f"{self.folder}/{name}")
        self._marks.put(base + 1, name)
        return base + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and what broken writes left. For the only writer."""
        numbers = self._marks.numbers()
        live = {self._marks.content(n) for n in numbers[-keep:]}
        for name in self._marks.folders("data"):
            if name not in live:
                self._marks.delete_folder(name)
        for n in numbers[:-keep]:
            self._marks.delete(n)
