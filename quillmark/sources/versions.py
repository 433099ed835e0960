"""Versions of stored tables: a new one is written beside the old and takes its place by one rename.

A folder holds version folders and ``CURRENT``, a text file with the number of
the valid one. Tables can be read, changed and written back, since what is read
stays; a write that fails leaves no trace but files that no version names, and
of two writers at once the later fails. Everything goes through Hadoop's file
systems, so the folder may be anywhere that Spark reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Versions:
    """Tables by name under ``path``."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> int:
        """The number of the valid version, 0 if there is none."""
        _, fs = self._fs()
        if not fs.exists(self._at("CURRENT")):
            return 0
        return int(self.spark.read.text(f"{self.path}/CURRENT").first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the valid version, or of another that has not been removed."""
        return self.spark.read.parquet(f"{self.path}/{self._folder(version or self.current())}/{name}")

    def _folder(self, version: int) -> str:
        return f"v{version:08d}"

    def write(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write all ``tables`` as the next version, which becomes valid when all are complete; its number.

        Tables of the valid version that are not among them are carried over by
        reference to it: they are copied. With ``expected`` the valid version
        must be that one, else nothing becomes valid.
        """
        jvm, fs = self._fs()
        last = self.current()
        if expected is not None and last != expected:
            raise RuntimeError(f"version {last} is valid, not {expected}")
        draft = f"draft-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{draft}/{name}")
        if last:
            for f in fs.listStatus(self._at(self._folder(last))):
                name = f.getPath().getName()
                if name not in tables:
                    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f.getPath(), fs, self._at(f"{draft}/{name}"), False, self.spark._jsc.hadoopConfiguration())
        # The rename fails where another writer has made this version meanwhile.
        if fs.exists(self._at(self._folder(last + 1))) or not fs.rename(self._at(draft), self._at(self._folder(last + 1))):
            fs.delete(self._at(draft), True)
            raise RuntimeError(f"version {last + 1} was written by another")
        out = fs.create(self._at(f"{draft}.txt"), True)
        out.write(bytearray(f"{last + 1}\n".encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("CURRENT").toUri() if "://" in self.path else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(self._at(f"{draft}.txt")), fs.makeQualified(self._at("CURRENT")), options)
        return last + 1

    def remove_before(self, version: int) -> None:
        """Delete the versions below ``version``, never the valid one."""
        _, fs = self._fs()
        for n in range(1, min(version, self.current())):
            fs.delete(self._at(self._folder(n)), True)
