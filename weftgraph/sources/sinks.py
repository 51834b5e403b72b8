"""Sinks: bulk parquet writes and tables that change all at once."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FILE = 5_000_000


def safe_name(name: str) -> str:
    """The name if it is a plain identifier; else an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def bulk_write(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE, partition: tuple[str, ...] = ()) -> None:
    """Writes all rows, in files of bounded size."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*map(safe_name, partition)) if partition else writer).parquet(path)


class VersionedTable:
    """A table of which readers see one whole version or the next.

    A version is written to a staging folder and gets its number by one rename, which the file system makes
    atomic; a writer that fails leaves a staging folder that nobody reads. Two writers can't get one number: the
    slower one's rename fails and is tried again with the next.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        target = self._fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._at("")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[8:]) for n in names if re.fullmatch(r"version=\d+", n))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise ValueError(f"no version at {self.path}")
        return self.spark.read.parquet(f"{self.path}/version={known[-1] if version is None else version}")

    def commit(self, df: DataFrame, attempts: int = 3) -> int:
        """Writes `df` as the next version and returns its number."""
        staging, fs = self._at(f"_staging-{uuid.uuid4().hex}")
        bulk_write(df, staging.toString(), "overwrite")
        for turn in range(attempts):
            number = (self.versions() or [0])[-1] + 1
            target, _ = self._at(f"version={number}")
            if not fs.exists(target) and fs.rename(staging, target):
                return number
            time.sleep(0.1 * 2**turn)
        fs.delete(staging, True)
        raise RuntimeError(f"could not commit to {self.path}")
