"""A log of deletions: written in transactions, read as one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .storage import coalesce_ranges

#: All of a key's points.
ALWAYS = (-(1 << 63), (1 << 63) - 1)


@dataclass
class TombstoneLog:
    """(key, min_time, max_time) rows in a folder; a transaction is a subfolder that appears whole.

    Additions are kept as DataFrames until ``commit`` writes and renames them,
    or ``rollback`` forgets them.  Readers see committed transactions only.
    """

    spark: SparkSession
    folder: str
    pending: list[DataFrame] = field(default_factory=list)

    def _path(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + ("/" + name if name else ""))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list:
        p, fs = self._path()
        return [s for s in fs.listStatus(p) if s.getPath().getName().startswith("txn=")] if fs.exists(p) else []

    def add(self, keys: list[str]) -> None:
        """Deletes whole keys."""
        self.add_range(keys, *ALWAYS)

    def add_range(self, keys: list[str], low: int, high: int) -> None:
        if low <= high and keys:
            self.add_rows(self.spark.createDataFrame([(k, low, high) for k in keys], "key string, min_time bigint, max_time bigint"))

    def add_rows(self, rows: DataFrame) -> None:
        """Any number of deletions, as a table."""
        self.pending.append(rows.select("key", "min_time", "max_time"))

    def commit(self) -> None:
        """Makes the additions visible, all at once."""
        if not self.pending:
            return
        rows = self.pending[0]
        for p in self.pending[1:]:
            rows = rows.unionByName(p)
        number = 1 + max((int(s.getPath().getName()[4:]) for s in self._committed()), default=-1)
        temporary, fs = self._path(f"_writing-{number}")
        rows.write.mode("overwrite").parquet(temporary.toString())
        final, _ = self._path(f"txn={number:09d}")
        if not fs.rename(temporary, final):
            raise OSError(f"can't commit {final.toString()}")
        self.pending = []

    def rollback(self) -> None:
        self.pending = []

    def walk(self) -> DataFrame:
        """All committed deletions."""
        found = [s.getPath().toString() for s in self._committed()]
        schema = "key string, min_time bigint, max_time bigint"
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def ranges(self, keys: list[str] | None = None) -> DataFrame:
        """The committed deletions of some keys (or all), overlapping ones as one."""
        rows = self.walk()
        return coalesce_ranges(rows.where(rows.key.isin(keys)) if keys is not None else rows, ["key"])

    def has_tombstones(self) -> bool:
        return bool(self._committed())

    def stats(self) -> tuple[int, int, int]:
        """(transactions, bytes, last change in milliseconds)."""
        found = self._committed()
        _, fs = self._path()
        return len(found), sum(fs.getContentSummary(s.getPath()).getLength() for s in found), max((s.getModificationTime() for s in found), default=0)

    def delete(self) -> None:
        """Removes the log."""
        p, fs = self._path()
        fs.delete(p, True)
