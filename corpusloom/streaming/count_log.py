"""A table of counts that a stream adds to: one small table a batch, merged by levels so that few are ever read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CountLog:
    """Additive counts (``keys``, ``cnt``) under ``path``: a batch that runs again changes nothing.

    A table's folder names its level and the batches it covers, and counts once Spark's ``_SUCCESS`` is in it. ``fanout``
    tables of a level are merged into one of the next, after which they are no longer read; a merge that is cut off leaves
    a folder without the marker, which the next one writes anew. So live tables are few (``fanout`` a level) however many
    batches there were. One stream writes a log. ``vacuum`` removes what is no longer read, once no reader is left on it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fanout: int = 8):
        self.spark, self.path, self.keys, self.fanout = spark, path.rstrip("/"), keys, fanout

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _complete(self) -> list[tuple[int, int, int]]:
        fs, at = self._files()
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("counts-")]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [tuple(map(int, n.split("-")[1:])) for n in done]

    def live(self) -> list[tuple[int, int, int]]:
        """``(level, first batch, last batch)`` of the tables that are read: those that no higher one covers."""
        found = self._complete()
        covered = lambda t: any(o[0] > t[0] and o[1] <= t[1] and t[2] <= o[2] for o in found)
        return sorted((t for t in found if not covered(t)), key=lambda t: t[1])

    def _at(self, table: tuple[int, int, int]) -> str:
        return f"{self.path}/counts-{'-'.join(map(str, table))}"

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("cnt").alias("cnt"))

    def _union(self, tables: list[tuple[int, int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._at(t)) for t in tables])

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` sink."""
        if not any(first <= batch_id <= last for _, first, last in self.live()):
            self._sum(batch).write.mode("overwrite").parquet(self._at((0, batch_id, batch_id)))
        self.compact()

    def compact(self) -> None:
        level = 0
        while True:
            tables = self.live()
            same = [t for t in tables if t[0] == level]
            if len(same) >= self.fanout:
                merged = (level + 1, same[0][1], same[-1][2])
                self._sum(self._union(same)).write.mode("overwrite").parquet(self._at(merged))
            elif not any(t[0] > level for t in tables):
                return
            level += 1

    def counts(self) -> DataFrame | None:
        """The sums over all batches; None before the first."""
        tables = self.live()
        return self._sum(self._union(tables)) if tables else None

    def vacuum(self) -> int:
        """Removes the tables that merged ones cover; how many."""
        fs, _ = self._files()
        old = set(self._complete()) - set(self.live())
        for t in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(t)), True)
        return len(old)
