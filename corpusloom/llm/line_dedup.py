"""Line dedup on levelled sorted runs of line hashes.

The store is a log-structured set of *runs*. A run is a bucketed, sorted Parquet table with one row per
line hash: ``(h1, h2, n, last)`` - how many documents of the run's batch hold the line, and the largest
doc_id among them. Each new batch is merge-anti-joined with the runs: hashes that no run holds become a
run of the batch's own on level 0, hashes that some run holds go to the repeat log. So runs are disjoint,
and compacting a full level is a merge without any de-duplication. All tables of a store share one bucketing
and order, by both hashes, and one file a bucket: a batch is dealt out once, when its lines are counted, and
joins and compaction read the buckets side by side, with neither a shuffle nor a sort of the runs.

Nothing is collected; a hot line is one row per task after partial aggregation, and the join that finds
the lines to drop is an inner join whose skewed partitions AQE splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, new_path, partitions, read, shielded

MIN_CHARS, MIN_DOCS = 40, 5
#: The contract's query feeds the store in so many batches; a level is compacted once it holds FANOUT runs.
BATCHES, FANOUT = 4, 3
#: What ``line_dedup`` adds to its rows.
ADDED = ("kept", "n_lines", "n_dropped")


def lines(text: Column) -> Column:
    """The lines of a text; null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column) -> Column:
    """The lines' keys: stripped at both ends, A-Z lower-cased."""
    return F.transform(lines(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(SPACES)))


def hashes(key: Column) -> list[Column]:
    """128 bits of hash, as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


HASHES = ["h1", "h2"]


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets of one file each are known to be in the files' order while this holds."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineStore:
    """Runs of line hashes by level, and the log of repeats.

    ``add`` takes rows ``(h1, h2, doc_id)`` with one row per line key and document, and returns the rows that
    became the batch's own run, i.e. its novel lines. ``totals`` returns one row per line hash.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets or partitions(spark), fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []
        self.names: list[str] = []

    def _write(self, df: DataFrame, dealt: bool = True) -> DataFrame:
        """A sorted table, one file a bucket. ``dealt``: the rows lie in the buckets' partitions already."""
        name = f"line_run_{uuid.uuid4().hex}"
        df = df.select(*HASHES, "n", "last")
        df = df if dealt else df.repartition(self.buckets, *HASHES)
        self.names.append(name)
        df.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", new_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def joined(batch: DataFrame, run: DataFrame, how: str) -> DataFrame:
        """A merge join of two tables of one bucketing and order."""
        return batch.join(run.hint("merge"), HASHES, how)

    def merged(self, tables: list[DataFrame]) -> DataFrame:
        """The tables in one, merged two at a time. Unions would be read as if they lay in the buckets' partitions, which they don't."""
        out = tables[0]
        for more in tables[1:]:
            both = self.joined(out, more.select(*HASHES, F.col("n").alias("more"), F.col("last").alias("later")), "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            out = self._write(both.select(*HASHES, n.alias("n"), F.greatest("last", "later").alias("last")))
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        own = batch.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        with sorted_buckets(self.spark):
            # counting deals rows out by the buckets' own hash, to as many partitions as the session shuffles to
            run = own = self._write(own, self.buckets == partitions(self.spark))
            if self.runs:
                for old in self.runs:
                    run = self.joined(run, old, "left_anti")
                run = self._write(run)
                self.repeats.append(self._write(self.joined(own, run, "left_anti")))
            self.levels[0].append(run)
            self._compact()
        return run

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.merged(level))
                self.levels[k] = []

    def totals(self) -> DataFrame:
        """``(h1, h2, n, last)`` over all batches. Only hashes in the repeat log need the log's rows added to their run's."""
        if not self.repeats:
            return reduce(DataFrame.unionByName, self.runs)
        with sorted_buckets(self.spark):
            log = self.merged(self.repeats).select(*HASHES, F.col("n").alias("more"), F.col("last").alias("later"))
        each = [self.joined(run, log, "left") for run in self.runs]
        return reduce(DataFrame.unionByName, each).select(*HASHES, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))

    def close(self) -> None:
        """Takes the tables' names out of the session's catalog; their files stay."""
        for run in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc_id)``: one row per document and distinct key of at least ``min_chars`` code points."""
    each = F.array_distinct(F.filter(keys(F.col("text")), lambda k: F.char_length(k) >= min_chars))
    return docs.select("doc_id", F.explode(each).alias("key")).select(*hashes(F.col("key")), "doc_id")


def drop_lines(docs: DataFrame, found: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with columns ``kept`` (text), ``n_lines`` and ``n_dropped``.

    ``found`` has ``(h1, h2, last)`` of the lines that go from every document but ``last``. Lines are found by
    place, so a document's text moves once, to meet its list of places. Rows that share a doc_id are told apart by
    their texts' hash; those that share both lose the same places.
    """
    row = F.xxhash64("text")
    at = (docs.select("doc_id", row.alias("_text"), F.posexplode(keys(F.col("text"))).alias("_at", "_key")).where(F.char_length("_key") >= min_chars)
          .select("doc_id", "_text", "_at", *hashes(F.col("_key"))).join(found, HASHES)
          .where(F.col("last").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("last"))))
    gone = at.groupBy(F.col("doc_id").alias("_doc"), "_text", "_at").agg(F.lit(1).alias("_one")).groupBy("_doc", "_text").agg(F.collect_list("_at").alias("_gone"))
    all_lines = lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return (docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (row == F.col("_text")), "left").withColumn("_lines", all_lines)
            .select(*docs.columns, kept.alias("kept"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped")))


def line_dedup(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines whose key is found in at least ``min_docs`` documents stay only in the largest doc_id that holds them.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns pass through, whatever their names, before ``kept``,
    ``n_lines`` and ``n_dropped``, which replace columns of the same names. Null or empty text: one empty line, nothing dropped. Rows that share a
    doc_id count as a document each; all rows of the largest doc_id keep the line. A null doc_id is below all
    others. A line that a document repeats goes or stays with all its places. Empty table: empty result.
    """
    docs = docs.drop(*ADDED)
    plain = shielded(docs, "doc_id", "text")
    staged = materialize(line_keys(plain, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line_keys")
    store = LineStore(docs.sparkSession)
    try:
        for k in range(batches):
            store.add(staged.where(F.col("batch") == k))
        with sorted_buckets(store.spark):
            found = materialize(store.totals().where(F.col("n") >= min_docs).select(*HASHES, "last"), "line_found")
    finally:
        store.close()
    return drop_lines(plain, found, min_chars).toDF(*docs.columns, *ADDED)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, (f.last IS NOT NULL AND f.last <> k.doc_id) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
