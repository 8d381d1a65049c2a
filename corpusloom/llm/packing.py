"""Best-fit packing under conflicts.

Documents are cut into pieces of at most a bin's capacity and put into bins by decreasing size, each into the
bin with the least room that is enough and with which it has no conflict. Open bins are kept in order of what
room is left; a bin carries two bitmaps, of the duplicate clusters it holds and of the places that its
sources have taken. The search starts at the successor of the piece's size and goes on to roomier bins until
one is compatible; that is the tightest compatible bin.

Bins are filled within *groups* of about GROUP pieces, dealt by hash, so that the number of groups grows with
the input and no group with any source or cluster. Only ids, sizes, sources and clusters are shuffled. Duplicate clusters
are given, or texts equal but for case and white space, or, as in the query, components of near copies by SimHash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import SPACES, WORD, ascii_lower, materialize, partitions, read

CAPACITY, GROUP, SOURCE_LIMIT = 2048, 4096, 6


class Bins:
    """Bins of one group. ``source_limit`` pieces of a source at most, and one of a cluster."""

    def __init__(self, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT):
        self.capacity, self.limit = capacity, source_limit
        self.open: list[tuple[int, int]] = []  # room left and bin, in order
        self.clusters: list[int] = []  # bitmaps by bin
        self.sources: list[int] = []
        self.bit_of: dict = {}
        self.slots_of: dict = {}

    def put(self, size: int, source, cluster) -> int:
        """The bin that a piece goes to."""
        bit = 1 << self.bit_of.setdefault(cluster, len(self.bit_of))
        first = self.limit * self.slots_of.setdefault(source, len(self.slots_of))
        full = ((1 << self.limit) - 1) << first
        for k in range(bisect_left(self.open, (size, -1)), len(self.open)):
            room, b = self.open[k]
            if not self.clusters[b] & bit and self.sources[b] & full != full:
                del self.open[k]
                break
        else:
            room, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append(0)
        self.clusters[b] |= bit
        taken = (self.sources[b] & full) >> first
        self.sources[b] |= (taken + 1) << first  # unary: the lowest free place
        if room > size:
            insort(self.open, (room - size, b))
        return b


def near_text_key(text: Column) -> Column:
    """Texts that differ only in the case of A-Z and in white space have one key."""
    return F.xxhash64(F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "), F.lit(SPACES)))


def sizes(docs: DataFrame, cluster: Column | None = None) -> DataFrame:
    """``(doc_id, source, size, cluster)`` of each row; a text's size is its number of words."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), (near_text_key(F.col("text")) if cluster is None else cluster).alias("cluster"))


def sizes_by_near_copies(docs: DataFrame) -> DataFrame:
    """As ``sizes``, with the components of near copies as clusters."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", "text", size.alias("size"))
    prints = materialize(simhash.fingerprints(rows, ("doc_id", "source", "size")), "pack_prints")
    of = simhash.components(prints.select("doc_id", "fp")).select(F.col("fp").alias("_fp"), F.col("component").alias("cluster"))
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "source", "size", "cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group: int = GROUP, source_limit: int = SOURCE_LIMIT) -> DataFrame:
    """``pack_sizes`` of ``docs`` (``doc_id``, ``text``, ``source``; other columns are left out).

    ``cluster`` (by default ``near_text_key``) tells duplicates. Null, empty or blank text is one piece of no words.
    """
    return pack_sizes(sizes(docs, cluster), capacity, group, source_limit)


def pack_sizes(meta: DataFrame, capacity: int = CAPACITY, group: int = GROUP, source_limit: int = SOURCE_LIMIT) -> DataFrame:
    """``(doc_id, copy, piece, first_word, n_words, source, cluster, bin_id, bin_words)``: each row's pieces and their bins.

    ``meta`` has ``(doc_id, source, size, cluster)``. Sizes above ``capacity`` are cut into full pieces and the rest; pieces of a
    document are of one cluster, so they lie in different bins, in order of their numbers nowhere promised. No bin holds two
    of one cluster, nor more than ``source_limit`` of a source (null is a source, and a cluster). A piece of no words fits
    any bin that has room left and no conflict; pieces of one cluster without words open a bin each where they must. Rows
    that share a doc_id are told apart by ``copy``. Reruns agree. Empty table: empty result.
    """
    meta = meta.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    meta = meta.select("doc_id", "source", "size", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = meta.select("doc_id", "source", "cluster", "copy", "size", F.posexplode(starts).alias("piece", "first_word"))
    pieces = materialize(pieces.withColumn("n_words", F.least(F.lit(capacity), F.col("size") - F.col("first_word"))).drop("size"), "pack_pieces")
    groups = max(1, -(-pieces.count() // group))
    pieces = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of groups, then by decreasing size; a group's rows are emitted once it ends."""
        schema, held, bins, now = None, [], None, None

        def done() -> pa.RecordBatch:
            filled: dict[int, int] = {}
            for r in held:
                filled[r["bin"]] = filled.get(r["bin"], 0) + r["n_words"]
            out = [{k: r[k] for k in kept} | {"bin_id": f"{now}-{r['bin']}", "bin_words": filled[r["bin"]]} for r in held]
            return pa.RecordBatch.from_pylist(out, schema=schema)

        kept: list[str] = []
        for b in batches:
            if schema is None:
                kept = [n for n in b.schema.names if n != "bin_group"]
                schema = pa.schema([b.schema.field(n) for n in kept] + [pa.field("bin_id", pa.string()), pa.field("bin_words", pa.int64())])
            for r in b.to_pylist():
                if r["bin_group"] != now:
                    if held:
                        yield done()
                    held, bins, now = [], Bins(capacity, source_limit), r["bin_group"]
                r["bin"] = bins.put(r["n_words"], r["source"], r["cluster"])
                held.append(r)
        if held:
            yield done()

    order = ["bin_group", F.col("n_words").desc(), F.xxhash64("doc_id", "copy", "piece"), "doc_id", "copy", "piece"]
    out = ["doc_id", "copy", "piece", "first_word", "n_words", "source", "cluster", "bin_group"]
    dealt = pieces.select(*out).repartition(max(partitions(meta.sparkSession), groups // 8), "bin_group").sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema if f.name != "bin_group"}
    return dealt.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", bin_id string, bin_words long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; no bin holds two near copies."""
    return pack_sizes(sizes_by_near_copies(read(spark, sf_dir, "documents")))
