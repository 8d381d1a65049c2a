"""Token counts as delta-maintained rollups.

A *ledger* holds what was counted of each document; a batch of changes (insert, revise, delete, in order of a
sequence number) is turned into signed differences against it, and only those differences are added to the totals
by source, language and tokenizer version. Totals are additive, so the rollup is the sum of all committed deltas,
whatever their order. A batch is committed by one marker written after its files; a batch id that has its marker is
not applied again, and files without one are not read and are overwritten on a retry.

Of the ledger only the rows of a batch's own documents are summed up. Once FANOUT tables of a level are there they are
compacted into one of the next level, so that a commit reads a number of tables that grows with the logarithm of the
batches, and a document has a row a table at most. A compaction counts once its marker, which lists what it replaces,
is written.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, map_texts, materialize, new_path, read

TOKENIZER = "byte_bpe_50k"
#: Where rank files are by default; any folder that the driver reaches, as a path or URI.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted by pieces that end before a space, as no token spans a word's start.
PIECE = 1 << 16
KEYS = ("source", "lang", "tokenizer")
FIGURES = ("n_docs", "n_tokens", "n_bytes")
#: Tables of a level that are compacted, and batches that the query loads by.
FANOUT, BATCHES = 4, 4


def load_ranks(folder: str = TOKENIZERS, name: str = TOKENIZER) -> tuple[str, dict[bytes, int]]:
    """The tokenizer's version (its name and a digest of its file) and ranks, read once by the driver and sent to tasks; its size is the file's."""
    where, path = filesystem(f"{folder}/{name}.tiktoken")
    with where.open_input_file(path) as f:
        data = f.read()
    return f"{name}@{hashlib.sha256(data).hexdigest()[:12]}", {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut before single spaces between letters, where no token of the tokenizer's pattern can span."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def count_tokens(docs: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``(doc_id, part, source, lang, tokenizer, n_tokens, n_bytes)`` for each row of ``docs``; null text has none.

    ``part`` is a hash of the row, which tells apart rows that share a doc_id; it stays with a document that is revised.
    """
    import tiktoken

    version, ranks = load_ranks(folder, name)
    kept = docs.sparkSession.sparkContext.broadcast(ranks)
    made: list = []

    def make(texts: list[str | None]) -> dict[str, list[int]]:
        if not made:
            made.append(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=kept.value, special_tokens={}))
        counts = [sum(len(made[0].encode_ordinary(p)) for p in pieces(t or "")) for t in texts]
        return {"n_tokens": pa.array(counts, pa.int64()), "n_bytes": pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())}

    ids = docs.select(F.struct("doc_id", F.xxhash64("text", "source", "lang").alias("part"), "source", "lang").alias("doc_id"), "text")
    return map_texts(ids, make, "n_tokens long, n_bytes long").select("doc_id.*", F.lit(version).alias("tokenizer"), "n_tokens", "n_bytes")


class Rollup:
    """Totals by source, language and tokenizer version, kept by signed deltas under ``path``.

    Changes have ``(doc_id, part, op, seq, source, lang, tokenizer, n_docs, n_tokens, n_bytes)``. A document is known by
    ``doc_id`` and ``part``, which tells apart rows that share a doc_id (any number that stays the document's own), and is
    counted once per tokenizer; ``n_docs`` rows that are equal in all are one with their sums. ``op`` is ``insert``
    (also of a document that is there, which then is a revision), ``revise`` (also of one that isn't there) or ``delete`` (of one
    that isn't there: nothing). Of several changes of a document in a batch the one with the largest ``seq`` holds; of
    equal ones the one that isn't a delete, then the larger figures. A null id, source or language is a value like any other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "token_rollup"), fanout

    def _at(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _hadoop(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[str]:
        place, files = self._hadoop(f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []

    def _mark(self, kind: str, name: str) -> None:
        """Fails if the marker is there already, so that of two writers one commits."""
        place, files = self._hadoop(f"{self.path}/{kind}/{name}")
        files.create(place, False).close()

    def committed(self) -> list[str]:
        """The ids of committed batches, by their markers."""
        return self._marks("commits")

    def _tables(self) -> list[list[str]]:
        """The tables that together hold what is committed, by level; level 0 are batches that no compaction holds yet."""
        levels: dict[int, list[str]] = {0: self.committed()}
        replaced: set[str] = set()
        for mark in self._marks("compactions"):
            levels.setdefault(int(mark.split("-")[1]), []).append(mark)
            rows = self.spark.read.text(f"{self.path}/replaced/{mark}").collect()  # FANOUT names
            replaced |= set(json.loads(rows[0].value))
        return [[t for t in levels.get(k, []) if t not in replaced] for k in range(max(levels) + 1)]

    def _read(self, kind: str, tables: list[str]) -> DataFrame | None:
        found = [self.spark.read.parquet(self._at(kind, b)) for b in tables]
        return reduce(DataFrame.unionByName, found) if found else None

    def ledger(self, only: DataFrame | None = None) -> DataFrame | None:
        """What is counted of each document (of those in ``only``): the sum of its signed rows, where that isn't nothing."""
        rows = self._read("ledger", [t for level in self._tables() for t in level])
        if rows is None:
            return None
        if only is not None:
            same = [rows[c].eqNullSafe(only[c]) for c in ("doc_id", "part", "tokenizer")]
            rows = rows.join(only, reduce(Column.__and__, same), "left_semi")
        return summed(rows, "doc_id", "part", *KEYS)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch, unless it is there already; whether it was applied."""
        if batch in self.committed():
            return False
        order = F.struct("seq", (F.col("op") != "delete").alias("live"), *FIGURES, "source", "lang")
        new = changes.groupBy("doc_id", "part", "tokenizer").agg(F.max(order).alias("x")).select("doc_id", "part", "tokenizer", "x.*")
        new = materialize(new.drop("seq"), "token_changes")
        rows, now = new.where("live").select("doc_id", "part", *KEYS, *FIGURES), self.ledger(new)
        if now is not None:
            rows = rows.unionByName(now.select("doc_id", "part", *KEYS, *((-F.col(c)).alias(c) for c in FIGURES)))
        rows.write.mode("overwrite").parquet(self._at("ledger", batch))
        summed(self.spark.read.schema(rows.schema).parquet(self._at("ledger", batch)), *KEYS).write.mode("overwrite").parquet(self._at("deltas", batch))
        self._mark("commits", batch)
        self._compact()
        return True

    def _compact(self) -> None:
        for k in range(64):
            tables = self._tables()
            if k >= len(tables) or len(tables[k]) < self.fanout:
                return
            name = f"level-{k + 1}-{hashlib.sha256(json.dumps(tables[k]).encode()).hexdigest()[:16]}"
            for kind, keys in (("ledger", ("doc_id", "part", *KEYS)), ("deltas", KEYS)):
                summed(self._read(kind, tables[k]), *keys).write.mode("overwrite").parquet(self._at(kind, name))
            names = self.spark.createDataFrame([(json.dumps(tables[k]),)], "value string")
            names.coalesce(1).write.mode("overwrite").text(f"{self.path}/replaced/{name}")
            self._mark("compactions", name)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens, n_bytes)`` over all committed batches; groups of no documents are gone."""
        deltas = self._read("deltas", [t for level in self._tables() for t in level])
        if deltas is None:
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{c} long" for c in FIGURES))
        return summed(deltas, *KEYS).where("n_docs <> 0")


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Figures summed by ``keys``; groups of nothing are gone."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in FIGURES)).where(" or ".join(f"{c} <> 0" for c in FIGURES))


def changes_of(counts: DataFrame, op: str | Column = "insert", seq: int | Column = 0) -> DataFrame:
    """``counts`` as changes. Rows that are equal in all but their place are one change with their sums, so that none is lost."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    one = counts.withColumns({"op": lit(op), "seq": lit(seq).cast("long")})
    return one.groupBy("doc_id", "part", "op", "seq", *KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents, reached by inserts, revisions and deletes.

    Loads all documents in batches, of which one is delivered twice; some documents come with a false count that a later
    change of the same batch revises. A second delivery then deletes a tenth of the documents and miscounts another, and a
    third puts both right.
    """
    counts = materialize(count_tokens(read(spark, sf_dir, "documents")), "token_counts")
    rollup, part = Rollup(spark), F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    tenth = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(10))
    gone, odd = counts.where(tenth == 0), counts.where(tenth == 1)
    false = odd.withColumns({"n_tokens": F.col("n_tokens") * 2 + 1, "source": F.lit("misfiled")})
    for k in [*range(BATCHES), 1]:
        rollup.commit(f"load-{k}", changes_of(false.where(part == k)).unionByName(changes_of(counts.where(part == k), "revise", 1)))
    rollup.commit("revise-0", changes_of(gone, "delete").unionByName(changes_of(false, "revise")))
    rollup.commit("revise-1", changes_of(gone).unionByName(changes_of(odd, "revise")))
    return rollup.totals()
