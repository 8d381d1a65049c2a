"""How sources of a language differ in their words: pairs of sources by distance, and the words that set a source apart.

Two passes over the texts. The first counts in how many documents of its language each term stands, exactly; frequent ones
are kept. The second counts occurrences of the kept terms with Aho-Corasick automata (pyahocorasick), in which a term has a
delimiter on both sides, as all terms have in a normalised text; so matches are whole terms. The vocabulary is dealt out by
range of (lang, term) to *shards* of about SHARD terms; one shard is broadcast at a time, and read against the documents of its
languages alone. Tasks add up what they see and give on counts, so no word, source or language is hot.

Counts by (lang, source, term) are sparse postings. The distance of two sources sums over all kept terms, but most have a
count of zero in one or both: what a term adds against a zero depends on its count alone, so these come from a histogram of
counts for each source, and only terms that both sources hold are looked at together, a chunk of terms at a time, which
gives one sum for each pair of sources.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read

#: Documents of its language that a term must stand in; ranks of terms that are given.
MIN_DOCS, RANKS = 10, 10
SMOOTHING, UNIT = 2, 1_000_000_000
#: Kept terms of an automaton; bytes from which on a term is known to it by a digest; and a worker's counts, texts and rows at once.
SHARD, LONG, HELD, VOLUME, ROWS = 1 << 18, 256, 1 << 18, 1 << 28, 1 << 15
#: Chunks of terms for the pairs of sources: postings of a chunk, and chunks at least.
CHUNK, CHUNKS = 1 << 16, 32
#: Bytes that end a term are a space, A-Z is a-z.
_NORMAL = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_TOO_LONG = re.compile(rb"[^ ]{%d,}" % (LONG + 1))
#: The last shard's automata, in a worker.
_BUILT: dict[str, dict] = {}


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def short(term: bytes) -> bytes:
    """A term as automata know it: long ones by a digest, with a mark that no term has."""
    return term if len(term) <= LONG else b"\x01" + hashlib.sha256(term).hexdigest().encode()


def plain(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)`` without nulls; texts as bytes."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def counted(batches: Iterator[pa.RecordBatch], count, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``count`` of each row adds to counters by key, which are given on as rows (key..., term, n) at the end or when they are large."""
    held: dict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        rows = ((*key, term, n) for key, c in held.items() for term, n in c.items())
        while part := list(itertools.islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
        held.clear()

    volume = seen = 0
    for b in batches:
        for row in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
            *key, text = (x.as_py() for x in row)
            count(held, tuple(key), text)
            volume, seen = volume + len(text), seen + 1
            if volume > VOLUME or seen % 64 == 0 and sum(map(len, held.values())) > HELD:
                yield from out()
                volume = 0
    yield from out()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(lang, term, n)``: documents of the language that hold the term. ``docs`` as ``plain`` gives them."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def count(held: dict, key: tuple, text: bytes) -> None:
        held[key].update(set(terms(text)))

    rows = docs.select("lang", "text").mapInArrow(lambda batches: counted(batches, count, schema), "lang string, term binary, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, shard: int = SHARD) -> tuple[DataFrame, int]:
    """``(lang, term, key, shard)`` of the kept terms, and the number of shards. ``key`` is what automata know a term by."""
    term = F.col("term").cast("string")
    key = F.when(F.octet_length("term") <= LONG, term).otherwise(F.concat(F.lit("\x01"), F.sha2("term", 256)))
    kept = materialize(document_frequencies(docs).where(F.col("n") >= min_docs).select("lang", term.alias("term"), key.alias("key")), "divergence_terms")
    shards = max(1, -(-kept.count() // shard))
    if shards == 1:
        return kept.withColumn("shard", F.lit(0)), 1
    dealt = materialize(kept.repartitionByRange(shards, "lang", "key").withColumn("shard", F.spark_partition_id()), "divergence_shards")
    return dealt, dealt.agg(F.max("shard")).first()[0] + 1


def automata(name: str, words: dict[str, list[bytes]]) -> dict:
    """An automaton for each language; a worker builds a shard's once."""
    if name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        made = {}
        for lang, keys in words.items():
            a = ahocorasick.Automaton()
            for key in keys:
                a.add_word(f" {key.decode('latin-1')} ", key)  # a character a byte
            a.make_automaton()
            made[lang] = a
        _BUILT[name] = made
    return _BUILT[name]


def recount(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, source, key, n)``: occurrences of one shard's terms; terms that don't occur have no row."""
    spark, listed = docs.sparkSession, defaultdict(list)
    table = words.select("lang", F.col("key").cast("binary").alias("key")).toArrow()
    for lang, key in zip(table["lang"].to_pylist(), table["key"].to_pylist(), strict=True):
        listed[lang].append(key)
    name, sent = new_path(spark, "automata"), spark.sparkContext.broadcast(dict(listed))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("key", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automata(name, sent.value)

        def count(held: dict, key: tuple, text: bytes) -> None:
            if key[0] in built:
                text = text.translate(_NORMAL)
                text = _TOO_LONG.sub(lambda m: short(m[0]), text) if len(text) > LONG else text
                held[key].update(map(itemgetter(1), built[key[0]].iter(f" {text.decode('latin-1')} ")))

        yield from counted(batches, count, schema)

    rows = docs.join(F.broadcast(words.select("lang").distinct()), "lang", "left_semi").select("lang", "source", "text")  # no more languages than a shard has terms
    counts = rows.mapInArrow(run, "lang string, source string, key binary, n long").groupBy("lang", "source", F.col("key").cast("string").alias("key")).agg(F.sum("n").alias("n"))
    out = materialize(counts, "divergence_counts")
    sent.unpersist()
    return out


def postings(docs: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """``recount`` of all shards, one after the other."""
    out = recount(docs, words.where("shard = 0"))
    for k in range(1, shards):
        out = out.unionByName(recount(docs, words.where(F.col("shard") == k)))
    return out


def probability(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * size)); null for an empty vocabulary."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.when(size > 0, F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + SMOOTHING), wide(total + SMOOTHING * size)) + 1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared_sums(rows: pa.Table) -> pa.Table:
    """What pairs of sources have to add for terms that both hold, less what zeros were taken for: ``(lang, a, b, x)`` of a chunk's postings."""
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    names = sorted(set(rows["source"].to_pylist()))
    at = {s: i for i, s in enumerate(names)}
    source = np.array([at[s] for s in rows["source"].to_pylist()], np.int64)
    key = np.asarray(pc.dictionary_encode(rows["key"].combine_chunks()).indices).astype(np.int64)
    order = np.lexsort((source, key))
    key, source, p, zero = key[order], source[order], np.asarray(rows["p"])[order], np.asarray(rows["zero"])[order]
    pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = 1
    while near < len(key) and (i := np.flatnonzero(key[near:] == key[:-near])).size:
        j = i + near
        more = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
        pairs, back = np.unique(np.concatenate([pairs, source[i] * len(names) + source[j]]), return_inverse=True)
        added = np.zeros(len(pairs), np.int64)
        np.add.at(added, back, np.concatenate([sums, more]))
        sums, near = added, near + 1
    lang = rows["lang"][0].as_py() if rows.num_rows else ""
    side = lambda x: pa.array([names[i] for i in x], pa.string())
    return pa.table([pa.array([lang] * len(pairs), pa.string()), side(pairs // max(1, len(names))), side(pairs % max(1, len(names))), pa.array(sums)], names=["lang", "a", "b", "x"])


def pair_distances(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of each source against each other one of its language. ``counts``: postings with ``p``; ``sizes``: ``lang, source, zero, words, held``."""
    hist = counts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    other = sizes.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.col("held").alias("other_held"))
    alone = hist.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * difference(F.col("p"), F.col("other"))).alias("alone"))
    alone = materialize(alone, "divergence_alone")
    chunks = max(CHUNKS, -(-counts.count() // CHUNK))
    dealt = counts.join(sizes.select("lang", "source", "zero"), ["lang", "source"]).select("lang", "source", F.col("key").cast("binary").alias("key"), "p", "zero", F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"))
    both = dealt.groupBy("lang", "chunk").applyInArrow(shared_sums, "lang string, a string, b string, x long").groupBy("lang", "a", "b").agg(F.sum("x").alias("both"))
    both = materialize(both, "divergence_both")
    both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "both").unionByName(both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "both"))
    pairs = sizes.join(other, "lang").where("source <> item")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    for part in (alone, back, both):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    none = (F.col("words") - F.col("held") - F.col("other_held")) * difference(F.col("zero"), F.col("other"))
    value = sum((F.coalesce(c, F.lit(0)) for c in ("alone", "back", "both")), F.coalesce(none, F.lit(0)))
    return pairs.select("lang", "source", "item", value.cast("long").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, shard: int = SHARD) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: see the module. ``docs`` has ``text``, ``lang`` and ``source``.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; each language keeps those of ``min_docs``
    of its documents. A kept term's p in a group (a source of a language, or the whole language) is smoothed, and the
    difference of two is floor((p - q)^2 / (p + q)). Part ``pair`` sums it over all kept terms for each other source; part ``term`` has the
    first ``ranks`` terms that are likelier in the source than in its language. Larger values come first, equal ones by item in
    the order of bytes. Null text, lang and source are ''. Sources without terms take part in pairs; a language without
    kept terms has zeros. Repeated rows are documents of their own. Terms of any length count whole. Other columns are
    left out. Empty table: empty result.
    """
    rows = plain(docs)
    words, shards = vocabulary(rows, min_docs, shard)
    counts = materialize(postings(rows, words, shards), "divergence_postings") if shards > 1 else postings(rows, words, 1)
    groups = materialize(rows.select("lang", "source").distinct(), "divergence_groups")
    kept = words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "held", "words"])
    sizes = materialize(sizes.withColumn("zero", probability(F.lit(0), F.col("total"), F.col("words"))), "divergence_sizes")
    counts = counts.join(sizes.select("lang", "source", "total", "words"), ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("words"))).select("lang", "source", "key", "n", "p")
    counts = materialize(counts, "divergence_p")
    ranked = lambda by: Window.partitionBy("lang", "source").orderBy(F.desc("value"), by)
    pairs = pair_distances(counts, sizes.select("lang", "source", "zero", "words", "held")).withColumn("rank", F.row_number().over(ranked("item")))
    overall = sizes.groupBy("lang").agg(F.sum("total").alias("all"), F.first("words").alias("words"))
    known = counts.groupBy("lang", "key").agg(F.sum("n").alias("all_n")).join(overall, "lang").join(words.select("lang", "key", "term"), ["lang", "key"])
    known = known.select("lang", "key", "term", probability(F.col("all_n"), F.col("all"), F.col("words")).alias("q"))
    apart = counts.join(known, ["lang", "key"]).where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(ranked("item"))).where(F.col("rank") <= ranks)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(apart, "term"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, v.v,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS p FROM full_counts
), q AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, v, sum(n) AS n FROM full_counts GROUP BY ALL)
), pair AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""
