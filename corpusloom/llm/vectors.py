"""Vectors stored in blocks, and exact searches for the largest inner products that look into the most promising blocks first.

Index: components become whole numbers. Every vector is keyed by its nearest pivot and its distance from it, both in a space
with one more dimension that makes all vectors equally long, so that near means a large inner product. The table is sorted by
(pivot, distance), cut by range into *slabs* of bounded size, and a slab into *blocks* of BLOCK rows of one pivot. A block is a
row: its vectors (the forward index), the largest and least of each component, and its interval of distances. Pivots are
a bounded sample, PIVOTS rows; every row is indexed.

Search: a *need* is a query vector, with limits on scores. A bound says for a need and a block how large and how small a
score can be. Needs are first taken to the slab that they lie in themselves, which gives each a score that its k-th best
can't fall below; then to every slab whose bound reaches that. In a slab the blocks are ordered by their bounds
for each need, and scored by matrix products in rounds of 1, 2, 4, ... blocks, until the next bound is below the k-th best. Ties
count: only what is below is left out, so results are exact.

Slabs and needs meet by (slab, part): at most about SLAB vectors and PART needs are in a task at once, whatever their
number. What is broadcast are bounds of at most COARSE groups of slabs, and the pivots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
#: Sampled pivots; rows of a block; rows of a slab at least, slabs from which on they grow, and rows of a slab at most.
PIVOTS, BLOCK, LEAST, SLABS, SLAB = 64, 128, 1024, 256, 1 << 18
#: Needs in a task, those that are looked at together, and groups of slabs whose bounds are broadcast.
PART, TOGETHER, COARSE = 1 << 16, 1024, 4096
#: Components are held to this, so that squares are finite.
FARTHEST = 2.0**500
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
NEED = "need long, row long, slab int, label int, v binary, least long, most long"
FOUND = "need long, row long, vec_id long, score long"


@dataclass
class Index:
    """``blocks`` is a table; ``pivots`` are as long as ``reach`` is squared, by one more dimension (``rise``)."""

    blocks: DataFrame
    rows: int
    width: int
    kind: str
    reach: float
    pivots: np.ndarray
    rise: np.ndarray


@dataclass
class Summary:
    """Of blocks, or groups of them with one pivot: interval of distances, and the components' extremes."""

    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    low: np.ndarray
    high: np.ndarray


#: For vectors (n, width) and a summary of m: largest and least possible scores, (n, m) each.
Bound = Callable[[np.ndarray, Summary], tuple[np.ndarray, np.ndarray]]


def within(bound: Bound, queries: np.ndarray, s: Summary) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on scores that are held to a long's limits."""
    upper, lower = bound(queries, s)
    return np.maximum(upper, float(LOWEST)), np.minimum(lower, float(HIGHEST))


def whole_numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of lists of numbers; short lists are filled up with zeros."""
    n, lengths = len(column), np.asarray(column.value_lengths())
    flat, out = np.asarray(column.flatten(), float), np.zeros((n, width))
    if n and lengths.min() == width:
        out = flat.reshape(n, width)
    elif len(flat):
        out[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.clip(np.floor(SCALE * out), -FARTHEST, FARTHEST)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products (a, b) of whole numbers, exactly; those that a long can't hold are held to its limits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if top < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(HIGHEST, max(LOWEST, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, embedding)`` of rows with an id and a vector of finite numbers."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)


def build(vectors: DataFrame) -> Index:
    """The index of ``vectors`` (``vec_id``, ``label``, ``embedding``), in the shared folder."""
    rows, spark = usable(vectors), vectors.sparkSession
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, reach = 0, 0.0, 0.0
        for b in batches:
            x = whole_numbers(b.column(0), width)
            n, top, reach = n + len(x), max(top, np.abs(x).max(initial=0)), max(reach, (x * x).sum(axis=1).max(initial=0))
        yield pa.RecordBatch.from_pydict({"n": [n], "top": [float(top)], "reach": [float(reach)]})

    seen = rows.select("embedding").mapInArrow(measure, "n long, top double, reach double").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("reach").alias("reach")).first()
    n, top, reach = seen.n or 0, seen.top or 0.0, seen.reach or 0.0
    kind = next((k for k, most in (("<i2", 2.0**15), ("<i4", 2.0**31)) if top < most), "<f8")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").toArrow()["embedding"].combine_chunks()
    pivots = np.unique(whole_numbers(sample, width), axis=0) if len(sample) else np.zeros((1, width))
    rise = np.sqrt(np.maximum(0, reach - (pivots * pivots).sum(axis=1)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_numbers(b.column("embedding"), width)
            up = np.sqrt(np.maximum(0, reach - (x * x).sum(axis=1)))
            close = x @ pivots.T + up[:, None] * rise
            pivot = close.argmax(axis=1) if len(x) else np.zeros(0, int)
            apart = np.sqrt(np.maximum(0, 2 * (reach - close[np.arange(len(x)), pivot])))
            data = [r.tobytes() for r in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(pivot, pa.int32()), pa.array(apart), pa.array(data, pa.binary())], names=["vec_id", "label", "pivot", "apart", "v"])

    slabs = max(1, min(-(-n // LEAST), SLABS), -(-n // SLAB))
    each = rows.mapInArrow(keyed, "vec_id long, label int, pivot int, apart double, v binary")
    dealt = each.repartitionByRange(slabs, "pivot", "apart", F.xxhash64("vec_id", "v")).sortWithinPartitions("pivot", "apart", "vec_id", "label")
    form = "slab int, block int, first long, pivot int, near double, far double, ids array<long>, labels array<int>, low array<double>, high array<double>, data binary"
    schema = pa.schema([("slab", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, held, at, number = TaskContext.get().partitionId(), None, 0, 0

        def made(t: pa.Table, last: bool) -> tuple[list[dict], int]:
            """Blocks, and the row that the next begins with; the last block may go on in the next batch."""
            nonlocal at, number
            out, pivot = [], np.asarray(t["pivot"])
            ends = [*(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]
            places = [(k, min(k + BLOCK, z)) for a, z in zip([0, *ends[:-1]], ends, strict=True) for k in range(a, z, BLOCK)]
            for a, z in places if last else places[:-1]:
                data = b"".join(t["v"][a:z].to_pylist())
                x, apart = np.frombuffer(data, kind).reshape(z - a, width).astype(float), np.asarray(t["apart"][a:z])
                out.append({"slab": slab, "block": number, "first": at, "pivot": int(pivot[a]), "near": apart.min(), "far": apart.max(), "ids": t["vec_id"][a:z].to_pylist(), "labels": t["label"][a:z].to_pylist(), "low": x.min(axis=0), "high": x.max(axis=0), "data": data})
                at, number = at + z - a, number + 1
            return out, len(pivot) if last else places[-1][0]

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                out, rest = made(t, False)
                held = t.slice(rest).combine_chunks()
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist(made(held, True)[0], schema=schema)

    blocks = materialize(dealt.mapInArrow(cut, form), "vector_blocks")
    return Index(blocks, n, width, kind, reach, pivots, rise)


def needs_of(index: Index, every: int) -> DataFrame:
    """A need for each indexed row whose vec_id ``every`` divides, with ``vec_id``; ``need`` and ``row`` are the row's place."""
    kind, width = np.dtype(index.kind).itemsize, index.width
    schema = pa.schema([("need", pa.int64()), ("row", pa.int64()), ("slab", pa.int32()), ("label", pa.int32()), ("v", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("vec_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for i, (vec, label) in enumerate(zip(r["ids"], r["labels"], strict=True)):
                    if vec % every == 0:
                        row = (r["slab"] << 32) + r["first"] + i
                        out.append((row, row, r["slab"], label, r["data"][i * width * kind : (i + 1) * width * kind], LOWEST, HIGHEST, vec))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return index.blocks.select("slab", "first", "ids", "labels", "data").mapInArrow(run, f"{NEED}, vec_id long")


def best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (need, row, vec_id, score), the first ``k`` of each need: scores descending, then ids and rows."""
    need, row, vec, score = found
    order = np.lexsort((row, vec, -1 - score, need))  # -1 - x turns the order of longs round without overflow
    need = need[order]
    starts = np.flatnonzero(np.r_[True, need[1:] != need[:-1]]) if len(need) else np.zeros(0, int)
    place = np.arange(len(need)) - np.repeat(starts, np.diff(np.r_[starts, len(need)]))
    return [x[order][place < k] for x in found]


def scan(blocks: pa.Table, needs: pa.Table, kind: str, width: int, bound: Bound, k: int, same: bool | None) -> pa.Table:
    """The best ``k`` of each need in one slab. ``same``: only rows of the need's label, or only of others, or any."""
    if not blocks.num_rows or not needs.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names=["need", "row", "vec_id", "score"])
    table = blocks.sort_by("block")
    floats = lambda c: np.array(table[c].to_pylist(), float).reshape(table.num_rows, -1)
    summary = Summary(np.asarray(table["pivot"]), np.asarray(table["near"]), np.asarray(table["far"]), floats("low"), floats("high"))
    first = np.asarray(table["first"]) + (np.asarray(table["slab"]).astype(np.int64) << 32)
    ids, labels = ([np.array(x, float if c == "labels" else np.int64) for x in table[c].to_pylist()] for c in ("ids", "labels"))
    data, needs = table["data"].to_pylist(), needs.sort_by("row")
    result: list[list[np.ndarray]] = []
    for part in (needs.slice(a, TOGETHER) for a in range(0, needs.num_rows, TOGETHER)):
        row, least, most = (np.asarray(part[c]) for c in ("row", "least", "most"))
        need, label = np.asarray(part["need"]), np.array(part["label"].to_pylist(), float)
        _, one, inverse = np.unique(row, return_index=True, return_inverse=True)
        vectors = np.frombuffer(b"".join(part["v"].take(one).to_pylist()), kind).reshape(len(one), width).astype(float)
        upper, lower = within(bound, vectors, summary)
        order = np.argsort(-upper, axis=1, kind="stable")
        kth, active, at, step = least.copy(), np.arange(len(need)), 0, 1
        kept = [np.zeros(0, np.int64)] * 4
        while len(active) and at < len(data):
            take = order[inverse[active], at : at + step]
            i, j = np.nonzero((upper[inverse[active][:, None], take] >= kth[active, None]) & (lower[inverse[active][:, None], take] <= most[active, None]))
            who, which = active[i], take[i, j]
            sort = np.argsort(which, kind="stable")
            who, which = who[sort], which[sort]
            more = [kept]
            for group, b in zip(np.split(who, np.flatnonzero(np.diff(which)) + 1), np.unique(which), strict=False):
                x = np.frombuffer(data[b], kind).reshape(len(ids[b]), width).astype(float)
                own, back = np.unique(inverse[group], return_inverse=True)
                score = products(vectors[own], x)[back]
                hit = (score >= kth[group, None]) & (score <= most[group, None]) & (first[b] + np.arange(len(x)) != row[group, None])
                if same is not None:
                    hit &= (labels[b] == label[group, None]) == same
                p, q = np.nonzero(hit)
                more.append([group[p], first[b] + q, ids[b][q], score[p, q]])
            kept = best([np.concatenate(x) for x in zip(*more, strict=True)], k)
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(need)) == k)
            if len(full):
                worst = np.full(len(need), HIGHEST)
                np.minimum.at(worst, kept[0], kept[3])
                kth[full] = np.maximum(kth[full], worst[full])
            at, step = at + step, step * 2
            if at < len(data):
                active = active[upper[inverse[active], order[inverse[active], at]] >= kth[active]]
        result.append([need[kept[0]], *kept[1:]])
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*result, strict=True)], names=["need", "row", "vec_id", "score"])


def coarse_bounds(index: Index) -> tuple[int, np.ndarray, Summary]:
    """How many slabs in a row share bounds, the group of each bound, and the bounds: one a group and pivot, some COARSE in all."""
    slabs = (index.blocks.agg(F.max("slab")).first()[0] or 0) + 1
    each = -(-slabs // COARSE)
    group = F.floor(F.col("slab") / each).cast("int").alias("group")
    keys = index.blocks.groupBy(group, "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")).orderBy("group", "pivot").toPandas()
    sides = index.blocks.select(group, "pivot", F.posexplode(F.arrays_zip("low", "high")).alias("d", "x")).groupBy("group", "pivot", "d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    ends = sides.orderBy("group", "pivot", "d").toPandas()
    shape = (len(keys), index.width)
    return each, keys["group"].to_numpy(), Summary(keys["pivot"].to_numpy(), keys["near"].to_numpy(), keys["far"].to_numpy(), ends["low"].to_numpy().reshape(shape), ends["high"].to_numpy().reshape(shape))


def search(index: Index, needs: DataFrame, bound: Bound, k: int, same: bool | None = None) -> DataFrame:
    """``(need, row, vec_id, score, rank)``: each need's best ``k`` rows other than its own, exactly.

    ``needs``: one row each, ``need`` unique. Scores are from ``least`` to ``most``; equal scores go by vec_id, then by place.
    """
    kind, width = index.kind, index.width
    needs = materialize(needs.select(*(c.split()[0] for c in NEED.split(", "))), "vector_needs")
    parts = max(1, -(-needs.count() // PART))
    part = F.pmod(F.xxhash64("need"), F.lit(parts)).cast("int").alias("part")
    stored = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def met(asked: DataFrame) -> DataFrame:
        sides = stored.groupBy("slab", "part").cogroup(asked.withColumn("part", part).groupBy("slab", "part"))
        return sides.applyInArrow(lambda blocks, rows: scan(blocks, rows, kind, width, bound, k, same), FOUND)

    home = materialize(met(needs), "vector_home")
    floor = home.groupBy("need").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("need", "kth")
    raised = needs.join(floor, "need", "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth")
    each, groups, summary = coarse_bounds(index)
    names = [c.split()[0] for c in NEED.split(", ")]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, np.diff(groups) != 0])
        for b in (b.slice(a, TOGETHER) for b in batches for a in range(0, b.num_rows, TOGETHER)):
            vectors = np.frombuffer(b"".join(b.column("v").to_pylist()), kind).reshape(b.num_rows, width).astype(float)
            upper, lower = within(bound, vectors, summary)
            reach = (upper >= np.asarray(b.column("least"))[:, None]) & (lower <= np.asarray(b.column("most"))[:, None])
            i, j = np.nonzero(np.maximum.reduceat(reach, starts, axis=1))
            for a in range(0, len(i), TOGETHER << 4):
                rows = b.take(pa.array(i[a : a + (TOGETHER << 4)]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(groups[starts][j[a : a + (TOGETHER << 4)]].astype(np.int32))], names=[*names, "group"])

    routed = raised.select(*names).mapInArrow(route, f"{NEED}, group int") if len(groups) else raised.withColumn("group", F.lit(0))
    to = F.explode(F.sequence(F.col("group") * each, (F.col("group") + 1) * each - 1))
    away = met(routed.withColumn("to", to).where("to <> slab").withColumn("slab", F.col("to")).select(*names))
    order = Window.partitionBy("need").orderBy(F.desc("score"), "vec_id", "row")
    return home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
