"""Vector searches and source divergence against brute force on small tables with nulls, odd numbers, ties, copies and repeated rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from corpusloom.llm import block_max, divergence, hard_negatives, vectors

VECTORS = "vec_id long, embedding array<float>, label int, score string, need string, slab int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    random_vector = lambda n=6: [r.gauss(0, 1) for _ in range(n)]
    common = random_vector()
    out = [(i, common if i % 4 == 0 else random_vector(), r.randrange(4), "x", "y", 1) for i in range(400)]
    out += [(400, None, 1, "", "", 0), (450, [1.0, None, 2.0], 1, "", "", 0), (500, [math.nan, 1.0], 2, "", "", 0), (550, [math.inf], 2, "", "", 0)]
    out += [(600, [], 3, "", "", 0), (650, [1.5, -2.0], 0, "", "", 0), (None, random_vector(), 1, "", "", 0), (700, random_vector(), None, "", "", 0)]
    out += [(50, out[50][1], out[50][2], "", "", 0), (7, random_vector(), 1, "", "", 0)]  # a repeated row and a repeated id
    return out


def usable(rows, labelled=False):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [r for r in rows if r[0] is not None and good(r[1]) and not (labelled and r[2] is None)]
    width = max(len(r[1]) for r in kept)
    return [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in kept]


def scored(rows, i):
    return sorted((-sum(x * y for x, y in zip(rows[i][1], v, strict=True)), vec, label, j) for j, (vec, v, label) in enumerate(rows) if j != i)


@pytest.fixture(params=[None, 8])
def sized(request, monkeypatch):
    """As it is, and with many slabs, parts and groups of slabs."""
    if request.param:
        for name, n in (("BLOCK", 8), ("LEAST", 40), ("PART", 5), ("COARSE", 3)):
            monkeypatch.setattr(vectors, name, n)


def test_top_k(spark, rows, sized):
    good = usable(rows)
    want = [(r[0], rank, vec, -s) for i, r in enumerate(good) if r[0] % 50 == 0 for rank, (s, vec, *_) in enumerate(scored(good, i)[:5], 1)]
    got = block_max.top_k(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives(spark, rows, sized):
    good, want = usable(rows, True), []
    for i, (vec, _, label) in enumerate(good):
        if vec % 50 == 0:
            near = scored(good, i)
            for s, other, *_ in [x for x in near if x[2] == label][:5]:
                fit = [x for x in near if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
                want += [(vec, other, rank, n, -s, -t) for rank, (t, n, *_) in enumerate(fit[:3], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_few_rows_and_none(spark):
    assert block_max.top_k(spark.createDataFrame([], VECTORS)).count() == hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "", "", 0)], VECTORS)
    assert block_max.top_k(one).count() == 0
    two = spark.createDataFrame([(0, [], 1, "", "", 0), (1, [], 2, "", "", 0)], VECTORS)
    assert [tuple(r) for r in block_max.top_k(two).collect()] == [(0, 1, 1, 0)]


@pytest.mark.parametrize("large", [1e3, 1e6, 1e15, 1e30])
def test_large_numbers_are_exact(spark, large):
    rows = [(i, [large * (i - 3), 1.0, i / 7], 0, "", "", 0) for i in range(12)]
    good = usable(rows)
    want = [(0, rank, vec, max(vectors.LOWEST, min(vectors.HIGHEST, -s))) for rank, (s, vec, *_) in enumerate(scored(good, 0)[:5], 1)]
    got = sorted(map(tuple, block_max.top_k(spark.createDataFrame(rows, VECTORS)).collect()))
    assert [g[3] for g in got] == [w[3] for w in want] and (large > 1e15 or got == want)


def test_bounds_hold_and_prune(spark):
    """No score is beyond its block's bounds, and of clustered vectors most blocks are left out."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(size=16) * 0.1], i % 12, "", "", 0) for i in range(3000)]
    index = vectors.build(spark.createDataFrame(rows, VECTORS))
    table = index.blocks.toArrow()
    side = lambda c: np.array(table[c].to_pylist(), float).reshape(table.num_rows, -1)
    summary = vectors.Summary(np.asarray(table["pivot"]), np.asarray(table["near"]), np.asarray(table["far"]), side("low"), side("high"))
    asked = np.floor(256 * np.float32([rows[i][1] for i in range(0, 3000, 50)]).astype(float))
    for bound in (block_max.term_maxima, hard_negatives.annuli(index)):
        upper, lower = bound(asked, summary)
        skipped = 0
        for b in range(table.num_rows):
            x = np.frombuffer(table["data"][b].as_py(), index.kind).reshape(-1, index.width).astype(float)
            s = asked @ x.T
            assert (s <= upper[:, [b]]).all() and (s >= lower[:, [b]]).all()
            skipped += (upper[:, b] < np.sort(asked @ asked.T, axis=1)[:, -3]).mean()
        assert skipped > table.num_rows / 2


DOCS = "doc_id long, text string, lang string, source string, n string, term string, rank string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    known = ["alpha", "Beta", "ÉCOLE", "école", "x", "naïve", "z" * 400, "слово", "it's", "a1b", "tie", "eit"]
    pick = lambda n: "".join(r.choice(known) + r.choice([" ", "\n", ", ", "  ", "0", "\x00"]) for _ in range(n))
    out = [(i, pick(r.randint(0, 12)), ["en", "en", "de", None, "few"][i % 5 if i % 35 == 4 or i % 5 != 4 else 0], ["a", "b", "c", None, ""][i % 7 % 5], "", "", "") for i in range(150)]
    out += [(200, None, "en", "a", "", "", ""), (201, "", "en", "silent", "", "", ""), (202, pick(3000), "de", "a", "", "", ""), (202, "alpha", "de", "a", "", "", ""), (203, "alpha", "few", "b", "", "", "")]
    return out


def brute_divergence(rows, least=10, ranks=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for g, _, words in docs if g == lang for t in set(words))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: collections.Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                counts[s].update(t for t in words if t in kept)
        p = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        whole, each = p(sum(counts.values(), collections.Counter())), {s: p(c) for s, c in counts.items()}
        for s in counts:
            parts = {"pair": [(-sum(f(each[s][t], each[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]}
            parts["term"] = [(-f(each[s][t], whole[t]), t.encode(), t) for t in kept if counts[s][t] and each[s][t] > whole[t]]
            for part, found in parts.items():
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(sorted(found), 1) if part == "pair" or rank <= ranks]
    return out


@pytest.mark.parametrize("shard", [divergence.SHARD, 3])
def test_divergence(spark, texts, shard, monkeypatch):
    if shard == 3:
        monkeypatch.setattr(divergence, "CHUNKS", 3)
        monkeypatch.setattr(divergence, "HELD", 5)
    got = divergence.source_divergence(spark.createDataFrame(texts, DOCS).repartition(3), shard=shard)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute_divergence(texts)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[2] for r in want} == {"pair", "term"} and any(len(r[3]) == 400 for r in want) and any(r[0] == "few" for r in want)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(1, "word", "en", "a", "", "", ""), (2, None, "en", "b", "", "", "")], DOCS)
    assert sorted(map(tuple, divergence.source_divergence(one).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
