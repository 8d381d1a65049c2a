"""The pipeline's stages on a small table, each against brute force on what the stage before kept."""

import collections
import itertools
import random

import corpus_pipeline
from corpusloom.llm import langid, near_copies
from corpusloom.llm.common import materialize
from pyspark.sql import functions as F
from test_ops import LONG, SCHEMA, brute_components, brute_fingerprint, brute_lines, brute_targets, words


def table():
    r = random.Random(9)
    pick = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    out = []
    for i in range(60):
        lines = [pick(r.randint(3, 12)) for _ in range(r.randint(1, 5))] + ([LONG] if i % 5 == 0 else [])
        text = "\n".join(lines)
        out.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}", len(text)))
    out += [(100 + i, out[i][1], *out[i][2:]) for i in range(10)] + [(200, None, "en", "s0", None), (201, "12 34", "en", "s0", 5)]
    return out


def test_stages(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)), f"test_{name}")
        kept.append([tuple(x) for x in out.collect()])
        if name != "packing":
            assert out.dtypes == docs.dtypes
        docs = out
    language, lines, near, mixed, packed = kept
    frame = spark.createDataFrame(rows, SCHEMA)
    leads = {x.doc_id: (x.lang_pred, x.lead) for x in langid.predict(frame, langid.train(langid.learnable(frame))).collect()}
    assert sorted(r[0] for r in language) == sorted(d for d, (lang, lead) in leads.items() if lang != "und" and lead >= langid.MIN_LEAD)
    assert sorted((r[0], r[1]) for r in lines) == [(d, text) for d, _, _, text in brute_lines(language)]
    assert all(r[4] == len(r[1]) for r in lines)
    ids = brute_components([brute_fingerprint(r[1]) for r in lines])
    assert sorted(r[0] for r in near) == sorted(min(r[0] for r, x in zip(lines, ids, strict=True) if x == c) for c in set(ids))
    taken, sizes, known = collections.Counter(mixed), collections.Counter(), set(near)
    assert set(taken) <= known and max(taken.values()) <= 3
    for r in near:
        sizes[r[3]] += len(words(r[1]))
    for source, target in brute_targets(sizes).items():
        got = sum(n * len(words(r[1])) for r, n in taken.items() if r[3] == source)
        assert got <= target + 1e-6 and target - got <= max(len(words(r[1])) for r in near if r[3] == source)
    assert sum(r[4] for r in packed) == sum(n * len(words(r[1])) for r, n in taken.items())
    assert collections.Counter((r[0], r[1]) for r in packed if r[2] == 0) == {(r[0], i): 1 for r, n in taken.items() for i in range(n)}
    again = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert again == sorted(map(str, docs.collect()))


def brute_kept(rows):
    """The smallest doc_id of each group that five-word shingles of Jaccard similarity 0.8 link."""
    sets = []
    for _, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    ids = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and ids[i] != ids[j]:
            a, b = sorted((ids[i], ids[j]))
            ids = [a if x == b else x for x in ids]
    return sorted(min(r[0] for r, x in zip(rows, ids, strict=True) if x == c) for c in set(ids))


def test_near_dedup_is_brute_force_at_its_similarity(spark, monkeypatch):
    r, rows = random.Random(4), []
    for _ in range(12):
        base = [r.choice("abcdefghijklmnopqrst") + str(r.randint(0, 99)) for _ in range(r.choice([3, 60, 100, 300]))]
        rows.append(base)
        for _ in range(6):
            copy = list(r.choice(rows[-3:]) if r.random() < 0.3 else base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            rows.append(copy)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_kept(rows)
    assert 12 < len(want) < len(rows) - 20
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    monkeypatch.setattr(near_copies, "ORDERS", 1)
    monkeypatch.setattr(near_copies, "SMALL", 3)
    assert sorted(x.doc_id for x in near_copies.near_deduplicated(docs).collect()) == want


def stages(spark, docs, top):
    """Each stage's columns and rows, on what the one before kept."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, top), f"odd_{name}")
        out.append((docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert [rows for _, rows in stages(spark, docs, str(tmp_path))] == [[]] * 5


def test_stages_with_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = table()
    rows += [(None, "a text without any id " * 9, None, None, None)] * 3 + [rows[5]] * 2 + [(3, "other text of an id that is there " * 8, "en", "s1", 1), (300, "very long " * 30_000 + "end", "en", "s2", 1)]
    extra = ("kept", "shard", "shard_order", "node", "fp", "_doc", "n_dropped", "size", "lang_pred", "cluster", "_c0", "buckets")
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in extra)) for i, r in enumerate(rows)], SCHEMA + "".join(f", {c} string" for c in extra)).repartition(3)
    language, lines, near, mixed, packed = stages(spark, docs, str(tmp_path))
    assert all(columns == docs.columns for columns, _ in (language, lines, near, mixed))
    known = {r[5:] for r in language[1]}
    assert len(known) == len(language[1]) == len(lines[1]) and {r[5:] for r in lines[1]} == known and {r[5:] for r in near[1]} <= known
    assert sum(r[0] is None for r in near[1]) == 1 and sum(r[0] == 300 for r in near[1]) == 1
    assert {r[5:] for r in mixed[1]} <= {r[5:] for r in near[1]}
    assert sum(r[4] for r in packed[1]) == sum(len(words(r[1])) for r in mixed[1])


def test_near_dedup_goes_through_the_trie(spark, monkeypatch):
    """Without any band of minima in common but within op10's bits, near copies are found by their fingerprints; far texts they propose are no links."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 9999)}" for _ in range(400)]
    texts = [base, [*base[:200], "new", *base[201:]], [f"x{i}" for i in range(400)]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(near_copies, "links", lambda classes, n: classes.crossJoin(classes.toDF("b", "other")).select(classes["fp"].alias("a"), "b"))
    real = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda docs, keep: real(docs, keep).withColumn("buckets", F.array(F.xxhash64("node"))))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
