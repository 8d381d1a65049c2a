"""The ten operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from corpusloom.llm import components, langid, line_dedup, media, mixing, packing, quality, secret_scan, simhash, token_counts, warc
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LONG = "A line that is shared by many of the documents here"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    pick = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta,"]) for _ in range(n))
    out = []
    for i in range(40):
        lines = [pick(r.randint(1, 12)) for _ in range(r.randint(0, 6))]
        if i % 3 == 0:
            lines.insert(0, ("  " if i % 2 else "\t") + (LONG.upper() if i % 2 else LONG) + "\x0b")
        if i % 9 == 0:
            lines.append(LONG)
        out.append((i, "\n".join(lines), ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], 1))
    out += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t", "en", "b", 3), (103, pick(3000), "de", "c", 1), (104, "x", "en", "a", 1)]
    out += [(7, out[7][1], "en", "b", 1), (105, out[103 - 60][1], "en", "a", 1)]  # a repeated id, a copy of the long one
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """With extra columns whose names the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("size", "h1", "fp", "key", "rank", "copies", "score", "lang_pred", "kept_", "component", "_0", "_doc", "_c0", "kept", "base", "found", "n", "last", "text_", "node", "bucket")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def brute_lines(rows, least=5, by=lambda r: r[0]):
    key = lambda line: line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(list)
    for row in rows:
        for k in {key(x) for x in (row[1] or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(row)
    gone = {k: max(v, key=by)[0] for k, v in holders.items() if len(v) >= least}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r))


def test_line_dedup_is_brute_force(odd, rows):
    got = line_dedup.line_dedup(odd).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)
    assert sum(r.n_dropped for r in got) > 5


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Each row loses its own lines only, wherever those of its namesakes stand."""
    rows = [(1, LONG + "\nfirst unique"), (1, "other text entirely\nsecond row"), (None, "null\n" + LONG), (None, LONG)] + [(i, "x\n" + LONG) for i in range(2, 6)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.lit(1))).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(rows, by=lambda r: (r[0] is not None, r[0])), key=str)


def test_line_store_joins_move_no_run(spark):
    """Runs are neither shuffled nor sorted, by joins or compaction, and no name stays in the catalog."""
    store = line_dedup.LineStore(spark)
    for k in range(4):
        store.add(spark.range(k * 50, k * 50 + 100).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("doc_id")))
    with line_dedup.sorted_buckets(spark):
        a, b = store.runs[0], store.runs[-1]
        for how in ("left", "full", "left_anti"):
            plan = store.joined(a, b, how)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert {(x.n, x["last"]) for x in store.totals().collect()} == {(1, i) for i in [*range(50), *range(200, 250)]} | {(2, i) for i in range(50, 200)}
    store.close()
    assert not spark.sql("SHOW TABLES LIKE 'line_run_*'").count()


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_store_levels(spark):
    """Runs stay disjoint, a full level is compacted, and totals are those of all batches."""
    store = line_dedup.LineStore(spark, buckets=3, fanout=2)
    r, expected = random.Random(1), {}
    for _ in range(5):
        batch = [(r.randint(1, 30), 0, r.randint(1, 99)) for _ in range(20)]
        for h, _, doc in batch:
            n, last = expected.get(h, (0, 0))
            expected[h] = (n + 1, max(last, doc))
        store.add(spark.createDataFrame(batch, "h1 long, h2 long, doc_id long"))
    assert len(store.levels) > 1 and len(store.levels[0]) < 2
    held = [x.h1 for run in store.runs for x in run.collect()]
    assert len(held) == len(set(held)) == len(expected)
    assert {x.h1: (x.n, x["last"]) for x in store.totals().collect()} == expected


# 2


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        capped = {s for s in free if share * w[s] > 3 * sizes[s] + 1e-9}
        if not capped:
            return out | {s: share * w[s] for s in free}
        for s in capped:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= capped
    return out


def test_mixing(spark, odd, rows):
    meta = mixing.sizes(odd)
    got = mixing.plan(meta, shards=3).select("doc_id", "source", "size", "words", "target", "copies", "shards").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    want = brute_targets(sizes)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert {r.words for r in mine} == {sizes[s]} and all(abs(r.target - t) < 1e-6 for r in mine)
        taken = sum(r.size * r.copies for r in mine)
        assert taken <= t + 1e-6 and t - taken <= max(r.size for r in mine)
    assert all(0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= x < 3 for x in r.shards) for r in got)
    again = mixing.plan(meta.repartition(5), shards=3).select("doc_id", "size", "copies", "shards").collect()
    assert sorted((r.doc_id, r["size"], r.copies, r.shards) for r in got) == sorted((r.doc_id, r["size"], r.copies, r.shards) for r in again)
    assert mixing.plan(mixing.sizes(empty(spark))).count() == 0


def test_mix_repeats_rows(odd, rows):
    plan = mixing.plan(mixing.sizes(odd)).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "shard", "shard_order"]
    got = collections.Counter(r.doc_id for r in mixed.collect())
    assert {r.doc_id: r.n for r in plan if r.n} == dict(got)


def test_shards_own_disjoint_draws(spark):
    """Each draw of a block has one home, and a shard holds of each source what the tree dealt it; the number of shards grows."""
    meta = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.col("id") % 50 + 1).alias("size"))
    got = mixing.plan(meta, docs_per_block=1).collect()
    assert all(len(r.shards) == r.copies == len(set(r.orders)) for r in got)
    shards = collections.Counter(x for r in got for x in r.shards)
    n = max(mixing.SHARDS, sum(r.copies for r in got) // mixing.BLOCKS_PER_SHARD)
    assert len(shards) >= n >= mixing.SHARDS and max(shards.values()) < 2 * len(got) * 3 // n
    few = mixing.plan(meta, docs_per_block=40).collect()
    assert {x for r in few for x in r.shards} <= set(range(mixing.SHARDS)) and all(len(r.shards) == r.copies for r in few)


@pytest.mark.parametrize(("pool", "good", "draws"), [(10, 4, 5), (30, 29, 7), (50, 20, 49), (6, 0, 3), (6, 6, 3), (1, 1, 0)])
def test_hypergeometric_is_exact(spark, pool, good, draws):
    """Quantiles of the inversion at evenly spread u have the exact probabilities."""
    from math import comb

    n = 4000
    df = spark.range(n).select(mixing.hypergeometric(F.lit(pool), F.lit(good), F.lit(draws), (F.col("id") + 0.5) / n).alias("x"))
    got = collections.Counter(r.x for r in df.collect())
    for x in range(max(0, draws - pool + good), min(good, draws) + 1):
        assert abs(got[x] / n - comb(good, x) * comb(pool - good, draws - x) / comb(pool, draws)) < 2 / n
    assert sum(got.values()) == n


def test_splitting_tree_deals_all_blocks(spark):
    quotas = spark.createDataFrame([([7, 0, 100, 13],)], "quotas array<long>")
    tree = {r.shard: r.quotas for r in mixing.splitting_tree(quotas, shards=5).collect()}
    assert sorted(tree) == list(range(5))
    assert [sum(q) for q in zip(*tree.values(), strict=True)] == [7, 0, 100, 13]
    assert all(sum(q) == 24 for q in tree.values()) and all(x >= 0 for q in tree.values() for x in q)


# 3


def test_pieces_count_alike():
    import tiktoken

    _, ranks = token_counts.load_ranks()
    e = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    text = "".join(r.choice(["word", " ", "  ", "\n", "é1", "'s", ", ", "x y z ", "　"]) for _ in range(3000))
    for size in (7, 50, 501):
        parts = token_counts.pieces(text, size)
        assert "".join(parts) == text
        assert sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(text))


TOTALS = ["source", "lang", "tokenizer", "n_docs", "n_tokens", "n_bytes"]


def recount(counts):
    """Totals from all counts at once."""
    want = counts.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))
    return sorted(map(str, want.select(TOTALS).collect()))


def totals(rollup):
    return sorted(map(str, rollup.totals().select(TOTALS).collect()))


def test_rollup_by_deltas(spark, docs):
    """Inserts, revisions, deletes and a batch delivered twice: the totals are those of what is left, compacted or not."""
    counts = token_counts.count_tokens(docs).cache()
    for fanout in (2, 9):
        rollup = token_counts.Rollup(spark, fanout=fanout)
        low, high = counts.where("doc_id < 20"), counts.where("doc_id >= 20 or doc_id is null")
        assert rollup.commit("a", token_counts.changes_of(low))
        assert rollup.commit("b", token_counts.changes_of(high))
        assert not rollup.commit("b", token_counts.changes_of(high))
        assert totals(rollup) == recount(counts)
        revised = counts.where("doc_id in (3, 25)").withColumns({"n_tokens": F.col("n_tokens") + 5, "source": F.lit("z")})
        assert rollup.commit("c", token_counts.changes_of(revised, "revise").unionByName(token_counts.changes_of(counts.where("doc_id in (4, 100)"), "delete")))
        left = counts.where("doc_id not in (3, 25, 4, 100)").unionByName(revised)
        assert totals(rollup) == recount(left)
        assert rollup.commit("d", token_counts.changes_of(counts.where("doc_id = 4"), "insert")) and totals(rollup) == recount(left.unionByName(counts.where("doc_id = 4")))
        assert sum(map(len, rollup._tables())) == (1 if fanout == 2 else 4)


def test_rollup_takes_the_last_change_of_a_batch(spark):
    """By sequence: a smaller revised count, and a delete after an insert, in one batch."""
    rows = [(1, "insert", 0, 10), (1, "revise", 1, 4), (2, "insert", 0, 7), (2, "delete", 1, 7), (3, "delete", 0, 0), (3, "insert", 1, 6), (4, "delete", 0, 1), (None, "insert", 0, 5)]
    changes = spark.createDataFrame([(d, 0, o, q, "s", None, "t", 1, n, n) for d, o, q, n in rows], "doc_id long, part long, op string, seq long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long")
    rollup = token_counts.Rollup(spark)
    rollup.commit("a", changes.withColumn("live", F.lit("an extra column")))
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(3, 15)]
    rollup.commit("b", changes.where("op = 'insert'").withColumn("op", F.lit("delete")))
    assert rollup.totals().count() == 0


def test_rollup_counts_rows_that_share_an_id(spark):
    rows = [(1, "one two", "en", "a", 1)] * 3 + [(1, "three", "en", "a", 1), (None, "x", None, None, 1), (None, "y y", None, None, 1), (None, None, None, None, None)]
    counts = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA))
    rollup = token_counts.Rollup(spark)
    rollup.commit("a", token_counts.changes_of(counts))
    assert totals(rollup) == recount(counts) and sum(r.n_docs for r in rollup.totals().collect()) == 7


def test_rollup_of_nothing(spark):
    counts = token_counts.count_tokens(empty(spark))
    rollup = token_counts.Rollup(spark)
    assert rollup.commit("a", token_counts.changes_of(counts)) and rollup.totals().count() == 0


def test_rollup_ignores_what_was_not_committed(spark, docs):
    counts = token_counts.count_tokens(docs.where("doc_id < 5"))
    rollup = token_counts.Rollup(spark)
    assert rollup.totals().count() == 0
    counts.select("source", "lang", "tokenizer", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes").write.parquet(rollup._at("deltas", "lost"))
    assert rollup.totals().count() == 0


def test_tokenizer_version_is_of_its_file(tmp_path):
    import shutil

    shutil.copy(f"{token_counts.TOKENIZERS}/{token_counts.TOKENIZER}.tiktoken", tmp_path / "own.tiktoken")
    version, ranks = token_counts.load_ranks(str(tmp_path), "own")
    with open(tmp_path / "own.tiktoken", "ab") as f:
        f.write(b"enp6eg== 60000\n")
    assert version.startswith("own@") and token_counts.load_ranks(str(tmp_path), "own")[0] != version and len(ranks) > 50_000


# 4


def test_text_media_round_trip(odd, rows):
    got = {(r.doc_id, r.n_bytes): r for r in media.text_media(odd).collect()}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[doc, len(raw)]
        stored = media.store(padded)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_area_resize_is_the_mean_of_boxes():
    r = np.random.default_rng(0)
    for h, w, oh, ow in [(12, 9, 4, 3), (7, 5, 3, 2), (2, 2, 5, 7), (1, 1, 3, 3)]:
        image = r.integers(0, 256, (h, w))
        fine = np.kron(image, np.ones((oh, ow)))  # each output box is whole samples of this
        want = fine.reshape(oh, h, ow, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, (oh, ow)), want)


def test_area_resize_by_bands(monkeypatch):
    image = np.random.default_rng(3).integers(0, 256, (103, 24, 3))
    whole = media.area_resize(image, (9, 7))
    for band in (1, 50, 24 * 7, 1 << 20):
        monkeypatch.setattr(media, "BAND", band)
        assert np.allclose(media.area_resize(image, (9, 7)), whole)


def test_netpbm_and_bmp():
    r = np.random.default_rng(1)
    grey = r.integers(0, 256, (5, 7), dtype=np.uint8)
    samples = lambda data: media.decode(data)[0]
    assert (samples(media.encode_pgm(grey)) == grey).all() and (samples(media.encode_bmp(grey)) == grey).all()
    rgb = r.integers(0, 256, (3, 4, 3), dtype=np.uint8)
    assert (samples(b"P6 # c\n4 3\n255\n" + rgb.tobytes()) == rgb).all()
    assert (samples(b"P3\n4 3 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert samples(b"P1\n3 2\n1 0 1\n0 1 1\n").tolist() == [[0, 1, 0], [1, 0, 0]]
    assert samples(b"P4\n3 2\n" + bytes([0b10100000, 0b01100000])).tolist() == [[0, 1, 0], [1, 0, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0].tolist() == [[258]] and media.decode(b"P5\n1 1\n15\n\x07")[1] == 15


def test_tiles_are_scaled_by_the_largest_sample():
    load = lambda data: np.load(__import__("io").BytesIO(data))
    ramp = np.linspace(0, 65535, 64 * 64).reshape(64, 64).astype(">u2")
    image, top = media.decode(b"P5\n64 64\n65535\n" + ramp.tobytes())
    assert top == 65535 and abs(load(media.tile(image, top=top)).astype(float) - media.area_resize(ramp.astype(float) * 255 / 65535, media.TILE)).max() <= 0.5
    dark, top = media.decode(b"P2\n2 1\n3\n0 3\n")
    assert load(media.tile(dark, (1, 2), top)).tolist() == [[0, 255]]


def test_media_columns_with_errors(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, media.encode_pgm(image)), (2, media.encode_bmp(image)), (3, None), (4, b""), (5, b"P5\n9 9\n255\n"), (6, b"BMx")]
    two = bytearray(media.encode_bmp(image))
    two[46:50] = (2).to_bytes(4, "little")  # a palette of two colours, and samples beyond
    rows += [(7, bytes(two)), (8, b"P2\n1 1\n5\n9\n"), (9, b"P5\n-1 4\n255\n"), (10, b"P5\n1 1\n0\n\0")]
    got = {r.media_id: r for r in media.media_columns(spark.createDataFrame(rows, "media_id long, bytes binary")).collect()}
    assert got[1].dhash == got[2].dhash == "ff" * 8 and got[1].tile == got[2].tile and got[1].error is None
    assert np.load(__import__("io").BytesIO(bytes(got[1].tile))).shape == media.TILE
    assert all(got[i].error and got[i].tile is None for i in range(3, 11))
    assert media.text_media(empty(spark)).count() == media.media_columns(spark.createDataFrame([], "media_id long, bytes binary")).count() == 0


# 5


def test_quality_figures(odd, rows):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(odd).collect())
    want = []
    for doc, text, *_ in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), failed))
    assert got == sorted(want)


def test_words_seen_before_look_at_the_whole_text():
    r = random.Random(4)
    distinct, few = [f"w{i}" for i in range(200)], [r.choice("abc") for _ in range(4000)]
    at = [rule.name for rule in quality.RULES].index("words_seen_before")
    figure = lambda w: quality.figures(" ".join(w), {})[5][at]
    assert abs(figure(distinct + few) - figure(few + distinct)) < 1e-3 and figure(distinct + few) > 0.85
    for _ in range(20):
        n = r.randint(1, 900)
        w = [r.choice([f"x{i}" for i in range(r.choice([3, 50, 2000]))]) for _ in range(n)]
        windows = [w[i : i + min(n, 200)] for i in range(n - min(n, 200) + 1)]
        assert abs(figure(w) - (1 - sum(len(set(x)) for x in windows) / sum(map(len, windows)))) < 1e-9
        assert abs(figure(w[n // 2 :] + w[: n // 2]) - figure(w)) < 0.05


def test_quality_of_nothing(spark):
    assert quality.quality(empty(spark)).count() == 0
    (one,) = quality.quality(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert one.base_failed and not one.kept and one.p_good is None


def votes_for(kind, n, but=()):
    """``n`` texts that all rules of a kind but some object to."""
    return np.tile([2 if r.kind == kind and r.name not in but else 1 for r in quality.RULES], (n, 1))


def test_a_misfiring_rule_is_outvoted():
    """Whichever rule it is, however often it misfires alone, and whatever junk there is, also of its own kind."""
    n = len(quality.RULES)
    junk = np.concatenate([votes_for("symbols", 12), votes_for("tables", 12), votes_for("repetition", 3, ("repeated_lines",))])
    for rule in range(n):
        for times in (1, 10, 100):
            votes = np.concatenate([np.ones((300, n), int), junk])
            votes[:times, rule] = 2
            p, table = quality.expectation_maximisation(votes, np.ones(len(votes)))
            assert (p[:300] >= quality.KEEP).all() and (p[300:] < quality.KEEP).all(), (rule, times)
            assert np.allclose(table.sum(axis=2), 1)


def test_two_rules_of_a_kind_are_believed_and_abstaining_says_nothing():
    n = len(quality.RULES)
    votes = np.concatenate([np.ones((1000, n), int), votes_for("symbols", 40), votes_for("symbols", 1, ("characters_not_letters",))])
    lone = np.ones((2, n), int)
    lone[:, 0] = 2
    lone[1, 1:3] = 0  # the kind's other rules abstain
    p, _ = quality.expectation_maximisation(np.concatenate([votes, lone]), np.ones(1043))
    assert p[1040] < 0.5 <= p[1041] and p[1042] < p[1041]


def test_the_posterior_is_not_all_must_pass(spark):
    """Clean texts that one rule's limit hits stay, and junk of each kind goes; ties and equal rows alike."""
    r = random.Random(2)
    line = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)) + "."
    prose = lambda: "\n".join(line(12) for _ in range(5))
    rows = [(i, prose()) for i in range(300)]
    poem = lambda: "\n".join(line(3)[-25:] for _ in range(20))
    refrain = line(6)
    rows += [(400 + i, poem()) for i in range(4)] + [(410 + i, prose() + ("\n" + refrain) * 4) for i in range(4)] * 2
    rows += [(1000 + i, prose().replace(" ", "%%% ")) for i in range(12)] + [(2000 + i, prose().upper().replace(" ", "!! ")) for i in range(12)] + [(3000 + i, prose().replace(" ", " | ")) for i in range(12)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("x"))).collect()
    assert len(got) == len(rows) and all(x.kept == (x.doc_id < 1000) for x in got if not x.base_failed)
    overruled = [x for x in got if x.kept and x.n_bad]
    assert len(overruled) >= 8 and any(x.doc_id < 410 for x in overruled) and any(x.doc_id >= 410 for x in overruled)


def test_quality_is_learned_alike_in_the_driver_and_by_tasks(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Alpha", "beta.", "##", "|", "GAMMA", "7", "delta!!", "word\n"]) + str(r.random())[: r.randint(0, 6)] for _ in range(r.randint(15, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = ({x.doc_id: x for x in quality.quality(docs, in_driver=n).collect()} for n in (quality.IN_DRIVER, 0))
    assert {k: x.kept for k, x in a.items()} == {k: x.kept for k, x in b.items()} and len(a) == 200
    assert all(x.p_good is None or abs(x.p_good - b[k].p_good) < 1e-6 for k, x in a.items()) and len({x.p_good for x in a.values()}) > 2
    assert quality.quality(empty(spark), in_driver=-1).count() == 0


def test_junk_planted_in_long_text_is_found(spark):
    text = " ".join(f"word{i % 977}#$" for i in range(40_000))
    clean = [(i, " ".join(random.Random(i).choice(["lorem", "ipsum", "dolor", "sit", "amet,", "elit."]) + "abcdefghijkl"[i % 9 : i % 9 + j % 4] for j in range(60)) + ".") for i in range(60)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame([(100, text), *clean], "doc_id long, text string")).collect()}
    assert got[100].n_words == 40_000 and not got[100].kept and got[100].base_failed
    assert all(got[i].kept for i in range(60) if not got[i].base_failed)


# 6


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>" + "ab é" * 400
    pages = [(1, "http://a", big), (5, "http://b", big), (5, "http://c", big), (2, None, "small"), (3, "u", "small"), (4, "x\ny", None), (6, "z", ""), (7, "r", "".join(map(chr, range(32, 9000)))), (None, "n", big)]
    pages += [(100 + i, f"http://{i}", random.Random(i).randbytes(3000).decode("latin1")) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    monkeypatch.setattr(warc, "CHUNK", 64)
    manifest = warc.write_archives(df, warc.new_path(spark, "warc"), archive=20_000)
    assert manifest.count() > 3
    for span in (50, 1000, 1 << 22):
        got = warc.read_archives(manifest, span).collect()
        assert len(got) == len(pages)
        texts = collections.Counter((p, (h or "").encode("utf-8", "surrogatepass")) for p, _, h in pages)
        full = collections.Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response")
        assert not full - texts
        revisits = sorted(((r.page_id, r.refers_to) for r in got if r.record_type == "revisit"), key=str)
        assert revisits == [(1, 5), (None, 5)]
        assert {r.payload_bytes for r in got if r.page_id == 1} == {len(big.encode())}
        assert {r.payload_digest for r in got if r.page_id in (1, 5)} == {hashlib.sha1(big.encode()).hexdigest()}


def test_warc_ranges_are_dealt_over_tasks(spark):
    rows = [(i, "u", random.Random(i).randbytes(3000).decode("latin1")) for i in range(60)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), warc.new_path(spark, "warc"))
    got = warc.read_archives(manifest, 10_000).withColumn("task", F.spark_partition_id())
    per_task = {r.task: r["count"] for r in got.groupBy("task").count().collect()}
    assert sum(per_task.values()) == 60 and len(per_task) >= 4 and max(per_task.values()) <= 30


def test_an_archive_as_a_payload_is_no_record(spark, tmp_path):
    """Stored bytes of records, even at a range's very start, are told from the archive's own by its id."""
    inner = warc.member(warc.record(7, "http://inner", b"inner", "d", None, "other"))
    own = warc.member(warc.record(1, "http://a", b"x", "d", None, "mine"))
    import io

    data = own + inner + own
    assert len(list(warc.scan_range(io.BytesIO(data), len(data), len(own), len(data), "mine"))) == 1
    assert len(list(warc.scan_range(io.BytesIO(data), len(data), len(own), len(data)))) == 2


def test_any_archive_is_read(spark, tmp_path):
    """Records of all types, of others' making: no HTTP headers, no address, several in one member, odd lines, and bytes that are no member."""

    def record(kind, block, *head):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\ncontent-length:4\r\nX: a\r\n b\r\n\r\nbody"
    records = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI:<http://a/>", "Content-Type: application/http; msgtype=request"),
        record("response", http, "WARC-Target-URI: http://a/", "Content-Type: application/http", "WARC-Truncated: length", "no field"), record("metadata", b"via: b\r\n"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "Content-Type: application/http", "WARC-Payload-Digest: sha1:ABC"), record("revisit", b""), record("resource", b"\x00\xff", "WARC-Target-URI: file:a"), record("conversion", "é".encode()),
    ]
    data = b"junk" + b"".join(map(warc.member, records[:3])) + warc.member(b"".join(records[3:])) + b"\x1f\x8b\x08tail, not compressed\r\nWARC/1.0\r\n"
    path = tmp_path / "other.warc.gz"
    path.write_bytes(data)
    manifest = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    for span in (17, 1 << 20):
        got = {(r.record_type, r.url, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in warc.read_archives(manifest, span, None).collect()}
        assert got == {
            ("warcinfo", None, 13, b"software: x\r\n"), ("request", "http://a/", 0, b""), ("response", "http://a/", 4, b"body"), ("metadata", None, 8, b"via: b\r\n"),
            ("revisit", None, None, None), ("resource", "file:a", 2, b"\x00\xff"), ("conversion", None, 2, "é".encode()),
        }
    assert warc.read_archives(manifest, types=("response",)).count() == 1
    own = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 2000), (2, "v", "x" * 2000)], "page_id long, url string, html string").repartition(1), warc.new_path(spark, "warc"))
    import gzip

    members = gzip.open(own.first().path).read().decode()
    assert members.startswith("WARC/1.1\r\nWARC-Type: warcinfo") and f"WARC-Record-ID: <urn:uuid:{own.first().archive_id}>" in members
    refers, ids = re.search("WARC-Refers-To: (.*)\r", members)[1], re.findall("WARC-Record-ID: (.*)\r", members)
    assert refers in ids and {r.record_type for r in warc.read_archives(own, types=None).collect()} == {"warcinfo", "response", "revisit"}


def test_warc_of_nothing(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_false_magic_is_no_record():
    import io

    inner = warc.member(b"WARC/1.1\r\nA: 1\r\n\r\n")
    fake = warc.MAGIC + b"\x00" * 30 + warc.member(b"not a record")
    data = fake + inner + fake + inner
    got = list(warc.scan_range(io.BytesIO(data), len(data), 0, len(data)))
    assert len(got) == 2 and all(x.startswith(warc.VERSION) for x in got)
    cut = len(fake) + 1
    parts = [len(list(warc.scan_range(io.BytesIO(data), len(data), a, b))) for a, b in ((0, cut), (cut, len(data)))]
    assert parts == [1, 1]


# 7


def test_secret_scan_is_brute_force(spark):
    texts = [
        None, "", "password = hunter2hunter2 é Token:'abcdefgh' token=short api-key=xxxxxxxxxxxx API_KEY=\"a/b+c=d.e_f-g\"", "é" * 5 + "AKIA" + "A1" * 8 + " AKIAxx AKIASHORT",
        "0123456789abcdef" * 2 + " " + "0123456789abcdef" * 3 + "g deadbeef", "token=secret=abcdefgh1 token=api_key:\"abcdefghijkl", "secret: " + "0a" * 20, "AKIAAKIA" + "B" * 12 + "\nPASSWD : \"12345678",
        "zQ8vX2kLr9TnB4wYc7HsJ1fGpD5mA3eU xxx getElementByIdentifierName and andthenthereareotherthings", "word " * 3000 + "token=" + "q" * 9,
    ]
    kinds = [(k, re.compile(p.replace("(?i:", "(?i:")), g, n) for k, (_, p, g, n) in enumerate(secret_scan.PATTERNS)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit(1))
    for r in secret_scan.scan(df).collect():
        want = sorted((m.start(), k, m.end()) for k, p, g, n in kinds for m in p.finditer(r.text or "") if len(m[g]) >= n)
        assert [(s.start, s.kind, s.end) for s in r.base] == want
        assert all(re.fullmatch(secret_scan.TOKEN.partition(")")[2].replace("}+", "}"), r.text[s.start : s.end]) for s in r.found)


def test_models_find_what_no_pattern_does(spark):
    """Planted keys without a pattern's match, in prose and beside ordinary names; a pattern's own key is judged as well."""
    keys = ["zQ8vX2kLr9TnB4wYc7HsJ1fGpD5mA3eU", "9c1f0b7ad3e84b56a0d2", "QK7Z2M9XW4B8N1V6C3T5", "b64-Zk9_dQ4xT7pLm2Rw8sVb"]
    plain = ["getElementByIdentifierName", "andthenthereareotherthings", "src/main/resources/application/settings", "Rechtsschutzversicherungen", "4000123412341234", "customer_order_history_2024", "MAXIMUM_CONNECTION_COUNT"]
    rows = [(i, f"some words {k}, and {p} too.") for i, k in enumerate(keys) for p in plain] + [(50, "clean text of " + " ".join(plain)), (51, "token=" + keys[0])]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "found": F.lit(2)}))
    assert got.columns == ["doc_id", "text", "base", "found"]
    for r in got.collect():
        assert [r.text[s.start : s.end] for s in r.found] == ([] if r.doc_id == 50 else [keys[r.doc_id % 51]])
        assert [(s.start, s.kind, s.end) for s in r.base] == ([(0, 0, 38)] if r.doc_id == 51 else [])
    assert secret_scan.scan(empty(spark)).count() == 0


def test_short_keys_and_many_matches(spark):
    """Keys of 12 to 19 characters without a pattern, beside ordinary words of that length; and 20 000 matches in one text."""
    keys = ["zQ8vX2kLr9Tn", "Xk7Pq2Zw9RtL4v", "q9Zx7Kp2Wv8Ytr3B", "4fG7kQz9XwP2mN8vRtB"]
    plain = "understanding configuration Wahrscheinlichkeit getElementById snake_case_name 2024-01-15-1200 MAXIMUM_SIZE internationalization"
    rows = [(i, f"{plain} {k} {plain}") for i, k in enumerate(keys)] + [(9, plain), (10, "token=abcdefgh1 " * 20000)]
    began = time.time()
    for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [r.text[s.start : s.end] for s in r.found] == (keys[r.doc_id : r.doc_id + 1] if r.doc_id < 9 else [])
        assert r.doc_id != 10 or len(r.base) == 20000 and r.base[-1].start == 16 * 19999
    assert time.time() - began < 60


def test_documents_label_themselves(spark):
    """Values of patterns and other tokens, but where the models of made samples say the opposite; a part is held out."""
    ratios = secret_scan.log_ratios(secret_scan.labelled_samples(spark).where("not held_out"))
    rows = [(i, f"token=Qx7zK{i:05d}wV9 plainidentifierword password=understanding Xk7Pq2Zw9RtL4vQ8 " + "0123456789abcdef" * 2) for i in range(50)] + [(None, None), (60, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_scan.labelled_documents(docs, ratios).collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
    want = {(f"Qx7zK{i:05d}wV9", True, held[i]) for i in range(50)} | {(t, r, x) for t, r in (("plainidentifierword", False), ("0123456789abcdef" * 2, True)) for x in (True, False)}
    assert {tuple(r) for r in got} == want and len(got) == 150
    assert secret_scan.labelled_documents(docs, ratios, 10).count() < 150


def test_models_on_held_out_samples(spark):
    """Held-out strings, and identifiers of words that no sample for training has; the score is that of plain counting."""
    labelled = secret_scan.labelled_samples(spark).cache()
    assert not {w for w in secret_scan.WORDS[::5]} & {w for i, w in enumerate(secret_scan.WORDS) if i % 5} and len(secret_scan.WORDS) < 200
    ratios = secret_scan.log_ratios(labelled.where("not held_out"))
    held = labelled.where("held_out")
    precision, recall = secret_scan.evaluate(held, ratios)
    assert precision >= 0.99 and recall >= 0.99 and held.where("random").count() == held.where("not random").count() == 800

    n = len(secret_scan.ALPHABET) + 1
    code = lambda c: secret_scan.ALPHABET.find(c) if c in secret_scan.ALPHABET else n - 1
    counts = {True: collections.Counter(), False: collections.Counter()}
    for r in labelled.where("not held_out").collect():
        counts[r.random].update(code(a) * n + code(b) for a, b in itertools.pairwise(r.token))
    want = [a - b for a, b in zip(*(secret_scan.log_probabilities(counts[x]) for x in (True, False)), strict=True)]
    assert np.allclose(ratios, want)
    token = "zQ8vX2kLr9Tn_B4wYc7é"
    got = spark.range(1).select(secret_scan.ratio(F.lit(token), F.array(*map(F.lit, ratios))).alias("x")).first().x
    assert abs(got - np.mean([want[code(a) * n + code(b)] for a, b in itertools.pairwise(token)])) < 1e-9


def test_models_learn_from_a_given_table(spark):
    """Labels turned round turn the verdict round."""
    labelled = secret_scan.labelled_samples(spark).select("token", (~F.col("random")).alias("random"))
    docs = spark.createDataFrame([(1, "zQ8vX2kLr9TnB4wYc7HsJ1fGpD5mA3eU andthenthereareotherthings")], "doc_id long, text string")
    (r,) = secret_scan.scan(docs, labelled=labelled).collect()
    assert [r.text[s.start : s.end] for s in r.found] == ["andthenthereareotherthings"]


# 8


def test_packing_fits_and_conflicts(odd, rows):
    got = packing.pack(odd, capacity=50, group=16, source_limit=2).collect()
    sizes = collections.Counter()
    for doc, text, *_ in rows:
        sizes[doc] += len(words(text))
    placed = collections.Counter()
    for r in got:
        placed[r.doc_id] += r.n_words
    assert placed == sizes
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) == held[0].bin_words <= 50
        assert len({r.cluster for r in held}) == len(held)
        assert max(collections.Counter(r.source for r in held).values()) <= 2
    again = packing.pack(odd.repartition(2), capacity=50, group=16, source_limit=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_keeps_near_copies_apart(spark):
    """By SimHash components: texts that differ by a word in many lie in different bins."""
    r = random.Random(14)
    base = [f"w{r.randint(0, 9999)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]), "en", f"s{i}", 1) for i in range(12) for k in [r.randrange(300)]]
    rows += [(100 + i, " ".join(f"w{r.randint(0, 9999)}" for _ in range(40)), "en", f"t{i}", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = {x.doc_id: x.component_id for x in simhash.simhash_components(docs).collect()}
    assert max(collections.Counter(ids.values()).values()) > 2
    bins = collections.defaultdict(list)
    for x in packing.pack_sizes(packing.sizes_by_near_copies(docs)).collect():
        bins[x.bin_id].append(ids[x.doc_id])
    assert all(len(set(held)) == len(held) for held in bins.values()) and len(bins) < len(rows)
    assert sum(map(len, bins.values())) == len(rows)


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark)).count() == packing.pack_sizes(packing.sizes_by_near_copies(empty(spark))).count() == 0


def test_best_fit_is_the_tightest_compatible():
    """Against a plain search over all bins."""
    r = random.Random(4)
    bins, plain = packing.Bins(20, 2), []
    for _ in range(400):
        size, source, cluster = r.randint(0, 20), r.choice("ab"), r.randint(0, 30)
        fits = [(b["room"], i) for i, b in enumerate(plain) if b["room"] > 0 and b["room"] >= size and cluster not in b["clusters"] and b["sources"].count(source) < 2]
        want = min(fits)[1] if fits else len(plain)
        if not fits:
            plain.append({"room": 20, "clusters": set(), "sources": []})
        got = bins.put(size, source, cluster)
        assert got == want
        plain[got]["room"] -= size
        plain[got]["clusters"].add(cluster)
        plain[got]["sources"].append(source)


# 9


def test_language_id_learns(spark):
    r = random.Random(6)
    stems = {"aa": ["bab", "cad", "dab", "abba"], "bb": ["zoz", "yoy", "ozzy", "voz"]}
    rows = [(i, " ".join(r.choice(stems[lang]) for _ in range(30)), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "aa"] * 40)]
    rows += [(900, None, "aa", "s", 1), (901, "123 \n", "aa", "s", 1), (902, "", None, "s", 1), (903, "zoz yoy", None, "s", 1), (None, "bab cad", "aa", "s", 1)]
    got = langid.language_id(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    truth = {r[0]: r[2] for r in rows}
    assert all(x.lang_pred == truth[x.doc_id] and 0.5 < x.score <= 1 for x in held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "bb"
    assert langid.language_id(empty(spark)).count() == 0
    kept = langid.identified(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == len(rows) - 3


def test_a_model_of_all_texts_is_dense_kernel_ridge():
    """With every text a landmark, scores are those of kernel ridge regression solved with the whole kernel matrix."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 25))) for letters in ["abcde", "cdefg", "xyzab"] * 15]
    langs, new = ["p", "q", "r"] * 15, ["abc dd", "gfe c", "zzz y x", "a"]

    def grams(text):
        padded = " " + text + " "
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}

    kernel = lambda a, b: np.array([[len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y))) for y in b] for x in a])
    y = np.array([[1.0 if a == b else -1.0 for b in "pqr"] for a in langs])
    dense = np.linalg.solve(kernel(texts, texts) + 1 + langid.RIDGE * 15 * np.eye(45), y)
    want = (kernel(new, texts) + 1) @ dense
    sets = [langid.presence(t) for t in texts]
    model = langid.model_of(["p", "q", "r"], [langid.pack(s) for s in sets])
    langid.fitted(model, model.kernels(sets), langs)
    assert np.allclose(model.raw(model.kernels([langid.presence(t) for t in new])), want, atol=2e-3)


def test_kernels_by_blocks(monkeypatch):
    r = random.Random(12)
    sets = [langid.presence("".join(r.choice("abcdefgh ") for _ in range(80))) for _ in range(9)]
    want = np.array([[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    for size in (1 << 22, 64):
        monkeypatch.setattr(langid, "UNPACKED", size)
        model = langid.model_of(["x"], [langid.pack(s) for s in sets])
        for _ in range(2):
            assert np.allclose(model.kernels(sets), want, atol=1e-6)
        assert np.allclose(langid.landmark_kernels(model), want, atol=1e-6)


def test_the_sample_is_bounded(spark, monkeypatch):
    """By rows in all and landmarks in all, however many languages there are and however many rows share an id."""
    monkeypatch.setattr(langid, "SAMPLE", 60)
    monkeypatch.setattr(langid, "MARKS", 20)
    r = random.Random(13)
    text = lambda lang: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz"[lang % 20 :][:4]) for _ in range(5)) for _ in range(12))
    rows = [(1, text(i % 30), f"l{i % 30:02}", "s", 1) for i in range(900)] + [(1, "same words", "l00", "s", 1)] * 50
    seen = []
    whole = langid.fitted
    monkeypatch.setattr(langid, "fitted", lambda model, kernels, langs, **k: seen.append((model, kernels, langs)) or whole(model, kernels, langs, **k))
    langid.train(spark.createDataFrame(rows, SCHEMA))
    (model, kernels, langs), = seen
    assert len(model.langs) == 20 == len(model.sizes) and len(kernels) == len(langs) == 60 and max(collections.Counter(langs).values()) == 3


@pytest.mark.parametrize("n", [1, 2, 4, 40])
def test_rejection_depends_on_the_lead_not_on_the_number_of_languages(spark, n):
    """Texts like those learned stay, whatever the number of languages; a text between two languages goes."""
    r = random.Random(8)
    stems = ["".join(chr(97 + (k * 7 + j * (k % 5 + 1)) % 26) for j in range(5)) + chr(0x430 + k % 30) * 2 for k in range(n)]
    word = lambda k: "".join(r.sample(stems[k], 6))
    rows = [(i, " ".join(word(i % n) for _ in range(25)), f"l{i % n:02d}", "s", 1) for i in range(max(80, n * 12))]
    kept = {x.doc_id for x in langid.identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(kept) >= 0.97 * len(rows)
    raw = np.array([[1.0, 0.9], [1.0, -1.0]])
    assert np.allclose(langid.Model.leads(raw), [0.1, 2.0]) and np.allclose(langid.Model.leads(raw[:, :1]), 2.0)


def test_language_id_without_labels(spark):
    got = langid.language_id(spark.createDataFrame([(1, "some text", None, "s", 1)], SCHEMA)).collect()
    assert got[0].lang_pred == "und" and got[0].score == 0


def test_presence_by_pieces(monkeypatch):
    text = "Straße, “quoted” words & más " * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert set(whole) <= set(langid.presence(text))


# 10


def brute_fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = ids[i], ids[j]
            ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def test_simhash_is_brute_force(odd, rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    ids = brute_components(prints)
    least = {c: min(r[0] for r, x in zip(rows, ids, strict=True) if x == c) for c in set(ids)}
    want = sorted((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, ids, strict=True))
    assert sorted(map(tuple, simhash.simhash_components(odd).collect())) == want


def test_nodes_within_the_budget():
    """Each pair of nodes that could hold a link is walked once, and far ones never."""
    r = random.Random(5)
    prints = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
    for order in [(63, 0, 7), tuple(range(10, 19))]:
        node = simhash.node_of(prints, order)
        flips = set(simhash.within(len(order), 4))
        for i, j in itertools.combinations(range(len(prints)), 2):
            bits = sum((int(prints[i]) ^ int(prints[j])) >> (63 - b) & 1 for b in order)
            assert (int(node[i] ^ node[j]) in flips) == (bits <= 4)
    assert len(list(simhash.within(16, 4))) == 2517


@pytest.mark.parametrize("split", [4096, 5, 1])
def test_trie_join_finds_all_links(spark, split):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(6)]
    prints += [base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)] + [0, (1 << 64) - 1]
    prints = list(dict.fromkeys(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash.links(df, len(prints), split=split)
    stars = {x.node: x.component for x in components.connected_components(edges).collect()}
    ids = brute_components(prints)
    mine = [stars.get(signed(p), signed(p)) for p in prints]
    assert len(set(zip(ids, mine, strict=True))) == len(set(ids)) == len(set(mine))


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**11])
def test_every_choice_of_blocks_is_exact(n):
    """Any four bits leave some table's prefix untouched, and permuting loses nothing."""
    tables = simhash.choices(n)
    spans = tables[0][0]
    assert sum(w for _, w in spans) == 64
    blocks = [{i for i, (a, w) in enumerate(spans) if a <= 63 - b < a + w} for b in (0, 9, 40, 63)]
    hit = set().union(*blocks)
    assert any(not hit & set(keep) for _, keep in tables)
    fp = np.array([0x0123456789ABCDEF, 2**64 - 1, 1], np.uint64)
    for spans, keep in tables[:3]:
        moved, _ = simhash.permute(fp, spans, keep)
        assert (simhash.restore(moved, spans, keep) == fp).all()


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_near_deduplicated_keeps_one(odd, rows):
    kept = simhash.near_deduplicated(odd)
    assert kept.columns == odd.columns
    ids = brute_components([brute_fingerprint(t) for _, t, *_ in rows])
    want = sorted(min(r[0] for r, x in zip(rows, ids, strict=True) if x == c) for c in set(ids))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300)] + [(400, 400 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(51), 100]) and got[201] == got[200] == 200 and all(got[400 + i] == 400 for i in range(30))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
