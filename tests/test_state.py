"""Streams with state, the log of counts, the error store and global places, against plain Python."""

import os
import random

import pandas as pd
import pytest
from corpusloom.operators import error_store, ranking
from corpusloom.streaming import autocorrect, stateful
from corpusloom.streaming.count_log import CountLog
from pyspark.sql import functions as F

SCHEMA = "user_id long, event_id long, word string, ts timestamp"


def requests(n=400, users=3, words=6, step=40_000, seed=1):
    rnd = random.Random(seed)
    ms, out = 1_700_000_000_000, []
    for i in range(n):
        ms += rnd.choice([0, 1000, rnd.randrange(step)])
        out.append((rnd.randrange(users), i, rnd.choice([None, "", *(f"w{k}" for k in range(words))]), ms))
    return out


def stream(spark, path, batches, schema=SCHEMA):
    """A stream of one file a batch, in order."""
    os.makedirs(path)
    names = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=names)
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        frame.astype({"ts": "datetime64[us]"}).to_parquet(f"{path}/{i:03}.parquet")
        os.utime(f"{path}/{i:03}.parquet", (1_000_000_000 + i, 1_000_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("parts", [1, 3])
def test_cached_lookups(spark, tmp_path, parts):
    rows, ttl, room = requests(), 100_000, 3
    got = autocorrect.run_available(stateful.cached_lookups(stream(spark, tmp_path / "in", cut(rows, parts)), "user_id", "word", "ts", ttl, room), str(tmp_path / "w")).collect()
    caches, want = {}, {}
    for user, event, word, ms in rows:
        cache = caches.setdefault(user, {})
        hit = bool(word) and word in cache and ms - cache[word] <= ttl
        if word and not hit:
            cache.pop(word, None)
            cache[word] = ms
            if len(cache) > room:
                del cache[min(cache, key=cache.get)]
        want[event] = hit
    assert {r.event_id: r.hit for r in got} == want and len(got) == len(rows)
    assert any(want.values()) and not all(want.values())


@pytest.mark.parametrize("parts", [1, 4])
def test_deferred(spark, tmp_path, parts):
    rows, idle = requests(step=60_000), 30_000
    got = autocorrect.run_available(stateful.deferred(stream(spark, tmp_path / "in", cut(rows, parts)), "user_id", "word", "ts", idle), str(tmp_path / "w")).collect()
    end, want = rows[-1][3] - 10_000, set()
    for user in range(3):
        mine = [r for r in rows if r[0] == user]
        for row, after in zip(mine, [*mine[1:], None], strict=True):
            if after[3] - row[3] >= idle if after else row[3] + idle < end:
                want.add((user, row[1], row[2]))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_flushes_survive_a_restart(spark, tmp_path):
    """Each batch is a run of its own, which starts from the checkpoint of the one before; no correction is lost or counted twice."""
    rows = [(i % 3, i, f"s{i % 2}", f"r{i % 5}", 1_700_000_000_000 + i) for i in range(101)]
    schema = "user_id long, event_id long, source string, replacement string, ts timestamp"
    log = CountLog(spark, f"{tmp_path}/log", ["source", "replacement"], fanout=3)
    for i, part in enumerate(cut(rows, 9)):
        stream(spark, tmp_path / "in" / f"part={i}", [part], schema)
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        writer = stateful.flushed_counts(events, "user_id", "ts").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check")
        writer.trigger(availableNow=True).foreachBatch(log.append).start().awaitTermination()
    want = {}
    for user in range(3):
        mine = [r for r in rows if r[0] == user]
        for r in mine[: len(mine) // 8 * 8]:
            want[r[2:4]] = want.get(r[2:4], 0) + 1
    assert {(r.source, r.replacement): r.cnt for r in log.counts().collect()} == want
    assert len(log.live()) <= 6


def test_count_log(spark, tmp_path):
    log = CountLog(spark, f"{tmp_path}/log", ["word"], fanout=2)
    assert log.counts() is None and log.vacuum() == 0
    batch = spark.createDataFrame([("a", 2), ("a", 1), (None, 5)], "word string, cnt long")
    for i in (0, 1, 1, 2, 0, 3, 4):  # some twice
        log.append(batch, i)
    want = {("a", 15), (None, 25)}
    assert {tuple(r) for r in log.counts().collect()} == want and len(log.live()) == 2
    # a merge that was cut off is not read
    os.makedirs(f"{tmp_path}/log/counts-3-0-9")
    assert {tuple(r) for r in log.counts().collect()} == want
    assert log.vacuum() > 0 and log.vacuum() == 0 and {tuple(r) for r in log.counts().collect()} == want


@pytest.mark.parametrize("chunk", [4, 65_536])
def test_error_store(spark, monkeypatch, chunk):
    monkeypatch.setattr(error_store, "CHUNK", chunk)
    rnd = random.Random(5)
    log = [(rnd.randrange(2), i, rnd.choices(["add", "remove", "close", "set", "clear"], [12, 3, 2, 1, 1])[0], rnd.choice([None, 1, 2]), rnd.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(log, "store long, seq long, op string, doc_id long, error_id long")
    lives = error_store.lifetimes(df).cache()
    for at in (-1, 0, 57, 150, 299):
        held, set_ = {}, {}
        for store, seq, op, doc, error in log[: at + 1]:
            mine = held.setdefault(store, [])
            set_[store] = op == "set" if op in ("set", "clear") else set_.get(store, False)
            if op == "add":
                mine.append((store, seq, doc, error))
            else:
                held[store] = [e for e in mine if (op == "close" and e[2] != doc) or (op == "remove" and e[3] != error)]
        got = [(r.store, r.seq, r.doc_id, r.error_id) for r in error_store.as_of(lives, at).collect()]
        assert sorted(got, key=str) == sorted((e for mine in held.values() for e in mine), key=str)
        assert {r.store: r.checked for r in error_store.checked(df, at).collect()} == set_
    assert error_store.lifetimes(df.where("false")).count() == 0


def test_places(spark, tmp_path):
    rnd = random.Random(2)
    keys = [rnd.randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    got = ranking.ranked(df, [F.col("k").desc(), F.col("i")], f"{tmp_path}/ranges").collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.place)] == sorted(((k, i) for i, k in enumerate(keys)), key=lambda x: (-x[0], x[1]))
    assert sorted(r.place for r in got) == list(range(1, 501))
    assert ranking.ranked(df.where("false"), [F.col("k")], f"{tmp_path}/none").count() == 0
