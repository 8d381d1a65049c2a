"""State by key over streams, in the events' time: a bounded cache with a time to live, deferred requests, counted flushes.

Spark's own time to live of state runs by the machine's clock; here the events' time decides, so that a stream run again
gives the same rows. A key's rows of one micro-batch are put in order of time and event id in one task; bound the batches
at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) where a key may be large. Rows of a later batch count as later.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPELLING_TTL_MS, GRAMMAR_TTL_MS = 8 * 60_000, 2 * 60_000
SPELLING_ENTRIES, GRAMMAR_ENTRIES = 256, 128
FLUSH_EVERY = 8
LATE = "10 seconds"

#: (rows in order, or None when time is up; what was kept) -> (rows out, what to keep or None, when time is up in ms)
Step = Callable[[list[tuple] | None, object], tuple[list[tuple], object, int | None]]


def by_key(requests: DataFrame, key: str, columns: list[str], time: str, fields: str, step: Step, late: str | None = LATE) -> DataFrame:
    """Each key's rows through ``step``: tuples of ``event_id``, ``columns`` and milliseconds, rows without a time left out.

    Gives the key and ``fields``. What is kept is any JSON value. Without ``late`` nothing times out.
    """
    key_type, names = requests.schema[key].dataType.simpleString(), [f.split()[0] for f in fields.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            rows = None
        else:
            frame = pd.concat(list(batches)).sort_values(["_ms", "event_id"])
            rows = list(frame[["event_id", *columns, "_ms"]].itertuples(index=False, name=None))
        out, kept, until = step(rows, kept)
        if kept is not None and until is not None and until <= state.getCurrentWatermarkMs():
            more, kept, until = step(None, kept)
            out = out + more
        if kept is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(kept),))
            if until is not None:
                state.setTimeoutTimestamp(until)
        if out:
            yield pd.DataFrame([(*k, *row) for row in out], columns=[key, *names])

    rows = requests.where(F.col(time).isNotNull()).withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))
    if late:
        rows = rows.withWatermark(time, late)
    waits = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    chosen = rows.select(*dict.fromkeys([key, "event_id", *columns, time, "_ms"]))
    return chosen.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, {fields}", "kept string", "append", waits)


def cached_lookups(requests: DataFrame, session: str, entry: str, time: str, ttl_ms: int = SPELLING_TTL_MS, entries: int = SPELLING_ENTRIES, late: str = LATE) -> DataFrame:
    """``(session, event_id, entry, hit)``: whether a session's cache holds what is looked up.

    What isn't held, or has been for longer than ``ttl_ms``, is computed and cached as of then; a hit doesn't make it younger.
    Beyond ``entries`` the oldest goes. Blank entries are never cached. State holds at most ``entries`` entries a session,
    and goes once the watermark has passed the last one's time.
    """

    def step(rows, kept):
        held = dict(kept or [])
        out = []
        for event, word, ms in rows or []:
            hit = bool(word) and word in held and ms - held[word] <= ttl_ms
            if word and not hit:
                held.pop(word, None)
                held[word] = ms
                if len(held) > entries:
                    del held[next(iter(held))]
            out.append((event, word, hit))
        if rows is None or not held:
            return out, None, None
        return out, list(held.items()), max(held.values()) + ttl_ms + 1

    return by_key(requests, session, [entry], time, f"event_id long, {entry} string, hit boolean", step, late)


def deferred(requests: DataFrame, key: str, payload: str, time: str, idle_ms: int, late: str = LATE) -> DataFrame:
    """``(key, event_id, payload)``: requests that are applied. One waits at a time: the next one takes its place, unless
    the key has been idle for ``idle_ms`` by then; each is applied once, or never."""

    def step(rows, waiting):
        if rows is None:
            return [tuple(waiting[:2])], None, None
        out = []
        for row in rows:
            if waiting and row[2] - waiting[2] >= idle_ms:
                out.append(tuple(waiting[:2]))
            waiting = list(row)
        return out, waiting, waiting[2] + idle_ms

    return by_key(requests, key, [payload], time, f"event_id long, {payload} string", step, late)


def flushed_counts(corrections: DataFrame, key: str, time: str, every: int = FLUSH_EVERY) -> DataFrame:
    """``(key, flush, source, replacement, cnt)``: additive counts of each full group of a key's ``every`` corrections.

    State holds the corrections, fewer than ``every``, that wait for their group, so that a restart loses none.
    """

    def step(rows, kept):
        flush, waiting = kept or (0, [])
        out = []
        for _, source, replacement, _ in rows:
            waiting.append((source, replacement))
            if len(waiting) == every:
                counts = Counter(map(tuple, waiting))
                out += [(flush, s, r, n) for (s, r), n in sorted(counts.items(), key=lambda x: (x[0][0] or "", x[0][1] or ""))]
                flush, waiting = flush + 1, []
        return out, [flush, waiting], None

    fields = "flush long, source string, replacement string, cnt long"
    return by_key(corrections, key, ["source", "replacement"], time, fields, step, None)
