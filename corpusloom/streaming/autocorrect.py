"""Streams of typing events: auto-correction, debounced script detection, suppression of repeats.

Event time is a column; state is bounded by watermarks or by what is kept per key. Every function takes a batch or a
streaming DataFrame, but for those that keep state of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import suggest

DEBOUNCE, DUPLICATE_MS, LOOK = "300 milliseconds", 1200, 2000


def typed_words(events: DataFrame, text: str = "text") -> DataFrame:
    """Events that end a word, with that word (``typed``), its place and its normalised form; words not checked are dropped."""
    t = F.coalesce(text, F.lit(""))
    done = events.where(T.at_boundary(t)).withColumn("typed", T.previous_word(t)).where("typed <> ''")
    end = F.char_length(F.regexp_replace(t, f"[^{T.WORD_CLASS}]+$", ""))
    done = done.withColumns({"end_index": end, "start_index": end - F.char_length("typed"), "normalized": T.normalize_word(F.col("typed"))})
    return done.where((F.char_length("normalized") > 1) & ~T.skip_word(F.col("normalized")))


def autocorrect(events: DataFrame, lexicon: DataFrame, best: DataFrame) -> DataFrame:
    """Typed words that aren't in the lexicon, with the replacement that is certain enough.

    ``best`` (``query``, ``suggestion``, ``distance``, ``score``) holds the best suggestion of words that are known to be
    misspelled; both joins are of the stream with a table.
    """
    words = typed_words(events).join(lexicon.select(F.col("word").alias("_w")), F.col("normalized") == F.col("_w"), "left_anti")
    sure = best.where(suggest.live_threshold(F.col("distance"), F.col("score"))).select(F.col("query").alias("_q"), "suggestion", "distance")
    return words.join(sure, F.col("normalized") == F.col("_q")).drop("_q").withColumn("replacement", T.keep_first_case(F.col("typed"), F.col("suggestion"))).drop("suggestion")


def once_per_place(words: DataFrame, keys: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """One event for each word at its place, however often it is reported; state is dropped by the watermark."""
    return words.withWatermark(time, within).dropDuplicatesWithinWatermark([*keys, "start_index", "end_index", "typed"])


def script_sessions(events: DataFrame, key: str, time: str, text: str = "text", gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """The script of the first characters of the last text of each burst of events: one that a pause of ``gap`` ends."""
    last = F.max_by(F.substring(F.coalesce(text, F.lit("")), 1, LOOK), time)
    by = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session")).agg(last.alias("text"), F.count(F.lit(1)).alias("events"))
    return by.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events", T.detect_script(F.col("text")).alias("script"))


def suppress_repeats(requests: DataFrame, key: str, word: str, time: str, within_ms: int = DUPLICATE_MS) -> DataFrame:
    """Batch: requests with ``repeated``: the same word as the key's request before, within the time."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(time, "event_id")
    gap = F.unix_millis(F.col(time).cast("timestamp")) - F.unix_millis(F.lag(time).over(order).cast("timestamp"))
    same = (F.lag(F.lower(word)).over(order) == F.lower(word)) & (gap <= within_ms)
    return requests.withColumn("repeated", F.coalesce(same, F.lit(False)))


def suppress_repeats_stream(requests: DataFrame, key: str, word: str, time: str, within_ms: int = DUPLICATE_MS, late: str = "10 seconds") -> DataFrame:
    """Streaming: as ``suppress_repeats``; a key's state is its last request, and goes once the watermark has passed it."""
    key_type = requests.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_word, last_ms = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([time, "event_id"])
        out = []
        for event, w, t in rows[["event_id", word, time]].itertuples(index=False):
            low, ms = (w or "").lower(), int(pd.Timestamp(t).value // 1_000_000)
            out.append((k[0], event, w, last_word == low and ms - last_ms <= within_ms))
            last_word, last_ms = low, ms
        state.update((last_word, last_ms))
        if last_ms + within_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last_ms + within_ms)
        yield pd.DataFrame(out, columns=[key, "event_id", word, "repeated"])

    grouped = requests.select(key, "event_id", word, time).withWatermark(time, late).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {key_type}, event_id long, {word} string, repeated boolean", "w string, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into Parquet under ``path``, and reads the result."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")

