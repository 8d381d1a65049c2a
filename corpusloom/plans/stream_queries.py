"""Queries that run streams over the tables' files, each to the end of what there is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import error_store as error_store_ops
from ..operators import spelling
from ..streaming import autocorrect as S
from ..streaming import stateful as state
from ..streaming.count_log import CountLog
from . import sql
from .text_queries import docs_of, read


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both reach it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or f"{tempfile.gettempdir()}/corpusloom/{spark.sparkContext.applicationId}"
    return f"{top.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # as a pattern, which may name a file where a plain path must be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def stream_typed_words(spark, sf_dir):
    """The last word of each turn that ends one."""
    turns = stream_of(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = S.typed_words(turns).select("conv_id", "turn", "typed", "normalized", "start_index", "end_index")
    return S.run_available(out, work_dir(spark, "typed"))


def stream_autocorrect(spark, sf_dir):
    """Turns whose last word no two documents hold, against a table of replacements made of the words themselves."""
    lex = spelling.lexicon_of(docs_of(spark, sf_dir))
    turns = stream_of(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = S.typed_words(read(spark, sf_dir, "conversations"))
    best = words.select(F.col("normalized").alias("query")).distinct().select("query", F.reverse("query").alias("suggestion"), F.lit(1).alias("distance"), (F.char_length("query") / 10.0).alias("score"))
    out = S.autocorrect(turns, lex, best).select("conv_id", "turn", "typed", "replacement")
    return S.run_available(out, work_dir(spark, "autocorrect"))


def debounce_sessions(spark, sf_dir):
    """Bursts of a user's events: sessions that a pause of ten minutes ends; the last event's type is the text.

    In batch, where a watermark closes nothing and no session is left open at the end."""
    batch = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    return S.script_sessions(batch, "user_id", "ts", gap="10 minutes").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "script")


def _requests(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def stream_suppress_repeats(spark, sf_dir):
    """A user's events of the same type as the one before within an hour."""
    out = S.suppress_repeats_stream(_requests(stream_of(spark, sf_dir, "events")), "user_id", "event_type", "ts", 3_600_000)
    return S.run_available(out, work_dir(spark, "repeats"))


def suppress_repeats(spark, sf_dir):
    return S.suppress_repeats(_requests(read(spark, sf_dir, "events")), "user_id", "event_type", "ts", 3_600_000).select("user_id", "event_id", "event_type", "repeated")


def run_into_log(counts: DataFrame, log: CountLog, path: str) -> DataFrame:
    """Runs a stream of counts into a log over what there is now, and reads the sums."""
    writer = counts.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(log.append).start().awaitTermination()
    return log.counts()


def stream_learned_counts(spark, sf_dir):
    """Counts by (event type, first letter of the type), added to a log of counts a batch at a time."""
    events = stream_of(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.substring("event_type", 1, 1).alias("replacement"), F.lit(1).cast("long").alias("cnt"))
    path = work_dir(spark, "counts")
    return run_into_log(events, CountLog(spark, f"{path}/log", ["source", "replacement"]), path)


def stream_flushed_counts(spark, sf_dir):
    """The same, where a user's events are flushed eight at a time: those that wait for their eighth aren't counted yet."""
    events = stream_of(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("source"), F.substring("event_type", 1, 1).alias("replacement"))
    path = work_dir(spark, "flushes")
    return run_into_log(state.flushed_counts(events, "user_id", "ts"), CountLog(spark, f"{path}/log", ["source", "replacement"]), path)


def stream_cached_lookups(spark, sf_dir):
    """Users look up their events' properties, in caches that hold twelve of them for five days."""
    events = stream_of(spark, sf_dir, "events").select("user_id", "event_id", "props", F.col("ts").cast("timestamp").alias("ts"))
    return S.run_available(state.cached_lookups(events, "user_id", "props", "ts", CACHED_MS, CACHED), work_dir(spark, "cache"))


def stream_deferred(spark, sf_dir):
    """A user's last event before four hours without any; the last of all only where the watermark has passed it by that much."""
    events = _requests(stream_of(spark, sf_dir, "events"))
    return S.run_available(state.deferred(events, "user_id", "event_type", "ts", IDLE_MS), work_dir(spark, "deferred"))


def store_log(events: DataFrame) -> DataFrame:
    """Users' events as a log of their error stores."""
    k = F.get_json_object("props", "$.k").cast("long")
    op = F.when(F.col("event_type").isin("error", "view"), "add").when(F.col("event_type") == "click", "remove").when(F.col("event_type") == "purchase", "close").when(F.col("value") > 40, "set").otherwise("clear")
    return events.select(F.col("user_id").alias("store"), F.col("event_id").alias("seq"), op.alias("op"), (k % 5).alias("doc_id"), (k % 20).alias("error_id"))


def error_store(spark, sf_dir):
    """How long each error of the users' stores lives."""
    return error_store_ops.lifetimes(store_log(read(spark, sf_dir, "events")))


def error_store_as_of(spark, sf_dir):
    """The users' stores after half of all events."""
    events = read(spark, sf_dir, "events")
    half = events.agg(F.floor(F.max("event_id") / 2)).scalar()
    return error_store_ops.as_of(error_store_ops.lifetimes(store_log(events)), half).groupBy("store", "doc_id").agg(F.count(F.lit(1)).alias("errors"))


CACHED_MS, CACHED, IDLE_MS = 5 * 86_400_000, 12, 4 * 3_600_000
QUERIES = {f.__name__: f for f in (
    stream_typed_words, stream_autocorrect, debounce_sessions, stream_suppress_repeats, suppress_repeats, stream_learned_counts, stream_flushed_counts,
    stream_cached_lookups, stream_deferred, error_store, error_store_as_of,
)}

LOG = """log AS (SELECT user_id AS store, event_id AS seq, CASE WHEN event_type IN ('error', 'view') THEN 'add' WHEN event_type = 'click' THEN 'remove' WHEN event_type = 'purchase' THEN 'close'
  WHEN value > 40 THEN 'set' ELSE 'clear' END AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS doc_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS error_id FROM events)"""
TYPED = r"""ty AS (SELECT conv_id, turn, regexp_extract(right(text, 128), '([\p{L}''ʻʼ‘’]+)[^\p{L}''ʻʼ‘’]*$', 1) AS typed, length(regexp_replace(text, '[^\p{L}''ʻʼ‘’]+$', '')) AS end_index
  FROM conversations WHERE regexp_matches(text, '[^\p{L}''ʻʼ‘’]$')), tw AS (SELECT conv_id, turn, typed, lower(typed) AS normalized, end_index - length(typed) AS start_index, end_index FROM ty WHERE length(typed) > 1)"""
REPEATS = """SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER w = event_type AND epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w <= 3600000, false) AS repeated
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
ORACLE_SQL = {
    "stream_typed_words": f"WITH {TYPED} SELECT * FROM tw",
    "stream_autocorrect": f"WITH {sql.tokens()}, {sql.lexicon(2)}, {TYPED} SELECT conv_id, turn, typed, CASE WHEN typed = upper(typed) THEN upper(reverse(normalized)) WHEN typed[1] <> lower(typed[1]) THEN upper(reverse(normalized)[1]) || reverse(normalized)[2:] ELSE reverse(normalized) END AS replacement FROM tw WHERE normalized NOT IN (SELECT word FROM lex) AND length(normalized) / 10.0 >= 0.52",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, event_type, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 600000000 AS end_us, count(*) AS events, 'Latin' AS script FROM n GROUP BY user_id, k""",
    "stream_suppress_repeats": REPEATS,
    "suppress_repeats": REPEATS,
    "stream_learned_counts": "SELECT event_type AS source, event_type[1] AS replacement, count(*) AS cnt FROM events GROUP BY 1, 2",
    "stream_flushed_counts": """WITH n AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT event_type AS source, event_type[1] AS replacement, count(*) AS cnt FROM n WHERE i <= c - c % 8 GROUP BY 1, 2""",
    "stream_cached_lookups": f"""WITH RECURSIVE n AS (SELECT user_id, event_id, props, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS event_id, ''::VARCHAR AS props, false AS hit, 0::BIGINT AS i, []::STRUCT(e VARCHAR, ms BIGINT)[] AS held FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, event_id, props, hit, i, CASE WHEN hit THEN held ELSE list_append(list_filter(held, lambda x: x.e <> props), {{'e': props, 'ms': ms}})[-{CACHED}:] END
FROM (SELECT n.*, r.held, len(list_filter(r.held, lambda x: x.e = n.props AND n.ms - x.ms <= {CACHED_MS})) > 0 AS hit FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
SELECT user_id, event_id, props, hit FROM r WHERE i > 0""",
    "stream_deferred": f"""WITH n AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS nx FROM events)
SELECT user_id, event_id, event_type FROM n WHERE nx - ms >= {IDLE_MS} OR (nx IS NULL AND ms + {IDLE_MS} < (SELECT max(ms) FROM n) - 10000)""",
    "error_store": f"""WITH {LOG} SELECT store, seq, doc_id, error_id, (SELECT min(b.seq) FROM log b WHERE b.store = a.store AND b.seq > a.seq
  AND (b.op IN ('set', 'clear') OR (b.op = 'close' AND b.doc_id = a.doc_id) OR (b.op = 'remove' AND b.error_id = a.error_id))) AS until FROM log a WHERE op = 'add'""",
    "error_store_as_of": f"""WITH {LOG}, past AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)) SELECT store, doc_id, count(*) AS errors FROM past a WHERE op = 'add' AND NOT EXISTS (
  SELECT 1 FROM past b WHERE b.store = a.store AND b.seq > a.seq AND (b.op IN ('set', 'clear') OR (b.op = 'close' AND b.doc_id = a.doc_id) OR (b.op = 'remove' AND b.error_id = a.error_id))) GROUP BY 1, 2""",
}
