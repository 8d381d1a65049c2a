"""A store of errors as a log: errors are added and removed, documents closed, the store set anew or cleared.

``log`` has ``store``, ``seq`` (its order within a store), ``op`` (add, remove, close, set, clear), ``doc_id`` and
``error_id``. From it comes how long each added error lives; the state as of any event is a filter on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of a store that one window orders.
CHUNK = 65_536


def next_event(log: DataFrame, by: list[str], ends: Column, name: str) -> DataFrame:
    """``log`` with the next later ``seq`` of the same ``by`` at which ``ends`` holds, null where there is none.

    Windows run within chunks of a store's log, then over one row a chunk, so that no task orders a store of any size.
    """
    rows = log.withColumns({"_c": F.floor(F.col("seq") / CHUNK), "_e": F.when(ends, F.col("seq"))})
    # from the last row backwards, so that the frame grows by a row at a time
    later = Window.partitionBy(*by, "_c").orderBy(F.col("seq").desc()).rangeBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*by, "_c").agg(F.min("_e").alias("_first"))
    after = Window.partitionBy(*by).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = chunks.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(by)), F.col("_c").alias("_bc"), F.min("_first").over(after).alias("_beyond"))
    same = F.col("_c") == F.col("_bc")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    found = rows.withColumn("_within", F.min("_e").over(later)).join(beyond, same, "left")
    return found.withColumn(name, F.coalesce("_within", "_beyond")).select(*log.columns, name)


def lifetimes(log: DataFrame) -> DataFrame:
    """Added errors with ``until``: the event that ends them, null while they live.

    Such is the next set or clear of the store, close of their document, or remove of the error, whichever comes first.
    """
    op = F.col("op")
    out = next_event(log, ["store"], op.isin("set", "clear"), "_reset")
    out = next_event(out, ["store", "doc_id"], op == "close", "_close")
    out = next_event(out, ["store", "error_id"], op == "remove", "_remove").where(op == "add")
    return out.withColumn("until", F.least("_reset", "_close", "_remove")).drop("op", "_reset", "_close", "_remove")


def as_of(lives: DataFrame, seq: int | Column) -> DataFrame:
    """The errors in store right after event ``seq``."""
    return lives.where((F.col("seq") <= seq) & (F.col("until").isNull() | (F.col("until") > seq)))


def checked(log: DataFrame, seq: int) -> DataFrame:
    """``(store, checked)`` right after event ``seq``: whether errors were set since the store was last cleared."""
    return log.where(F.col("seq") <= seq).groupBy("store").agg(F.coalesce(F.max_by("op", F.when(F.col("op").isin("set", "clear"), F.col("seq"))) == "set", F.lit(False)).alias("checked"))
