"""Helpers that the training-data operators share."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and what is stripped from lines: space and TAB to CR.
SPACES = " \t\n\x0b\x0c\r"
#: A word, for regular expressions of Java.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that are Python strings at once.
TEXTS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, with no executors elsewhere, may go without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{tempfile.gettempdir()}/corpusloom/{spark.sparkContext.applicationId}"


def filesystem(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if not urlparse(path).scheme else fs.FileSystem.from_uri(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with its columns but ``own`` under names that no operator uses; ``toDF(*docs.columns)`` gives theirs back."""
    return docs.toDF(*(c if c in own else f"_c{i}" for i, c in enumerate(docs.columns)))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() has a fast path for plain ASCII; other text takes translate()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def unit_interval(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(docs: DataFrame, make: Callable[[list[str | None]], dict[str, Any]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` as they are, beside what ``make`` says of each batch's texts: columns of ``schema``, in its order.

    Arrow batches, so that null and large ids survive; ``make`` is given plain strings and None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            made = make(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, made.values())], names=[*keep, *made])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, {schema}")
