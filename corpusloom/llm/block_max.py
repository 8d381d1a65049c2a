"""Exact top-k inner products by block-at-a-time pruning.

A vector's components are its terms, each twice: as they are, for queries that weigh them positively, and negated, for the
others. A block of vectors keeps the maximum of each term; the sum of a query's weights times these bounds every score
in the block. For each query the blocks are ordered by these sums, and scored through their forward indexes until the
sums fall below the k-th best score (``vectors.search``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import read

TOP, EVERY = 5, 50
#: Sums are rounded; by so much of their size they count as larger.
SLACK = 1e-9


def term_maxima(queries: np.ndarray, s: vectors.Summary) -> tuple[np.ndarray, np.ndarray]:
    """Sums of term maxima, and of term minima."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    room = 1 + SLACK * (np.abs(queries) @ np.maximum(np.abs(s.low), np.abs(s.high)).T)
    return plus @ s.high.T + minus @ s.low.T + room, plus @ s.low.T + minus @ s.high.T - room


def top_k(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query with all other rows.

    ``embeddings`` has ``vec_id`` and ``embedding``; components become floor(256 * x). Queries are the rows whose vec_id ``every``
    divides. Equal scores go to smaller ids. Rows that share a vec_id are rows of their own: queries each, and found by each other.
    Vectors that are null or hold null or non-finite numbers take no part, nor do rows without vec_id. A vector that is shorter
    than others counts as filled up with zeros, an empty one too. Scores that a long can't hold are its largest or
    smallest. Fewer than ``k`` other rows: all. Other columns are left out. Empty table: empty result.
    """
    index = vectors.build(embeddings.select("vec_id", F.lit(None).cast("int").alias("label"), "embedding"))
    needs = vectors.needs_of(index, every)
    found = vectors.search(index, needs, term_maxima, k)
    asked = needs.select("need", F.col("vec_id").alias("query_id"))
    return found.join(asked, "need").select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
