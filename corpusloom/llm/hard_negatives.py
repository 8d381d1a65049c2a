"""Hard negatives by one-dimensional distance keys.

Vectors are made equally long by one more dimension, in which a query has zero, so that a larger inner product is a smaller
distance. They are stored sorted by (pivot, distance from it). By the triangle inequality, what lies in an interval of keys is at
least as far from a query as the query's own distance from the pivot is from the interval; so intervals are scanned outwards
from the query's own key, at all pivots at once, nearest annulus first, until what remains can't reach the k-th best
(``vectors.search``). Positives are the nearest rows of the anchor's label, negatives the nearest of other labels whose scores lie in a
band below the positive's, which also gives the scan its inner radius and its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import materialize, read

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: Of a positive's score, in percent: what negatives have at least and at most.
FROM, TO = 50, 95
#: Distances are rounded; by so much of their size scores count as nearer.
SLACK = 1e-9


def annuli(index: vectors.Index) -> vectors.Bound:
    """Bounds by the intervals of distances from pivots."""
    reach, pivots = index.reach, index.pivots

    def bound(queries: np.ndarray, s: vectors.Summary) -> tuple[np.ndarray, np.ndarray]:
        long = (queries * queries).sum(axis=1, keepdims=True)
        own = np.sqrt(np.maximum(0, long + reach - 2 * queries @ pivots.T))[:, s.pivot]
        gap = np.maximum(0, np.maximum(s.near - own, own - s.far))
        room = 1 + SLACK * (long + reach + (own + s.far) ** 2)
        return (long + reach - gap * gap) / 2 + room, (long + reach - (own + s.far) ** 2) / 2 - room

    return bound


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``embeddings`` has ``vec_id``, ``label`` and ``embedding``; components become floor(256 * x) and a score is their inner product.
    Anchors are the rows whose vec_id ``every`` divides; an anchor's positives are its first ``positives`` other rows of the same
    label, and for each the first ``negatives`` rows of other labels are given that have FROM to TO percent of its score. Higher scores
    come first, equal ones by smaller id. A negative score of a positive has no negatives. Rows that share a vec_id are
    rows of their own. Rows without vec_id or label and vectors that are null or hold null or non-finite numbers take no part;
    shorter vectors count as filled up with zeros. Other columns are left out. Empty table: empty result.
    """
    index = vectors.build(embeddings.where("label is not null").select("vec_id", "label", "embedding"))
    bound, anchors = annuli(index), vectors.needs_of(index, every)
    near = materialize(vectors.search(index, anchors, bound, positives, same=True), "hard_positives")
    own = anchors.select(F.col("need").alias("anchor"), "row", "slab", "label", "v", F.col("vec_id").alias("anchor_id"))
    asks = near.where("score >= 0").select(F.col("need").alias("anchor"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(own, "anchor")
    wide = F.col("positive_score").cast("decimal(38,0)")
    asks = asks.withColumns({
        "need": F.col("anchor") * positives + F.col("place") - 1,
        "least": F.ceil(wide * FROM / 100).cast("long"),
        "most": F.floor(wide * TO / 100).cast("long"),
    })
    asks = materialize(asks, "hard_asks")
    found = vectors.search(index, asks, bound, negatives, same=False).select("need", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(asks.select("need", "anchor_id", "positive_id", "positive_score"), "need").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one first, as noise."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
