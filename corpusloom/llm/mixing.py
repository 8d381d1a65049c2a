"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash into *blocks* of about DOCS_PER_BLOCK, whose order within the
source is permuted by an affine map. A source's target in words becomes an exact quota of blocks (whole
passes over the source, then blocks from the front, then part of one block). The tree splits the vector of
quotas among the output shards: each node's left half draws as many blocks as its shards hold, one exact
hypergeometric draw a source, given the draws before. Shards then own disjoint ranges of each source's
permuted blocks and order their documents by a local hash. The number of shards grows with the input.

Only word counts move; texts are read once. Running sums go over blocks of blocks, so that the hottest
source is summed by many tasks; the tables of one row a source are what a single task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read, shielded, unit_interval

DOCS_PER_BLOCK, SUPER = 256, 1024
#: Shards are as many as give each about so many blocks, but at least the first number.
SHARDS, BLOCKS_PER_SHARD = 16, 256
MAX_REPEATS, SEED = 3, 20
#: A prime above any number of blocks, so that it has no factor in common with it.
PRIME = 2147483647


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``; size is the number of words (null: 0)."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(meta: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = MAX_REPEATS) -> DataFrame:
    """``(source, rank, n_docs, words, weight, target)``.

    Sources by code point (null last) weigh ``weights``, repeating. They share all words by weight, none above
    ``limit`` times its own; what is above goes to the others by weight. In order of limit per weight the
    sources at their limit come first, so the share per weight of the others is known at each of them.
    """
    own = meta.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("words"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)).cast("double"))
    cap = (F.col("words") * limit).cast("double")
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("words").over(Window.partitionBy())
    share = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = own.withColumns({"_at": F.row_number().over(order), "_share": share, "_cap": cap})
    free = F.when(F.col("_cap") >= F.col("_share") * F.col("weight"), F.col("_at"))
    level = F.min(F.when(free.isNotNull(), F.struct(free, "_share"))).over(Window.partitionBy())
    target = F.least("_cap", F.coalesce(level["_share"], F.lit(float("inf"))) * F.col("weight"))
    return own.withColumn("target", target).drop("_at", "_share", "_cap")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def hypergeometric(pool: Column, good: Column, draws: Column, u: Column) -> Column:
    """An exact draw by inversion of ``u``: outcomes outward from the mode, their odds by recurrence.

    Outcomes beyond 12 standard deviations are less likely than doubles resolve.
    """
    n, k, m = (x.cast("double") for x in (pool, good, draws))
    low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(k, m)
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(F.greatest(F.lit(0.0), m * k / n * (1 - k / n) * (n - m) / F.greatest(F.lit(1.0), n - 1)))

    def steps(at: Column, width: Column, up: bool, state: Column) -> Column:
        """Folds over the outcomes on one side; state: odds, what is left of ``u``, the outcome, the sum of odds."""
        count = F.least((high - at) if up else (at - low), width).cast("int")

        def step(s: Column, i: Column) -> Column:
            x = at + (i if up else -i)
            odds = s["odds"] * ((k - x + 1) * (m - x + 1) / (x * (n - k - m + x)) if up else (x + 1) * (n - k - m + x + 1) / ((k - x) * (m - x)))
            left = s["left"] - odds
            found = F.when((s["left"] >= 0) & (left < 0), x).otherwise(s["found"])
            return F.struct(odds.alias("odds"), left.alias("left"), found.alias("found"), (s["sum"] + odds).alias("sum"))

        return F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), state, step)

    def start(left: Column, found: Column, total: Column) -> Column:
        return F.struct(F.lit(1.0).alias("odds"), left.cast("double").alias("left"), found.cast("double").alias("found"), total.cast("double").alias("sum"))

    def drawn(at: Column, width: Column) -> Column:
        none = F.lit(-1.0)
        total = 1 + steps(at, width, True, start(none, at, F.lit(0.0)))["sum"] + steps(at, width, False, start(none, at, F.lit(0.0)))["sum"]

        def search(t: Column) -> Column:
            above = steps(at, width, True, start(t - 1, at, F.lit(0.0)))
            return let(above, lambda a: F.when((t < 1) | (a["left"] < 0), a["found"]).otherwise(steps(at, width, False, start(a["left"], at, F.lit(0.0)))["found"]))

        return let(total * u, search)

    inside = let(mode, lambda at: let(F.ceil(12 * spread) + 20, lambda width: drawn(at, width.cast("double"))))
    return F.when((low >= high) | (n <= 0), low).otherwise(inside).cast("long")


def split(quotas: Column, draws: Column, key: Column, seed: int) -> Column:
    """What ``draws`` blocks drawn from all of a node's blocks hold of each source: a draw a source, given those before."""
    pool = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def step(s: Column, q: Column) -> Column:
        u = unit_interval(F.lit(seed), key, F.size(s["out"]))
        return let(hypergeometric(s["pool"], q, s["draws"], u), lambda x: F.struct((s["pool"] - q).alias("pool"), (s["draws"] - x).alias("draws"), F.array_append(s["out"], x).alias("out")))

    empty = F.array().cast("array<long>")
    return F.aggregate(quotas, F.struct(pool.alias("pool"), draws.alias("draws"), empty.alias("out")), step)["out"]


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(shard, quotas)``: the one row of ``quotas`` (an array, in blocks) dealt to ``shards`` shards of equal numbers of blocks.

    A level's nodes are a table of their own, as both children use what their node's left half drew.
    """
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas", total.alias("total"))
    upto = lambda shard: F.floor(shard * F.col("total") / shards)  # noqa: E731  blocks of all shards below
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = split(F.col("quotas"), upto(mid) - upto(F.col("lo")), F.col("lo").cast("long") * (shards + 1) + F.col("hi"), seed)
        nodes = nodes.withColumns({"mid": mid, "left": F.when(F.col("hi") - F.col("lo") > 1, left)})
        nodes = materialize(nodes, "mix_node")
        halves = F.array(F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("quotas")), F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        same = F.array(F.struct("lo", "hi", "quotas"))
        nodes = nodes.select("total", F.explode(F.when(F.col("left").isNull(), same).otherwise(halves)).alias("x")).select("x.*", "total")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def homes(tree: DataFrame, by: DataFrame) -> DataFrame:
    """``(rank, at, homes)``: for each block of a source that the mix takes, the shard of each time it does.

    The shards own a source's draws in order: draw ``e * blocks + at`` is block ``at``'s in pass ``e``.
    """
    each = tree.select("shard", F.posexplode("quotas").alias("rank", "q"))
    end = F.sum("q").over(Window.partitionBy("rank").orderBy("shard"))
    each = each.withColumn("end", end).where("q > 0").select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("q"), F.col("end") - 1)).alias("draw"))
    each = each.join(by.select("rank", "blocks"), "rank").withColumns({"at": F.col("draw") % F.col("blocks"), "pass": F.floor(F.col("draw") / F.col("blocks"))})
    return each.groupBy("rank", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("homes"))


def plan(meta: DataFrame, shards: int | None = None, seed: int = SEED, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """``meta`` (``doc_id``, ``source``, ``size``) with its source's figures, ``copies`` (how often the mix takes it), ``shards`` (where each copy goes) and ``orders`` (its place's key there)."""
    by = materialize(targets(meta), "mix_targets").withColumn("blocks", F.ceil(F.col("n_docs") / docs_per_block))
    meta = meta.withColumnsRenamed({"source": "_source"})
    whole = F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.col("words")))
    by = by.withColumn("passes", F.when(F.col("words") > 0, whole).otherwise(F.lit(0)).cast("long"))
    by = by.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("words")))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), "source"), F.col("blocks"))
    placed = meta.join(by, F.col("_source").eqNullSafe(F.col("source"))).drop("_source").withColumn("at", F.pmod(block * F.lit(PRIME) + shift, F.col("blocks")))

    # running sums of words over the permuted blocks, by blocks of blocks; sources at their limit need none
    sums = placed.where(F.col("passes") < MAX_REPEATS).groupBy("rank", "rest", F.floor(F.col("at") / SUPER).alias("sup"), "at").agg(F.sum("size").alias("size"))
    tops = sums.groupBy("rank", "sup").agg(F.sum("size").alias("top"))
    upto = F.coalesce(F.sum("top").over(Window.partitionBy("rank").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("rank", "sup", upto.alias("upto"))
    within = F.sum("size").over(Window.partitionBy("rank", "sup").orderBy("at"))
    sums = sums.withColumn("within", within).join(tops, ["rank", "sup"])
    full = (F.col("upto") + F.col("within")) <= F.col("rest") + 1e-6
    fronts = sums.groupBy("rank").agg(F.coalesce(F.min(F.when(~full, F.col("at"))), F.max("at") + 1).alias("front"),
                                      F.max(F.when(full, F.col("upto") + F.col("within")).otherwise(F.lit(0))).alias("front_words"))
    fronts = materialize(fronts, "mix_fronts")

    # quotas in blocks, dealt to shards
    front = F.coalesce("front", F.lit(0))
    quota = F.col("passes") * F.col("blocks") + front + F.when((front < F.col("blocks")) & (F.col("passes") < MAX_REPEATS), 1).otherwise(0)
    quotas = by.join(fronts, "rank", "left").select("rank", quota.cast("long").alias("q"))
    if shards is None:
        shards = max(SHARDS, (quotas.agg(F.sum("q")).first()[0] or 0) // BLOCKS_PER_SHARD)
    row = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("quotas"))
    own = materialize(homes(splitting_tree(row, shards, seed), by), "mix_homes")

    # of the block at the front, the largest documents that still fit
    placed = placed.join(fronts, "rank", "left").join(own, ["rank", "at"], "left")
    edge = placed.where(F.col("at") == F.col("front")).groupBy("rank", "doc_id", "size", "rest", "front_words").agg(F.count(F.lit(1)).alias("n"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("size") * F.col("n")).alias("less"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id", "size")))
    none = F.array().cast(edge.select("doc_id", "size").schema.simpleString().join(("array<", ">")))

    def fit(s: Column, x: Column) -> Column:
        fits = s["room"] + x["less"] >= -1e-6
        return F.struct(F.when(fits, s["room"] + x["less"]).otherwise(s["room"]).alias("room"), F.when(fits, F.array_append(s["taken"], F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size")))).otherwise(s["taken"]).alias("taken"))

    picked = edge.groupBy("rank", "rest", "front_words").agg(best.alias("best"))
    picked = picked.select("rank", F.aggregate("best", F.struct((F.col("rest") - F.col("front_words")).alias("room"), none.alias("taken")), fit)["taken"].alias("taken"))
    picked = materialize(picked.select(F.col("rank").alias("_rank"), F.explode("taken").alias("x")).select("_rank", F.col("x.doc_id").alias("_doc"), F.col("x.size").alias("_size")), "mix_edge")
    same = (F.col("rank") == F.col("_rank")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size"))
    placed = placed.join(picked, same, "left")
    more = F.when((F.col("at") < F.col("front")) | F.col("_rank").isNotNull(), 1).otherwise(0)
    placed = placed.withColumn("copies", (F.col("passes") + more).cast("long"))
    each = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    orders = F.transform(each, lambda e: F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "size", e))
    taken = F.when(F.col("copies") > 0, F.slice("homes", F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return placed.withColumns({"shards": taken, "orders": orders})


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per copy that the mix takes, with ``docs``' columns, ``shard`` and ``shard_order``.

    A shard's rows in order of ``shard_order`` are its local shuffle. Null text has no words; null source is a source,
    the last. A document of no words weighs nothing and is taken as often as its source is gone through. Rows that share
    doc_id, source and size are taken alike. Ties are broken by hash of doc_id, so reruns agree. Columns of any name pass
    through; ``shard`` and ``shard_order`` replace columns of the same names. Empty table: empty result.
    """
    docs = docs.drop("shard", "shard_order")
    plain = shielded(docs, "doc_id", "text", "source")
    drawn = plan(materialize(sizes(plain), "mix_sizes"), shards, seed)
    drawn = drawn.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.explode(F.arrays_zip("shards", "orders")).alias("_x"))
    drawn = drawn.select("_doc", "_source", "_size", "_x.shards", "_x.orders").distinct()
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    return plain.join(drawn, same).select(*plain.columns, "shards", "orders").toDF(*docs.columns, "shard", "shard_order")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = materialize(sizes(read(spark, sf_dir, "documents")), "mix_sizes")
    where = F.array_join(F.transform(F.arrays_zip("shards", "orders"), lambda x: F.concat_ws(":", x["shards"], x["orders"])), ",")
    return plan(meta).select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), where.alias("shard_orders"))
