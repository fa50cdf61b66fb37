"""Candidate pairs by equi-joins on blocking keys.

Keys are a long table (entity, key), never a dictionary on the driver. Keys that are frequent on the target side are
pruned before the join, so a key's fan-out is bounded there; a key that is hot on the query side too is split by
the adaptive skew join. Pairs are narrow (two ids and a count) until they are ranked.

Many keys make many times more meetings than entities. A numbered index carries, with each key of an entity, the numbers
of all its keys, so that a pair is told once, at its first shared key, and its shared keys are counted there: no meeting
is shuffled, only keys are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.plans.store import written


def long_keys(entities: DataFrame, keys, *keep: str) -> DataFrame:
    return entities.select("entity_id", *keep, F.explode(keys).alias("key"))


def pruned(index: DataFrame, cap: int, caps: dict[str, int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The index without keys that more than cap target entities have, by group; caps has other caps by the key's tag."""
    limit = F.lit(cap)
    for tag, other in (caps or {}).items():
        limit = F.when(F.col("key").startswith(tag), other).otherwise(limit)
    rare = index.groupBy(*by, "key").agg(F.count("*").alias("df")).filter(F.col("df") <= limit)
    return index.join(rare.select(*by, "key"), [*by, "key"], "left_semi")


def block(queries: DataFrame, index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, cand_id, n_keys: pairs that share a key, with the number of shared keys."""
    left = queries.select(*by, "key", F.col("entity_id").alias("s1_id"))
    right = index.select(*by, "key", F.col("entity_id").alias("cand_id"))
    return left.join(right, [*by, "key"]).groupBy("s1_id", "cand_id").agg(F.count("*").alias("n_keys"))


def _own(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of an entity and a key's number, with kids, all numbers of the entity in order, and plain, whether none of them repeats."""
    each = rows.groupBy("entity_id").agg(F.collect_list(F.struct(*keep, "kid")).alias("own"))
    each = each.withColumn("kids", F.array_sort(F.col("own.kid"))).withColumn("plain", F.size(F.array_distinct("kids")) == F.size("kids"))
    return each.select("entity_id", "kids", "plain", F.explode(F.array_distinct("own")).alias("k")).select("entity_id", "kids", "plain", "k.*")


def numbered(index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The index with a number for each key (kid), for block_numbered. Index and numbers are written on the way, so that keys are made once."""
    index = written(index, "index")
    numbers = written(index.select(*by, "key").distinct().withColumn("kid", F.monotonically_increasing_id()), "keys")
    return _own(index.join(numbers, [*by, "key"]), *by, "key")


def block_numbered(queries: DataFrame, index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What block gives, from a numbered index and without a shuffle of pairs."""
    known = queries.join(index.select(*by, "key", "kid").distinct().hint("merge"), [*by, "key"])  # keys of entities are many times their file, so they are never broadcast
    left = _own(known).select("kid", F.col("entity_id").alias("s1_id"), F.col("kids").alias("a"), F.col("plain").alias("plain_a"))
    right = index.select("kid", F.col("entity_id").alias("cand_id"), F.col("kids").alias("b"), F.col("plain").alias("plain_b"))
    shared = F.array_intersect("a", "b")
    times = lambda of, k: F.size(F.filter(of, lambda x: x == k)).cast("long")
    repeated = F.aggregate(shared, F.lit(0).cast("long"), lambda n, k: n + times(F.col("a"), k) * times(F.col("b"), k))
    n_keys = F.when(F.col("plain_a") & F.col("plain_b"), F.size(shared).cast("long")).otherwise(repeated)
    return left.join(right, "kid").filter(F.get(shared, F.lit(0)) == F.col("kid")).select("s1_id", "cand_id", n_keys.alias("n_keys"))


def top(pairs: DataFrame, k: int, *order, by: str = "s1_id") -> DataFrame:
    """The first k pairs of each query; cand_id settles ties."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order, "cand_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def capped(pairs: DataFrame, k: int) -> DataFrame:
    """The k candidates with most shared keys."""
    return top(pairs, k, F.desc("n_keys")).drop("rank")


def recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_truth, n_found, recall of true pairs (s1_id, cand_id) among candidates."""
    hit = truth.select("s1_id", "cand_id").distinct().join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left")
    return hit.agg(F.count("*").alias("n_truth"), F.count("hit").alias("n_found"), F.coalesce(F.count("hit") / F.count("*").cast("double"), F.lit(0.0)).alias("recall"))


def stats(pairs: DataFrame, n_queries: int, n_targets: int) -> DataFrame:
    """total, average and largest number of candidates, and the reduction against all pairs, null without any candidate."""
    each = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).__truediv__(F.lit(float(max(n_queries, 1)))).alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")
    ).withColumn("reduction", F.when(F.col("total") > 0, F.lit(float(n_queries) * n_targets) / F.col("total")))
