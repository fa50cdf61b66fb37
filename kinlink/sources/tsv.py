"""Tab-separated sources and sinks of the linkage task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
CANDIDATES = ["source1_entity_id", "candidate_entity_ids"]
MATCHES = ["source1_entity_id", "matched_entity_ids"]


def read(spark: SparkSession, path, schema: str) -> DataFrame:
    """One file or several; every line must fit the schema."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "FAILFAST").csv(path)


def entities(spark: SparkSession, *paths: str) -> DataFrame:
    """The bag union of entity files."""
    return read(spark, list(paths), ENTITY)


def id_column(spark: SparkSession, path: str) -> DataFrame:
    """entity_id only, stripped, distinct, without blanks."""
    ids = read(spark, path, ENTITY).select(F.trim("entity_id").alias("entity_id"))
    return ids.filter("entity_id <> ''").distinct()


def truth_pairs(lists: DataFrame) -> DataFrame:
    """s1_id, cand_id of lists with columns TRUTH; blank lists give none."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.array_distinct(ids)).alias("cand_id"))


def candidate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, cand_id, rank of a candidate file, one row for each candidate."""
    rows = read(spark, path, "s1_id string, ids string").filter("ids is not null and ids <> ''")
    one = rows.select("s1_id", F.posexplode(F.split("ids", ",")).alias("at", "cand_id"))
    return one.select("s1_id", "cand_id", (F.col("at") + 1).alias("rank"))


def write_lists(lists: DataFrame, path: str, names: list[str]) -> None:
    """lists (s1_id, ids) as a folder of files with the given header; empty lists stay empty cells."""
    out = lists.select(F.col("s1_id").alias(names[0]), F.col("ids").alias(names[1]))
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def sample(df: DataFrame, n: int, id_column: str = "entity_id", seed: int = 42) -> DataFrame:
    """n rows by hash of their id: the same on every run."""
    return df.orderBy(F.xxhash64(id_column, F.lit(seed)), id_column).limit(n)


def embeddings(entities_: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """entities_ with the vector column name, null where vectors (entity_id, vector) has none."""
    return entities_.join(vectors.select("entity_id", F.col("vector").alias(name)), "entity_id", "left")
