"""Exact duplicates, contamination by equal texts, and components of near-duplicate links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_sql
from ..session import cut


def exact_groups(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(key, keep, n): SHA-256 of the normal form, smallest id and number of rows. Null texts belong to no group. Only ids and digests are shuffled."""
    d = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(norm_sql(F.col(text_col)), 256).alias("key"))
    return d.groupBy("key").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows with the smallest id of their group; rows without text all stay."""
    kept = exact_groups(df, text_col, id_col).select(F.col("keep").alias(id_col)).distinct()
    return df.join(kept, id_col, "left_semi").unionByName(df.where(F.col(text_col).isNull()))


def without_texts(df: DataFrame, banned: DataFrame, text_col: str, banned_col: str) -> DataFrame:
    """Rows whose normal form isn't among those of banned."""
    keys = banned.where(F.col(banned_col).isNotNull()).select(F.sha2(norm_sql(F.col(banned_col)), 256).alias("_key")).distinct()
    keyed = df.withColumn("_key", F.sha2(norm_sql(F.col(text_col)), 256))
    return keyed.join(keys, "_key", "left_anti").drop("_key")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): smallest node of each connected component of the links (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of the longest path. Labels are checkpointed in the shared folder every round.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        after = cut(step.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "before"))
        labels = after.drop("before")
        if after.where("component <> before").isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise the number of rounds")
