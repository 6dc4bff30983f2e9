"""A forest of labels: closure, projection to cuts, nearest common ancestors, and many-to-many label maps.

Tagsets are configuration, a few hundred rows at most; their closure is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of a forest at most; deeper ones are an error.
DEPTH = 12


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, steps) of nodes (node, parent), every node being its own ancestor in 0 steps."""
    out = level = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    up = nodes.where("parent is not null").select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for k in range(DEPTH + 1):
        if k == DEPTH and not level.isEmpty():
            raise ValueError(f"labels lie deeper than {DEPTH} levels, or in a circle")
        level = level.join(F.broadcast(up), "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("steps") + 1).alias("steps"))
        out = out.union(level)
    return out


def project(labels: DataFrame, nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with a column ``target``: the nearest ancestor of ``label`` that belongs to the cut (column node); null if none does."""
    near = closure(nodes).join(F.broadcast(cut.select(F.col("node").alias("ancestor"))), "ancestor").groupBy("node").agg(F.min_by("ancestor", "steps").alias("target"))
    return labels.join(F.broadcast(near.withColumnRenamed("node", "label")), "label", "left")


def common_ancestor(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, y, lca): deepest common ancestor of each pair; null in different trees."""
    c = closure(nodes)
    a, b = c.select(F.col("node").alias("x"), "ancestor", F.col("steps").alias("sx")), c.select(F.col("node").alias("y"), "ancestor", F.col("steps").alias("sy"))
    best = pairs.join(F.broadcast(a), "x").join(F.broadcast(b), ["y", "ancestor"]).groupBy("x", "y").agg(F.min_by("ancestor", F.col("sx") + F.col("sy")).alias("lca"))
    return pairs.join(best, ["x", "y"], "left")


def reconcile(pairs: DataFrame, defined: DataFrame, least: int, least_share: float) -> DataFrame:
    """(source, target, n, share, kind): defined pairs always, observed ones with enough support and share; the others as off_map. pairs: one row per observation (source, target)."""
    n = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    j = n.join(total, "source").join(defined.select("source", "target", F.lit(True).alias("is_defined")), ["source", "target"], "full")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    kind = F.when(F.col("is_defined"), "defined").when((F.col("n") >= least) & (share >= least_share), "observed").otherwise("off_map")
    return j.select("source", "target", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), kind.alias("kind"))


def collapse_rare(counts: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(label, target): each label moved to its nearest ancestor whose subtree, with what came up to it, reaches ``least``; roots take what is left."""
    under = counts.join(F.broadcast(closure(nodes).withColumnRenamed("node", "label")), "label").groupBy(F.col("ancestor")).agg(F.sum("n").alias("total"))
    up = closure(nodes).join(F.broadcast(under), "ancestor")
    fit = up.where(F.col("total") >= least).groupBy("node").agg(F.min_by("ancestor", "steps").alias("fit"))
    root = up.groupBy("node").agg(F.max_by("ancestor", "steps").alias("root"))
    return counts.select("label").join(root.withColumnRenamed("node", "label"), "label").join(fit.withColumnRenamed("node", "label"), "label", "left").select("label", F.coalesce("fit", "root").alias("target"))


def back_project(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """(target, label, options): the leaves of the forest that each label of the cut stands for, and how many they are."""
    parents = nodes.where("parent is not null").select(F.col("parent").alias("label")).distinct()
    leaves = nodes.select(F.col("node").alias("label")).join(parents, "label", "left_anti")
    of = project(leaves, nodes, cut).where("target is not null")
    return of.join(of.groupBy("target").agg(F.count(F.lit(1)).alias("options")), "target").select("target", "label", "options")


def invert(pairs: DataFrame) -> DataFrame:
    """(target, sources, n): distinct sources of each target, joined by |, and their number. Labels are configuration, so the sets are small."""
    return pairs.select("source", "target").distinct().groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("source")), "|").alias("sources"), F.count(F.lit(1)).alias("n"))
