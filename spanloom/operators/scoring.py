"""Counts and metrics of predicted against gold spans. Metrics with a denominator of 0 are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import merge_regions, overlaps


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def prf(tp: Column, predicted: Column, gold: Column, beta: float = 1.0) -> list[Column]:
    """precision, recall and F as columns, not rounded."""
    b = beta * beta
    return [ratio(tp, predicted).alias("precision"), ratio(tp, gold).alias("recall"), ratio((1 + b) * tp, predicted + b * gold).alias("f")]


def pooled(counts: DataFrame, by: list[str], panel: str = "lang") -> DataFrame:
    """Summed counts and metrics by the columns and panel, and over all of the panel (panel null, all_panels 1)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "predicted", "gold")]
    g = counts.groupingSets([[*by, panel], list(by)], *by, panel).agg(F.grouping(panel).alias("all_panels"), *sums)
    return g.select("*", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def accuracies() -> list[Column]:
    """Accuracy and balanced accuracy of the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return [ratio(tp + tn, tp + fp + fn + tn), (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2]


def region_counts(gold: DataFrame, predicted: DataFrame, cover: float) -> DataFrame:
    """(doc, tp, predicted, gold) of merged regions. With more than half of both to be covered a region has one partner at most, so the pairs are a maximum matching."""
    g, p = merge_regions(gold).drop("n"), merge_regions(predicted).drop("n")
    pairs = overlaps(g, p, cover).groupBy("doc").agg(F.count(F.lit(1)).alias("tp"))
    n = lambda t, c: t.groupBy("doc").agg(F.count(F.lit(1)).alias(c))
    out = n(g, "gold").join(n(p, "predicted"), "doc", "full").join(pairs, "doc", "left")
    return out.select("doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "predicted", "gold")])


def typed_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, predicted, gold) of distinct exact triples, by every label of either side."""
    k = ["doc", "s", "e", "label"]
    j = gold.select(*k, F.lit(1).alias("g")).distinct().join(predicted.select(*k, F.lit(1).alias("p")).distinct(), k, "full")
    return j.groupBy("label").agg(F.count(F.when((F.col("g") == 1) & (F.col("p") == 1), 1)).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("gold"))


def character_counts(gold: DataFrame, predicted: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, tp, fp, fn, tn) in characters, by the lengths of merged regions; texts: (doc, n)."""
    g, p = merge_regions(gold), merge_regions(predicted)
    both = overlaps(g.drop("n"), p.drop("n")).groupBy("doc").agg(F.sum("shared").alias("tp"))
    size = lambda t, c: t.groupBy("doc").agg(F.sum(F.col("e") - F.col("s")).alias(c))
    j = texts.join(size(g, "g"), "doc", "left").join(size(p, "p"), "doc", "left").join(both, "doc", "left").na.fill(0, ["g", "p", "tp"])
    return j.select("doc", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("n") - F.col("g") - F.col("p") + F.col("tp")).alias("tn"))


def recall_by_label(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, gold, hit, recall): distinct gold spans that any predicted span overlaps."""
    g = gold.select("doc", "s", "e", "label").distinct()
    p = predicted.select(F.col("doc").alias("p_doc"), F.col("s").alias("p_s"), F.col("e").alias("p_e"))
    hit = g.join(p, (F.col("doc") == F.col("p_doc")) & (F.col("s") < F.col("p_e")) & (F.col("p_s") < F.col("e")), "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("hit"))
    out = g.groupBy("label").agg(F.count(F.lit(1)).alias("gold")).join(hit, "label", "left").na.fill(0, ["hit"])
    return out.select("label", "gold", "hit", ratio(F.col("hit"), F.col("gold")).alias("recall"))


def maximum_matching(pairs: DataFrame) -> DataFrame:
    """(doc, matched): size of a maximum one-to-one matching of the compatible pairs (doc, g, p), for spans that may nest. One document is one group, bounded by the length of its text."""
    import pandas as pd

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        partners = rows.groupby("g")["p"].apply(sorted).to_dict()
        return pd.DataFrame({"doc": [key[0]], "matched": [matching_size(partners)]})

    kind = pairs.schema["doc"].dataType.simpleString()
    return pairs.groupBy("doc").applyInPandas(run, f"doc {kind}, matched int")


def matching_size(partners: dict) -> int:
    """Size of a maximum matching, by phases of shortest augmenting paths (Hopcroft and Karp), without recursion."""
    mate_g: dict = {}
    mate_p: dict = {}
    while True:
        # layers of alternating paths from the free left nodes
        depth = {g: 0 for g in partners if g not in mate_g}
        queue, reached = list(depth), False
        for g in queue:
            for p in partners[g]:
                nxt = mate_p.get(p)
                if nxt is None:
                    reached = True
                elif nxt not in depth:
                    depth[nxt] = depth[g] + 1
                    queue.append(nxt)
        if not reached:
            return len(mate_g)
        left = {g: iter(partners[g]) for g in depth}
        for root in [g for g in depth if g not in mate_g]:
            path = [root]
            via: list = []
            while path:
                step = next((p for p in left[path[-1]] if mate_p.get(p) is None or depth.get(mate_p[p]) == depth[path[-1]] + 1), None)
                if step is None:
                    path.pop()
                    via = via[:-1]
                elif mate_p.get(step) is None:
                    for g, p in zip(path, [*via, step]):
                        mate_g[g], mate_p[p] = p, g
                    break
                else:
                    via.append(step)
                    path.append(mate_p[step])
