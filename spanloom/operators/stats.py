"""Resampling and choice of operating points over additive counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ratio


def paired_bootstrap(counts: DataFrame, groups: str, resamples: int = 1_000, seed: int = 0) -> DataFrame:
    """One row: observed difference of F1 between sides a and b, quantiles, two-sided p and win rate over resampled groups.

    counts: (group, a_tp, a_predicted, a_gold, b_tp, b_predicted, b_gold), summed by group first. Each group draws, from its
    own hash and the seed, a Poisson(1) weight for every resample; partitions add weighted sums, so neither groups nor
    draws are gathered: what is moved is six sums per resample and partition.
    """
    cols = ["a_tp", "a_predicted", "a_gold", "b_tp", "b_predicted", "b_gold"]
    g = counts.groupBy(F.xxhash64(F.coalesce(F.col(groups).cast("string"), F.lit(""))).alias("h")).agg(*[F.sum(c).cast("double").alias(c) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((resamples + 1, len(cols)))
        for b in batches:
            v = np.column_stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(cols))])
            for h, row in zip(b.column(0).to_numpy(), v):
                w = np.random.default_rng([seed, int(h) & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, resamples)
                total += np.append(w, 1)[:, None] * row
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples + 1)), *(pa.array(total[:, k]) for k in range(len(cols)))], ["resample", *cols])

    sums = g.mapInArrow(run, "resample bigint, " + ", ".join(f"{c} double" for c in cols)).groupBy("resample").agg(*[F.sum(c).alias(c) for c in cols])
    f1 = lambda x: ratio(2 * F.col(f"{x}_tp"), F.col(f"{x}_predicted") + F.col(f"{x}_gold"))
    d = sums.select("resample", (f1("a") - f1("b")).alias("d"))
    drawn = F.when(F.col("resample") < resamples, F.col("d"))
    out = d.agg(
        F.max(F.when(F.col("resample") == resamples, F.col("d"))).alias("observed"),
        F.percentile(drawn, F.lit(0.025)).alias("low"),
        F.percentile(drawn, F.lit(0.975)).alias("high"),
        F.avg((drawn > 0).cast("double")).alias("win_rate"),
        F.avg((drawn <= 0).cast("double")).alias("_le"),
        F.avg((drawn >= 0).cast("double")).alias("_ge"),
    )
    return out.select("observed", "low", "high", F.least(F.lit(1.0), 2 * F.least("_le", "_ge")).alias("p"), "win_rate")


def bootstrap_error(counts: DataFrame, by: str, unit: str, resamples: int = 1_000, seed: int = 0) -> DataFrame:
    """(by, f, error): F1, and its standard deviation over resamples of the units, each drawn a Poisson(1) number of times by its own hash and the seed. What is moved is three sums per resample, group and partition."""
    names = ["tp", "predicted", "gold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            v = np.column_stack([b.column(k + 2).to_numpy(zero_copy_only=False) for k in range(3)])
            for key, h, row in zip(b.column(0).to_pylist(), b.column(1).to_numpy(), v):
                w = np.random.default_rng([seed, int(h) & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, resamples)
                total[key] = total.get(key, 0) + np.append(w, 1)[:, None] * row
        for key, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(t), pa.string()), pa.array(np.arange(len(t))), *(pa.array(t[:, k]) for k in range(3))], ["key", "resample", *names])

    each = counts.select(F.col(by).cast("string"), F.xxhash64(unit), *[F.col(c).cast("double") for c in names])
    sums = each.mapInArrow(run, "key string, resample bigint, tp double, predicted double, gold double").groupBy("key", "resample").agg(*[F.sum(c).alias(c) for c in names])
    f = sums.select("key", "resample", ratio(2 * F.col("tp"), F.col("predicted") + F.col("gold")).alias("f"))
    return f.groupBy(F.col("key").alias(by)).agg(F.max(F.when(F.col("resample") == resamples, F.col("f"))).alias("f"), F.stddev_samp(F.when(F.col("resample") < resamples, F.col("f"))).alias("error"))


def best_threshold(curve: DataFrame, by: list[str], default: float = 0.5) -> DataFrame:
    """(by, threshold, f): the threshold with the highest F; ties go to the one nearest the default, then to the lower."""
    w = Window.partitionBy(*by).orderBy(F.round("f", 12).desc(), F.round(F.abs(F.col("threshold") - default), 9), "threshold")
    return curve.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "threshold", "f")


def trust_region(curve: DataFrame, by: list[str], slack: float) -> DataFrame:
    """(by, best, low, high, middle, n): the contiguous run of thresholds around the best whose F lies within ``slack`` of it, with its middle point."""
    best = best_threshold(curve, by).select(*by, F.col("threshold").alias("best"), F.col("f").alias("top"))
    j = curve.join(F.broadcast(best), by)
    w = Window.partitionBy(*by).orderBy("threshold")
    inside = F.col("f") >= F.col("top") - slack
    j = j.withColumn("inside", inside).withColumn("run", F.sum(F.when(inside, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    home = j.where(F.col("threshold") == F.col("best")).select(*by, F.col("run").alias("home"))
    r = j.join(F.broadcast(home), by).where("inside and run = home")
    r = r.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return r.groupBy(*by).agg(F.first("best").alias("best"), F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.max(F.when(F.col("k") == F.floor((F.col("n") + 1) / 2), F.col("threshold"))).alias("middle"), F.first("n").alias("n"))


def one_standard_error(curve: DataFrame, score: str, error: str, order: str) -> DataFrame:
    """The first row by ``order`` whose score lies within one standard error of the best row's."""
    best = curve.orderBy(F.col(score).desc(), order).select((F.col(score) - F.col(error)).alias("least")).first()
    if best is None:
        return curve.limit(0)
    return curve.where(F.col(score) >= best[0]).orderBy(order).limit(1)


def js_divergence(p: DataFrame, q: DataFrame, key: str, n: str) -> DataFrame:
    """(js): Jensen-Shannon divergence in bits of two tables of counts by key; null if either is empty."""
    total = lambda t: float(t.agg(F.sum(n)).first()[0] or 0) or None
    a = p.select(F.col(key), (F.col(n) / F.lit(total(p))).alias("p"))
    b = q.select(F.col(key), (F.col(n) / F.lit(total(q))).alias("q"))
    j = a.join(b, key, "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return j.agg((F.sum(part(F.col("p"))) / 2 + F.sum(part(F.col("q"))) / 2).alias("js"))
