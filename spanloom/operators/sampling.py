"""Deterministic splits, draws and weights. All randomness is the hash of a key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_unit


def share_duplicate_mass(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Rows with the same keys share the mass of one: the sum of their weights over the square of their number, scaled to keep the total of all. One grouped join; nothing is gathered."""
    g = df.groupBy(*keys).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}"))
    j = df.alias("d").join(g.alias("g"), match).select("d.*", (F.col("_w") / (F.col("_n") * F.col("_n"))).alias("_s"))
    before, after = g.agg(F.sum("_w"), F.sum(F.col("_w") / F.col("_n"))).first()
    return j.withColumn("shared", F.col("_s") * F.lit((before or 0.0) / after if after else 1.0)).drop("_s")


def cap_shares(mass: dict[str, float], caps: dict[str, float], movable: set[str] | None = None, rounds: int = 100) -> tuple[dict[str, float], list[str]]:
    """Factors by group that bring no group over its cap of the total, and the groups whose cap can't be met.

    The mass that capped groups lose goes to the movable groups under their caps, in proportion to their mass. Works on
    the masses of groups, a small table, never on rows.
    """
    total = sum(mass.values())
    now = dict(mass)
    movable = set(mass) if movable is None else movable & set(mass)
    fixed: set[str] = set()
    for _ in range(rounds):
        over = {g for g in movable - fixed if g in caps and now[g] > caps[g] * total + 1e-12}
        if not over:
            break
        takers = {g: now[g] for g in movable - fixed - over if now[g] > 0}
        if not takers:  # nothing may take the mass, so it stays and the groups are told
            return {g: now[g] / mass[g] if mass[g] else 0.0 for g in mass}, sorted(over)
        free = sum(now[g] - caps[g] * total for g in over)
        for g in over:
            now[g] = caps[g] * total
        fixed |= over
        scale = 1 + free / sum(takers.values())
        for g in takers:
            now[g] *= scale
    short = sorted(g for g in mass if g in caps and now[g] > caps[g] * total + 1e-9)
    return {g: now[g] / mass[g] if mass[g] else 0.0 for g in mass}, short


def capped_weights(df: DataFrame, group: str, weight: str, caps: dict[str, float], movable: set[str] | None = None) -> DataFrame:
    """Rows with ``capped``: their weight times the factor of their group."""
    mass = {str(r[0]): float(r[1] or 0) for r in df.groupBy(F.coalesce(F.col(group), F.lit("")).alias("g")).agg(F.sum(weight)).collect()}  # one row per group, as many as caps name and a few more
    factors, _ = cap_shares(mass, caps, movable)
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(list(factors.items()) or [("", 1.0)], "_g string, _f double"))
    return df.join(table, F.coalesce(F.col(group), F.lit("")) == F.col("_g"), "left").withColumn("capped", F.col(weight) * F.coalesce("_f", F.lit(1.0))).drop("_g", "_f")


#: Width of the stretches of an order column within which running sums are taken in one task.
STRETCH = 1 << 14


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str = "running", stretch: int = STRETCH) -> DataFrame:
    """Rows with the running sum of a value by an integer column with distinct values, within the groups.

    Two levels: sums by stretch of the order column are summed up first, a small table, and rows are ordered within their
    stretch only, so a hot group is spread over as many tasks as it has stretches.
    """
    d = df.withColumn("_k", F.floor(F.col(order) / stretch))
    sums = d.groupBy(*by, "_k").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).drop("_s")
    match = F.lit(True)
    for c in [*by, "_k"]:
        match = match & F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
    j = d.alias("d").join(starts.alias("t"), match).select("d.*", "t._before")
    w = Window.partitionBy(*by, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_k", "_before")


def systematic_draw(df: DataFrame, by: list[str], order: str, weight: str, step: float, start: float = 0.5) -> DataFrame:
    """Rows with ``draws``: how many points start*step, (start+1)*step, ... fall in the row's stretch of the running weight, within the groups."""
    count = lambda x: F.floor(F.round(x / step - start, 9)) + 1
    r = running_sum(df, by, order, weight, "_run")
    return r.withColumn("draws", (count(F.col("_run")) - count(F.col("_run") - F.col(weight))).cast("bigint")).drop("_run")


def ordered_prefix(df: DataFrame, by: list[str], order: str, length: str, fraction: float) -> DataFrame:
    """Rows with ``taken``: the prefix of each group whose summed length comes closest to the fraction of all; ties go to the shorter."""
    r = running_sum(df, by, order, length, "_run")
    total = r.groupBy(*by).agg(F.sum(length).alias("_total"))
    miss = F.round(F.abs(F.col("_run") - fraction * F.col("_total")), 9)
    stop = r.join(total, by).groupBy(*by).agg(F.min(F.struct(miss.alias("m"), F.col("_run").alias("stop"))).alias("x")).select(*by, F.col("x.stop").alias("_stop"))
    return r.join(stop, by).withColumn("taken", F.col("_run") <= F.col("_stop")).drop("_run", "_stop")


def weighted_choice(df: DataFrame, by: list[str], key: Column, weight: str, k: int = 1) -> DataFrame:
    """k rows of each group drawn without replacement in proportion to their weights: the largest of ln(u) / w, u from the hash of the key. Rows without positive weight are never drawn."""
    score = F.log(hash_unit(key)) / F.col(weight)
    w = Window.partitionBy(*by).orderBy(F.col("_score").desc())
    return df.where(F.col(weight) > 0).withColumn("_score", score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_score", "_r")


def largest_remainder(groups: DataFrame, weight: str, budget: int, tie: str) -> DataFrame:
    """Groups with ``rows``: the budget shared in proportion, whole parts first, the rest to the largest remainders."""
    one = Window.partitionBy(F.lit(1))
    j = groups.withColumn("_x", F.lit(float(budget)) * F.col(weight) / F.sum(weight).over(one)).withColumn("_base", F.floor(F.round("_x", 9)))
    j = j.withColumn("_left", F.lit(budget) - F.sum("_base").over(one)).withColumn("_r", F.row_number().over(one.orderBy(F.round(F.col("_x") - F.col("_base"), 9).desc(), tie)))
    return j.withColumn("rows", F.col("_base") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).drop("_x", "_base", "_left", "_r")


def group_split(df: DataFrame, stratum: str, group: str, size: str, fraction: float, seed: str = "0") -> DataFrame:
    """(stratum, group, in_first): whole groups, in hash order, up to the prefix closest to the fraction of the stratum; strata with two groups or more have both sides."""
    g = df.groupBy(stratum, group).agg(F.sum(size).alias("n")).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256))
    w = Window.partitionBy(stratum).orderBy("_h")
    all_ = Window.partitionBy(stratum)
    g = g.withColumn("k", F.row_number().over(w)).withColumn("_count", F.count(F.lit(1)).over(all_)).withColumn("_run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.withColumn("_miss", F.abs(F.col("_run") - fraction * F.sum("n").over(all_)))
    best = F.min(F.when((F.col("k") < F.col("_count")) | (F.col("_count") == 1), F.struct(F.round("_miss", 9).alias("m"), F.col("k").alias("k")))).over(all_)
    return g.select(stratum, group, (F.col("k") <= best["k"]).alias("in_first"))


def carried_draw(df: DataFrame, expected: str, epoch: int, key: Column) -> DataFrame:
    """Rows with ``draws`` in the given epoch (from 0): credit is carried over, so that after every epoch the sum of draws is the whole part of what was expected so far, with a start between 0 and 1 from the key's hash."""
    u = hash_unit(key)
    so_far = lambda n: F.floor(F.round(F.col(expected) * n + u, 9))
    return df.withColumn("draws", (so_far(epoch + 1) - so_far(epoch)).cast("bigint"))


def floor_weights(mass: dict[str, float], floors: dict[str, float], rounds: int = 100) -> tuple[dict[str, float], list[str]]:
    """Factors by label that lift the labels with a floor exactly to their share of the total and scale the others down alike, and the labels whose floor can't be met. Works on the masses of labels."""
    total = sum(mass.values())
    lifted: set[str] = set()
    for _ in range(rounds):
        rest = total - sum(floors[g] * total for g in lifted)
        others = sum(m for g, m in mass.items() if g not in lifted)
        scale = rest / others if others else 0.0
        low = {g for g in floors if g in mass and g not in lifted and mass[g] > 0 and mass[g] * scale < floors[g] * total - 1e-12}
        if not low:
            break
        lifted |= low
    missing = sorted(g for g in floors if not mass.get(g)) + ([] if sum(floors[g] for g in lifted) <= 1 else sorted(lifted))
    rest = max(0.0, total - sum(floors[g] * total for g in lifted))
    others = sum(m for g, m in mass.items() if g not in lifted)
    return {g: floors[g] * total / m if g in lifted else (rest / others if others else 0.0) for g, m in mass.items() if m > 0}, missing


def neighbour_mean(ranked: DataFrame, by: str, order: str, weight: str, value: str, k: float) -> DataFrame:
    """(by, mean): mean of the value over the nearest rows until their weights fill k places, the last one in part."""
    before = F.coalesce(F.sum(weight).over(Window.partitionBy(by).orderBy(F.desc(order), value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = F.greatest(F.lit(0.0), F.least(F.col(weight), F.lit(float(k)) - F.col("_before")))
    return ranked.withColumn("_before", before).withColumn("_part", part).groupBy(by).agg((F.sum(F.col("_part") * F.col(value)) / F.sum("_part")).alias("mean"))


def support_deficits(examples: DataFrame, cells: DataFrame, keys: list[str], surface: str, group: str, least: int, least_groups: int) -> DataFrame:
    """Required cells (keys) that have fewer examples' surfaces or groups than asked; cells without any example are kept."""
    n = examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("examples"), F.count_distinct(surface).alias("surfaces"), F.count_distinct(group).alias("groups"))
    j = cells.join(n, keys, "left").na.fill(0, ["examples", "surfaces", "groups"])
    return j.where((F.col("surfaces") < least) | (F.col("groups") < least_groups)).withColumn("missing", F.greatest(F.lit(0), F.lit(least) - F.col("surfaces")))


def capped_extra_weights(scores: DataFrame, key: str, score: str, budget: float, cap: float) -> DataFrame:
    """(key, weight): the budget in proportion to the scores, no weight over the cap.

    Weights are score * scale up to the cap, where the scale is the one at which they sum to the budget: scores are summed
    by size, and the scale is read off the running sums, so no round over the rows is needed. If the budget can't be placed
    all positive scores have the cap; scores of 0 or less have no weight.
    """
    by = scores.where(F.col(score) > 0).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    down = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    total = by.agg(F.sum(F.col("_s") * F.col("_n"))).first()[0] or 0.0
    over = by.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0))).withColumn("_mass", F.coalesce(F.sum(F.col("_s") * F.col("_n")).over(down), F.lit(0.0)))
    # the scale if all scores above this one are capped; the first at which this one isn't is the right one
    scale = (F.lit(float(budget)) - cap * F.col("_above")) / (F.lit(float(total)) - F.col("_mass"))
    found = over.withColumn("_scale", scale).where(F.col("_s") * F.col("_scale") < cap).orderBy(F.desc("_s")).select("_scale").first()
    weight = F.when(F.col(score) <= 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.col(score) * F.lit(max(0.0, found[0]))) if found else F.lit(float(cap)))
    return scores.select(key, F.coalesce(weight, F.lit(0.0)).alias("weight"))


def schedule_metrics(rows: DataFrame, batch: str, size: str, key: str) -> DataFrame:
    """(batches, padding, repeats, variation): part of the batches' places that padding fills, rows whose key their batch has already, and the coefficient of variation of the batches' sizes."""
    b = rows.groupBy(batch).agg(F.sum(size).alias("used"), (F.max(size) * F.count(F.lit(1))).alias("held"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeats"))
    return b.agg(F.count(F.lit(1)).alias("batches"), (1 - F.sum("used") / F.sum("held")).alias("padding"), F.sum("repeats").alias("repeats"), (F.stddev_samp("used") / F.avg("used")).alias("variation"))
