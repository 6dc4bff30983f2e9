"""Gates and joins that must hold: quarantine, expectations, equal keys, chosen ids, places, equal beginnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .intervals import overlaps

#: Names of columns that tell of text (fixed values).
TEXT_LIKE = ("text", "raw_text", "surface", "value", "content", "carrier", "sentence", "before", "after")


def quarantine(df: DataFrame, fields: dict[str, Column], blocked: dict[str, list[str]], id_col: str) -> DataFrame:
    """(reason, n, first): rows by the first field whose value begins with one of its blocked prefixes, and the smallest id."""
    reason = F.lit(None).cast("string")
    for name in reversed(list(fields)):
        hit = F.lit(False)
        for p in blocked.get(name, []):
            hit = hit | F.coalesce(fields[name].startswith(p), F.lit(False))
        reason = F.when(hit, name).otherwise(reason)
    return df.select(F.col(id_col).alias("_id"), reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))


def require_none(df: DataFrame, message: str) -> DataFrame:
    """The (empty) table; an error if it has rows."""
    if not df.isEmpty():
        raise ValueError(f"{message}: {df.first()}")
    return df


def expectations(records: DataFrame) -> DataFrame:
    """(expectation, failed) of canonical records (id, text, lang, spans): all in one pass, and the repeated ids in a second."""
    n = F.length("text")
    spans = F.when(F.col("text").isNotNull(), F.coalesce("spans", F.array())).otherwise(F.array())
    bad = lambda f: F.size(F.filter(spans, lambda x: F.coalesce(f(x), F.lit(False))))
    per = {
        "text_missing": F.col("text").isNull().cast("int"),
        "lang_missing": F.col("lang").isNull().cast("int"),
        "spans_unknown": F.col("spans").isNull().cast("int"),
        "label_missing": bad(lambda x: x["label"].isNull()),
        "span_empty": bad(lambda x: x["end_char"] <= x["start_char"]),
        "span_outside": bad(lambda x: (x["start_char"] < 0) | (x["end_char"] > n)),
    }
    sums = records.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in per.items()])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("expectation"), F.col(k).alias("failed")) for k in per])).alias("x")).select("x.*")
    repeated = records.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"))
    return out.union(repeated.select(F.lit("id_repeated"), "failed"))


def not_contained(spans: DataFrame, holders: DataFrame) -> DataFrame:
    """Spans that no holder of the same document contains."""
    h = holders.select(F.col("doc").alias("h_doc"), F.col("s").alias("h_s"), F.col("e").alias("h_e"))
    return spans.join(h, (F.col("doc") == F.col("h_doc")) & (F.col("h_s") <= F.col("s")) & (F.col("e") <= F.col("h_e")), "left_anti")


def text_like(schema: DataType, path: str = "") -> list[str]:
    """Paths of a schema whose last name tells of text; structs, arrays and maps are walked."""
    out: list[str] = []
    if isinstance(schema, StructType):
        for f in schema.fields:
            here = f"{path}.{f.name}" if path else f.name
            out += ([here] if f.name in TEXT_LIKE or f.name == "spans" else []) + text_like(f.dataType, here)
    elif isinstance(schema, ArrayType):
        out += text_like(schema.elementType, path)
    elif isinstance(schema, MapType):
        out += text_like(schema.valueType, path)
    return out


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables with the same distinct keys; the job fails at a key that one side lacks or has twice."""
    n = lambda d, c: d.groupBy(key).agg(F.count(F.lit(1)).alias(c), *[F.first(x).alias(x) for x in d.columns if x != key])
    j = n(left, "_l").join(n(right, "_r"), key, "full")
    wrong = (F.coalesce("_l", F.lit(0)) != 1) | (F.coalesce("_r", F.lit(0)) != 1)
    kind = j.schema[key].dataType
    checked = F.when(wrong, F.raise_error(F.concat(F.lit(f"{key} is not on both sides once: "), F.col(key).cast("string"))).cast(kind)).otherwise(F.col(key))
    return j.withColumn(key, checked).drop("_l", "_r")


def select_ids(df: DataFrame, key: str, include: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of the included ids that aren't excluded; the job fails at an included id without a row."""
    wanted = include.select(key).where(F.col(key).isNotNull()).distinct()
    kept = df.withColumn("_here", F.lit(True)).join(wanted, key, "right")
    kind = df.schema[key].dataType
    kept = kept.withColumn(key, F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string"))).cast(kind)).otherwise(F.col(key))).drop("_here")
    return kept if exclude is None else kept.join(exclude.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


#: Width of the key stretches whose rows one task numbers.
PLACES = 1 << 14


def with_place(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``k``, the place from 0 in the order of an integer key with distinct values: counts by stretch of the key first, then places within it."""
    d = df.withColumn("_b", F.floor(F.col(key) / PLACES))
    n = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return d.join(before, "_b").withColumn("k", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_before")


def zip_by_place(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of both tables that have the same place in the order of their keys."""
    return with_place(left, left_key).join(with_place(right, right_key), "k").select(left_key, right_key, "k")


def equal_prefix(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(equal_rows, prefix): rows equal at the same place, and the length of the equal beginning, in the order of the keys.

    Up to the first key that one side lacks or that differs both sides have the same places, so nothing is numbered: the
    smallest such key is found first, and the rows before it are counted.
    """
    tag = lambda d, x: d.select(*keys, *[F.col(c).alias(f"{x}{c}") for c in columns], F.lit(True).alias(f"_{x}"))
    j = tag(a, "a").join(tag(b, "b"), keys, "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in columns:
        same = same & F.col(f"a{c}").eqNullSafe(F.col(f"b{c}"))
    # where keys are missing on one side the places shift, so equality by place needs the places
    w = Window.partitionBy(F.lit(1)).orderBy(*keys)
    number = lambda d, x: d.select(F.row_number().over(w).alias("k"), F.struct(*keys, *columns).alias(x))
    placed = number(a, "x").join(number(b, "y"), "k", "full")
    rows = placed.agg(F.count(F.when(F.col("x") == F.col("y"), 1)).alias("equal_rows"))
    first = j.where(~same).agg(F.min(F.struct(*keys)).alias("first"))
    before = j.select(F.struct(*keys).alias("key")).join(F.broadcast(first)).where(F.col("first").isNull() | (F.col("key") < F.col("first"))).agg(F.count(F.lit(1)).alias("prefix"))  # first is one row
    return rows.join(F.broadcast(before))


def preponderant_label(spans: DataFrame, votes: DataFrame) -> DataFrame:
    """Spans (doc, s, e, label) with ``vote``, the label whose votes cover most of their characters, and ``w``, how many; ties go to the first by name, spans without votes are left out."""
    c = overlaps(spans.select("doc", "s", "e", "label"), votes.select("doc", "s", "e", "label"))
    w = c.groupBy("doc", "s", "e", "label", F.col("r_label").alias("vote")).agg(F.sum("shared").alias("w"))
    best = F.row_number().over(Window.partitionBy("doc", "s", "e", "label").orderBy(F.desc("w"), "vote"))
    return w.withColumn("_k", best).where("_k = 1").drop("_k")


def distinct_targets(df: DataFrame, key: str, needs: list[tuple[str, Column]]) -> DataFrame:
    """(need, key): for each need in turn the smallest key that meets it and that none before has taken; null if there is none. One pass for each need, a short stated list."""
    taken: list = []
    rows = []
    for name, meets in needs:
        free = df.where(meets) if not taken else df.where(meets & ~F.col(key).isin(taken))
        got = free.agg(F.min(key)).first()[0]
        rows.append((name, got))
        if got is not None:
            taken.append(got)
    return df.sparkSession.createDataFrame(rows, f"need string, {key} {df.schema[key].dataType.simpleString()}")
