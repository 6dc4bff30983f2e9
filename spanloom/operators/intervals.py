"""Algebra of half-open spans [s, e) by document: islands, cuts, coverage, agreement, and folds over text.

All functions take rows (doc, s, e, ...), one per span; spans with null ends or e <= s are left out first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_spans(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(doc, s, e, label) of an array of span structs; null and empty arrays give no rows."""
    x = df.select(F.col(id_col).alias("doc"), F.explode(array_col).alias("x"))
    return valid(x.select("doc", F.col("x.start_char").alias("s"), F.col("x.end_char").alias("e"), F.col("x.label").alias("label")))


def valid(spans: DataFrame) -> DataFrame:
    return spans.where("s is not null and e is not null and s >= 0 and e > s")


def merge_regions(spans: DataFrame, keys: list[str] | None = None, gap: int = 0) -> DataFrame:
    """Disjoint unions of spans that overlap or touch within ``gap`` characters, by document and keys, with the number of spans in each."""
    by = ["doc", *(keys or [])]
    w = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.select(*by, "s", "e").withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0))
    islands = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("island")


def subtract(spans: DataFrame, holes: DataFrame) -> DataFrame:
    """Pieces (doc, s, e) of the merged spans outside the merged holes, by a sweep over all end points."""
    a, b = merge_regions(spans), merge_regions(holes)
    points = reduce(DataFrame.union, [a.select("doc", F.col("s").alias("p"), F.lit(1).alias("da"), F.lit(0).alias("db")), a.select("doc", F.col("e").alias("p"), F.lit(-1), F.lit(0)), b.select("doc", F.col("s").alias("p"), F.lit(0), F.lit(1)), b.select("doc", F.col("e").alias("p"), F.lit(0), F.lit(-1))])
    points = points.groupBy("doc", "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy("doc").orderBy("p")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select("doc", F.col("p").alias("s"), F.lead("p").over(w).alias("e"), F.sum("da").over(run).alias("in_a"), F.sum("db").over(run).alias("in_b"))
    return merge_regions(swept.where("in_a > 0 and in_b = 0 and e is not null")).drop("n")


def overlaps(left: DataFrame, right: DataFrame, cover: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs of spans of one document that share characters; with cover, at least that part of both. Columns of right get the prefix r_."""
    r = right.select("doc", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "doc"])
    both = F.least("e", "r_e") - F.greatest("s", "r_s")
    test = (F.col("s") < F.col("r_e")) & (F.col("r_s") < F.col("e"))
    if cover:
        test = test & (both >= cover * (F.col("e") - F.col("s"))) & (both >= cover * (F.col("r_e") - F.col("r_s")))
    if how == "inner":
        return left.join(r, "doc").where(test).withColumn("shared", both)
    return left.alias("l").join(r.alias("r"), (F.col("l.doc") == F.col("r.doc")) & test, how)


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans of inner that lie within a span of outer in the same document, with its ends as r_s and r_e."""
    o = outer.select("doc", F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    return inner.join(o, "doc").where("r_s <= s and e <= r_e")


def not_overlapping(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """Spans that share no character with any of taken."""
    t = taken.select(F.col("doc").alias("t_doc"), F.col("s").alias("t_s"), F.col("e").alias("t_e"))
    return spans.join(t, (F.col("doc") == F.col("t_doc")) & (F.col("s") < F.col("t_e")) & (F.col("t_s") < F.col("e")), "left_anti")


def merge_adjacent(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of one label joined across gaps of white space; texts has (doc, text)."""
    w = Window.partitionBy("doc", "label").orderBy("s", "e")
    j = spans.join(texts.select("doc", "text"), "doc").withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    between = F.substring(F.col("text"), F.col("before") + 1, F.col("s") - F.col("before"))
    joined = F.col("before").isNotNull() & ((F.col("s") <= F.col("before")) | ((F.length(between) > 0) & between.rlike(r"^\s+$")))
    i = j.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("doc", "label", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("island")


def agreement(spans: DataFrame, voter: str, least: int) -> DataFrame:
    """Spans that the spans of at least ``least`` voters (their own included) overlap."""
    o = overlaps(spans, spans.select("doc", "s", "e", voter))
    return o.groupBy("doc", "s", "e", voter).agg(F.count_distinct(f"r_{voter}").alias("voters")).where(F.col("voters") >= least)


def unique_counterparts(left: DataFrame, right: DataFrame, cover: float = 0.8) -> DataFrame:
    """Pairs that match exactly, and pairs over the coverage where each side has no other partner, among the spans without an exact match."""
    l, r = left.select("doc", "s", "e").distinct(), right.select("doc", "s", "e").distinct()
    exact = l.join(r, ["doc", "s", "e"]).select("doc", "s", "e", F.col("s").alias("r_s"), F.col("e").alias("r_e"), F.lit("exact").alias("tier"))
    o = overlaps(l.join(r, ["doc", "s", "e"], "left_anti"), r.join(l, ["doc", "s", "e"], "left_anti"), cover)
    o = o.withColumn("nl", F.count(F.lit(1)).over(Window.partitionBy("doc", "s", "e"))).withColumn("nr", F.count(F.lit(1)).over(Window.partitionBy("doc", "r_s", "r_e")))
    return exact.unionByName(o.where("nl = 1 and nr = 1").select("doc", "s", "e", "r_s", "r_e", F.lit("unique").alias("tier")))


def greedy_longest(array_col: str) -> Column:
    """Spans of an array (start_char, end_char, label) kept longest first where they overlap none kept before; ties by start, then label. In order of start."""
    ranked = F.array_sort(
        F.filter(F.transform(F.coalesce(F.col(array_col), F.array()), lambda x: F.struct((x["start_char"] - x["end_char"]).alias("k"), x["start_char"].alias("s"), x["end_char"].alias("e"), x["label"].alias("label"))), lambda x: x["e"] > x["s"])
    )
    kept = F.aggregate(ranked, F.expr("cast(array() as array<struct<k:int,s:int,e:int,label:string>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["label"].alias("label"))))


def replace_spans(text: Column, spans: Column, left: str = "[", right: str = "]") -> Column:
    """Text with every span (s, e, label), in order of start, replaced by its label; overlapping later ones are skipped."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.when(x["s"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(left), F.coalesce(x["label"], F.lit("unknown")), F.lit(right)).alias("out"), x["e"].alias("at"))).otherwise(a)
    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<s:int,e:int,label:string>>")), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def trim_edges(text: Column, s: Column, e: Column) -> Column:
    """The span without white space at its ends, null if nothing is left."""
    inside = F.substring(text, s + 1, e - s)
    lead = F.length(inside) - F.length(F.regexp_replace(inside, r"^\s+", ""))
    tail = F.length(inside) - F.length(F.regexp_replace(inside, r"\s+$", ""))
    return F.when(lead + tail < e - s, F.struct((s + lead).alias("s"), (e - tail).alias("e")))


def layers(array_col: str) -> Column:
    """Spans of an array with the number of the first layer where they overlap nothing placed before, in order of start, then length: overlapping annotation as flat views."""
    ordered = F.array_sort(F.filter(F.transform(F.coalesce(F.col(array_col), F.array()), lambda x: F.struct(x["start_char"].alias("s"), (-x["end_char"]).alias("k"), x["label"].alias("label"))), lambda x: -x["k"] > x["s"]))
    empty = F.expr("named_struct('ends', cast(array() as array<int>), 'out', cast(array() as array<struct<s:int,e:int,label:string,layer:int>>))")

    def step(acc: Column, x: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: (e <= x["s"]).cast("int")), 1).cast("int")
        layer = F.when(free > 0, free - 1).otherwise(F.size(acc["ends"]))
        ends = F.when(free > 0, F.transform(acc["ends"], lambda e, i: F.when(i == free - 1, -x["k"]).otherwise(e))).otherwise(F.concat(acc["ends"], F.array(-x["k"])))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), (-x["k"]).alias("e"), x["label"].alias("label"), layer.alias("layer")))).alias("out"))

    return F.aggregate(ordered, empty, step, lambda acc: acc["out"])


def best_schedule(spans: list[tuple[int, int, float]]) -> list[int]:
    """Indexes of non-overlapping spans (s, e, score) of the greatest summed score; of equal ones the later start loses.

    One sweep over the coordinates: the best total up to each is handed on, spans pick it up where they start and offer
    theirs where they end.
    """
    starting: dict[int, list[int]] = {}
    ending: dict[int, list[int]] = {}
    for k, (s, e, _) in enumerate(spans):
        starting.setdefault(s, []).append(k)
        ending.setdefault(e, []).append(k)
    total, chain = 0.0, None  # chain: (index, chain before)
    reached: dict[int, tuple[float, tuple | None]] = {}
    for x in sorted(starting.keys() | ending.keys()):
        for k in ending.get(x, ()):
            before, links = reached.pop(k)
            if before + spans[k][2] > total:
                total, chain = before + spans[k][2], (k, links)
        for k in starting.get(x, ()):
            reached[k] = total, chain
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return sorted(out)


def schedule(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(doc, s, e, label, score) of the best non-overlapping spans of each row's array of scored spans."""
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, spans in enumerate(b.column(1).to_pylist()):
                good = [x for x in spans or [] if x["start_char"] is not None and x["end_char"] is not None and x["end_char"] > x["start_char"]]
                for i in best_schedule([(x["start_char"], x["end_char"], x["score"] or 0.0) for x in good]):
                    at.append(k)
                    rows.append((good[i]["start_char"], good[i]["end_char"], good[i]["label"], good[i]["score"]))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.float64())))], ["doc", "s", "e", "label", "score"])

    return df.select(id_col, array_col).mapInArrow(run, f"doc {kind}, s int, e int, label string, score double")


def occurrences(texts: DataFrame, surfaces: DataFrame, id_col: str, text_col: str, most_surfaces: int = 100_000) -> DataFrame:
    """(doc, s, e, surface) of all occurrences, overlapping ones too, of a bounded set of surfaces, found in one pass by an automaton over all of them."""
    import ahocorasick
    import pyarrow as pa

    words = [r[0] for r in surfaces.select("surface").where("surface <> ''").distinct().limit(most_surfaces + 1).collect()]
    if len(words) > most_surfaces:
        raise ValueError(f"more than {most_surfaces} surfaces; join their n-grams instead")
    sent = texts.sparkSession.sparkContext.broadcast(sorted(words))
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = ahocorasick.Automaton()
        for w in sent.value:
            machine.add_word(w, w)
        machine.make_automaton()
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for end, w in machine.iter(t) if t and len(machine) else ():
                    at.append(k)
                    rows.append((end + 1 - len(w), end + 1, w))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), y) for c, y in zip(cols, (pa.int32(), pa.int32(), pa.string())))], ["doc", "s", "e", "surface"])

    return texts.select(id_col, text_col).mapInArrow(run, f"doc {kind}, s int, e int, surface string")
