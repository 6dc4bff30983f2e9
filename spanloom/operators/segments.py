"""Cutting texts into paragraphs, windows and bounded segments, and token labels into spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_text


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no, s, e, text) of the lines with any visible character, trimmed; offsets in the text."""
    pieces = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    w = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    lead = F.length("line") - F.length(F.regexp_replace("line", r"^[\s\p{Z}]+", ""))
    bare = strip_text(F.col("line"))
    return placed.where(F.length(bare) > 0).select("doc", "no", (F.col("at") + lead).cast("int").alias("s"), (F.col("at") + lead + F.length(bare)).cast("int").alias("e"), bare.alias("text"))


def slices(df: DataFrame, id_col: str, text_col: str, size: int, step: int) -> DataFrame:
    """(doc, no, s, e, text): windows of ``size`` characters every ``step``; the last reaches the end of the text."""
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    x = df.where(n > 0).select(F.col(id_col).alias("doc"), F.col(text_col).alias("_t"), F.posexplode(F.sequence(F.lit(0), last)).alias("no", "k"))
    s = F.col("k") * step
    return x.select("doc", "no", s.alias("s"), F.least(s + size, F.length("_t")).alias("e"), F.substring(F.col("_t"), s + 1, F.lit(size)).alias("text"))


def context(parts: DataFrame) -> DataFrame:
    """Parts (doc, no, text) with the text before and after in the same document."""
    w = Window.partitionBy("doc").orderBy("no")
    return parts.withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w))


def bounded_segments(df: DataFrame, id_col: str, text_col: str, spans_col: str, most: int) -> DataFrame:
    """(doc, no, s, e): segments of at most ``most`` characters that end after a line break or full stop where there is one.

    A segment is longer only where a protected span would be cut. The segments of a text, joined, are the text.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, (text, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for no, (s, e) in enumerate(cut_segments(text or "", [(x["start_char"], x["end_char"]) for x in spans or []], most)):
                    at.append(k)
                    rows.append((no, s, e))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), pa.int32()) for c in cols)], ["doc", "no", "s", "e"])

    return df.select(id_col, text_col, spans_col).mapInArrow(run, f"doc {kind}, no int, s int, e int")


def cut_segments(text: str, protected: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Cuts at the last natural boundary within reach, else at the limit, moved to the end of the protected stretch that it would part."""
    n = len(text)
    inner = np.zeros(n + 2, np.int32)  # places strictly inside a protected span
    for a, b in protected:
        if a is not None and b is not None and 0 <= a < b <= n and b - a > 1:
            inner[a + 1] += 1
            inner[b] -= 1
    closed = np.cumsum(inner)[: n + 1] > 0
    free = np.flatnonzero(~closed)
    natural = np.array(sorted({m.end() for m in _BOUNDARY.finditer(text)}), np.int64)
    out, s = [], 0
    while s < n:
        e = min(n, s + most)
        if e < n:
            near = natural[np.searchsorted(natural, s, "right") : np.searchsorted(natural, e, "right")]
            e = int(near[-1]) if len(near) else e
            e = int(free[np.searchsorted(free, e)])
        out.append((s, e))
        s = e
    return out


_BOUNDARY = re.compile(r"\n|\. ")


def token_spans(tokens: DataFrame) -> DataFrame:
    """(doc, s, e, label) of BIO labels. tokens: (doc, no, token, tag), one row per token; the text is the tokens joined by one blank.

    An I tag without a span of its label before it begins one.
    """
    w = Window.partitionBy("doc").orderBy("no")
    t = tokens.withColumn("s", F.coalesce(F.sum(F.length("token") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    t = t.withColumn("e", F.col("s") + F.length("token")).withColumn("label", F.when(F.col("tag") != "O", F.substring_index("tag", "-", -1))).withColumn("head", F.substring("tag", 1, 1))
    begins = (F.col("head") == "B") | (F.col("label") != F.coalesce(F.lag("label").over(w), F.lit("")))
    t = t.withColumn("span", F.sum(F.when(F.col("label").isNotNull() & begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("label is not null").groupBy("doc", "span", "label").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("span")
