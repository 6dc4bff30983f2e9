"""P6: cutting oversized windows at natural boundaries, by a recursive hierarchy of separators.

Separators rank section, paragraph, sentence, word, character. A piece is packed greedily up to the limit and ends at the
last boundary of the highest rank that lies within reach; the next piece starts exactly ``overlap`` characters before that
end. Character cuts never part a base from its marks or the halves of a joined emoji, unless nothing else fits.

Defined results: null texts and texts within their limit are not cut (``split_windows`` gives them one piece, texts that
are null none); a profile without limits cuts nothing; an overlap of the limit or more counts as the limit less one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of units, from the largest to the smallest; a cut comes after the match.
SEPARATORS = (
    regex.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:(?:\r?\n|\r)[^\S\r\n]*){2,}|\f|(?:\r?\n|\r)(?=#{1,6} )|(?:\r?\n|\r)[-=*_]{3,}[^\S\r\n]*(?:\r?\n|\r)"),
    regex.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:\r?\n|\r)\s*"),
    regex.compile(r"(?:\r?\n|\r)|(?<![.!?…])[.!?…]++[\"'”’»)\]]*+\s++(?=[^\p{Ll}])|[。！？｡．؟۔।॥]+[」』”’»）)\]]*\s*"),
    regex.compile(r"\s+"),
)


def _joined(text: str, at: int) -> bool:
    """Whether a cut before text[at] would part one visible character."""
    a, b = text[at - 1], text[at]
    return unicodedata.category(b)[0] == "M" or a == "‍" or b in "‍️" or "\U0001f3fb" <= b <= "\U0001f3ff"


def cut_points(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of text."""
    n = len(text)
    if n <= most:
        return [(0, n)] if n else []
    overlap = max(0, min(overlap, most - 1))
    levels = [sorted({m.end() for m in s.finditer(text)} - {n}) for s in SEPARATORS]
    out, start = [], 0
    while n - start > most:
        reach, least = start + most, start + overlap + 1
        end = next((e for e in (_last(level, least, reach) for level in levels) if e), 0)
        if not end:
            end = reach
            while end > least and _joined(text, end):
                end -= 1
            if _joined(text, end):
                end = reach
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def _last(points: list[int], least: int, most: int) -> int:
    from bisect import bisect_right

    k = bisect_right(points, most)
    return points[k - 1] if k and points[k - 1] >= least else 0


def cut_windows(windows: DataFrame, limits: DataFrame, whole: bool = False) -> DataFrame:
    """(window_id, piece_no, n_pieces, from_char, to_char, piece): pieces of the windows over their limit, with offsets within the window's text; with whole, also those within."""
    w = windows.select("window_id", "profile", "text").join(F.broadcast(limits.select("profile", "max_chars", "overlap_chars")), "profile", "left" if whole else "inner")
    w = w.where(F.col("text").isNotNull())
    if not whole:
        w = w.where(F.length("text") > F.col("max_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, most, overlap in zip(*(c.to_pylist() for c in b.columns)):
                cuts = cut_points(text, most, overlap or 0) if most else [(0, len(text))]
                rows += [(i, k, len(cuts), s, e, text[s:e]) for k, (s, e) in enumerate(cuts)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _NAMES)

    return w.select("window_id", "text", "max_chars", "overlap_chars").mapInArrow(run, "window_id bigint, piece_no int, n_pieces int, from_char int, to_char int, piece string")


_NAMES = ["window_id", "piece_no", "n_pieces", "from_char", "to_char", "piece"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]


def locate_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(window_id, base): true start of each window's text in its document's raw_text, null where it isn't there.

    The delivered start holds if the text is there; else the occurrence found first counts, and for padded texts the one
    of the text without its blanks. Only windows are shuffled with the documents they name.
    """
    blank = r"^[\s\p{Z}\p{Cf}]+"
    w = windows.where(F.col("text").isNotNull()).select("window_id", "doc_id", "start_char", "text")
    j = w.join(docs.select("doc_id", "raw_text"), "doc_id")
    lead = F.length("text") - F.length(F.regexp_replace("text", blank, ""))
    bare = F.regexp_replace(F.regexp_replace("text", blank, ""), r"[\s\p{Z}\p{Cf}]+$", "")
    held = F.substring(F.col("raw_text"), F.col("start_char") + 1, F.length("text")) == F.col("text")
    first = F.expr("instr(raw_text, text)")
    first_bare = F.instr(F.col("raw_text"), bare)
    base = F.when(held, F.col("start_char")).when(first > 0, first - 1).when((F.length(bare) > 0) & (first_bare > 0), first_bare - 1 - lead)
    return j.select("window_id", base.cast("int").alias("base"))


def split_windows(windows: DataFrame, limits: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(window_id, piece_no, n_pieces, start_char, end_char, located, text) of all windows with a text.

    start_char and end_char count in the document's raw_text where the window could be located there, else in the
    window's own text (located is false).
    """
    pieces = cut_windows(windows, limits, whole=True)
    if docs is None:
        placed = pieces.withColumn("base", F.lit(None).cast("int"))
    else:
        placed = pieces.join(locate_windows(windows, docs), "window_id", "left")
    shift = F.coalesce("base", F.lit(0))
    # a padded window may start before its document does
    return placed.select("window_id", "piece_no", "n_pieces", F.greatest(F.lit(0), F.col("from_char") + shift).alias("start_char"), F.greatest(F.lit(0), F.col("to_char") + shift).alias("end_char"), F.col("base").isNotNull().alias("located"), F.col("piece").alias("text"))
