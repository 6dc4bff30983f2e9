"""P5: duplicates hidden by formatting differences, by Merkle-style digests of nested records.

A record is a tree: a form text is an unordered node over its ``label: value`` fields, a JSON object one over its members,
whose values may be objects, unordered as well, and lists, which keep their order; any other text is a single leaf. Leaves
are normalised (letters, marks and digits only, upper case, so that ß equals SS) and hashed; a node's digest is that of its
children's digests, sorted where it is unordered. Records with one root digest form a group. The members of groups, and they
alone, are then compared in full, structure and leaves, with the representative of their group.

Texts stay where they are: what is shuffled are digests, and the normalised records of the members. Which records these are
is told to the workers by a filter of fixed size over the digests of groups, and so is which groups are hot.

Defined results: null texts, and texts with fewer than ``min_chars`` letters, marks and digits, belong to no group.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .wordfilter import WordFilter, filter_segments

MIN_CHARS = 20
#: Fields that make a form where every piece between separators is one, and where pieces may go on over separators.
MIN_FIELDS, FORM_FIELDS = 2, 4
HOT_COPIES = 10_000
SALTS = 32
#: A label in a form: short words without sentence marks, two at most, or three where every piece is a field.
_WORD = r"[\p{L}\p{M}\p{Nd}'-]{1,18}"
_LABEL, _LABEL3 = (rf"[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}\p{{Nd}}'-]{{0,18}}(?:[ .]{_WORD}){{0,{n}}}[\s\p{{Cf}}]*[:：]" for n in (1, 2))
_FIELD, _FIELD3 = (regex.compile(rf"[\s\p{{Cf}}]*({x})(.*)", regex.S) for x in (_LABEL, _LABEL3))
#: Separators of the layouts, tried in turn; and where they stand before a label.
_SEPARATORS = tuple(map(regex.compile, (r"\s\|(?=\s)", r";(?=\s)", r"[\r\n]+")))
_CUTS = tuple(regex.compile(rf"(?:{sep.pattern})[\s\p{{Cf}}]*(?={_LABEL})") for sep in _SEPARATORS)
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")


def fold(text: str) -> str:
    """Letters, marks and digits in upper case; every other character goes."""
    return _OTHER.sub("", text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).upper()


def _node(value) -> str:
    """Canonical form of a JSON value. Folded leaves have none of the marks that it is made of."""
    if isinstance(value, dict):
        return "{" + ",".join(sorted(f"{fold(str(k))}:{_node(v)}" for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_node, value)) + "]"
    return fold(value if isinstance(value, str) else json.dumps(value))


def _fields(text: str) -> list[tuple[str, str]] | None:
    """Label and canonical value of each field of a form text, else null. Pieces without a label of their own belong to the field before."""
    body = text.strip("\ufeff\u200b \t\r\n\xa0\u3000")
    if body.startswith("{") and body.endswith("}"):
        try:
            record = json.loads(body, strict=False)
            return [(fold(str(k)), _node(v)) for k, v in record.items()] if isinstance(record, dict) else None
        except (ValueError, RecursionError):
            return None
    if body.count(":") + body.count("：") < MIN_FIELDS or not _FIELD3.match(body):
        return None
    for sep in _SEPARATORS:
        found = [None if "\n" in p or "\r" in p else _FIELD3.match(p) for p in sep.split(body)]
        if len(found) >= MIN_FIELDS and all(found):
            return [(fold(m[1]), fold(m[2])) for m in found]
    for cut in _CUTS:
        pieces = cut.split(body)
        if len(pieces) >= FORM_FIELDS:
            found = [_FIELD.match(p) for p in pieces]
            return [(fold(m[1]), fold(m[2])) for m in found] if all(found) else None
    return None


def leaves(text: str) -> list[str]:
    """Normalised children of a record: sorted fields of a form with labels of their own, one leaf for any other text."""
    fields = _fields(text)
    if fields and len(fields) >= MIN_FIELDS and len({k for k, _ in fields}) == len(fields):
        return sorted(f"{k}:{v}" for k, v in fields)
    return [fold(text)]


_INSIDE = regex.compile(r"[{}\[\],:]")


def _digest(node: str) -> bytes:
    """Digest of a canonical child, bottom-up: those of its parts, in order, under its marks."""
    hashed = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()
    if not _INSIDE.search(node):
        return hashed(node)
    return hashlib.sha256(b"".join(hashed(x) for x in regex.splititer(r"([{}\[\],:])", node))).digest()


def root_digest(parts: list[str]) -> bytes:
    """Digest of the unordered node over the sorted digests of its children."""
    return hashlib.sha256(b"".join(sorted(map(_digest, parts)))).digest()


def _digests(docs: DataFrame, id_col: str, text_col: str, min_chars: int, groups: WordFilter | None = None) -> DataFrame:
    """(id, root) of all records long enough to compare; with a filter of groups (id, root, slice, leaves) of those in groups, hot groups in slices."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(groups)  # of fixed size
    names = ["id", "root", "slice", "leaves"][: 2 if groups is None else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, roots, slices, whole = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                parts = leaves(t)
                if sum(sum(map(str.isalnum, p)) if len(parts) > 1 else len(p) for p in parts) < min_chars:
                    continue
                root = root_digest(parts)
                if sent.value is not None:
                    name = root.hex().upper()
                    if not sent.value.has("group", name):
                        continue
                    slices.append(xxhash.xxh32_intdigest(str(b.column(0)[k])) % SALTS if sent.value.has("hot", name) else 0)
                    whole.append("\n".join(parts))
                keep.append(k)
                roots.append(root)
            columns = [b.column(0).take(pa.array(keep, pa.int64())), pa.array(roots, pa.binary()), pa.array(slices, pa.int32()), pa.array(whole, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, root binary" + ", slice int, leaves string" * (groups is not None))


def _sliced(rows: DataFrame, groups: WordFilter) -> DataFrame:
    """Rows with a root, once for each slice of its group, as the filter tells."""
    sent = rows.sparkSession.sparkContext.broadcast(groups)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([SALTS if sent.value.has("hot", r.hex().upper()) else 1 for r in b.column(b.schema.get_field_index("root")).to_pylist()], np.int64)
            at = np.repeat(np.arange(b.num_rows), n)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array((np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))], [*b.schema.names, "slice"])

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", slice int")


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """(root, rep, copies) of each group of two or more records: smallest id and number of records. Partial counts before the shuffle."""
    g = digests.groupBy("root").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("id").alias("last"))
    return g.where("copies > 1 and rep <> last").drop("last")


def duplicate_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy_id): one row per further copy of the record with the smallest id, confirmed by comparing the records.

    Both joins are by root and slice, so no task gets a whole hot group.
    """
    groups = stage_table(duplicate_groups(_digests(docs, id_col, text_col, min_chars)), "groups")
    kinds = [groups.select(F.lit("group").alias("kind"), F.col("root").alias("word")), groups.where(F.col("copies") > HOT_COPIES).select(F.lit("hot").alias("kind"), F.col("root").alias("word"))]
    told = WordFilter(filter_segments(kinds[0].union(kinds[1])))
    found = _digests(docs, id_col, text_col, min_chars, told).join(_sliced(groups.select("root", "rep"), told), ["root", "slice"])
    members = stage_table(found, "members")
    first = members.where("id = rep").select("root", F.col("leaves").alias("rep_leaves")).distinct()
    out = members.where("id <> rep").join(_sliced(first, told), ["root", "slice"]).where("leaves = rep_leaves")
    return out.select(F.col("rep").alias("doc_id"), F.col("id").alias("copy_id")).distinct()


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copies): one row per distinct record. Records too short to compare stay as they are, with one copy."""
    further = duplicate_members(docs, id_col, text_col, min_chars)
    counts = further.groupBy("doc_id").agg((F.count(F.lit(1)) + 1).alias("copies"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    kept = ids.join(further.select(F.col("copy_id").alias("doc_id")), "doc_id", "left_anti")
    return kept.join(counts, "doc_id", "left").select("doc_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
