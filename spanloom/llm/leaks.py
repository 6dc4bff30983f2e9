"""P2: passages of held-out items in the corpus, by spaced-seed hashing.

Texts are reduced to their letters, marks and digits in folded case. A seed is a fixed mask over SPAN consecutive
characters of which some positions are ignored; the hashes of all windows of the items, one set per mask, meet the hashes
of all windows of the documents. A passage of a mask's length or more equal characters always gives a hit, and one with a
replaced character still gives hits under the masks that ignore its place. Along the shifts of the hits the overlap is
verified, tolerating replaced characters; ``leaked_items`` then asks for equal passages besides, ``tolerant_overlaps`` doesn't.
Items in Chinese, Japanese and Korean, whose passages are shorter, have shorter masks.

The items are taken in blocks of bounded size; each block is one narrow pass over the documents, whose texts never move.
Defined results: null or empty texts and items give no rows; equal items each give their own rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Masks over consecutive characters: 1 counts, 0 is ignored (fixed values). For alphabets, and for Chinese, Japanese and Korean.
MASKS = ("11101100101101110111", "11011011110100110111", "10111010011111011011")
MASKS_CJK = ("110110100111", "111010011011", "101110110101")
#: Part of a passage's characters that must be the same.
EQUAL = 0.9
#: Hits along one shift, and those for each character of the wanted share, below which a pair isn't looked at.
LEAST_HITS, HITS_PER_CHAR = 2, 0.08
PASSAGE, PASSAGE_CJK = 50, 20
SHARE = 0.5
#: Characters of items in one block; its index has at most three hashes for each.
BLOCK_CHARS = 2_000_000
_BITS = 22
_DROP = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+").sub


def squeeze(text: str) -> str:
    """Letters, marks and digits in folded case."""
    return _DROP("", text).casefold()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def seed_hashes(codes: np.ndarray, mask: str, salt: int, stride: int = 1) -> np.ndarray:
    """One hash for each window of len(mask) codes, or each stride-th; the mask's zeros are ignored."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full((n + stride - 1) // stride, 0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    wide, factor = codes.astype(np.uint64), np.uint64(0x100000001B3)
    for k, bit in enumerate(mask):
        if bit == "1":
            h *= factor
            h ^= wide[k : k + n : stride]
            h += h << np.uint64(7)
    h ^= h >> np.uint64(29)
    return h


class SeedIndex:
    """Hashes of all windows of items with one least passage, under each mask.

    Without tolerance a document's windows are looked up at every stride-th place, so that each passage of the least length
    still has three or more of them; with it at every place.
    """

    def __init__(self, items: list[tuple[int, str]], least: int, masks: tuple[str, ...] = MASKS, tolerant: bool = False):
        self.masks, self.least, self.span = masks, least, len(masks[0])
        self.stride = 1 if tolerant else max(1, (least - self.span + 1) // 4)
        #: Hits along one shift that a passage has at least: with equal passages those of all masks at each place looked up.
        self.tolerant, self.least_hits = tolerant, LEAST_HITS if tolerant else len(masks) * ((least - self.span + 1) // self.stride)
        self.ids = [i for i, _ in items]
        self.codes = [_codes(squeeze(t)) for _, t in items]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.tables = []
        for m, mask in enumerate(masks):
            parts = [seed_hashes(c, mask, m) for c in self.codes]
            h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else np.empty(0, np.int32)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((h[order], owner[order], place[order], seen))

    def hits(self, codes: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and shift of all hits under mask m; the shift is the place in the document less the place in the item."""
        starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        (keys, owner, place, seen), mask = self.tables[m], self.masks[m]
        h = seed_hashes(flat, mask, m, self.stride)
        at = np.flatnonzero(seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(keys, h[at], "left")
        lo[lo == len(keys)] = 0
        same = keys[lo] == h[at] if len(keys) else np.zeros(len(at), bool)
        at, lo = at[same], lo[same]
        hi = np.searchsorted(keys, h[at], "right")
        at = at * self.stride
        doc = np.searchsorted(starts, at, "right") - 1
        good = at + len(mask) <= starts[doc + 1]
        at, doc, lo, n = at[good], doc[good], lo[good], (hi - lo)[good]
        each = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        return doc, owner[each].astype(np.int64), at - starts[doc] - place[each]

    def candidates(self, codes: list[np.ndarray], share: float) -> list[tuple[int, int, np.ndarray]]:
        """Documents, items and shifts whose hits may cover that share of the item. Pairs with equal passages of that share are all there."""
        found = [self.hits(codes, m) for m in range(len(self.masks))]
        doc, item, shift = (np.concatenate([f[j] for f in found]) for j in range(3))
        if not len(doc):
            return []
        width = np.int64(1) << np.int64(32)
        pair = doc * len(self.ids) + item
        key, n = np.unique(pair * width + (shift + (width >> np.int64(1))), return_counts=True)
        key, n = key[n >= self.least_hits], n[n >= self.least_hits]
        pair, shift = np.divmod(key, width)
        shift -= width >> np.int64(1)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(first):
            return []
        d, i = np.divmod(pair[first], len(self.ids))
        ends = np.append(first[1:], len(pair))
        if self.tolerant:
            reach, need = np.add.reduceat(n, first), HITS_PER_CHAR * share * self.sizes[i]
        else:  # so many characters the passages of a shift can have at most
            most = self.stride * n / len(self.masks) + (self.span + self.stride - 2) * (n // self.least_hits)
            reach, need = np.add.reduceat(most, first), share * self.sizes[i]
        good = np.flatnonzero(reach >= need)
        return [(int(d[g]), int(i[g]), shift[first[g] : ends[g]]) for g in good]

    def shares(self, item: int, text: np.ndarray, shifts: np.ndarray) -> tuple[float, float]:
        """Shares of the item's characters in passages of the least length with EQUAL of them the same, and with all of them, along the shifts."""
        t, least = self.codes[item], self.least
        need = (math.ceil(EQUAL * least), least)
        covered = [np.zeros(len(t), bool), np.zeros(len(t), bool)]
        for s in shifts.tolist():
            a, b = max(0, -s), min(len(t), len(text) - s)
            if b - a < least:
                continue
            run = np.concatenate([[0], np.cumsum(t[a:b] == text[a + s : b + s])])
            same = run[least:] - run[:-least]
            for c, enough in zip(covered, need):
                good = np.flatnonzero(same >= enough)
                if len(good):
                    edge = np.bincount(good, minlength=b - a + 1) - np.bincount(good + least, minlength=b - a + 1)
                    c[a:b] |= np.cumsum(edge)[:-1] > 0
        return tuple(float(c.mean()) if len(c) else 0.0 for c in covered)


def item_blocks(items: DataFrame, id_col: str, text_col: str, lang_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Lists of (id, text, lang) with at most block_chars characters each (a longer item is a block of its own)."""
    block, size = [], 0
    for row in items.select(id_col, text_col, lang_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[1])
    if block:
        yield block


def _scan(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, tolerant: bool, share: float, item_type: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters
    names = ["item_id", id_col, "share"]
    doc_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cjk = [bool(lang) and lang.lower()[:2] in ("zh", "ja", "ko") for _, _, lang in sent.value]
        indexes = [SeedIndex([x[:2] for x, c in zip(sent.value, cjk) if c == kind], least, masks, tolerant) for kind, least, masks in ((False, PASSAGE, MASKS), (True, PASSAGE_CJK, MASKS_CJK))]
        for b in batches:
            for ids, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, rows = [_codes(t) for t in texts], []
                for x in indexes:
                    for d, i, shifts in x.candidates(codes, share):
                        near, equal = x.shares(i, codes[d], shifts)
                        found = near if tolerant else min(near, equal)
                        if found >= share:
                            rows.append((x.ids[i], ids[d], found))
                cols = [list(c) for c in zip(*rows)] or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kinds = [_arrow(item_type), _arrow(doc_type), pa.float64()]
    return docs.select(id_col, text_col).mapInArrow(run, f"item_id {item_type}, `{id_col}` {doc_type}, share double")


def _chunks(ids: list, texts: list, most: int = 400_000) -> Iterator[tuple[list, list[str]]]:
    """Squeezed texts of a batch in parts of about ``most`` characters, a longer text being a part of its own."""
    part, kept, size = [], [], 0
    for i, t in zip(ids, texts):
        if t:
            part.append(i)
            kept.append(squeeze(t))
            size += len(kept[-1])
            if size >= most:
                yield part, kept
                part, kept, size = [], [], 0
    if part:
        yield part, kept


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", item_col: str = "item_id", item_text: str = "text", lang_col: str = "lang", share: float = SHARE, tolerant: bool = False) -> DataFrame:
    """(item_id, id, share) of each document that holds at least ``share`` of an item in long enough passages."""
    kind = items.schema[item_col].dataType.simpleString()
    parts = [_scan(docs, b, id_col, text_col, tolerant, share, kind) for b in item_blocks(items, item_col, item_text, lang_col)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, share double")
    return reduce(DataFrame.unionByName, parts)


def tolerant_overlaps(docs: DataFrame, items: DataFrame, share: float = SHARE, **columns) -> DataFrame:
    """As leaked_items, but one in ten characters of a passage may be another one.

    Hits at every place and under every mask find such passages; of passages of the least length with one in ten characters
    replaced at random, 0.97 are found, of longer ones more (``tests/llm`` measures it).
    """
    return leaked_items(docs, items, share=share, tolerant=True, **columns)
