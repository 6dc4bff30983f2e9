"""P7: encoding by a public byte-level BPE tokenizer, through a deterministic tokenization automaton.

The automaton reads tokens. It starts with one state that allows every byte; each merge (left, right) -> new splits the
state behind ``left``: the copy has no arc ``right`` any more, and every state with an arc ``left`` gets an arc ``new`` to
the state behind ``right``. After all merges the automaton accepts exactly one token sequence for each string, the one that
the tokenizer gives. States are kept as (token, time) and the arcs of a state are found on demand and kept in a table, so
building takes one pass over the merges. Words are encoded left to right by table look-ups; arcs' labels give the text back.

Defined results: empty and null texts both give an empty array. Special tokens are ordinary text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The split of texts into words that the vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in a worker.
KEPT_WORDS = 300_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json where the public tokenizers are installed."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand = _byte_of()
        raw = {t: bytes(stand[c] for c in t) for t in model["vocab"] if all(c in stand for c in t)}
        self.label = {i: raw[t] for t, i in model["vocab"].items() if t in raw}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        v = model["vocab"]
        self.left, self.right = dict.fromkeys(self.label, -1), dict.fromkeys(self.label, -1)
        self.made = dict.fromkeys(self.label, 0)
        self.gadget: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges, 1):
            a_id, b_id, c_id = v[a], v[b], v[a + b]
            self.gadget[a_id, b_id] = time
            self.left[c_id], self.right[c_id], self.made[c_id] = a_id, b_id, time
        self.end = len(merges) + 1
        whole = {i for i, t in self.label.items() if len(t) == 1 or self.made[i]}
        self.token = {self.label[i]: i for i in whole}
        self.reach: dict[bytes, int] = {}
        for t in self.token:
            k = t[:2]
            if len(t) > self.reach.get(k, 1):
                self.reach[k] = len(t)
        self.table: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def arc(self, u: int, t: int) -> bool:
        """Whether the state behind token u has an arc t."""
        known = self.table.get((u, t))
        if known is not None:
            return known
        key, before, made, gadget = (u, t), self.end, self.made, self.gadget
        while True:
            time = gadget.get((u, t))
            if time is not None and time <= before:
                allowed = False
                break
            if made[u] > made[t]:  # the state behind u began as the one behind its right part, just before the merge
                u, before = self.right[u], made[u] - 1
            elif made[t] > made[u] or made[t]:  # the arc t came with its merge, where the left part had an arc
                t, before = self.left[t], min(before, made[t])
            else:
                allowed = True
                break
        self.table[key] = allowed
        return allowed

    def encode_word(self, word: bytes) -> list[int]:
        one = self.token.get(word)
        if one is not None:
            return [one]
        n = len(word)
        token, reach, table, arc = self.token, self.reach, self.table, self.arc
        last = [-1] * (n + 1)
        for s in range(n):
            u = last[s]
            for e in range(s + 1, min(n, s + reach.get(word[s : s + 2], 1)) + 1):
                if last[e] >= 0:
                    continue
                t = token.get(word[s:e])
                if t is not None and (s == 0 or (ok := table.get((u, t))) or (ok is None and arc(u, t))):
                    last[e] = t
        out, e = [], n
        while e:
            out.append(last[e])
            e -= len(self.label[last[e]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                if len(self.table) > 4 * KEPT_WORDS:
                    self.table.clear()
                ids = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    words[w] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> str:
        """The text of ids: the labels of the arcs, one after the other."""
        return b"".join(self.label[int(i)] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>): one row for each row of docs. One narrow pass, no shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            ids, ends = [], [0]
            for t in b.column(1).to_pylist():
                ids += a.encode(t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The columns keep and the number of tokens of the text; null texts have 0."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            sizes = pa.array([len(a.encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], sizes], [*keep, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{kinds}, `{name}` bigint")
