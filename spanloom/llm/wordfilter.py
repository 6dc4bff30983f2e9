"""Words by class in a Bloom filter of one size for every corpus, so that what workers hold doesn't grow with its vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose answers a worker remembers.
KEPT = 200_000


class WordFilter:
    """Whether a word belongs to a class. No word is lost; with 2**BITS places and HASHES of them for each word, 10 million
    words make under 1 in 200 other words pass for one, and a million under 1 in 10**6."""

    BITS, HASHES, SEGMENT = 27, 4, 20

    def __init__(self, segments: Iterable[tuple[int, bytes]] = ()):
        self.rows = np.zeros(1 << (self.BITS - 3), np.uint8)
        width = 1 << (self.SEGMENT - 3)
        for k, part in segments:
            self.rows[k * width : (k + 1) * width] = np.frombuffer(part, np.uint8)
        self.known: dict[tuple[str, str], bool] = {}

    @classmethod
    def places(cls, kind: str, word: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(f"{kind}|{word}".encode("utf-8", "surrogatepass"))
        return [(h >> (cls.BITS * k)) & ((1 << cls.BITS) - 1) for k in range(cls.HASHES)]

    def has(self, kind: str, word: str) -> bool:
        found = self.known.get((kind, word))
        if found is None:
            if len(self.known) > KEPT:
                self.known.clear()
            found = self.known[kind, word] = all(self.rows[p >> 3] >> (p & 7) & 1 for p in self.places(kind, word))
        return found

    def __getstate__(self):
        return self.rows

    def __setstate__(self, rows) -> None:
        self.rows, self.known = rows, {}


def filter_segments(words: DataFrame) -> list[tuple[int, bytes]]:
    """Segments of the filter of (kind, word), binary words as their hex digits: places are set on the workers; the driver gets the filter's bytes, whatever the number of words."""
    segment = (1 << WordFilter.SEGMENT) - 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([p for k, w in zip(*(c.to_pylist() for c in b.columns)) for p in WordFilter.places(k, w)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> WordFilter.SEGMENT).astype(np.int32)), pa.array((at & segment).astype(np.int32))], ["segment", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column(1):
                bits = np.zeros(segment + 1, bool)
                bits[places.values.to_numpy()] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["segment", "bits"])

    text = F.col("word") if dict(words.dtypes)["word"] == "string" else F.hex("word")
    places = words.select("kind", text.alias("word")).mapInArrow(spread, "segment int, place int").groupBy("segment").agg(F.collect_set("place").alias("places"))  # at most 2**SEGMENT places
    return [(r[0], bytes(r[1])) for r in places.mapInArrow(pack, "segment int, bits binary").collect()]
