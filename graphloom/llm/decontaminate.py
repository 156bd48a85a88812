"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For every length that benchmark items have, windows of as many words are compared with the items of that length:

1. Positions of a document whose word shingle occurs in any item. A window of similarity 0.8 or more shares at least
   0.8 / 1.8 of both windows' shingles with its item, so windows with fewer such positions are not fingerprinted
   (no loss, and nearly all of a clean corpus ends here).
2. SimHash of each window left, from running bit counts. Candidate items come from a multi-index: 64 bits in radius
   + 1 blocks, of which two fingerprints within the radius agree on one at least; those within the radius stay.
3. Exact weighted (multiset) Jaccard similarity of the shingles.

The radius of 24 bits lies five deviations above the 9.7 bits expected at similarity 0.8.
The benchmark is sent to executors in blocks of bounded size; a larger one takes more passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import columns, gram_hashes, map_rows, mix, some, texts
from graphloom.session import prepare

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Words of benchmark text sent to the executors at once (about 120 bytes each there).
BLOCK_WORDS = 1_000_000
#: Window starts fingerprinted at once.
WINDOWS = 1 << 14
#: Bits of the first, approximate membership table.
TABLE_BITS = 22


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each row of bit counts over n shingles."""
    return ((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Shelf:
    """The items of one shingle length and one length in words, with their multi-index."""

    def __init__(self, radius: int):
        self.radius = radius
        self.items: list[int] = []
        self.counts: list[Counter] = []
        self.fps = np.zeros(0, np.uint64)
        width = [len(x) for x in np.array_split(np.arange(64), radius + 1)]
        self.blocks = [(np.uint64(sum(width[:k])), np.uint64((1 << w) - 1)) for k, w in enumerate(width)]
        self.index: list[dict[int, np.ndarray]] = []

    def close(self) -> None:
        for at, mask in self.blocks:
            value = (self.fps >> at) & mask
            self.index.append({int(v): np.flatnonzero(value == v) for v in np.unique(value)})

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of fps, item) of all that are within the radius, in order."""
        agree = np.zeros((len(fps), len(self.items)), bool)
        for (at, mask), by in zip(self.blocks, self.index, strict=True):
            value = (fps >> at) & mask
            for v, found in by.items():
                rows = np.flatnonzero(value == np.uint64(v))
                if len(rows):
                    agree[np.ix_(rows, found)] = True
        rows, found = np.nonzero(agree)
        close = np.bitwise_count(fps[rows] ^ self.fps[found]) <= self.radius
        return rows[close], found[close]


class Items:
    """Index of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, bytes]], shingle: int = SHINGLE, radius: int = RADIUS):
        self.shelves: dict[int, dict[int, Shelf]] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item, text in rows:
            h = word_hashes(text)
            if not len(h):
                continue
            g = min(shingle, len(h))
            s = gram_hashes(h, g)
            shelf = self.shelves.setdefault(g, {}).setdefault(len(h), Shelf(radius))
            shelf.items.append(item)
            shelf.counts.append(Counter(s.tolist()))
            shelf.fps = np.r_[shelf.fps, _fingerprints(_bits(s).sum(axis=0, dtype=np.int64)[None], len(s))]
            known.setdefault(g, []).append(s)
        for by in self.shelves.values():
            for shelf in by.values():
                shelf.close()
        self.members = {}
        for g, found in known.items():
            keys = np.unique(np.concatenate(found))
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(mix(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.members[g] = keys, table

    def hits(self, g: int, s: np.ndarray) -> np.ndarray:
        """Positions whose shingle some item has."""
        keys, table = self.members[g]
        maybe = np.flatnonzero(table[(mix(s) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, s[maybe]), len(keys) - 1)
        return maybe[keys[k] == s[maybe]]

    def find(self, text: bytes | None, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float, int]]:
        """(item id, start word of the best window, windows found, its similarity, its distance)."""
        h, out = word_hashes(text), []
        for g, shelves in self.shelves.items():
            s = gram_hashes(h, g)
            pos = self.hits(g, s)
            for words, shelf in shelves.items() if len(pos) else ():
                size = min(words, len(h)) - g + 1  # shingles of a window
                a = words - g + 1
                need = similarity * (a + size) / (1 + similarity) - 1e-9
                if size < 1 or len(pos) < need:
                    continue
                # windows that start before a hit and hold as many as needed: the need-th hit from there is inside
                last = pos[int(np.ceil(need)) - 1 :] if need > 0 else pos
                first = pos[: len(last)]
                near = first + size > last
                if not near.any():
                    continue
                starts = np.unique((last[near, None] - np.arange(size)[None]).ravel()) if near.sum() * size < 1 << 20 else np.arange(pos[0] - size + 1, pos[-1] + 1)
                starts = starts[(starts >= 0) & (starts + size <= len(s))]
                starts = starts[np.searchsorted(pos, starts + size) - np.searchsorted(pos, starts) >= need]
                best: dict[int, tuple] = {}
                fps = window_fingerprints(s, starts, size)
                for at in range(0, len(starts), WINDOWS):
                    piece, row_before = None, -1
                    for row, k in zip(*(x.tolist() for x in shelf.near(fps[at : at + WINDOWS])), strict=True):
                        start, fp = int(starts[at + row]), fps[at + row]
                        if row != row_before:
                            piece, row_before = Counter(s[start : start + size].tolist()), row
                        both = sum((piece & shelf.counts[k]).values())
                        score = both / (a + size - both)
                        if score >= similarity:
                            old = best.get(k)
                            far = int(np.bitwise_count(fp ^ shelf.fps[k]))
                            best[k] = (start, 1, score, far) if old is None else (start, old[1] + 1, score, far) if score > old[2] else (old[0], old[1] + 1, *old[2:])
                out += [(shelf.items[k], *found) for k, found in best.items()]
        return out


def window_fingerprints(s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` hashes at the starts, by running bit counts over blocks of positions."""
    out = np.zeros(len(starts), np.uint64)
    block = max(WINDOWS, size)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = int(np.searchsorted(starts, first + block))
        ones = np.zeros((int(starts[to - 1]) - first + size + 1, 64), np.int32)
        np.cumsum(_bits(s[first : first + len(ones) - 1]), axis=0, out=ones[1:])
        k = starts[at:to] - first
        out[at:to] = _fingerprints(ones[k + size] - ones[k], size)
        at = to
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; they stream through the driver, one block at a time."""
    block, words = [], 0
    for row in columns(benchmark, id_col, text_col).where("id is not null and text is not null").toLocalIterator():
        block.append((row.id, row.text.encode()))
        words += row.text.count(" ") + row.text.count("\n") + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start, windows, similarity, distance) for each document and item that it holds.

    ``start`` is the first word of the most similar window (the first one of equals), ``windows`` how many
    windows reach the similarity. Words are lower-cased (A-Z) runs between ASCII white space. A document
    shorter than an item is one window; an item of fewer words than a shingle must occur whole. Null and
    empty texts and items match nothing; null item ids are left out, null doc ids come out as null;
    repeated rows are reported each; empty tables give no rows.
    """
    spark = prepare(docs.sparkSession)
    schema = "doc_id long, item_id long, start long, windows long, similarity double, distance int"

    def scan(block: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(block, shingle))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in some(batches):
                rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), texts(b), strict=True) for x in shared.value.find(t, similarity)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.float64(), pa.int32()), strict=True)], ["doc_id", "item_id", "start", "windows", "similarity", "distance"])

        return columns(docs, id_col, text_col).mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [scan(b) for b in _blocks(benchmark, item_col, item_text)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` in which no window is similar to an item; columns unchanged, no shuffle.

    Null and empty texts and null ids stay; repeated rows are judged alike; an empty benchmark drops nothing.
    """
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(Items(block, shingle))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in some(batches):
                yield b.filter(pa.array([not shared.value.find(t, similarity) for t in texts(b, f"c{at}")], pa.bool_()))

        docs = map_rows(docs, run)
    return docs
