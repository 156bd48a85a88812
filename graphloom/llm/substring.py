"""Substring dedup by level-wise doubling.

To find the windows of w words (50) that occur in a document of a smaller id, windows of growing length are
looked at (13, 25, 50 words); those that repeat at one length, in different documents, are the only ones that are
extended to the next, twice as long, until none survive or the full length is reached.

At the first length only one window inside each full window is looked at, its anchor: the one with the smallest
hash, the leftmost of equals. Equal full windows have equal anchors at equal places, so none is lost, and a document
has about one anchor for each w/3 words. Neighbouring full windows with one anchor form a run. At the lengths
between, the anchor is extended to the right where it stays inside the full window, else to the left; a run is cut
where that changes, so that all full windows of a run go on or end together.

At the full length a run is compared as a whole first: one that an earlier document has too is covered by it. Where
survivors with one extended anchor are of different runs, the first document of each run goes on: its full windows
are hashed, and the smallest id of each is found. A window in an earlier document is always also in the first
document of that one's run, so nothing is lost.

What is removed is decided by 128-bit hashes; shorter ones only choose candidates. All levels aggregate before they
shuffle, and the joins of rows with the repeated hashes are plain ones between two exchanges, which Spark divides at
run time where a passage of a third of all documents makes one hash hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import columns, gram_hashes, mix, some, texts
from graphloom.session import cut, prepare, stash

WINDOW = 50
#: The shortest first level; it is more than half of a level if the window is that short.
FIRST = 8
#: Words hashed together.
BLOCK = 1 << 18


def levels(window: int) -> list[int]:
    """Lengths of the levels: the window, and halves of it down to FIRST words or more."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= FIRST:
        out.insert(0, half)
    return out


def leftmost_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest of each n consecutive values is, the leftmost of equals; by doubling."""
    at, size = np.arange(len(x)), 1
    while size < n and len(at):
        step = min(size, n - size)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(x[b] < x[a], b, a)
        size += step
    return at


class Runs:
    """Full windows of a few texts: all starts in order, the runs they form, and the hashes of both."""

    def __init__(self, split: list[list[bytes]], window: int):
        lengths = levels(window)
        size = np.array([len(w) for w in split], np.int64)
        self.first = np.cumsum(size) - size  # word offset of each text
        n = int(size.sum())
        per = np.maximum(0, size - window + 1)
        #: text of each window, and its word offset
        self.text = np.repeat(np.arange(len(split)), per)
        self.start = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first, per)
        if not len(self.start):
            self.head = self.run = self.start
            self.hash, self.keys, self.code = np.zeros((2, 0), np.uint64), np.zeros((len(lengths) - 1, 0), np.uint64), np.zeros((2, 0), np.uint64)
            return
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for w in split for x in w]), ">u8").astype(np.uint64).reshape(n, 2).T
        self.hash = np.stack([gram_hashes(lane, window)[self.start] for lane in h])
        first, between = lengths[0], lengths[1:-1]
        grams = gram_hashes(h[0], first) if len(lengths) > 1 else None
        anchor = leftmost_least(grams, window - first + 1)[self.start] if len(lengths) > 1 else self.start
        to_right = [anchor + size <= self.start + window for size in between]
        changed = (anchor[1:] != anchor[:-1]) | (self.text[1:] != self.text[:-1])
        for right in to_right:
            changed |= right[1:] != right[:-1]
        #: first window of each run, and the run of each window
        self.head = np.flatnonzero(np.r_[True, changed])
        self.run = np.cumsum(np.r_[False, changed])
        at = anchor[self.head]
        keys = [grams[at]] if len(lengths) > 1 else []
        for size, right in zip(between, to_right, strict=True):
            right = right[self.head]
            keys.append(mix(gram_hashes(h[0], size)[np.where(right, at, at + first - size)] + right))
        #: of each run: its extended anchor at each level before the last; a hash of all its windows in order of level
        self.keys = np.array(keys, np.uint64).reshape(len(lengths) - 1, len(self.head))
        self.code = np.stack([mix(np.add.reduceat(mix(lane), self.head)) for lane in self.hash])

    def once(self, text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the (2, n) hashes are the first of their kind in their text."""
        order = np.lexsort((hashes[1], hashes[0], text))
        t, h = text[order], hashes[:, order]
        new = np.r_[True, (t[1:] != t[:-1]) | (h[:, 1:] != h[:, :-1]).any(axis=0)] if len(t) else np.zeros(0, bool)
        return np.sort(order[new])


def _blocks(rows: list, text_of) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows with their words, about BLOCK words at a time; one text is never divided."""
    held, words, n = [], [], 0
    for r in rows:
        w = (text_of(r) or b"").split()  # bytes split at ASCII white space, which is what a word ends at
        held.append(r)
        words.append(w)
        n += len(w)
        if n >= BLOCK:
            yield held, words
            held, words, n = [], [], 0
    if held:
        yield held, words


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row.

    Words are runs of characters other than ASCII white space, unchanged. Every word covered by a window of
    ``window`` words that also starts in a document with a smaller id is removed; ``kept`` joins the others by
    one blank. Repeats inside one document, and in rows that share an id, stay. Null and empty texts have no
    words; texts shorter than a window and rows with a null id stay whole. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    own = columns(docs, id_col, text_col)
    known = own.where("id is not null")
    names = [f"k{j}" for j in range(len(levels(window)) - 1)]

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            for rows, words in _blocks(list(zip(b.column(0).to_pylist(), texts(b), strict=True)), lambda r: r[1]):
                r = Runs(words, window)
                text = r.text[r.head]
                keep = r.once(text, r.code)
                ids = np.array([x[0] for x in rows], np.int64)
                yield pa.RecordBatch.from_arrays([*(_long(k[keep]) for k in r.keys), _long(r.code[0, keep]), _long(r.code[1, keep]), pa.array(ids[text[keep]])], [*names, "c0", "c1", "id"])

    alive = stash(known.mapInArrow(all_runs, ", ".join(f"{k} long" for k in [*names, "c0", "c1", "id"])))
    for name in names:
        again = cut(alive.groupBy(name).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(name))
        if again.isEmpty():
            alive = alive.limit(0)
            break
        alive = stash(alive.join(again, name))
    # the full length: the first document of each run, and which extended anchors have different runs
    last = names[-1:]
    variants = cut(alive.groupBy("c0", "c1", *last).agg(F.min("id").alias("first"), F.max("id").alias("last")))
    repeated = cut(variants.where("first < last").groupBy("c0", "c1").agg(F.min("first").alias("first")))
    covered = alive.join(repeated, ["c0", "c1"]).where("id > first").select("id", F.lit(True).alias("whole"), F.col("c0").alias("h"))
    if last:
        split = cut(variants.groupBy(*last).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*last))
        open_runs = variants.join(split, last)
    else:
        open_runs = variants.limit(0)  # windows without a shorter level are runs of their own
    open_runs = open_runs.groupBy(F.col("first").alias("id")).agg(F.collect_set("c0").alias("runs"))

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            for rows, words in _blocks(list(zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist(), strict=True)), lambda r: r[1]):
                r = Runs(words, window)
                code, owner = r.code[0].view(np.int64), r.text[r.head]
                wanted = np.zeros(len(code), bool)
                edge = np.searchsorted(owner, np.arange(len(rows) + 1))
                for k, x in enumerate(rows):
                    wanted[edge[k] : edge[k + 1]] = np.isin(code[edge[k] : edge[k + 1]], np.array(x[2], np.int64))
                at = np.flatnonzero(wanted[r.run]) if len(r.run) else r.run
                at = at[r.once(r.text[at], r.hash[:, at])]
                ids = np.array([x[0] for x in rows], np.int64)
                yield pa.RecordBatch.from_arrays([_long(r.hash[0, at]), _long(r.hash[1, at]), pa.array(ids[r.text[at]])], ["h0", "h1", "id"])

    windows = stash(known.join(open_runs, "id").select("id", "text", "runs").mapInArrow(open_windows, "h0 long, h1 long, id long"))
    least = cut(windows.groupBy("h0", "h1").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h0", "h1", "first"))
    single = windows.join(least, ["h0", "h1"]).where("id > first").select("id", F.lit(False).alias("whole"), F.col("h0").alias("h"))
    # inside one document 64 bits tell its runs and windows apart
    lists = covered.union(single).groupBy("id").agg(F.collect_list(F.when(F.col("whole"), F.col("h"))).alias("runs"), F.collect_list(F.when(~F.col("whole"), F.col("h"))).alias("windows"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            cols = [b.column(0).to_pylist(), texts(b), b.column(2).to_pylist(), b.column(3).to_pylist()]
            for rows, words in _blocks(list(zip(*cols, strict=True)), lambda r: r[1]):
                touched = [k for k, x in enumerate(rows) if x[2] or x[3]]
                r = Runs([words[k] for k in touched], window)
                code = r.code[0].view(np.int64)
                edge = np.searchsorted(r.text, np.arange(len(touched) + 1))
                removed = [0] * len(rows)
                for j, k in enumerate(touched):
                    part = slice(edge[j], edge[j + 1])
                    hit = np.isin(code[r.run[part]], np.array(rows[k][2], np.int64)) | np.isin(r.hash[0, part].view(np.int64), np.array(rows[k][3], np.int64))
                    cover = np.zeros(len(words[k]) + 1, np.int64)
                    at = r.start[part][hit] - r.first[j]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    removed[k] = int((~keep).sum())
                    words[k] = [w for w, x in zip(words[k], keep.tolist(), strict=True) if x]
                kept = [b" ".join(w) for w in words]
                n = [len(w) + d for w, d in zip(words, removed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    none = F.lit(None).cast("array<long>")
    judged = known.join(lists, "id", "left").select("id", "text", "runs", "windows")
    unknown = own.where("id is null").select("id", "text", none.alias("runs"), none.alias("windows"))
    return judged.union(unknown).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
