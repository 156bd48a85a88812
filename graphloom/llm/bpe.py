"""Byte-level BPE by merge replay over the distinct pieces of a corpus block.

An inverted index maps each merge to the positions of its pair over all words at once. Merges are taken in
rank order; each is applied at all its positions in one step, leftmost first where they overlap, and only
the pairs beside a merged one are looked up and indexed anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import columns, strings
from graphloom.llm.pieces import SPACE, Pieces, gathered
from graphloom.session import prepare

#: Bytes of text whose pieces are replayed together; the lists and arrays of a block take some 50 times that.
CHUNK = 3 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found[a * self.size + b] = rank
        self.pairs = np.array(sorted(found), np.int64)
        self.pair_rank = np.array([found[k] for k in self.pairs.tolist()], np.int64)
        # tokens of which a pair merges at a lower rank than they do themselves: there, order within a word counts
        self.unsafe = np.zeros(self.size, bool)
        for part in (self.pairs // self.size, self.pairs % self.size):
            self.unsafe[part[self.pair_rank < part]] = True
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1)

    def _one(self, word: bytes) -> list[int]:
        """The same by the definition, for the words in which a later merge outranks an earlier one."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None) if any(parts[i] + parts[i + 1] in self.ranks for i in range(len(parts) - 1)) else None
            if best is None:
                return [self.ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (non-empty), as little-endian 32-bit integers."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        n = int(end[-1])
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[end - 1], left[end - size] = n, -1
        rank = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(right < n)
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        odd: list[np.ndarray] = []

        def enter(at: np.ndarray) -> None:
            value = rank[at]
            at = at[value >= 0]
            if len(at):
                value = rank[at]
                order = np.argsort(value)
                value, at = value[order], at[order]
                cuts = (np.flatnonzero(value[1:] != value[:-1]) + 1).tolist()
                for a, b, r in zip([0, *cuts], [*cuts, len(at)], value[[0, *cuts]].tolist(), strict=True):
                    if r in index:
                        index[r].append(at[a:b])
                    else:
                        index[r] = [at[a:b]]
                        heapq.heappush(waiting, r)

        enter(inner)
        while waiting:
            r = heapq.heappop(waiting)
            lists = index.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:  # where pairs overlap, every other one of a chain, from the left
                rank[at] = -2
                if (rank[right[at]] == -2).any():
                    at = np.unique(at)
                    chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
                    place = np.arange(len(at))
                    since = place - np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[since % 2 == 0]
            gone = right[at]
            beyond = right[gone]
            if self.unsafe[r]:  # one merge at this rank could let a lower rank in before the next one
                for side, first in ((left[at], True), (beyond, False)):
                    near = np.flatnonzero((side >= 0) & (side < n))
                    other = sym[side[near]]
                    value = self._rank(other, np.full(len(near), r)) if first else self._rank(np.full(len(near), r), other)
                    odd.append(at[near[(value >= 0) & (value < r)]])
            sym[at], sym[gone] = r, -1
            rank[gone] = -1
            right[at] = beyond
            inside = beyond < n
            left[beyond[inside]] = at[inside]
            rank[at] = -2
            before = left[at]
            before = before[(before >= 0) & (rank[before] != -2)]  # no position twice
            touched = np.concatenate([at, before])
            nxt = right[touched]
            real = nxt < n
            rank[touched] = -1
            touched, nxt = touched[real], nxt[real]
            rank[touched] = self._rank(sym[touched], sym[nxt])
            if self.unsafe[r]:
                odd.append(touched[(rank[touched] >= 0) & (rank[touched] < r)])
            enter(touched)
        alive = np.flatnonzero(sym >= 0)
        flat = sym[alive].astype("<u4").tobytes()
        cuts = (np.searchsorted(alive, end) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905
        if odd:
            for w in np.unique(np.searchsorted(end, np.concatenate(odd), side="right")).tolist():
                out[w] = np.array(self._one(words[w]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Each match of the pattern is encoded by itself; a match that is a token is that token.
        """
        split = [self.pattern.findall(t) for t in texts]
        ids = dict.fromkeys(w for s in split for w in s)
        rest, names = [], []
        for w in ids:
            b = w.encode()
            if (r := self.ranks.get(b)) is not None:
                ids[w] = r.to_bytes(4, "little")
            else:
                rest.append(b)
                names.append(w)
        ids.update(zip(names, self.replay(rest), strict=True))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s]) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        size = self.length[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.offset[ids] - (end - size), size) + np.arange(total)].tobytes()

    def encoder(self) -> Pieces:
        return Pieces(self.encode, CHUNK)


_READY: dict[tuple[str, str], tuple[MergeReplay, Pieces, list[str]]] = {}


def _ready(path: str, pattern: str) -> tuple[MergeReplay, Pieces, list[str]]:
    """Once in each Python worker."""
    if (path, pattern) not in _READY:
        replay = MergeReplay(load_ranks(path), pattern)
        _READY[path, pattern] = replay, replay.encoder(), [str(i) for i in range(replay.size)]
    return _READY[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    Null and empty texts have no ids. The digests are of the decimal ids joined by commas and of the bytes
    decoded from the ids. Repeated rows and null doc ids pass; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pieces, decimal = _ready(path, pattern)
        for held in gathered(batches, CHUNK):
            found = pieces.run([t for b in held for t in strings(b)])
            for b in held:
                n, a, d, all_ids = [], [], [], []
                for _ in range(b.num_rows):
                    x = np.frombuffer(next(found), "<u4")
                    n.append(len(x))
                    a.append(hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest())
                    d.append(hashlib.sha256(replay.decode(x)).hexdigest())
                    if ids:
                        all_ids.append(x)
                out = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if ids:
                    flat = np.concatenate(all_ids).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(out, names)

    return columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
