"""Token counts of a unigram tokenizer without making the tokens.

Aho-Corasick finds every vocabulary piece that ends at each character of a word; dynamic programming over
word positions carries the best score and the number of pieces that reach it. Ties are decided as the
tokenizers library's Unigram model decides them: a later start replaces an earlier one only with a strictly
higher score; a character that no piece of one character covers can be an unknown piece at the lowest score
less ten, which counts as its bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from graphloom.llm.common import columns, some, strings
from graphloom.session import prepare

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words remembered in a Python worker.
REMEMBERED = 400_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word that starts with the mark."""
        n = len(word)
        best, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.find.iter(word):
            ends[end].append(hit)
        for e in range(1, n + 1):
            top = start = None
            single = False
            for size, score in ends[e - 1]:  # longest first: the earliest start
                single |= size == 1
                value = score + best[e - size]
                if top is None or value > top:
                    top, start = value, e - size
            unknown = False
            if not single:
                value = self.unknown + best[e - 1]
                if top is None or value > top:
                    top, start, unknown = value, e - 1, True
            best[e] = top
            if not unknown:
                count[e] = count[start] + 1
            elif self.bytes:
                count[e] = count[start] + len(word[start].encode())
            else:  # unknown characters in a row are one piece
                count[e] = count[start] + (not fused[start])
            fused[e] = unknown
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(MARK, " ")
        words = (marked if marked[0] == " " else " " + marked).split(" ")[1:]
        seen, total = self.seen, 0
        for n in map(seen.get, words):
            if n is None:
                break
            total += n
        else:
            return total
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self.word(MARK + w)
        return sum(map(seen.__getitem__, words))


_READY: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every row: pieces of the best segmentation.

    Text is split before each blank, which becomes the mark, with one put first if there is none. Null and
    empty texts have 0. Repeated rows and null ids pass; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _READY:
            _READY[path] = Counter(load_vocabulary(path))
        for b in some(batches):
            all_texts = strings(b)
            counts = np.fromiter(map(_READY[path].count, all_texts), np.int64, len(all_texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array([len(t) for t in all_texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
