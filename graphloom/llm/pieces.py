"""Encoding whole texts piece by piece, each distinct piece once.

A byte-level BPE splits a text before it merges, and with GPT-2's pattern a split never crosses the start of a
run of white space that follows other characters. So a text is cut there, each distinct piece is encoded once,
and the ids of the pieces in order are those of the text. What is remembered is bounded; forgetting costs time
only. Callers whose tokenizer may split elsewhere say so (``whole``), and their texts aren't cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import filterfalse

from graphloom.llm.common import some

#: Unicode's White_Space, as the pre-tokenizers' patterns have it (Python's \\s also takes U+001C..U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Without these, all white space of a text is single blanks and line feeds between other characters.
ODD = ["  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r"]
ODD_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A piece that keeps its ids when it is put before and after others of its kind.
INNER = re.compile(f"[{SPACE}].*[^{SPACE}]", re.DOTALL)
#: Bytes of text looked at before the new pieces are encoded, and pieces remembered.
CHUNK, REMEMBERED = 6 << 20, 400_000


class Memory:
    """Pieces and what they are encoded to, in two generations: what isn't met again goes with the older one."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int):
        self.encode, self.remembered = encode, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > self.remembered // 2:
            self.old, self.young = self.young, {}

    def learn(self, missing: set[str]) -> None:
        """Let ``young`` have all the pieces."""
        found = missing & self.old.keys()
        self.young.update((k, self.old[k]) for k in found)
        new = list(missing - found)
        self.young.update(zip(new, self.encode(new), strict=True))


class Pieces:
    """encode: raw pieces -> bytes for each (what the pieces of a text add up to by concatenation)."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], chunk: int = CHUNK, remembered: int = REMEMBERED, whole: bool = False):
        self.chunk, self.whole = chunk, whole
        # by the piece less its leading blank, or from a line feed on; and by the piece as it is
        self.spaced = Memory(lambda keys: encode([x if x[:1] == "\n" else " " + x for x in keys]), remembered)
        self.raw = Memory(encode, remembered)

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """(raw pieces, keys of spaced pieces): the raw ones come first."""
        if self.whole:
            return [text], []
        if any(x in text for x in ODD) or (not text.isascii() and any(x in text for x in ODD_WIDE)):
            return _SEGMENT.findall(text), []
        head, *rest = text.replace("\n", " \n").split(" ")
        return [head], rest

    def run(self, texts: list[str]) -> Iterator[bytes]:
        """What each text adds up to, in order."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= self.chunk):
                size += len(texts[end])
                end += 1
            held = [self.parts(t) for t in texts[at:end]]
            for k, memory in enumerate((self.raw, self.spaced)):
                memory.turn()
                missing: set[str] = set()
                for x in held:
                    missing.update(filterfalse(memory.young.__contains__, x[k]))
                memory.learn(missing)
            raw, spaced = self.raw.young.__getitem__, self.spaced.young.__getitem__
            for a, b in held:
                yield b"".join([*map(raw, a), *map(spaced, b)])
            if self.whole:
                self.raw.young.clear()
            at = end


def gathered(batches: Iterator, size: int = CHUNK) -> Iterator[list]:
    """Arrow batches in lists of about ``size`` bytes, so that new pieces are encoded together."""
    held, total = [], 0
    for b in some(batches):
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
