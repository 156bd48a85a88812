"""Token-id shards: a flat id array, with document boundaries in Elias-Fano form.

A shard is two files. ``N.ids`` holds the ids of its documents one after the other, little-endian, two bytes each
where the vocabulary allows. ``N.bounds`` holds the document ends and the document ids as Elias-Fano sequences:
the low bits of each value packed, the high bits in unary, and a select sample for every 256th value, so that any
boundary is found without a table of 64-bit offsets (about 2 + log2(mean length) bits a document).
Shards are in ascending document id order; ``manifest.json`` has their totals.
"""

from __future__ import annotations

import io
import json
import os
import string
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import columns, some, strings
from graphloom.llm.pieces import INNER, Pieces, gathered
from graphloom.session import discard_at_exit, prepare, shared_dir

MAGIC = b"GLEF0001"
SAMPLE = 256
#: Bytes of ids read at once.
READ = 8 << 20


class EliasFano:
    """A sequence of non-decreasing whole numbers of 0 or more."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * low_bits, np.uint8)
        for k in range(low_bits):
            low[k::low_bits] = (v >> np.uint64(k)) & np.uint64(1)
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        high[place] = 1
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), place[::SAMPLE].astype("<u4"))

    def _place(self, i: int) -> int:
        """Where the i-th one of the high bits is: from the sample before it, over the counts of whole bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, left = divmod(i, SAMPLE)
        at = int(self.samples[k])
        part = self.high[at // 8 : int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self.high)].copy()
        part[0] &= 0xFF << (at % 8) & 0xFF
        ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        byte = int(np.searchsorted(ones, left, side="right"))
        left -= int(ones[byte - 1]) if byte else 0
        return 8 * (at // 8 + byte) + int(np.flatnonzero(np.unpackbits(part[byte : byte + 1], bitorder="little"))[left])

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.part(i, i + 1)[0])

    def part(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to before the j-th; nothing else is unpacked."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = self._place(i), self._place(j - 1)
        base = first // 8
        place = np.flatnonzero(np.unpackbits(self.high[base : last // 8 + 1], bitorder="little")) + 8 * base
        place = place[(place >= first) & (place <= last)]
        out = (place - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i * self.low_bits
            low = np.unpackbits(self.low[at // 8 : (j * self.low_bits + 7) // 8], bitorder="little")[at % 8 :]
            low = low[: (j - i) * self.low_bits]
            for k in range(self.low_bits):
                out |= low[k :: self.low_bits].astype(np.uint64) << np.uint64(k)
        return out

    def dump(self, f: io.IOBase) -> None:
        f.write(struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)))
        for x in (self.low, self.high, self.samples):
            f.write(x.tobytes())

    @classmethod
    def load(cls, f: io.IOBase) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack("<QIQQQ", f.read(36))
        return cls(n, low_bits, np.frombuffer(f.read(a), np.uint8), np.frombuffer(f.read(b), np.uint8), np.frombuffer(f.read(4 * c), "<u4"))


def dump_bounds(f: io.IOBase, ends: np.ndarray, ids: np.ndarray, nulls: int, width: int) -> None:
    """Ends of documents in ids; ``ids`` without the ``nulls`` documents without one, which come first."""
    least = int(ids[0]) if len(ids) else 0
    f.write(MAGIC + struct.pack("<BQq", width, nulls, least))
    EliasFano.of(ends).dump(f)
    EliasFano.of((ids - least).astype(np.uint64)).dump(f)


class Bounds:
    """Document ends and document ids of a shard, as read."""

    def __init__(self, f: io.IOBase):
        if f.read(8) != MAGIC:
            raise ValueError("not a bounds file")
        self.width, self.nulls, self.least = struct.unpack("<BQq", f.read(17))
        self.ends, self.ids = EliasFano.load(f), EliasFano.load(f)

    def __len__(self) -> int:
        return self.ends.n

    def edges(self, i: int, j: int) -> np.ndarray:
        """Start of the i-th document and the ends from it to the one before the j-th."""
        return np.r_[self.ends.select(i - 1) if i else 0, self.ends.part(i, j)].astype(np.int64)

    def documents(self, i: int, j: int) -> list[int | None]:
        """Ids of the documents from the i-th to before the j-th."""
        none = max(0, min(j, self.nulls) - i)
        known = self.ids.part(max(i, self.nulls) - self.nulls, max(j, self.nulls) - self.nulls)
        return [None] * none + (known.astype(np.int64) + self.least).tolist()

    def until(self, i: int, most: int) -> int:
        """The last document before which the ids from the i-th one on are ``most`` at the most, but one document at least."""
        limit = (self.ends.select(i - 1) if i else 0) + most
        low, high = i + 1, len(self)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.ends.select(mid - 1) <= limit else (low, mid - 1)
        return low


#: Pieces that a Python worker remembers, and bytes of new pieces that the library encodes at once.
REMEMBERED, JOINED = 800_000, 1 << 14


#: The first character beyond the Latin letters that every Unicode version has.
LATIN = chr(0x250)
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: chr(b if b in PRINTABLE else 256 + k) for b, k in zip(range(256), accumulate((b not in PRINTABLE for b in range(256)), initial=0), strict=False)}


class Encoder:
    """The ids of a tokenizers file as little-endian bytes, by the library's own encode calls.

    A byte-level tokenizer with its usual split gets texts in pieces; the new ones go in one after the other, as in
    a text, and are told apart by the lengths of their tokens. Texts that hold the string of an added token, and
    all texts of other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        cut = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made.get("normalizer") is None
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.size = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.size[number] = len(token)  # a character for each byte
        self.pieces = Pieces(self._pieces if cut else self._whole, remembered=REMEMBERED, whole=not cut)

    def _whole(self, raw: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]

    def _pieces(self, raw: list[str]) -> list[bytes]:
        """Letters and the punctuation after them are never one token's, so the word before it is encoded once."""
        cores = [x.rstrip(string.punctuation) for x in raw]
        cut = [k for k, (x, c) in enumerate(zip(raw, cores, strict=True)) if len(c) < len(x) and c[-1:].isalpha() and c[0] == " "]
        known, new = self.pieces.spaced, {}
        for k in cut:
            c = cores[k]
            if c not in new:
                new[c] = known.young.get(c[1:]) or known.old.get(c[1:])
        for k, x in enumerate(raw):
            if x not in new:
                new[x] = None
        for k in cut:
            del new[raw[k]]
        tails = list({raw[k][len(cores[k]) :] for k in cut})
        tail = dict(zip(tails, self._whole(tails), strict=True))
        todo = [x for x, ids in new.items() if ids is None]
        new.update(zip(todo, self._joined(todo), strict=True))
        for k in cut:
            new[raw[k]] = new[cores[k]] + tail[raw[k][len(cores[k]) :]]
        return [new[x] for x in raw]

    def _joined(self, raw: list[str]) -> list[bytes]:
        """A blank and Latin letters are one word to the library's model. Other pieces go one after the other, as in a
        text; their tokens are told apart by their lengths."""
        out: list[bytes | None] = [None] * len(raw)
        tokenize, code = self.model.tokenize, "H" if self.width == 2 else "I"
        for k, x in enumerate(raw):
            if x[:1] == " " and x[1:].isalpha() and max(x) < LATIN:
                ids = array(code, [t.id for t in tokenize(x.encode().decode("latin-1").translate(ALPHABET))])
                out[k] = ids.tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()
        inner = [k for k, x in enumerate(raw) if out[k] is None and INNER.fullmatch(x)]
        at = 0
        while at < len(inner):
            end, total = at, 0
            while end < len(inner) and total < JOINED:
                total += len(raw[inner[end]])
                end += 1
            some = inner[at:end]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([raw[k] for k in some])], add_special_tokens=False)[0].ids, self.kind)
            token_end = np.cumsum(self.size[ids])
            piece_end = np.cumsum(np.fromiter((len(raw[k].encode()) for k in some), np.int64, len(some)))
            place = np.searchsorted(token_end, piece_end)
            if len(ids) and place[-1] < len(ids) and (token_end[place] == piece_end).all():
                flat, cuts = ids.tobytes(), ((place + 1) * self.width).tolist()
                for k, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                    out[k] = flat[a:b]
            at = end
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._whole([raw[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def run(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        special = [any(a in t for a in self.added) for t in texts]
        cut = self.pieces.run([t for t, x in zip(texts, special, strict=True) if not x])
        for t, x in zip(texts, special, strict=True):
            yield self._whole([t])[0] if x else next(cut)


_READY: dict[str, Encoder] = {}


def _ready(path: str) -> Encoder:
    """Once in each Python worker."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


#: Rows that the bounds of a shard are drawn from, at about; they decide how large shards are, and nothing else.
DRAWN = 100


def _key(number: int | None, tie: int) -> tuple[bool, int, int]:
    """Where a document stands: null ids first."""
    return number is not None, number or 0, tie


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bounds: list[tuple] = ()) -> DataFrame:
    """(id, tie, part, width, ids) of every row: the ids of its text as little-endian numbers of ``width`` bytes.

    As the tokenizers library gives them with add_special_tokens=False: the string of an added token in a text is
    that token. ``tie`` is a hash of the text, ``part`` how many of the ``bounds`` are no higher than (id, tie). Null
    and empty texts have no ids. Repeated rows and null ids pass; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(path)
        for held in gathered(batches):
            found = encoder.run([t for b in held for t in strings(b)])
            for b in held:
                part = [bisect_right(bounds, _key(*x)) for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                ids = pa.array([next(found) for _ in range(b.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(part, pa.int32()), pa.array(np.full(b.num_rows, encoder.width, np.int32)), ids], ["id", "tie", "part", "width", "ids"])

    return columns(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).mapInArrow(run, "id long, tie long, part int, width int, ids binary")


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shards: int | None = None) -> list[dict]:
    """Write all texts as shards into ``folder`` (a URI that executors share); the manifest's rows.

    Documents ascend by id, rows that share one by a hash of their text; null ids come first. ``end`` follows each
    document. Null and empty texts are the end id alone. Texts are encoded where they lie, and only ids are dealt
    out, to ranges of (id, hash) whose bounds come from a sample of rows. A file appears under its name when it is
    whole, so a repeated task replaces it by the same. An empty table gives a manifest without shards.
    """
    spark = prepare(docs.sparkSession)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = columns(docs, id_col, text_col).select("id", F.xxhash64("text").alias("tie"))
    share = min(1 << 20, (DRAWN * n << 20) // max(1, docs.count()) + 1)
    drawn = sorted(_key(*r) for r in keys.where(F.pmod(F.xxhash64("id", "tie", F.lit(7)), F.lit(1 << 20)) < share).collect())
    bounds = sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []
    rows = encode(docs, path, id_col, text_col, bounds).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("id", "tie", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        temp = f"{root}/.{uuid.uuid4().hex}"
        sizes, ids, nulls, out, width, number = [], [], 0, None, 0, 0
        try:
            for b in some(batches):
                width, number = b.column(1)[0].as_py(), b.column(3)[0].as_py()
                stop = np.array([end], f"<u{width}").tobytes()
                out = out or store.open_output_stream(f"{temp}.ids")
                held = b.column(2).to_pylist()
                out.write(stop.join([*held, b""]))
                sizes.append(np.fromiter(map(len, held), np.int64, len(held)) // width + 1)
                nulls += b.column(0).null_count
                ids.append(b.column(0).drop_null().to_numpy())
            if not sizes:
                return
            out.close()
            total = np.cumsum(np.concatenate(sizes))
            with store.open_output_stream(f"{temp}.bounds") as f:
                dump_bounds(f, total, np.concatenate(ids), nulls, width)
            for kind in ("ids", "bounds"):
                store.move(f"{temp}.{kind}", f"{root}/{number:05d}.{kind}")
        except BaseException:
            for info in store.get_file_info([f"{temp}.ids", f"{temp}.bounds"]):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(total)], pa.int64()), pa.array([int(total[-1])], pa.int64())], ["shard", "n_docs", "n_tokens"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    manifest, start = [], 0
    for r in sorted(rows.select("id", "width", "ids", "part").mapInArrow(run, "shard long, n_docs long, n_tokens long").collect()):
        manifest.append(r.asDict() | {"start": start})
        start += r.n_tokens
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"shards": manifest, "end": end}).encode())
    return manifest


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the shards of a folder.

    Offsets come from the select structures, a block of documents at a time.
    """
    prepare(spark)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    listed = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard long, start long").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{shard:05d}.bounds") as f:
                    bounds = Bounds(f)
                with store.open_input_stream(f"{root}/{shard:05d}.ids") as f:
                    at = 0
                    while at < len(bounds):
                        to = bounds.until(at, READ // bounds.width)
                        edge = bounds.edges(at, to)
                        flat = np.frombuffer(f.read(int(edge[-1] - edge[0]) * bounds.width), f"<u{bounds.width}").astype("<u4")
                        cut = edge - edge[0]
                        view = memoryview(flat.tobytes())
                        crc = [zlib.crc32(view[4 * a : 4 * c]) for a, c in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                        out = [pa.array(bounds.documents(at, to), pa.int64()), pa.array(edge[:-1] + start), pa.array(np.diff(cut)), pa.array(crc, pa.int64())]
                        if ids:
                            out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(out, names)
                        at = to

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def encode_to_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, folder: str | None = None) -> DataFrame:
    """Encode all texts with a tokenizers file, write shards, and read them back: see write_shards and read_documents.

    Without ``folder`` the shards lie in the shared folder until this process ends. Null and empty texts are the end
    id alone; repeated rows come out as often as they go in; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = folder is None
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)
    if own:
        discard_at_exit(spark, folder)
    write_shards(docs, path, folder, id_col, text_col, end)
    return read_documents(spark, folder)
