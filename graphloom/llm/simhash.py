"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into short segments and embedded as the vector of their bit counts. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a
range join in the embedded grid loses no link. The grid join runs on equality: the coordinates are
dealt into groups, and two vectors within distance r agree exactly on all but r of the groups, so each
choice of the other groups is a key. Of fingerprints that share a key the Manhattan distance is taken, and those
within it are compared bit by bit.

Exact copies collapse to one fingerprint before the join. Inside a bucket only a spanning set of links
goes out, never all pairs; buckets are compared in streaming order, a hot one by breadth-first search
over the fingerprints not reached yet.

The pipeline's stage takes these links, and besides them those of similar sets of five-word shingles, whose
fingerprints can lie further apart than any radius a grid serves. Their candidates come from prefixes of the ordered sets,
which loses no similar pair; positions and bitmaps bound the overlap of two sets inside the buckets, and the sets of what
is left are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import columns, fresh, mix, some, texts
from graphloom.plans.components import connected_components
from graphloom.session import cut, matching, prepare, release, spread_join, stash, without

#: Shingles hashed at once; bounds memory for very long texts.
BLOCK = 1 << 17
#: Buckets up to this size are compared by offset, larger ones by search.
SMALL = 32
#: Numbers of one vectorised pass over sorted buckets.
PASS = 1 << 20


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first; bytes count up to 255 rows at a time."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones + bits[whole:].sum(axis=0, dtype=np.uint8)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle, repeats included, in blocks; fewer words than a shingle are one."""
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size) + np.arange(len(words))
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)


def simhash(words: list[bytes], shingle: int = 3, length: int = 1) -> list[int]:
    """A fingerprint of ``length`` unsigned 64-bit numbers of the shingles, repeats included; zero if there is no word."""
    return majority(shingle_hashes(words, shingle), length)


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words, shingle)]))


def majority(blocks: Iterable[np.ndarray], length: int) -> list[int]:
    """``length`` unsigned 64-bit numbers: a bit is set if over half of the hashes have it.

    The first number takes the hashes themselves, the others take 64-bit mixes of them.
    """
    ones, n = np.zeros((length, 64), np.int64), 0
    for h in blocks:
        n += len(h)
        for k in range(length):
            ones[k] += _ones(mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else h)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [int(weight[2 * row > n].sum(dtype=np.uint64)) for row in ones]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, length: int = 1) -> DataFrame:
    """(id, f0, f1, ...) for every row; signed longs."""
    prepare(docs.sparkSession)
    names = [f"f{k}" for k in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            got = np.array([simhash(words_of(t), shingle, length) for t in texts(b)], np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in range(len(names)))], ["id", *names])

    return columns(docs, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def word_hashes(docs: DataFrame) -> DataFrame:
    """(id, d0, d1, f0) of (id, text) rows: the 128-bit hash of the words, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            held = [words_of(t) for t in texts(b)]
            got = np.array([[*divmod(xxhash.xxh3_128_intdigest(b" ".join(w)), 1 << 64), *simhash(w)] for w in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in got.T)], ["id", "d0", "d1", "f0"])

    return docs.mapInArrow(run, "id long, d0 long, d1 long, f0 long")


def radius_keys(fps: np.ndarray, radius: int, segment: int = 2) -> Iterator[np.ndarray]:
    """Keys of one-word fingerprints such that any two within the radius share one.

    The 64 / segment bit counts are dealt into radius + 3 groups; a key is the choice of 3 groups and
    their bit counts, which two vectors at Manhattan distance radius or less share for some choice.
    """
    f = fps[:, 0]
    mask = np.uint64((1 << segment) - 1)
    counts = [np.bitwise_count((f >> np.uint64(i)) & mask).astype(np.uint64) for i in range(0, 64, segment)]
    groups = np.array_split(np.arange(len(counts)), radius + 3)
    coded = []
    for g in groups:
        code = np.zeros(len(f), np.uint64)
        for i in g:
            code = code * np.uint64(segment + 1) + counts[i]
        coded.append(code)
    for number, chosen in enumerate(combinations(range(len(groups)), 3)):
        key = np.full(len(f), number + 1, np.uint64)
        for i in chosen:  # three groups of at most 11 two-bit counts fit in 64 bits
            key = key * np.uint64((segment + 1) ** len(groups[i])) + coded[i]
        yield key


def counted(fps: np.ndarray) -> np.ndarray:
    """The bit counts of two-bit segments, each as so many ones: the Hamming distance of two such numbers is the
    Manhattan distance of the counts."""
    odd = np.uint64(0x5555555555555555)
    low, high = fps & odd, (fps >> np.uint64(1)) & odd
    return low | high | (low & high) << np.uint64(1)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _search(edge: int, end: int, linked: Callable) -> list[tuple[int, int]]:
    """Spanning links of one bucket: breadth-first over what isn't reached yet."""
    rest, out = np.arange(edge, end), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = linked(rest, x)
            if hit.any():
                found = rest[hit].tolist()
                out += [(x, y) for y in found]
                queue += found
                rest = rest[~hit]
    return out


def bucket_links(key: np.ndarray, linked: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked rows, among rows sorted by key: all links of small buckets, a spanning set of others.

    ``linked(rows, others)`` tells which rows are linked to the others, or to the one other.
    """
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    left, right = [], []
    inside = np.repeat(size, size)
    rows = np.flatnonzero((inside > 1) & (inside <= SMALL))
    last = np.repeat(edge[1:], size)
    for d in range(1, SMALL):
        rows = rows[rows + d < last[rows]]
        if not len(rows):
            break
        hit = rows[linked(rows, rows + d)]
        left.append(hit)
        right.append(hit + d)
    for k in np.flatnonzero(size > SMALL):
        if found := _search(edge[k], edge[k + 1], linked):
            pair = np.array(found)
            left.append(pair[:, 0])
            right.append(pair[:, 1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def sweep(reps: DataFrame, words: int, keys, work, schema: str) -> DataFrame:
    """``work(rows)`` over all buckets of the keys: rows are key, the columns of ``reps``, in order of key and node.

    ``reps``: long columns, the first one node, the last ones f0...
    """
    names = reps.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            fps = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns[-words:]], axis=1)
            for key in keys(fps):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], ["key", *names])

    return buckets(reps.mapInArrow(deal, "key long, " + ", ".join(f"{n} long" for n in names)), work, schema)


def buckets(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows)`` over rows of long columns, the first two key and node; buckets stream by and are never divided."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            cut_at = len(x) if final else int(np.searchsorted(x[:, 0], x[-1, 0]))
            done, held[:] = x[:cut_at], [x[cut_at:]]
            if len(done):
                yield work(done)

        for b in some(batches):
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if sum(x.size for x in held) >= PASS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return dealt.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(join, schema)


def _words(rows: np.ndarray, words: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, -words:]).view(np.uint64)


def links(reps: DataFrame, words: int, radius: int, keys) -> DataFrame:
    """(src, dst) node pairs within the radius, enough of them to connect what is connected.

    ``reps``: node and f0.. of distinct fingerprints. ``keys``: fingerprints -> arrays of keys.
    """

    def work(rows: np.ndarray) -> pa.RecordBatch:
        fps = _words(rows, words)
        counts = counted(fps)

        def linked(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
            hit = _near(counts[a], counts[b]) <= radius
            at = np.flatnonzero(hit)
            hit[at] = _near(fps[a[at]], fps[b] if np.ndim(b) == 0 else fps[b[at]]) <= radius
            return hit

        a, b = bucket_links(rows[:, 0], linked)
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 1]), pa.array(rows[b, 1])], ["src", "dst"])

    return sweep(reps.select("node", *(f"f{k}" for k in range(words))), words, keys, work, "src long, dst long")


def groups(fps: DataFrame, radius: int) -> DataFrame:
    """(id, f0, component_id): each row's fingerprint and the smallest id reachable over links."""
    fps = cut(fps)
    reps = cut(fps.groupBy(F.col("f0").alias("node")).agg(F.min("id").alias("least")))
    found = links(reps.withColumn("f0", F.col("node")), 1, radius, lambda x: radius_keys(x, radius))
    comp = connected_components(found).select(F.col("id").alias("node"), F.col("component").alias("label"))
    reps = reps.join(comp, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    least = reps.groupBy("label").agg(F.min("least").alias("component_id"))
    named = reps.select(F.col("node").alias("f0"), "label").join(least, "label").select("f0", "component_id")
    return fps.join(named, "f0").select("id", "f0", "component_id")


def fingerprint_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst) pairs of (node, f0) rows that connect all whose fingerprints are linked at the radius or equal."""
    reps = cut(nodes.groupBy("f0").agg(F.min("node").alias("least")))
    found = links(reps.select(F.col("f0").alias("node"), "f0"), 1, radius, lambda x: radius_keys(x, radius)).distinct()
    end = lambda name: reps.select(F.col("f0").alias(name), F.col("least").alias(f"{name}_node"))
    near = found.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    equal = nodes.join(reps, "f0").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    return near.union(equal).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row, by 64-bit SimHash and links at ``radius`` bits or fewer.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows with a null id get
    the component of their fingerprint and never name one (null if nothing else is reachable). Repeated
    rows and ids come out as often as they go in; an empty table gives an empty result.
    """
    fps = fingerprints(docs, id_col, text_col, shingle)
    return groups(fps, radius).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: 64-bit numbers of the fingerprint by which candidates are ordered.
LONG = 8
#: 64-bit numbers of the bitmap of a shingle set.
BITMAP = 16
#: Shingles that the prefixes of two similar sets share at least: this many, or this part of the set if that is more.
SHARED, PART = 8, 10
#: Four fifths, the least similarity of near duplicates.
SIMILARITY = (4, 5)
#: Nearest candidates that a fingerprint proposes from each bucket in the first round after the stars.
NEAREST = 64
#: Pairs that one copy of a shingle set serves, and rows of a bucket that are starred together.
SERVED, STARRED = 1000, 4096
#: Columns of a candidate: long fingerprint; size of its shingle set and bitmap.
PRINT = [f"f{k}" for k in range(LONG)]
SKETCH = ["size", *(f"b{k}" for k in range(BITMAP))]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP numbers with the bit of each hash, taken modulo their length, set."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(mix(hashes) % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles, PRINT, SKETCH) of (id, text) rows: distinct shingle hashes and what stands for them in buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            held = [shingle_set(words_of(t), shingle) for t in texts(b)]
            at = np.cumsum([0, *map(len, held)], dtype=np.int32)
            drawn = np.array([[*majority([h], LONG), len(h), *bitmap(h).tolist()] for h in held], np.uint64).view(np.int64)
            sets = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(held).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), sets, *(pa.array(np.ascontiguousarray(c)) for c in drawn.T)], ["node", "shingles", *PRINT, *SKETCH])

    return docs.mapInArrow(run, "node long, shingles array<long>, " + ", ".join(f"{n} long" for n in [*PRINT, *SKETCH]))


def least_overlap(size: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """Shingles that a set of this size shares with any similar one, at least; that one's size, at least."""
    up, down = similarity
    return -(-size * up // down)


def shared(size: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """How many first common shingles the prefix of a set of this size has."""
    return min(max(SHARED, size // PART), least_overlap(size, similarity))


def prefix(hashes: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of a mix, so many that they have the first shared(size) ones of those
    that it has in common with any similar set."""
    n = len(hashes)
    return hashes[np.argsort(mix(hashes))[: n - least_overlap(n, similarity) + shared(n, similarity)]]


def prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, node, at) of (id, text) rows: each shingle of the prefix; at is its place and, 32 bits up, the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys, nodes, at, n = [], [], [], 0
            for node, text in zip(ids.tolist(), texts(b), strict=True):
                held = shingle_set(words_of(text), shingle)
                first = prefix(held)
                keys.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                at.append((len(held) << 32) + np.arange(len(first), dtype=np.int64))
                n += len(first)
                if n >= BLOCK:
                    yield packed(keys, nodes, at)
                    keys, nodes, at, n = [], [], [], 0
            if n:
                yield packed(keys, nodes, at)

    def packed(keys, nodes, at) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(at))], ["key", "node", "at"])

    return docs.mapInArrow(run, "key long, node long, at long")


def _placed(at: np.ndarray, similarity: tuple[int, int]) -> Callable:
    """Which rows of a bucket can have the similarity, by the places of its shingle in both sets: what comes before and
    after it bounds the overlap."""
    before, size = at & 0xFFFFFFFF, at >> 32
    after = size - before
    up, down = similarity
    return lambda a, b: (np.minimum(after[a], after[b]) + np.minimum(before[a], before[b])) * (up + down) >= (size[a] + size[b]) * up


def similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The (src, dst) pairs whose shingle sets have the Jaccard similarity or more, exactly.

    The set of a node on many pairs goes out in copies, one for each SERVED pairs, so no task gets them all.
    """
    up, down = similarity
    copies = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("long").alias("copies"))
    dealt = pairs.join(copies, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), "copies").alias("copy"))
    left = sets.join(copies.withColumnRenamed("src", "node"), "node").select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
    both = dealt.join(left, ["src", "copy"]).select("src", "dst", "a").join(right, "dst")
    same, size = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    near = F.least(F.size("a"), F.size("b")) * down >= F.greatest(F.size("a"), F.size("b")) * up
    return both.where(near).where(same * (up + down) >= size * up).select("src", "dst")


def rare_common(rows: DataFrame) -> DataFrame:
    """The rows of prefixes by which two similar sets meet: of each node's shingles that others have too, the rarest.

    Two similar sets have shared(size) common shingles in their prefixes, with the size of the smaller one. A
    node with fewer repeated shingles than that has no partner. Of others the most frequent ones can be left out, as
    many as that less one: the rarest common shingle of a pair is then still among both nodes' rows.
    """
    up, down = SIMILARITY
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    of = lambda size: F.expr(f"({size} * {up} + {down - 1}) div {down}")  # noqa: E731  least_overlap
    need = F.least(F.greatest(F.lit(SHARED), F.expr(f"least div {PART}")), of("least"))
    found = spread_join(rows, counts, ["key"]).withColumn("least", of("shiftright(at, 32)"))  # the smallest partner's size
    found = found.withColumn("repeated", F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("n", "key")))
    return found.where(F.col("place") <= F.col("repeated") - need + 1).select("key", "node", "at")


def _candidates(rows: np.ndarray, similarity: tuple[int, int]) -> Callable:
    """Which of the sketched rows can have the similarity.

    Each bit that one bitmap alone has stands for a shingle that the other set lacks, so what the bitmaps leave
    of the sizes is an upper bound of the overlap: no similar pair is lost by it.
    """
    bits, size = _words(rows, BITMAP), rows[:, -len(SKETCH)]
    up, down = similarity
    ones = np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)

    def linked(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        common = np.bitwise_count(bits[a] & bits[b]).sum(axis=-1, dtype=np.int64)
        most = np.minimum(size[a] - ones[a], size[b] - ones[b]) + common
        return most * (up + down) >= (size[a] + size[b]) * up

    return linked


def _both(rows: np.ndarray) -> Callable:
    """_candidates and _placed at once, of rows whose third column is at."""
    linked, placed = _candidates(rows, SIMILARITY), _placed(rows[:, 2], SIMILARITY)

    def both(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        hit = placed(a, b)
        at = np.flatnonzero(hit)
        if len(at):
            hit[at] = linked(a[at], b if np.ndim(b) == 0 else b[at])
        return hit

    return both


def _stars(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs, few for each row and bucket, that connect the candidates of a bucket.

    A bucket of more than about STARRED rows is divided, and each part gets the bucket's first node as well.
    """

    def work(rows: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(rows[:, 0], _both(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 1]), pa.array(rows[b, 1])], ["src", "dst"])

    counts = dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / STARRED).alias("parts"), F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    rows = spread_join(dealt, counts, ["key"])
    part = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    rows = rows.select("key", "node", "at", "parts", F.explode(part).alias("part"))
    rows = rows.select(F.when(F.col("parts") > 1, F.xxhash64("key", "part")).otherwise(F.col("key")).alias("key"), "node", "at")
    live = rows.join(sets.select("node", *SKETCH), "node").select("key", "node", "at", *SKETCH)
    found = buckets(live, work, "src long, dst long")
    return found.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _across(dealt: DataFrame, sets: DataFrame, labels: DataFrame, nearest: int) -> DataFrame:
    """(src, dst, more): candidate pairs of different labels, the ``nearest`` of each row and bucket.

    Of two rows of different labels one at least isn't of the bucket's most frequent label, so only such rows
    propose, and only buckets of several labels are looked at. ``more`` tells that some row had further candidates.
    """

    def work(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
        label, node = rows[:, 3], rows[:, 1]
        f, linked = _words(rows, LONG + len(SKETCH))[:, :LONG], _both(rows)
        src, dst, more = [], [], []
        for k in range(len(edge) - 1):
            part = np.arange(edge[k], edge[k + 1])
            names, count = np.unique(label[part], return_counts=True)
            for x in part[label[part] != names[np.argmax(count)]].tolist():
                at = part[label[part] != label[x]]
                at = at[linked(at, x)]
                full = len(at) > nearest
                if full:
                    at = at[np.lexsort((node[at], _near(f[at], f[x])))[:nearest]]
                src += [int(node[x])] * len(at)
                dst += node[at].tolist()
                more += [full] * len(at)
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(more, pa.bool_())], ["src", "dst", "more"])

    named = dealt.join(labels, "node").select("key", "node", "at", "label")
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    live = spread_join(named, mixed, ["key"]).join(sets.select("node", *PRINT, *SKETCH), "node").select("key", "node", "at", "label", *PRINT, *SKETCH)
    found = buckets(live, work, "src long, dst long, more boolean")
    return found.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("more").alias("more"))


def similar_groups(docs: DataFrame, reps: DataFrame, copies: DataFrame, shingle: int) -> DataFrame:
    """(node, label) of the nodes linked to another: components of the fingerprints' links and of the pairs of similar sets.

    ``docs``: id, text; ``reps``: node (the id of a row in docs), f0; ``copies``: the ids of docs that aren't nodes. Nodes that share a rare shingle of their prefixes, at
    places and with sizes that allow the similarity, get a sketch. First each bucket proposes stars, which connect its
    candidates; where all of them hold, a group is done. In the others, rounds propose what is still of different
    labels, the nearest first, until no row had to leave one out: a pair of candidates is then either in one component
    or found to be dissimilar.
    """
    spark = docs.sparkSession

    def named(pairs: DataFrame) -> DataFrame:
        return connected_components(pairs).select(F.col("id").alias("node"), F.col("component").alias("label"))

    linked = cut(fingerprint_links(reps.select("node", "f0")))
    release(spark)
    own = without(docs, F.col("id"), copies.select(F.col("id").alias("copy")))
    dealt = cut(rare_common(prefixes(own, shingle)))
    release(spark)
    near = cut(dealt.select("node").distinct())
    sets = stash(shingle_sets(matching(docs, F.col("id"), near), shingle))
    release(spark)
    tested = cut(_stars(dealt, sets))
    release(spark)
    true, nearest = cut(similar(tested, sets)), NEAREST
    label = named(linked.union(true))
    # of a small bucket all candidates were tested; one in parts is connected by its first node only, so it may still
    # hold pairs of different groups even if all of the stars hold
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(SMALL, STARRED))
    most = counts.agg(F.max("n")).first()[0]
    if most is None or most <= STARRED and tested.join(true, ["src", "dst"], "left_anti").isEmpty():
        return label
    dealt = cut(spread_join(dealt, counts, ["key"]).select("key", "node", "at"))
    nodes = cut(dealt.select("node").distinct())
    while True:
        labels = cut(nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        pairs = cut(_across(dealt, sets, labels, nearest))
        release(spark)
        more = pairs.agg(F.max("more")).first()[0]
        new = cut(pairs.select("src", "dst").join(tested, ["src", "dst"], "left_anti"))
        found = cut(similar(new, sets))
        release(spark)
        if not found.isEmpty():
            true = cut(true.union(found))
            label = named(linked.union(true))
        if not more:
            return label
        tested, nearest = cut(tested.union(new)), nearest * 16


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` less all but one (the smallest id) of each group of near duplicates.

    Texts link as in near_duplicates, if their 64-bit SimHash fingerprints differ in two bits or fewer, found by the
    same lossless join of segment counts. Texts also link if the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more, which is decided by the sets themselves: such fingerprints may differ in ten bits and more.
    These candidates share a shingle of the prefixes of their sets, which every similar pair does. Groups are the
    components of both kinds of links. Texts of the same words are one node. Null and wordless texts are one group. Rows
    with a null id stay. Rows that share an id are one document, and one of them stays: the first by a hash of its text. Other columns pass; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    known = columns(docs, id_col, text_col).where("id is not null")
    hashes = cut(word_hashes(known))
    reps = cut(hashes.groupBy("d0", "d1").agg(F.min("id").alias("node"), F.min("f0").alias("f0")).select("node", "f0"))
    copies = cut(hashes.select("id").distinct().join(reps, F.col("id") == F.col("node"), "left_anti"))
    release(docs.sparkSession)
    later = similar_groups(known, reps, copies, shingle).where("label < node").select("node")
    id_ = fresh("id", docs.columns)
    doc = F.col(f"`{id_col}`")
    own = without(docs.where(doc.isNotNull()), doc.cast("long"), cut(copies.union(later).toDF(id_)))
    if not known.groupBy("id").count().where("count > 1").isEmpty():
        place, content = fresh("place", docs.columns), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
        first = Window.partitionBy(doc).orderBy(F.xxhash64(F.col(f"`{text_col}`").cast("string")), content)
        own = own.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return own.unionByName(docs.where(doc.isNull()))
