"""URL filters as a sort-merge range join.

The canonical key of a host is its labels in reverse, each ended by a dot: ``net.example.``. A rule fits its
host and all subdomains, which are exactly the keys that begin with the rule's key: an interval in sort order.
A sweep over sorted keys keeps the stack of rule hosts whose intervals are open; they nest, so the stack is the
chain of the url's rule hosts. Paths are looked up at each host on the stack by the lengths its rules have.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import fresh, map_rows, some
from graphloom.session import prepare

#: A rule set of up to this many rules is sent to every executor (some 100 bytes each); a larger one is range-partitioned with the urls.
BROADCAST_RULES = 100_000
#: Keys sampled for each range of the partitioned join.
SAMPLED = 50

ALLOW, BLOCK = "allow", "block"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def key_column(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Host:
    """The rules of one host, by path."""

    __slots__ = ("key", "host", "paths", "sizes")

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.sizes = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.paths or verdict == BLOCK:  # a path both allowed and blocked is blocked
            self.paths[path] = verdict
            self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> str | None:
        for n in self.sizes:
            if n <= len(path) and path[:n] in self.paths:
                return path[:n]
        return None


def judge(stack: list[Host], path: str) -> tuple[str | None, str]:
    """The rule that wins and its verdict: the longest text of host and path; of equals the longer host."""
    best = None
    for h in reversed(stack):
        p = h.longest(path)
        if p is not None and (best is None or len(h.host) + len(p) > len(best[0].host) + len(best[1])):
            best = h, p
    return (best[0].host + best[1], best[0].paths[best[1]]) if best else (None, ALLOW)


def advance(stack: list[Host], key: str) -> None:
    """Close the intervals that end before the key."""
    while stack and not key.startswith(stack[-1].key):
        stack.pop()


def hosts(rules: Iterable[tuple[str, str, str]]) -> list[Host]:
    """Rules (verdict, host, path) as hosts in key order."""
    found: dict[str, Host] = {}
    for verdict, host, path in rules:
        key = key_of(host)
        found.setdefault(key, Host(key, host)).add(path, verdict)
    return [found[k] for k in sorted(found)]


def sweep(urls: list[tuple[str, str]], rules: list[Host], begins: list[str]) -> list[tuple[str | None, str]]:
    """Judge urls (host, path): both sides in key order, one pass from the first url's key on.

    ``begins``: the keys of the rules. Intervals that are open at the first key have a prefix of it for a key.
    """
    keys = [key_of(h) for h, _ in urls]
    out: list[tuple[str | None, str]] = [(None, ALLOW)] * len(urls)
    first = min(keys, default="")
    at = bisect.bisect_left(begins, first)
    parts = (bisect.bisect_left(begins, first[:end]) for end in range(len(first)))
    stack = [rules[k] for end, k in enumerate(parts) if k < at and begins[k] == first[:end]]
    for i in sorted(range(len(urls)), key=keys.__getitem__):
        key = keys[i]
        while at < len(rules) and rules[at].key <= key:
            advance(stack, rules[at].key)
            stack.append(rules[at])
            at += 1
        advance(stack, key)
        out[i] = judge(stack, urls[i][1])
    return out


def _broadcast(named: DataFrame, rules: list[tuple[str, str, str]], host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """Few rules: every batch of urls is sorted and swept where it is; nothing is shuffled."""
    found = hosts(rules)
    shared = named.sparkSession.sparkContext.broadcast((found, [h.key for h in found]))
    at = [named.columns.index(c) for c in (host, path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            pairs = list(zip(*(b.column(k).to_pylist() for k in at), strict=True))
            found = sweep(pairs, *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*b.schema.names, rule, verdict])

    return map_rows(named, run, [T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())])


def _partitioned(named: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str, ranges: int) -> DataFrame:
    """Many rules: both sides in the same key ranges, each rule in every range that its interval meets.

    Ranges are cut by (key, path, a hash of the row), so that one host or url with a third of all rows is
    spread over many; a range sorts and sweeps as a stream.
    """
    spark = named.sparkSession
    names = named.columns
    row = F.struct(*(F.col(f"`{c}`") for c in named.columns)).alias("row")
    urls = named.select(key_column(F.col(f"`{host}`")).alias("key"), F.col(f"`{path}`").alias("path"), F.xxhash64(*(F.col(f"`{c}`") for c in named.columns)).alias("salt"), row)
    order = F.struct("key", "path", "salt")
    n = ranges * SAMPLED
    drawn = urls.select(order.alias("o")).orderBy(F.xxhash64("o", F.lit(5))).limit(n).collect()
    bounds = sorted((r.o.key, r.o.path, r.o.salt) for r in drawn)
    bounds = sorted(set(bounds[SAMPLED::SAMPLED]))
    lines = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(key, path, salt):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([bisect.bisect_right(lines.value, x) for x in zip(key, path, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([list(range(bisect.bisect_left(lines.value, (k, "", -(2**63))), bisect.bisect_right(lines.value, (k + "\U0010ffff", "", 0)) + 1)) for k in key])

    none = F.lit(None).cast(urls.schema["row"].dataType)
    left = urls.select(range_of("key", "path", "salt").alias("part"), "key", F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("host"), "row")
    right = rules.select(F.explode(ranges_of("key")).alias("part"), "key", F.lit(0).alias("kind"), "path", "verdict", "host", none.alias("row"))
    both = left.union(right).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Host] = []
        part = None
        for b in some(batches):
            mine, found = [], []
            cols = [b.column(k).to_pylist() for k in range(6)]
            for i, (p, key, kind, path_, verdict_, host_) in enumerate(zip(*cols, strict=True)):
                if p != part:
                    part, stack = p, []
                advance(stack, key)
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Host(key, host_))
                    stack[-1].add(path_, verdict_)
                else:
                    mine.append(i)
                    found.append(judge(stack, path_))
            if mine:
                rows = b.column(6).take(pa.array(mine)).flatten()
                yield pa.RecordBatch.from_arrays([*rows, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*names, rule, verdict])

    return both.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())]))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", limit: int = BROADCAST_RULES, ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and the host's subdomains if
    the url's path starts with the rule's; the longest (host and path together) wins, of equals the one with
    the longer host, of one rule with both verdicts the block. No rule: null and ``allow``. A null url or
    one without ``://`` has an empty host and path. Rules without a host or verdict are left out, a null path
    is empty. Added columns that clash with the input's get a trailing underscore; repeated rows pass. Urls of any
    length are judged whole. An empty table gives an empty result; without rules every url is allowed.
    """
    spark = prepare(pages.sparkSession)
    taken = pages.columns
    host, path, rule, verdict = (fresh(c, taken) for c in ("host", "path", "rule", "verdict"))
    named = pages.withColumn(host, url_host(F.col(f"`{url_col}`"))).withColumn(path, url_path(F.col(f"`{url_col}`")))
    valid = rules.where("coalesce(host, '') <> '' and verdict is not null")
    valid = valid.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    few = valid.limit(limit + 1).collect()
    if len(few) <= limit:
        return _broadcast(named, [tuple(r) for r in few], host, path, rule, verdict)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _partitioned(named, valid.select("verdict", "host", key_column(F.col("host")).alias("key"), "path"), host, path, rule, verdict, ranges)
