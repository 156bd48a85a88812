"""Language ID with bit-sliced Bloom filters over character n-grams.

Row h of the table holds one bit for each language, so one lookup answers for all languages at once: the
rows of an n-gram's hashes, and-ed, are the mask of the languages whose filter holds it. Over a text the
hits of each language are counted from the masks; a filter's known share of false positives is taken
out of its count, and the largest share of n-grams truly held decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import fresh, map_rows, mix, some, strings
from graphloom.session import prepare

UNDECIDED = "und"
#: Characters of an n-gram; words are lower-cased letters between blanks.
GRAM = 4
#: Labelled documents per language to fit on (in expectation, chosen by a hash of their id).
FIT_DOCS = 2000
#: An n-gram belongs to a language if its share of that language's n-grams reaches this ...
LEAST_SHARE = 2e-5
#: ... and this part of its largest share in any language.
LEAST_RATIO = 0.2
#: Rows of the table, and hashes of an n-gram.
TABLE_BITS, HASHES = 20, 2
#: Characters handled at once.
BLOCK = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


_LETTER: dict[int, bool] = {}


def _is_letter(x: np.ndarray) -> np.ndarray:
    out = ((x >= 97) & (x <= 122)) | ((x >= 65) & (x <= 90))
    odd = np.flatnonzero(x > 127)
    if len(odd):
        found, back = np.unique(x[odd], return_inverse=True)
        for c in found.tolist():
            if c not in _LETTER:
                _LETTER[c] = chr(c).isalpha()
        out[odd] = np.array([_LETTER[c] for c in found.tolist()], bool)[back]
    return out


def _grams(x: np.ndarray) -> np.ndarray:
    """Hash of each n-gram."""
    h = np.zeros(len(x) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + x[k : len(x) - GRAM + 1 + k].astype(np.uint64)
    return mix(h)


def text_grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, in blocks; none if it has no letter.

    Of the lower-cased letters, with a blank for each run of other characters and at both ends, and more blanks after
    them if they are fewer than an n-gram. What a block ends with goes before the next one, so blocks don't show.
    """
    text = text.lower()
    tail, any_letter, given = np.full(1, 32, np.uint32), False, False
    for at in range(0, len(text), BLOCK):
        x = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter(x)
        any_letter |= bool(letter.any())
        x = np.r_[tail[-1:], np.where(letter, x, np.uint32(32))]
        x = np.r_[tail[:-1], x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]]
        if len(x) >= GRAM:
            yield _grams(x)
            given = True
        tail = x[-(GRAM - 1) :]
    if any_letter:
        x = tail if tail[-1] == 32 else np.r_[tail, np.uint32(32)]
        if not given:
            yield _grams(np.r_[x, np.full(max(0, GRAM - len(x)), 32, np.uint32)])
        elif len(x) >= GRAM:
            yield _grams(x)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # [word, row] masks of up to 64 languages each
    false: np.ndarray  # share of false positives of each language's filter

    @staticmethod
    def fit(held: dict[str, np.ndarray]) -> Model:
        """From the n-gram hashes of each language."""
        languages = tuple(sorted(held))
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << TABLE_BITS), np.uint64)
        for k, lang in enumerate(languages):
            for rows in Model.rows(held[lang]):
                table[k // 64, rows] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([((table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return Model(languages, table, fill**HASHES)

    @staticmethod
    def rows(h: np.ndarray) -> list[np.ndarray]:
        return [((h * odd) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for odd in _ODD[:HASHES]]

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """How many n-grams the text has, and how many of them each language's filter holds."""
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        for g in text_grams(text):
            n += len(g)
            one, *more = self.rows(g)
            for w in range(len(self.table)):
                masks = self.table[w, one]
                for rows in more:
                    masks = masks & self.table[w, rows]
                for k in range(64 * w, min(len(hits), 64 * w + 64)):
                    hits[k] += np.count_nonzero(masks & (np.uint64(1) << np.uint64(k % 64)))
        return n, hits

    def predict(self, text: str) -> tuple[str, float]:
        n, hits = self.counts(text)
        if not n or not len(self.languages):
            return UNDECIDED, 0.0
        true = np.clip((hits - self.false * n) / np.maximum(1 - self.false, 1e-9), 0, n) / n
        best = int(np.argmax(true))  # the first language in order, if several have as many
        return self.languages[best], float(true[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """Learn a filter for each language from rows with a language; others are left out.

    Fitted on about ``fit_docs`` rows a language, whole texts; only n-grams above a least share of their
    language come to the driver, 1 / LEAST_SHARE of them a language at most.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    total = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Model.fit({})
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 20))
    limit = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, int(min(1.0, fit_docs / n) * (1 << 20)) + 1)))
    chosen = rows.where(part < limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in seen.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            seen.clear()

        held = 0
        for b in some(batches):
            for text, lang in zip(strings(b), b.column(1).to_pylist(), strict=True):
                for g in text_grams(text):
                    seen.setdefault(lang, []).append(g)
                    held += len(g)
                if held > 1 << 22:
                    yield from flush()
                    held = 0
        yield from flush()

    grams = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = grams.groupBy("lang").agg(F.sum("n").alias("all"))
    share = grams.join(F.broadcast(sums), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("by"))
    mine = top.select("gram", F.transform(F.filter("by", lambda x: x["share"] >= F.col("top") * LEAST_RATIO), lambda x: x["lang"]).alias("langs"))
    held: dict[str, list[int]] = {lang: [] for lang in total}
    for r in mine.toLocalIterator():
        for lang in r.langs:
            held[lang].append(r.gram)
    return Model.fit({lang: np.array(g, np.int64).view(np.uint64) for lang, g in held.items()})


def _run(docs: DataFrame, model: Model, text_col: str, keep, lang: str, score: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            found = [shared.value.predict(t) for t in strings(b, f"c{at}")]
            out = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield keep(b, out)

    added = [] if lang is None else [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_rows(docs, run, added)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the share of its n-grams that the language truly holds.

    ``und`` and 0 for a null text and one without a letter; ties go to the first language in order.
    Other columns, repeated rows and nulls pass unchanged; an empty table gives an empty result.
    """
    lang, score = fresh(lang, docs.columns), fresh(score, docs.columns)
    return _run(docs, model, text_col, lambda b, out: pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, lang, score]), lang, score)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows whose language is known (not ``und``) with a score of ``least`` or more; columns unchanged.

    Null and empty texts and texts without a letter go; repeated rows and null ids are judged like others; an empty
    table gives an empty result.
    """
    return _run(docs, model, text_col, lambda b, out: b.filter(pa.array([a != UNDECIDED and s >= least for a, s in zip(out[0].to_pylist(), out[1].to_pylist(), strict=True)], pa.bool_())), None, None)
