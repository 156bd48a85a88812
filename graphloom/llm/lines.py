"""Line dedup over overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fresh
from graphloom.session import spread_join

WINDOW = 3


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, mark, spans): the merged spans [s, e) of line numbers covered by later occurrences of a window.

    A window is ``window`` consecutive lines of one document (lines end at ``\\n`` alone). Of equal
    windows the one with the smallest (id, mark, position) is the first; ``mark`` is a hash of the
    text, so rows with equal id and text count as one document and other rows that share an id don't.
    """
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = lines.where("id is not null and text is not null").select("id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("line"))
    lines = lines.where(F.size("line") >= window)
    # two hashes of each window: 128 bits hold at any size
    one = F.transform("line", lambda x: F.xxhash64(x))
    two = F.transform("line", lambda x: F.xxhash64(x, F.lit(1)))
    hashed = lines.select("id", "mark", one.alias("h1"), two.alias("h2"))

    def at(name: str) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.size(name) - (window - 1)), lambda i: F.xxhash64(*(F.get(F.col(name), i + (k - 1)) for k in range(window))))

    zipped = F.arrays_zip(at("h1").alias("a"), at("h2").alias("b"))
    wins = hashed.select("id", "mark", F.posexplode(zipped).alias("pos", "w")).select("id", "mark", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    # partial aggregation first: a window that a third of all documents have is one row from each task, and the join
    # that tells its later occurrences is divided at run time
    first = wins.groupBy("a", "b").agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.max(F.struct("id", "mark", "pos")).alias("last"))
    first = first.where("first <> last").select("a", "b", "first")
    later = spread_join(wins, first, ["a", "b"]).where(F.struct("id", "mark", "pos") > F.col("first")).select("id", "mark", "pos").distinct()
    order = Window.partitionBy("id", "mark").orderBy("pos")
    step = F.when(F.col("pos") - F.lag("pos").over(order) <= window, 0).otherwise(1)
    islands = later.withColumn("step", step).withColumn("island", F.sum("step").over(order))
    merged = islands.groupBy("id", "mark", "island").agg(F.min("pos").alias("s"), (F.max("pos") + window).alias("e"))
    return merged.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with every line removed that a later occurrence of a repeated three-line window covers.

    Same rows and columns, text changed; ``n_lines`` and ``n_removed`` name counts to add. Null texts
    stay null (0 lines), texts of fewer lines than a window and rows with a null id stay unchanged;
    blank lines count as lines; a text may become empty. Equal windows inside one document: the first
    stays. Repeated rows (same id and text) are changed alike. Texts of any length are judged whole; an empty
    table gives an empty result; other columns pass unchanged, whatever their names.
    """
    taken = docs.columns
    id_, mark, spans, lines = (fresh(x, taken) for x in ("id", "mark", "spans", "lines"))
    found = repeated_spans(docs, id_col, text_col, window).select(F.col("id").alias(id_), F.col("mark").alias(mark), F.col("spans").alias(spans))
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    joined = docs.join(found, (doc.cast("long") == F.col(id_)) & (F.xxhash64(text.cast("string")) == F.col(mark)), "left")
    joined = joined.withColumn(lines, F.split(text.cast("string"), "\n"))
    many = F.size(spans)
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(spans), i - 1)["e"])  # noqa: E731  where span i - 1 ends
    begin = lambda i: F.when(i == many, F.size(lines)).otherwise(F.get(F.col(spans), i)["s"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), many), lambda i: F.slice(F.col(lines), end(i) + 1, begin(i) - end(i))))
    removed = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x["e"] - x["s"]), F.lit(0))
    whole = F.col(spans).isNull()
    out = [F.when(whole, text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in taken]
    if n_lines:
        out.append(F.when(text.isNull(), 0).otherwise(F.size(lines)).alias(n_lines))
    if n_removed:
        out.append(removed.alias(n_removed))
    return joined.select(*out)
