"""Line dedup on hashes alone, giving keep bitmaps.

A line's key is its text without white space at both ends, A-Z lower-cased. Keys that enough
documents hold lose all their lines except in the document with the largest id.

Three steps, all of them built-in columns:

1. Each document gives each of its keys once, as two 64-bit hashes. Counting documents per hash
   combines inside the map tasks first, so a line that a third of all documents share reaches its
   reducer as one row per map task.
2. Lines whose hash is held often enough are range-partitioned by hash and sorted by document
   (largest first) and position. A hash is cut into slices of its id range, as many as its
   count asks for, so that a hot hash spans partitions; the stream meets the line's first
   occurrence at the start of slice 0, and everything after that document goes.
3. The lines to drop come together per document and become runs of kept lines, a run-length
   compressed bitmap. Texts move once, when bitmaps are applied.

Defined cases: a null or empty text is one empty line; all rows of an id are one document, and rows
without an id are one together, whose id is smaller than any other. Rows that repeat with id and
text are kept or dropped alike. Work is linear in a line's length, whatever blanks it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.llm.tables import (
    SPACE_CHARS,
    ascii_lower,
    id_key,
    text_or_empty,
    unpacked,
    whole_row,
)
from reelgate.session import pinned

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines of one hash that share a slice, about.
SLICE_LINES = 256


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, docs, first and last id of the keys that at least ``min_docs`` documents hold."""
    lines = F.filter(F.split(ascii_lower(text_or_empty()), "\n"), lambda x: F.char_length(x) >= min_chars)
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)))
    keys = docs.select(id_key().alias("id"), F.explode(F.array_distinct(stripped)).alias("key"))
    hashed = keys.where(F.char_length("key") >= min_chars).select("id", *_hashes(F.col("key")))
    # a document counts once however many rows it has; that takes a shuffle, for those with several rows
    several = pinned(
        docs.groupBy(id_key().alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id")
    )
    if not several.isEmpty():
        again = hashed.join(several, "id", "left_semi").distinct()
        hashed = hashed.join(several, "id", "left_anti").unionByName(again)
    return (
        hashed.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("low"), F.max("id").alias("last"))
        .where(F.col("docs") >= min_docs)
    )


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, text_hash and position of every line to drop."""
    lines = docs.select(
        id_key().alias("id"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
        F.posexplode(F.split(text_or_empty(), "\n")).alias("position", "line"),
    )
    key = F.btrim(ascii_lower(F.col("line")), F.lit(SPACE_CHARS))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", key)
    lines = lines.where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "text_hash", "position", *_hashes(F.col("key")))
    # stored first, so that the join below can split a hot hash among tasks
    repeated = pinned(repeated_keys(docs, min_chars, min_docs))
    held = pinned(lines.join(repeated, ["h1", "h2"]))

    span = F.col("last").cast("double") - F.col("low").cast("double")
    width = F.greatest(span / F.ceil(F.col("docs") / SLICE_LINES), F.lit(1.0))
    below = F.col("last").cast("double") - F.col("id").cast("double")
    sliced = held.withColumn("slice", F.floor(below / width)).repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("id").desc(), "position")
    first = F.first("id").over(stream)
    kept = (F.col("slice") == 0) & (F.col("id") == F.col("keeper"))
    return sliced.withColumn("keeper", first).where(~kept).select("id", "text_hash", "position")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, text_hash, dropped positions' count and the kept runs, of documents that lose lines.

    ``keep`` is an array of (start, length); the last run is open, its length is null.
    """
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set("position")).alias("p")
    )
    last = F.size("p") - 1
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == last) | (F.get("p", i + 1) != x + 1))
    runs = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)),
        starts,
        lambda begin, stop: F.struct(begin.alias("start"), (stop - begin).alias("length")),
    )
    kept = F.filter(runs, lambda r: r["length"].isNull() | (r["length"] > 0))
    return gone.select("id", "text_hash", F.size("p").cast("long").alias("dropped"), kept.alias("keep"))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Each row of ``docs`` (as struct ``row``) with ``dropped``, ``keep`` and ``kept_text``."""
    maps = keep_bitmaps(docs, min_chars, min_docs)
    rows = docs.select(
        whole_row(docs), id_key().alias("id"), F.xxhash64(text_or_empty()).alias("text_hash")
    )
    joined = rows.join(maps, ["id", "text_hash"], "left")

    def kept_text(lines: Column) -> Column:
        chosen = F.transform(
            "keep",
            lambda r: F.slice(lines, r["start"] + 1, F.coalesce(r["length"], F.size(lines))),
        )
        return F.array_join(F.flatten(chosen), "\n")

    # the lambda binds the split lines once for all runs
    applied = F.element_at(F.transform(F.array(F.split(text_or_empty("row.text"), "\n")), kept_text), 1)
    text = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(applied)
    return joined.select("row", "dropped", "keep", text.alias("kept_text"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated lines dropped; ``n_chars`` follows the text."""
    count = F.when(F.col("keep").isNull(), F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))
    changed = {
        "text": F.col("kept_text"),
        "n_chars": count.otherwise(F.char_length("kept_text").cast("long")),
    }
    return unpacked(with_bitmaps(docs, **options), docs.columns, changed)
