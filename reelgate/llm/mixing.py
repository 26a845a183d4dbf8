"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule, a piecewise linear curve of its demand over training
time 0 to 1. The curve's integral, scaled to the words the source is to give, is its cumulative
demand. A document's place in the cumulative supply of its source (documents in a hashed order,
read again from the start as often as needed) is looked up in the inverse of that demand, which
is the training position of the copy, and the copies are range-sorted by position.

Shapes at scale: texts are read once to count words, everything after that works on narrow
rows. Cumulative supply is a sum over hash buckets of a source (about the square root of all
rows, so that neither the buckets nor the rows of one bucket grow out of hand) plus a window
inside a bucket; a source with a third of all documents is spread over all buckets.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; rows
without an id and repeated rows are documents like others; size-0 documents are never taken; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.llm.tables import SPACE, WORD, id_key, text_or_empty, unpacked, whole_row
from reelgate.session import pinned

WEIGHTS = (1, 2, 3)
#: No document is taken more often than this, and so no source beyond this multiple of its size.
REPEATS = 3
#: Demand over time as (time, height) knots; sources take the curves in turn. Heights are
#: relative: a curve only says when a source's words are wanted, not how many.
CURVES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.25), (0.75, 1.0), (1.0, 1.5)),
)

Curve = Sequence[tuple[float, float]]


def sized(docs: DataFrame) -> DataFrame:
    """The narrow row of each document: id, source, words and a hash of the text."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS
) -> DataFrame:
    """Words wanted from each source.

    All words are shared by weight, and no source gives more than ``repeats`` times what it
    has. Sharing the excess again and again ends where every source gives the smaller of its
    limit and one common level times its weight. Sorted by limit over weight, the level is what
    is left to share when the first source stays below its limit.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    ordinal = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("source_no", ordinal).withColumn(
        "weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))
    )
    limit = F.col("source_size") * repeats
    order = Window.orderBy((limit / F.col("weight")), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0)
    )
    levelled = ranked.withColumn("level", left / weight_left).withColumn(
        "below", limit / F.col("weight") > F.col("level")
    )
    common = F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.coalesce(common * F.col("weight"), limit.cast("double"))
    return levelled.select(
        "source",
        "source_no",
        "source_size",
        "source_docs",
        F.least(limit.cast("double"), share).alias("target"),
    )


def _position(fraction: Column, number: Column, curves: Sequence[Curve]) -> Column:
    """The time at which a curve's integral reaches a fraction of its whole."""
    found = F.lit(None).cast("double")
    for at, curve in enumerate(curves):
        pieces = [
            (t0, t1 - t0, h0, h1, (h0 + h1) / 2 * (t1 - t0))
            for (t0, h0), (t1, h1) in zip(curve[:-1], curve[1:], strict=True)
        ]
        whole = sum(p[4] for p in pieces)
        wanted = fraction * F.lit(whole)
        value, base = F.lit(curve[-1][0]), whole
        for t0, width, h0, h1, area in reversed(pieces):
            base -= area
            inside = F.greatest(wanted - F.lit(base), F.lit(0.0))
            slope = (h1 - h0) / width
            root = F.sqrt(F.greatest(F.lit(h0 * h0) + F.lit(2 * slope) * inside, F.lit(0.0)))
            step = F.when(inside == 0, F.lit(0.0)).otherwise(
                inside * 2 / (F.lit(h0) + root)
            )
            here = F.lit(t0) + F.least(step, F.lit(width))
            value = F.when(wanted < F.lit(base + area), here).otherwise(value)
        found = F.when(number % len(curves) == at, value).otherwise(found)
    return found


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    curves: Sequence[Curve] = CURVES,
    seed: str = "mix",
) -> DataFrame:
    """What the mix takes of each document: one narrow row per row of ``docs``.

    ``taken`` counts words, ``copies`` holds one struct (position, words) per copy; a copy has
    all words of its document, except for the one document per source at which the target is
    reached, whose last copy is cut there.
    """
    sizes = pinned(sized(docs))
    targets = source_targets(sizes, weights, repeats)
    buckets = isqrt(max(1, sizes.count() - 1)) + 1
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("key", key)
        .withColumn(
            "bucket",
            F.floor(
                F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)
            ),
        )
    )
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy("source_no", "bucket")
        .agg(F.sum("size").alias("held"))
        .withColumn("base", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
        .drop("held")
    )
    inside = (
        Window.partitionBy("source_no", "bucket")
        .orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    wanted = F.floor(F.col("target") + 0.5)
    has = F.greatest(F.col("source_size"), F.lit(1))
    placed = (
        rows.join(bases, ["source_no", "bucket"])
        .withColumn("before", before)
        .withColumn("wanted", wanted)
        .withColumn("rounds", F.floor(F.col("wanted") / has).cast("int"))
        .withColumn(
            "rest",
            F.greatest(
                F.least(F.col("wanted") - F.col("rounds") * F.col("source_size") - F.col("before"), F.col("size")),
                F.lit(0),
            ),
        )
    )

    def copy(number: Column, words: Column) -> Column:
        demand = (number * F.col("source_size") + F.col("before")) / F.greatest(F.col("wanted"), F.lit(1))
        return F.struct(
            _position(demand, F.col("source_no"), curves).alias("position"), words.alias("words")
        )

    copies = F.filter(
        F.array(
            *[
                copy(
                    F.lit(number),
                    F.when(F.col("rounds") > number, F.col("size"))
                    .when(F.col("rounds") == number, F.col("rest"))
                    .otherwise(F.lit(0)),
                )
                for number in range(repeats)
            ]
        ),
        lambda c: c["words"] > 0,
    )
    return placed.select(
        "doc_id",
        "source",
        "text_hash",
        "size",
        "source_size",
        "target",
        (F.col("rounds") * F.col("size") + F.col("rest")).alias("taken"),
        copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every copy as a row of ``docs``, range-sorted by training position.

    A document taken twice is two rows. The copy at which a source's target is reached holds
    the first words only; its text is cut after the last of them and ``n_chars`` follows.
    """
    plan = mix(docs, **options)
    group = ["id", "text_hash"]
    ways = plan.select(id_key().alias("id"), "text_hash", "size", "copies").groupBy(*group).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list("copies")).alias("ways")
    )
    rows = docs.select(
        whole_row(docs), id_key().alias("id"), F.xxhash64(text_or_empty()).alias("text_hash")
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*group)))
    taken = rows.join(ways, group).withColumn("copy", F.explode(F.element_at("ways", F.col("nth"))))
    pieces = F.split(text_or_empty("row.text"), rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    words = F.col("copy.words")
    cut = words < F.col("size")
    first_words = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    text = F.when(cut, first_words).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(taken.orderBy("copy.position", "id", "text_hash"), docs.columns, changed)
