"""Filter interaction audit: what five text filters remove alone, together and in every order.

A document's failures are bits, one per filter:

* A: under 200 words; B: fewer distinct words than half of all; C: more than 3 in 100 code points are
  A-Z; D: holds one of ``#$%&*|``. They follow from the text alone.
* E: identical to the text of a smaller doc_id anywhere in the table, an existential self-join: a
  left-semi join on hash, exact text and smaller id.

The ids that E marks are united with those of the other failures, bits are put together per id,
and documents are counted per part and combination of bits. All 120 orders follow from these counts:
what a filter removes depends on the set of filters before it only, of which there are 16 per filter.

Shapes at scale: texts are read where they lie for A to D. For E the hashes are counted first (a sum
that combines inside the map tasks), and only texts whose hash occurs twice move. The self-join's
other side is one row per different text, the smallest id that holds it, so no pairs of copies
arise; both sides are salted by the number of copies, so a text that a third of all documents share
is compared in many tasks. What comes after that is one narrow row per document, then at most 128
rows per part.

Defined cases: a null text is empty, a null part is the empty string; a row without an id is
identical to no smaller one and smaller than none; rows that repeat with id and text are all
counted and do not mark each other; an id has quality (toxic) 1 if any of its labels says so, and
labels without an id count for no document; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.llm.tables import NO_ID, SPACE, SPACE_CHARS, id_key, text_or_empty
from reelgate.session import pinned

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
#: Copies of one text that share a salt, about.
COPIES = 512


def text_failures(text: Column) -> Column:
    """The bits of filters A to D."""
    stripped = F.btrim(text, F.lit(SPACE_CHARS))

    def judged(words: Column) -> Column:
        count = F.when(stripped == "", 0).otherwise(F.size(words))
        distinct = F.when(stripped == "", 0).otherwise(F.size(F.array_distinct(words)))
        upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
        return (
            F.when(count < MIN_WORDS, 1).otherwise(0)
            + F.when(100 * distinct.cast("long") < DISTINCT_PERCENT * count.cast("long"), 2).otherwise(0)
            + F.when(100 * upper.cast("long") > UPPER_PERCENT * F.char_length(text).cast("long"), 4).otherwise(0)
            + F.when(F.rlike(text, F.lit(SYMBOLS)), 8).otherwise(0)
        )

    # the lambda binds the words once
    return F.element_at(F.transform(F.array(F.split(stripped, f"[{SPACE}]+")), judged), 1)


def copies_of_smaller_ids(docs: DataFrame, counts: DataFrame, part: str) -> DataFrame:
    """id, hash and part of the documents whose text a smaller id holds; ``counts`` has copies per hash."""
    texts = docs.select(
        id_key().alias("id"),
        F.xxhash64(text_or_empty()).alias("hash"),
        F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        text_or_empty().alias("text"),
    ).where(F.col("id") != NO_ID)
    salts = F.ceil(F.col("copies") / COPIES)
    often = pinned(counts.where(F.col("copies") > 1).select("hash", salts.alias("salts")))
    held = pinned(texts.join(often, "hash").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))))
    first = F.min("id").alias("first")
    salted = held.groupBy("hash", "salts", "salt", "text").agg(first)
    firsts = salted.groupBy("hash", "salts", "text").agg(F.min("first").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    smaller = firsts.select("hash", "salt", "text", "first").alias("smaller")
    same = [F.col(f"held.{c}") == F.col(f"smaller.{c}") for c in ("hash", "salt", "text")]
    marked = held.alias("held").join(smaller, [*same, F.col("smaller.first") < F.col("held.id")], "left_semi")
    return marked.select("id", "hash", "part").distinct()


def combinations(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, bits, n, good, toxic: the documents of each combination of failures."""
    rows = pinned(
        docs.select(
            id_key().alias("id"),
            F.xxhash64(text_or_empty()).alias("hash"),
            F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
            text_failures(text_or_empty()).alias("bits"),
            F.lit(1).cast("long").alias("n"),
        )
    )
    copies = copies_of_smaller_ids(docs, rows.groupBy("hash").agg(F.sum("n").alias("copies")), part)
    marked = copies.select("id", "hash", "part", F.lit(1 << 4).alias("bits"), F.lit(0).cast("long").alias("n"))
    failures = rows.unionByName(marked).groupBy("id", "hash", "part")
    failures = failures.agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max((F.col("quality") == 1).cast("long")).alias("good"),
            F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
        )
    )

    def counted(column: str) -> Column:
        return F.sum(F.col("n") * F.coalesce(column, F.lit(0))).alias(column)

    judged = failures.join(known, "id", "left").groupBy("part", "bits")
    return judged.agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def _places(docs: DataFrame) -> DataFrame:
    """filter, earlier, filter_order, step: the 600 steps of all orders, with the set of filters before."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for step, number in enumerate(order, 1):
            rows.append((number, earlier, "".join(FILTERS[i] for i in order), step))
            earlier |= 1 << number
    return docs.sparkSession.createDataFrame(rows, "filter int, earlier int, filter_order string, step int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sets = [(n, m) for n in range(len(FILTERS)) for m in range(1 << len(FILTERS)) if not m >> n & 1]
    pairs = F.array(
        *[F.struct(F.lit(n).alias("filter"), F.lit(1 << n).alias("own"), F.lit(m).alias("earlier")) for n, m in sets]
    )
    rows = combinations(docs, labels, part).select("*", F.explode(pairs).alias("p")).select("*", "p.filter", "p.earlier")
    own = F.col("p.own")
    fails = F.col("bits").bitwiseAND(own) != 0
    gone = F.col("bits").bitwiseAND(F.col("earlier")) != 0

    def over(where: Column, value: Column | None = None) -> Column:
        return F.sum(F.when(where, F.col("n") if value is None else value).otherwise(0))

    # a document of k failures is removed by each of their filters in one k-th of all orders
    share = F.lit(len(list(permutations(FILTERS)))).cast("long") / F.bit_count("bits")
    effects = rows.groupBy("part", "filter", "earlier").agg(
        over(~fails & ~gone).alias("kept"),
        over(fails & ~gone).alias("removed"),
        over(fails & gone).alias("redundant"),
        over(F.col("bits") == own).alias("unique_fails"),
        over(fails & ~gone, F.col("good")).alias("good_lost"),
        over(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        over(fails, F.col("n") * F.round(share).cast("long")).alias("shapley"),
    )
    # 600 rows, whatever the input
    return effects.join(F.broadcast(_places(docs)), ["filter", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
