"""Near-duplicate join of word n-gram sets by parity sketches.

A document's set holds its distinct shingles of four words. Two sets of sizes a and b with a
Jaccard similarity of at least p differ in at most (1 - p) / (1 + p) * (a + b) elements.

* Sketch: every element flips one bit; a sketch is cut into blocks, more of them in bands of
  larger sets. An element in only one of two sets flips one bit in one block, so the Hamming
  distance of two sketches is a lower bound of the sets' difference, and two similar sets
  agree in all blocks but as many as they differ in elements.
* Pigeonhole join: beside its bits, a block has the XOR of its elements' 64-bit hashes, which
  equal blocks share and others do not. Of m blocks of which at least m - d agree, the
  d + 1 that come first in any fixed order must have one in common. The order here puts the
  rarest blocks first. Blocks that nobody else has lead it and match nothing: a set with d + 1
  of them is done, and others are joined on the few rarest blocks that remain. A set enters a
  band's join with its own d, and the next smaller band as well when a partner can be there.
* Verify: pairs that pass the Hamming bound are compared as whole sets.

Nothing in a group of equal blocks is paired with everything else. First each member is paired
with the group's smallest document, and the links found give components; a group of thousands of
near copies costs one comparison each. Documents of groups that still hold more than one component
are joined again on more and smaller blocks, where most sets have enough blocks of their own to
be done. In the groups that remain, sketches of different components are compared in cells of
bounded size, and only pairs within the Hamming bound leave a cell. So no link between
components is missed. Documents with equal sets are one node throughout.

Where an id has several texts, each of them is a node of its own, named by a hash of both, and nodes
of one id are linked; components are then named after their smallest id.

Defined cases: without words or text a set is empty and links with nothing; rows that share an id
have the links of all its texts; a row without an id takes no part, its component is
null. Equal 64-bit hashes of shingles are taken for equal shingles.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgate.llm import hashing
from reelgate.llm.components import components
from reelgate.llm.tables import id_key, real_id, text_or_empty
from reelgate.operators.scan import map_sorted_groups
from reelgate.session import pinned

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A band's sizes reach up to this multiple of its smallest.
BAND = 1.6
#: Blocks of a band for each difference that its largest sets allow: for all documents, and for
#: those that are compared across components.
SPARE, FINE = 1.25, 2.5
#: Members of a group that one step compares with each other, about.
CELL = 256
#: Pairs with one hub that one sorted run compares, about.
RUN = 64
_U = np.uint64


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = hashing.joined(texts)
    data = hashing.ASCII_LOWER[data]
    starts, ends, owner = hashing.words(data, offsets)
    tokens = hashing.word_hashes(data, starts, ends)
    grams = hashing.ngrams(tokens, size)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            found.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            found.append(hashing.ngrams(tokens[a:b], int(b - a)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def _band_edges() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


EDGES = _band_edges()


def band_views(size: int, percent: int = PERCENT, spare: float = SPARE) -> list[tuple[int, int, int]]:
    """Band, number of blocks and most differing blocks, for each join that a set of this size enters."""
    band = bisect_right(EDGES, size) - 1

    def blocks(of: int) -> int:
        top = EDGES[of + 1] - 1
        return math.ceil(spare * (most_apart(top, top * 100 // percent, percent) + 1))

    views = [(band, blocks(band), most_apart(size, size * 100 // percent, percent))]
    while band and -(-size * percent // 100) < EDGES[band]:
        band -= 1
        views.append((band, blocks(band), most_apart(size, EDGES[band + 1] - 1, percent)))
    return views


def sketch(elements: np.ndarray, band: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the blocks and the sketch's bits (eight a block, as 64-bit words)."""
    spread = hashing.mixed(elements + _U(band + 1))
    block = (((spread >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)
    bit = (spread & _U(7)).astype(np.int64)
    words = -(-blocks // 8)
    bits = np.packbits(np.bincount(block * 8 + bit, minlength=words * 64) & 1)
    total = np.zeros(blocks, dtype=np.uint64)
    np.bitwise_xor.at(total, block, elements)
    place = hashing.mixed(np.arange(blocks, dtype=np.uint64) * _U(1024) + _U(band))
    return hashing.mixed(total + place).view(np.int64), bits.view(np.int64)


def described(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, spare: float = SPARE
) -> DataFrame:
    """id, n_shingles, two hashes of the set and its views (band, apart, keys, bits)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            for first, part in hashing.steps(texts):
                rows = []
                for elements in shingle_sets(part, size):
                    views = []
                    for band, blocks, apart in (
                        band_views(len(elements), percent, spare) if len(elements) else []
                    ):
                        keys, bits = sketch(elements, band, blocks)
                        views.append({"band": band, "apart": apart, "keys": keys, "bits": bits})
                    spread = hashing.mixed(elements)
                    rows.append(
                        (
                            len(elements),
                            int(np.bitwise_xor.reduce(spread).view(np.int64)) if len(spread) else 0,
                            int(spread.sum().view(np.int64)) if len(spread) else 0,
                            views,
                        )
                    )
                out = pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "views"])
                out.insert(0, "id", batch["id"].iloc[first : first + len(part)].to_numpy())
                yield out

    rows = docs.select(id_key().alias("id"), text_or_empty().alias("text"))
    return rows.mapInPandas(
        describe,
        "id long, n_shingles long, f1 long, f2 long,"
        " views array<struct<band: int, apart: int, keys: array<long>, bits: array<long>>>",
    ).withColumn("id", real_id("id"))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The whole sets of some documents, as binary."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in hashing.steps([t.encode() for t in batch["text"]]):
                yield pd.DataFrame(
                    {
                        "id": batch["id"].iloc[first : first + len(part)],
                        "elements": [s.tobytes() for s in shingle_sets(part, size)],
                    }
                )

    wanted = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(ids, "id", "left_semi")
    return wanted.mapInPandas(cut, "id long, elements binary")


def rarest_blocks(views: DataFrame) -> DataFrame:
    """id, band and key of the blocks on which a set is joined: of its rarest, those not its alone."""
    keys = views.select("id", "band", "apart", F.size("keys").alias("blocks"), F.explode("keys").alias("key"))
    held = pinned(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    shared = keys.join(held, "key")
    own = Window.partitionBy("id", "band")
    alone = F.col("blocks") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("n", "key"))
    ranked = shared.withColumn("place", place).withColumn("alone", alone)
    return ranked.where(F.col("place") + F.col("alone") <= F.col("apart") + 1).select("id", "band", "key")


def near(pairs: DataFrame, views: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, band) whose sizes and sketches allow a link, as (a, b)."""

    def side(name: str) -> DataFrame:
        return views.select(
            F.col("id").alias(name),
            "band",
            F.col("n_shingles").alias(f"n_{name}"),
            F.col("bits").alias(f"bits_{name}"),
        )

    apart = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    total = F.col("n_a") + F.col("n_b")
    possible = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (
        apart * (100 + percent) <= total * (100 - percent)
    )
    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    return both.where(possible).select("a", "b").distinct()


def compared(placed: DataFrame, views: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one key and different components whose sizes and sketches allow a link."""
    many = pinned(placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("chunks")))
    rows = placed.join(views.select("id", "band", "n_shingles", "bits"), ["id", "band"]).join(many, "key")
    chunk = F.pmod(F.hash("id"), F.col("chunks"))
    cells = rows.withColumn("chunk", chunk).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select(
        "key",
        F.least("chunk", "with").alias("low"),
        F.greatest("chunk", "with").alias("high"),
        "id",
        "component",
        "n_shingles",
        "bits",
    )

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        ids, part = held["id"].to_numpy(), held["component"].to_numpy()
        sizes = held["n_shingles"].to_numpy()
        bits = np.stack(held["bits"].to_numpy()).view(np.uint64)
        found = []
        for at in range(len(ids) - 1):
            rest = slice(at + 1, None)
            total = sizes[at] + sizes[rest]
            least = np.minimum(sizes[at], sizes[rest]) * 100 >= np.maximum(sizes[at], sizes[rest]) * percent
            other = np.flatnonzero((part[rest] != part[at]) & least)
            if not len(other):
                continue
            apart = np.bitwise_count(bits[at] ^ bits[rest][other]).sum(axis=1, dtype=np.int64)
            near = other[apart * (100 + percent) <= total[other] * (100 - percent)]
            found += [(min(ids[at], b), max(ids[at], b)) for b in ids[rest][near]]
        return pd.DataFrame(found, columns=["a", "b"])

    found = map_sorted_groups(cells, ["key", "low", "high"], ["id"], compare, "a long, b long")
    return found.distinct()


def verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) that link. Runs of one hub's pairs stream past its set, which is held."""
    pairs = pinned(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = pinned(_sets(docs, ids, size))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    dealt = pairs.join(many, "a").withColumn("run", F.pmod(F.hash("b"), "runs"))
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select(
        "a", "run", F.lit(1).alias("member"), "b", "elements"
    )
    hubs = (
        dealt.select("a", "run")
        .distinct()
        .join(sets.withColumnRenamed("id", "a"), "a")
        .select("a", "run", F.lit(0).alias("member"), F.col("a").alias("b"), "elements")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hub = None, []
        for batch in batches:
            links = []
            for a, run, member, b, raw in zip(
                batch["a"], batch["run"], batch["member"], batch["b"], batch["elements"], strict=True
            ):
                elements = np.frombuffer(raw, dtype=np.uint64)
                if (a, run) != at:
                    at, hub = (a, run), []
                if not member:
                    hub.append(elements)
                    continue
                for own in hub:
                    common = np.intersect1d(own, elements, assume_unique=True).size
                    if 100 * common >= percent * (own.size + elements.size - common) > 0:
                        links.append((a, b))
                        break
            yield pd.DataFrame(links, columns=["a", "b"])

    runs = members.unionByName(hubs).repartition("a", "run").sortWithinPartitions("a", "run", "member")
    return runs.mapInPandas(compare, "a long, b long")


def _groups(views: DataFrame, twins: DataFrame) -> DataFrame:
    """key, band, id and hub (smallest id) of the groups of two and more different sets."""
    offered = rarest_blocks(views).join(twins, "id", "left")
    offered = pinned(offered.select("key", "band", F.coalesce("twin", "id").alias("id")).distinct())
    hubs = offered.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other"))
    hubs = pinned(hubs.where(F.col("hub") != F.col("other")).select("key", "hub"))
    return pinned(offered.join(hubs, "key"))


def _across(shared: DataFrame, known: DataFrame) -> DataFrame:
    """The members, with their component, of groups that hold several components."""
    placed = shared.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = pinned(spread.where(F.col("low") != F.col("high")).select("key"))
    return placed.join(several, "key").select("key", "band", "id", "component")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    text_hash = F.xxhash64(text_or_empty())
    several = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    several = several.agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high"))
    several = pinned(several.where(F.col("low") != F.col("high")).select("doc_id", F.lit(True).alias("several")))
    if several.isEmpty():
        return _joined(docs, percent, size)
    node = F.when(F.col("several"), F.xxhash64("doc_id", text_hash)).otherwise(F.col("doc_id"))
    named = docs.select("doc_id", "text").join(several, "doc_id", "left")
    named = pinned(named.select(F.col("doc_id").alias("owner"), node.alias("doc_id"), "text", "several"))
    owners = pinned(named.where("several").select("owner", F.col("doc_id").alias("node")).distinct())
    # one node of each id stands for it; the others are linked to that one
    anchors = owners.groupBy("owner").agg(F.min("node").alias("a"))
    same = owners.join(anchors, "owner").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    found = _joined(named.select("doc_id", "text"), percent, size, same)
    owned = found.join(owners, F.col("doc_id") == F.col("node"), "left").select(
        F.coalesce("owner", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("component")
    )
    owned = pinned(owned)
    smallest = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return owned.join(smallest, "component", "left").select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame, percent: int, size: int, same: DataFrame | None = None) -> DataFrame:
    """``near_duplicates`` of ids with one text each; ``same`` (a, b) are further links."""
    table = pinned(described(docs, percent, size))
    nodes = table.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    views = nodes.select("id", "n_shingles", F.explode("views").alias("v")).select("id", "n_shingles", "v.*")
    one_of = nodes.groupBy("f1", "f2", "n_shingles").agg(
        F.min("id").alias("twin"), F.max("id").alias("other")
    )
    one_of = pinned(one_of.where(F.col("twin") != F.col("other")).drop("other"))
    twins = pinned(
        nodes.select("id", "f1", "f2", "n_shingles")
        .join(one_of, ["f1", "f2", "n_shingles"])
        .where(F.col("id") != F.col("twin"))
        .select("id", "twin")
        .distinct()
    )
    shared = _groups(views, twins)

    stars = shared.where(F.col("id") != F.col("hub")).select(
        F.col("hub").alias("a"), F.col("id").alias("b"), "band"
    )
    copies = twins.select(F.col("twin").alias("a"), F.col("id").alias("b"))
    if same is not None:
        copies = copies.unionByName(same)
    links = pinned(
        verified(near(stars.distinct(), views, percent), docs, percent, size).unionByName(copies)
    )

    # groups that hold more than one component: test the pairs between components
    known = pinned(components(links))
    mixed = _across(shared, known).select("id").distinct()
    fine_rows = docs.join(mixed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    fine = pinned(described(fine_rows, percent, size, FINE)).where(F.col("n_shingles") > 0)
    fine = fine.select("id", "n_shingles", F.explode("views").alias("v")).select("id", "n_shingles", "v.*")
    placed = pinned(_across(_groups(fine, twins), known))
    more = verified(compared(placed, fine, percent), docs, percent, size)
    final = components(links.unionByName(more)).withColumnRenamed("node", "id")
    return table.join(final, "id", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of the smallest id of each component; of rows without an id, one of each text."""
    found = near_duplicates(docs, **options)
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti")
    key = ["__id", "__hash"]
    keyed = [id_key().alias("__id"), F.xxhash64(text_or_empty()).alias("__hash")]
    again = docs.select(*keyed).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    again = pinned(again.select(*key))
    if again.isEmpty():
        return kept
    # only rows that repeat move
    held = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *keyed)
    once = held.join(again, key, "left_semi").groupBy(*key).agg(F.min("__row").alias("__row"))
    rest = held.join(again, key, "left_anti").select("__row")
    whole = rest.unionByName(once.select("__row"))
    return whole.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
