"""Conversation prefix trie by time-forward processing.

Conversations are rebuilt behind a shared head and every distinct sequence of their first d turns is
a node. A node's name is a digest of sums over its turns (each turn hashed with its place), so that
names follow from running sums, which ``ordered_scan`` computes for a conversation of any length.

Totals of subtrees go up by time-forward processing:

1. The nodes are range-partitioned into shards by their first turns, then by the conversation they
   are named after, so that a subtree lies in one shard or few. In each shard they are sorted by reverse level
   order and streamed once: a node takes what its children have sent out of a priority queue, adds
   its own and sends the totals to its parent. Messages that nobody in the shard takes leave it.
2. The nodes that such messages name are looked up in their shards, and a second stream tells through
   which node outside each of them passes its totals on. These few make a tree of their own, across shard
   roots, which is streamed in the same way in one task.
3. A third stream adds what came from outside and gives the whole totals.

Shapes at scale: texts are hashed and their words counted once, then rows are narrow. Sorting is
Spark's external sort. A queue holds ``HELD`` messages and spills sorted runs beyond that into an
unnamed file, which belongs to the task alone, as the runs of Spark's own sort do, and is gone with it. Messages between
shards are one per shard and node outside, at most the shards times the length of the path to a
shard's first node, as long as shards are ranges of first turns.
Digests of ids stream over id lists that were sorted and joined in ranges before.

Defined cases: turns are ordered by number (null first), then role, then text; a null role or text is
empty; rows that repeat are turns that repeat; rows without a conv_id are left out; an empty table gives
no rows. Conversations that end up without a turn are members of the root.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.llm.tables import WORD, shuffle_parts
from reelgate.operators.scan import Running, group_rows, ordered_scan
from reelgate.session import pinned

#: Conversations of one group take their head from the one whose id is a multiple of this.
GROUP = 20
#: A head has fewer turns than this.
HEADS = 4
#: Turns that decide a node's shard before its conversation does.
LEADING = 6
#: Nodes of a shard, at most about.
SHARD = 200_000
#: Messages that a queue holds before it spills.
HELD = 65_536
#: Ids joined into one piece before they are digested.
LIST = 4_096
_SUMS = ("s0", "s1", "s2", "s3")
_SHARDED = ["shard", "depth", "node"]


class SpillingQueue:
    """A priority queue of (key, value) that keeps at most ``held`` entries in memory.

    When it is full its entries become a sorted run in an unnamed file; runs are merged as they
    are read back, a block of entries at a time.
    """

    BLOCK = 512

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.file, self.order, self.spills = held, [], None, 0, 0
        self.runs: list[tuple[tuple, int, list]] = []

    def push(self, key: tuple, value: tuple) -> None:
        if len(self.heap) >= self.held:
            self._spill()
        # a running number keeps values out of comparisons
        heapq.heappush(self.heap, (key, self.order, value))
        self.order += 1

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.heap.sort()
        # written from the last block to the first, each with the place of the one after it
        after, first = -1, None
        for begin in reversed(range(0, len(self.heap), self.BLOCK)):
            packed = pickle.dumps((after, self.heap[begin : begin + self.BLOCK]))
            after = self.file.seek(0, 2)
            self.file.write(struct.pack("<q", len(packed)) + packed)
            first = after
        self.heap = []
        self.spills += 1
        self._load(first)

    def _load(self, place: int) -> None:
        """Put the block at ``place`` in line, keyed by its first entry."""
        if place < 0:
            return
        self.file.seek(place)
        size = struct.unpack("<q", self.file.read(8))[0]
        after, block = pickle.loads(self.file.read(size))
        block.reverse()
        heapq.heappush(self.runs, (block[-1][:2], after, block))

    def head(self) -> tuple | None:
        """The smallest key, or None."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0][:2]):
            return self.runs[0][0][0]
        return self.heap[0][0] if self.heap else None

    def pop(self) -> tuple[tuple, tuple]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0][:2]):
            _, after, block = heapq.heappop(self.runs)
            key, _, value = block.pop()
            if block:
                heapq.heappush(self.runs, (block[-1][:2], after, block))
            else:
                self._load(after)
            return key, value
        key, _, value = heapq.heappop(self.heap)
        return key, value


def _climb(batches: Iterator[pd.DataFrame], held: int) -> Iterator[pd.DataFrame]:
    """Totals of the nodes of a stream in reverse level order, and of messages that nobody takes.

    A row is (shard, depth, node, parent_depth, parent, as_child, children, leaves, saved), the last
    three being its own share; rows that come out have ``outside`` set where they are such messages.
    """
    columns = ["outside", "shard", "depth", "node", "children", "leaves", "saved"]
    queue, shard = SpillingQueue(held), None

    def taken(upto: tuple | None) -> Iterator[tuple]:
        """Messages for nodes before ``upto``, put together per node."""
        while (at := queue.head()) is not None and (upto is None or at < upto):
            yield (True, shard, -at[0], at[1], *received(at))

    def received(at: tuple) -> tuple[int, int, int]:
        children = leaves = saved = 0
        while queue.head() == at:
            c, n, s = queue.pop()[1]
            children, leaves, saved = children + c, leaves + n, saved + s
        return children, leaves, saved

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.shard != shard:
                out.extend(taken(None))
                shard = row.shard
            at = (-row.depth, row.node)
            out.extend(taken(at))
            children, leaves, saved = received(at)
            children, leaves, saved = children + row.children, leaves + row.leaves, saved + row.saved
            out.append((False, shard, row.depth, row.node, children, leaves, saved))
            if row.parent is not None:
                queue.push((-row.parent_depth, row.parent), (row.as_child, leaves, saved))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(list(taken(None)), columns=columns)


def _exits(batches: Iterator[pd.DataFrame], held: int) -> Iterator[pd.DataFrame]:
    """For each wanted node of a stream in reverse level order, the node outside that it leads to."""
    queue, shard = SpillingQueue(held), None

    def left(upto: tuple | None) -> Iterator[tuple]:
        while (at := queue.head()) is not None and (upto is None or at < upto):
            yield from ((depth, node, -at[0], at[1]) for depth, node in queue.pop()[1])

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.shard != shard:
                out.extend(left(None))
                shard = row.shard
            at = (-row.depth, row.node)
            out.extend(left(at))
            below = [(row.depth, row.node)] if row.wanted else []
            while queue.head() == at:
                more = queue.pop()[1]
                below, more = (below, more) if len(below) >= len(more) else (more, below)
                below.extend(more)
            if below and row.parent is not None:
                queue.push((-row.parent_depth, row.parent), below)
        yield pd.DataFrame(out, columns=["depth", "node", "parent_depth", "parent"])
    yield pd.DataFrame(list(left(None)), columns=["depth", "node", "parent_depth", "parent"])


def _streamed(rows: DataFrame, parts: int, function, schema: str, held: int) -> DataFrame:
    dealt = rows.repartitionById(parts, "shard").sortWithinPartitions("shard", F.col("depth").desc(), "node")
    return dealt.mapInPandas(lambda batches: function(batches, held), schema)


_TOTALS = "outside boolean, shard int, depth int, node string, children long, leaves long, saved long"


def subtree_totals(nodes: DataFrame, parts: int, held: int = HELD) -> DataFrame:
    """node, children, leaves and saved of whole subtrees.

    ``nodes`` has shard, depth, node, parent (null at the root) and a node's own leaves and saved.
    """
    none = F.lit(0).cast("long")
    rows = nodes.select(
        *_SHARDED,
        (F.col("depth") - 1).alias("parent_depth"),
        "parent",
        F.lit(1).cast("long").alias("as_child"),
        none.alias("children"),
        "leaves",
        "saved",
    )
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    outside = _streamed(rows, parts, _climb, _TOTALS, held).where("outside").groupBy("depth", "node").agg(*sums)
    outside = pinned(outside)

    wanted = rows.join(outside.select("node", F.lit(True).alias("wanted")), "node", "left").select(
        *_SHARDED, "parent_depth", "parent", F.coalesce("wanted", F.lit(False)).alias("wanted")
    )
    schema = "depth int, node string, parent_depth int, parent string"
    exits = _streamed(wanted, parts, _exits, schema, held)
    # one row per node that shards send to: the tree across shard roots
    roots = outside.join(exits, ["depth", "node"], "left").select(
        F.lit(0).alias("shard"), "depth", "node", "parent_depth", "parent", none.alias("as_child"), "children", "leaves", "saved"
    )
    whole = _streamed(roots, 1, _climb, _TOTALS, held).where("not outside")
    arrived = pinned(whole.select("node", *[F.col(c).alias(f"in_{c}") for c in ("children", "leaves", "saved")]))

    def with_arrived(column: str) -> Column:
        return (F.col(column) + F.coalesce(f"in_{column}", none)).alias(column)

    fed = rows.join(arrived, "node", "left").select(
        *_SHARDED, "parent_depth", "parent", "as_child", *[with_arrived(c) for c in ("children", "leaves", "saved")]
    )
    return _streamed(fed, parts, _climb, _TOTALS, held).where("not outside").select("node", "children", "leaves", "saved")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Turns (conv_id, place, a, b, words) and conversations (conv_id, n_turns) after rebuilding.

    The third is whether a conversation is too large for one task.
    """
    said = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    large = said.groupBy("conv_id").count().where(F.col("count") > group_rows(said)).count() > 0
    placed = ordered_scan(said, ["conv_id"], ["turn", "role", "text"], {"place": Running("ordinal")}, large=large)
    placed = pinned(
        placed.select(
            "conv_id",
            "place",
            *[F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in enumerate("ab")],
            F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))).cast("long").alias("words"),
        )
    )
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("donor", F.expr(f"conv_id - conv_id % {GROUP}")).withColumn(
        "head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    )
    donors = sizes.where(F.col("conv_id") == F.col("donor")).select("donor", F.col("n").alias("given"))
    plan = pinned(
        sizes.join(donors, "donor", "left").select(
            "conv_id", "donor", "n", "head", F.least("head", F.coalesce("given", F.lit(0).cast("long"))).alias("taken")
        )
    )
    # at most HEADS - 1 turns of a donor, for at most GROUP conversations
    heads = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "donor")
    heads = heads.join(plan, "donor").where(F.col("place") < F.col("taken"))
    own = placed.join(plan, "conv_id").where(F.col("place") >= F.col("head"))
    own = own.withColumn("place", F.col("place") - F.col("head") + F.col("taken"))
    columns = ["conv_id", "place", "a", "b", "words"]
    sized = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_turns"))
    return pinned(heads.select(columns).unionByName(own.select(columns))), sized, large


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums).cast("binary"))


def members(turns: DataFrame) -> DataFrame:
    """node, parent, depth, path, conv_id, ends, words: one row per conversation and prefix."""
    rows, sized, large = rebuilt_turns(turns)
    low = F.lit(0xFFFFFFFF)
    halves = []
    for seed in (0, 1):
        value = F.xxhash64(F.lit(seed), "place", "a", "b")
        halves += [value.bitwiseAND(low), F.shiftrightunsigned(value, 32)]
    terms = [f"t{i}" for i in range(len(_SUMS))]
    rows = rows.select("*", *[h.alias(t) for h, t in zip(halves, terms, strict=True)])
    summed = ordered_scan(
        rows, ["conv_id"], ["place"], {s: Running("sum", t) for s, t in zip(_SUMS, terms, strict=True)}, large=large
    )
    # at most LEADING turns of a conversation
    lead = F.array_sort(F.collect_list(F.struct("place", F.lpad(F.hex("t0"), 8, "0").alias("turn"))))
    leads = rows.where(F.col("place") < LEADING).groupBy("conv_id").agg(
        F.array_join(F.transform(lead, lambda x: x["turn"]), "").alias("lead")
    )
    known = sized.join(leads, "conv_id", "left")
    depth = (F.col("place") + 1).cast("int")
    inner = summed.join(known, "conv_id").select(
        _name(depth, [F.col(s) for s in _SUMS]).alias("node"),
        _name(depth - 1, [F.col(s) - F.col(t) for s, t in zip(_SUMS, terms, strict=True)]).alias("parent"),
        depth.alias("depth"),
        F.substring("lead", F.lit(1), 8 * F.least(depth, F.lit(LEADING))).alias("path"),
        "conv_id",
        (depth == F.col("n_turns")).alias("ends"),
        "words",
    )
    nothing = F.lit(0).cast("long")
    root = sized.select(
        _name(F.lit(0), [nothing] * len(_SUMS)).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).alias("depth"),
        F.lit("").alias("path"),
        "conv_id",
        (F.col("n_turns") == 0).alias("ends"),
        nothing.alias("words"),
    )
    return inner.unionByName(root)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of id lists: node, first id, ids joined; rows come sorted by node and id."""
    node, ids = None, []
    for batch in batches:
        out = []
        for name, number in zip(batch["node"], batch["conv_id"], strict=True):
            if ids and (name != node or len(ids) == LIST):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = name
            ids.append(number)
        yield pd.DataFrame(out, columns=["node", "first", "ids"])
    rest = [(node, ids[0], ",".join(map(str, ids)))] if ids else []
    yield pd.DataFrame(rest, columns=["node", "first", "ids"])


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node and the digest of its whole list; pieces come sorted by node and first id."""
    node, digest = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch["node"], batch["ids"], strict=True):
            if name == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((node, digest.hexdigest()))
            node, digest = name, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["node", "digest"])
    rest = [] if node is None else [(node, digest.hexdigest())]
    yield pd.DataFrame(rest, columns=["node", "digest"])


def id_digests(ends: DataFrame, parts: int) -> DataFrame:
    """node and the SHA-256 of its conv_ids, ascending, in decimal, comma-joined."""
    dealt = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInPandas(_listed, "node string, first long, ids string")
    whole = pieces.repartition("node").sortWithinPartitions("node", "first")
    return whole.mapInPandas(_digested, "node string, digest string")


def prefix_trie(turns: DataFrame, *, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent."""
    rows = pinned(members(turns))
    nodes = pinned(
        rows.groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.min("depth").alias("depth"),
            F.min("path").alias("path"),
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.col("ends").cast("long")).alias("n_ends"),
            F.min("words").alias("words"),
        )
    )
    parts = max(shuffle_parts(nodes), -(-nodes.count() // shard))
    # the ranges are drawn once and stored, as every stream has to meet the same shards
    ranged = nodes.repartitionByRange(parts, "path", "conv_id", "depth").select(
        "*",
        F.spark_partition_id().alias("shard"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    ranged = pinned(ranged)
    totals = subtree_totals(ranged, parts, held)
    above = ranged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    digests = id_digests(rows.where("ends").select("node", "conv_id"), parts)
    done = ranged.join(totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "node")
    done = done.join(above, "parent", "left").join(digests, "node", "left")
    return done.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "node",
        "parent",
    )
