"""Exact top-k inner product search by ball trees.

Vectors are dealt into shards by hash, and each shard becomes one ball tree: nodes with a
centre and a radius, leaves of ``LEAF`` vectors. For a query q no vector of a node has an inner
product above q * centre + |q| * radius. A block of queries walks a tree from the node with the
largest bound down; a query leaves a node when the bound lies below its k-th score so far.
A block searches its shards in waves of 1, 2, 4, ... shards; after each wave the k-th score found so
far is shared, as the bound that every query enters the shards of the next wave with.

Shapes at scale: trees and query blocks are rows of at most ``SHARD`` and ``BLOCK`` vectors, so a
task holds one of each. Each block meets each shard once (a query set against all rows, in
blocks), and gives at most k rows a query that reach the shared bound. There are as many waves as
the number of shards has binary digits.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
rows that repeat in id and vector count once; other rows with a query's id are not its
candidates; vectors are only compared with vectors of the same length; with fewer than k
candidates all are given. Scores are exact integers of 64 bits, also beyond 2**53; one that would leave
64 bits is held at the end of the range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgate.session import pinned

LEAF = 128
#: Most vectors of a shard, and of a block of queries.
SHARD = BLOCK = 32_768
#: Shards are smaller than that only to give every core a few.
LEAST_SHARD = 1_024
#: No score yet. Real scores are larger.
NOTHING = np.int64(np.iinfo(np.int64).min)


def ball_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors; per node its span and children (begin, end, left, right), centre, radius."""
    order = np.arange(len(vectors))
    spans, centres, radii = [], [], []
    todo = [(0, len(vectors), -1, 0)]
    while todo:
        begin, end, parent, side = todo.pop()
        number = len(spans)
        own = vectors[order[begin:end]].astype(np.float64)
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        spans.append([begin, end, -1, -1])
        centres.append(centre)
        radii.append(np.sqrt(away.max()))
        if parent >= 0:
            spans[parent][2 + side] = number
        if end - begin <= leaf or away.max() == 0:
            continue
        one = own[np.argmax(away)]
        other = own[np.argmax(((own - one) ** 2).sum(axis=1))]
        middle = (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(own @ (other - one), middle)]
        todo += [(begin, begin + middle, number, 0), (begin + middle, end, number, 1)]
    return order, np.array(spans, dtype=np.int64), np.array(centres), np.array(radii)


class Best:
    """The k best candidates so far of each query: highest score first, then smallest id."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.scores = np.full((queries, k), NOTHING)
        self.ids = np.zeros((queries, k), dtype=np.int64)
        self.given = bound

    def bound(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.given[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = ((scores >= self.bound(rows)[:, None]) & (scores != NOTHING)).any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        k = self.scores.shape[1]
        every = np.concatenate([self.scores[rows], scores], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        # the complement falls as the score rises, and unlike the negative it has no overflow
        best = np.lexsort((names, ~every), axis=-1)[:, :k]
        self.scores[rows] = np.take_along_axis(every, best, axis=1)
        self.ids[rows] = np.take_along_axis(names, best, axis=1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, held to the range of 64 bits.

    Doubles do the work where they can hold every sum, integers of 64 bits where those can, and
    integers of any length in the rest, in all cases without an array beyond rows x columns.
    """
    most = int(np.abs(queries.astype(np.float64)).max(initial=0)) * int(np.abs(vectors.astype(np.float64)).max(initial=0))
    most *= queries.shape[1]
    if most < 1 << 52:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return queries @ vectors.T
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.clip(whole, int(NOTHING) + 1, int(np.iinfo(np.int64).max)).astype(np.int64)


def search(
    query_ids: np.ndarray,
    queries: np.ndarray,
    bound: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    tree: tuple[np.ndarray, np.ndarray, np.ndarray],
    k: int,
) -> Best:
    """Branch and bound of a block of queries through one tree (vectors in tree order)."""
    spans, centres, radii = tree
    best = Best(len(queries), k, bound)
    plain = queries.astype(np.float64)
    norms = np.sqrt((plain**2).sum(axis=1))
    slack = 1e-9 * (1 + norms * (np.sqrt((centres**2).sum(axis=1)).max() + radii.max()))

    def above(node: int, rows: np.ndarray) -> np.ndarray:
        return plain[rows] @ centres[node] + norms[rows] * radii[node] + slack[rows]

    everyone = np.arange(len(queries))
    top = above(0, everyone)
    heap = [(-top.max(), 0, everyone, top)]
    while heap:
        _, node, rows, top = heapq.heappop(heap)
        bound = best.bound(rows)
        live = (bound == NOTHING) | (top >= bound)
        rows = rows[live]
        if not len(rows):
            continue
        begin, end, left, right = spans[node]
        if left < 0:
            scores = products(queries[rows], vectors[begin:end])
            scores[query_ids[rows][:, None] == ids[None, begin:end]] = NOTHING
            best.offer(rows, scores, ids[begin:end])
            continue
        for child in (left, right):
            over = above(child, rows)
            heapq.heappush(heap, (-over.max(), int(child), rows, over))
    return best


def whole_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the floors of ``scale`` times each component, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
        .where(usable)
        .select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
        .distinct()
    )


def _packed(rows: DataFrame, groups: list[str], build: bool) -> DataFrame:
    """One row per group: its ids and vectors as binary, with the ball tree where ``build`` asks."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids = pdf["vec_id"].to_numpy(dtype=np.int64)
        vectors = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        out = pdf[groups].head(1).copy()
        spans = centres = radii = np.zeros(0)
        if build:
            order, spans, centres, radii = ball_tree(vectors)
            ids, vectors = ids[order], vectors[order]
        for name, values in (("ids", ids), ("vectors", vectors), ("spans", spans), ("centres", centres), ("radii", radii)):
            out[name] = [np.ascontiguousarray(values).tobytes()]
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups)
    return rows.groupBy(*groups).applyInPandas(
        pack, f"{schema}, ids binary, vectors binary, spans binary, centres binary, radii binary"
    )


def _searched(cells: DataFrame, k: int) -> DataFrame:
    """The best of every query of every cell: a block of queries and a shard, side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids = np.frombuffer(row.q_ids, dtype=np.int64)
                queries = np.frombuffer(row.q_vectors, dtype=np.int64).reshape(len(query_ids), row.dim)
                bound = np.full(len(query_ids), NOTHING)
                if row.q_bound is not None:
                    bound = np.frombuffer(row.q_bound, dtype=np.int64)
                ids = np.frombuffer(row.ids, dtype=np.int64)
                tree = (
                    np.frombuffer(row.spans, dtype=np.int64).reshape(-1, 4),
                    np.frombuffer(row.centres, dtype=np.float64).reshape(-1, row.dim),
                    np.frombuffer(row.radii, dtype=np.float64),
                )
                vectors = np.frombuffer(row.vectors, dtype=np.int64).reshape(len(ids), row.dim)
                best = search(query_ids, queries, bound, ids, vectors, tree, k)
                used = (best.scores > NOTHING) & (best.scores >= bound[:, None])
                at, place = np.nonzero(used)
                yield pd.DataFrame(
                    {
                        "dim": row.dim,
                        "block": row.block,
                        "shard": row.shard,
                        "query_no": at,
                        "query_id": query_ids[at],
                        "vec_id": best.ids[at, place],
                        "score": best.scores[at, place],
                    }
                )

    return cells.mapInPandas(
        run, "dim int, block int, shard int, query_no long, query_id long, vec_id long, score long"
    )


def top_k(table: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id ``every`` divides."""
    vectors = pinned(whole_vectors(table, scale).withColumn("dim", F.size("v")))
    count = vectors.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-count // SHARD), min(-(-count // LEAST_SHARD), 2 * cores), 1)
    draw = F.xxhash64("vec_id", "v")
    trees = pinned(_packed(vectors.withColumn("shard", F.pmod(draw, F.lit(shards)).cast("int")), ["dim", "shard"], True))
    asking = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(-(-asking.count() // BLOCK), 1)
    asking = asking.withColumn("block", F.pmod(draw, F.lit(blocks)).cast("int"))
    queries = pinned(
        _packed(asking, ["dim", "block"], False).select(
            "dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
        )
    )
    numbers = trees.groupBy("dim").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    planned = pinned(queries.join(numbers, "dim"))
    best, begin, width = None, 0, 1
    while begin < shards:
        # blocks begin at different shards
        wave = F.transform(
            F.sequence(F.lit(begin), F.least(F.lit(begin + width), F.size("shards")) - 1),
            lambda at: F.get("shards", ((F.col("block") + at) % F.size("shards")).cast("int")),
        )
        asked = _bounded(planned, best, k) if best is not None else planned.withColumn("q_bound", F.lit(None).cast("binary"))
        cells = asked.where(F.size("shards") > begin).withColumn("shard", F.explode(wave)).drop("shards")
        found = _searched(cells.join(trees, ["dim", "shard"]), k)
        best = pinned(_merged(found if best is None else best.drop("rank").unionByName(found), k))
        begin, width = begin + width, 2 * width
    return best.select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "block", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded(planned: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Blocks of queries with the k-th scores found so far (``NOTHING`` before there are k)."""
    kth = best.where(F.col("rank") == k).groupBy("dim", "block").agg(
        F.collect_list(F.struct("query_no", F.col("score").alias("kth"))).alias("bounds")
    )

    def as_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for ids, bounds in zip(batch["q_ids"], batch["bounds"], strict=True):
                bound = np.full(len(ids) // 8, NOTHING)
                for one in [] if bounds is None else bounds:
                    bound[one["query_no"]] = one["kth"]
                packed.append(bound.tobytes())
            batch["q_bound"] = packed
            yield batch[["dim", "block", "q_ids", "q_vectors", "shards", "q_bound"]]

    schema = "dim int, block int, q_ids binary, q_vectors binary, shards array<int>, q_bound binary"
    return planned.join(kth, ["dim", "block"], "left").mapInPandas(as_bounds, schema)
