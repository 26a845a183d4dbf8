"""Improbable-feature digests of documents.

Every window of ``WINDOW`` bytes has an entropy, in ``LEVELS`` steps. Levels that are rare in the
corpus are improbable, and windows of improbable levels make good features: in every run of
``WINDOW`` successive windows the rarest (leftmost on ties) gets a vote, and windows with at least
``VOTES`` votes are selected. Texts with fewer than ``WINDOW`` such runs take shorter runs, fewer
votes, and their first and last window in any case, so that every byte of theirs counts. Selected
windows are hashed into a chain of Bloom filters, at most ``FEATURES`` in each, and two digests
are compared filter by filter: the overlap of their bits beyond what chance gives the best of so
many filters, over the most it can be, weighed by the filter's features.

Shapes at scale: one pass counts levels (a row per level and task), another one makes digests. Where
each document is compared with its successor, documents move once: into runs of successive
ids, whose first document is copied to the end of the run before. Runs are bounded by ids read
off a range partitioning of the ids alone, so that texts are shuffled a single time.

Defined cases: a null text is empty and has an empty digest; two empty digests are alike (1.0), an
empty one is unlike any other (0.0); a text shorter than a window is one feature; rows of equal id
follow each other in the order of a hash of their texts, rows without an id come last.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.llm import hashing
from reelgate.llm.tables import id_key, real_id, shuffle_parts, text_or_empty

WINDOW = 64
LEVELS = 1000
#: Windows below this level are runs of few characters; they are selected last.
LEAST_LEVEL = 100
VOTES = 16
#: The same for short texts.
SHORT_RUN = 16
SHORT_VOTES = 4
FEATURES = 160
FILTER_BYTES = 256
#: Bits that one feature sets.
HASHES = 5
#: Runs of documents per shuffle partition.
RUNS = 2
_STEP = 1 << 18

_c = np.arange(WINDOW + 1, dtype=np.float64)
_weights = np.round(_c * np.log2(np.maximum(_c, 1)) * 1024).astype(np.int32)
# what one more occurrence of a byte adds to the sum of c * log2(c)
_GAIN = np.diff(_weights)
_MOST = int(_weights[WINDOW])
_NORMAL = NormalDist()


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that begins at each byte (none for the last 63)."""
    before = np.zeros(len(data), dtype=np.uint8)
    after = np.zeros(len(data), dtype=np.uint8)
    for shift in range(1, WINDOW):
        same = data[shift:] == data[:-shift]
        before[shift:] += same
        after[:-shift] += same
    steps = _GAIN[before]
    steps[WINDOW:] -= _GAIN[after[:-WINDOW]]
    total = np.cumsum(steps)[WINDOW - 1 :]
    return (LEVELS - total * LEVELS // _MOST).astype(np.int16)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, first window and window count of each text, and all levels."""
    data, offsets = hashing.joined(texts)
    lengths = np.diff(offsets) - 1
    counts = np.maximum(lengths - WINDOW + 1, 0)
    found = levels(data) if len(data) > WINDOW else np.zeros(0, dtype=np.int16)
    return data, offsets[:-1], counts, found


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of every span, in order."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each level."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            for _, texts in hashing.steps([t.encode() for t in batch["text"]], _STEP):
                _, starts, counts, found = _windows(texts)
                if counts.any():
                    total += np.bincount(found[_ranges(starts, counts)], minlength=LEVELS + 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"level": used.astype(np.int32), "n": total[used]})

    rows = docs.select(text_or_empty().alias("text")).mapInPandas(count, "level int, n long")
    # at most LEVELS + 1 rows
    sums = rows.groupBy("level").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(LEVELS + 1, dtype=np.int64)
    total[sums["level"]] = sums["n"]
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, rarest first; levels of mere runs come last."""
    late = np.arange(len(counts)) < LEAST_LEVEL
    ranks = np.empty(len(counts), dtype=np.int64)
    ranks[np.lexsort((np.arange(len(counts)), counts, late))] = np.arange(len(counts))
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text, one row of 64-bit words per filter."""
    data, starts, counts, found = _windows(texts)
    never = np.iinfo(np.int64).max
    key = np.full(len(data), never)
    places = _ranges(starts, counts)
    if len(places):
        key[places] = (ranks[found[places]] << 32) | places
    least = key.copy()
    reach = 1
    while reach < WINDOW:
        least[:-reach] = np.minimum(least[:-reach], least[reach:])
        reach *= 2
        if reach == SHORT_RUN:
            near = least.copy()
    brief = counts < 2 * WINDOW - 1
    chosen = np.zeros(len(data), dtype=bool)
    for some, rarest, run, least_votes in ((~brief, least, WINDOW, VOTES), (brief, near, SHORT_RUN, SHORT_VOTES)):
        rounds = _ranges(starts[some], np.maximum(counts[some] - run + 1, 0))
        if len(rounds):
            chosen |= np.bincount(rarest[rounds] & 0xFFFFFFFF, minlength=len(data)) >= least_votes
    long = np.flatnonzero(counts)
    if len(long):
        ends_too = long[brief[long]]
        chosen[starts[ends_too]] = chosen[starts[ends_too] + counts[ends_too] - 1] = True
        # the rarest window of a text counts in any case
        edges = np.stack([starts[long], starts[long] + counts[long]], axis=1).ravel()
        chosen[np.minimum.reduceat(key, edges)[::2] & 0xFFFFFFFF] = True
    at = np.flatnonzero(chosen)
    owner = np.searchsorted(starts, at, side="right") - 1
    short = np.flatnonzero((counts == 0) & (np.diff(np.append(starts, len(data))) > 1))
    sums = hashing.prefix_sums(data)
    ends = np.append(starts[1:], len(data)) - 1
    hashes = np.concatenate(
        [
            hashing.span_hashes(sums, at, at + WINDOW),
            hashing.span_hashes(sums, starts[short], ends[short]),
        ]
    )
    owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    many = np.bincount(owner, minlength=len(texts))
    filters = -(-many // FEATURES)
    first = np.cumsum(filters) - filters
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    target = (first[owner] + place // FEATURES) * FILTER_BYTES
    bits = np.zeros(int(filters.sum()) * FILTER_BYTES, dtype=np.uint8)
    for number in range(HASHES):
        bit = ((hashes >> np.uint64(11 * number)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)
        np.bitwise_or.at(bits, target + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    rows = bits.view(np.uint64).reshape(-1, FILTER_BYTES // 8)
    return [rows[a : a + n] for a, n in zip(first, filters, strict=True)]


def as_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint64).reshape(-1, FILTER_BYTES // 8)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain of each filter's best overlap in the other.

    Filters count by their features. Chance is the best of as many unlike filters, about the
    median and in whole bits, so that few bits are not found in one of many full filters.
    """
    if len(one) > len(other):
        one, other = other, one
    if not len(one):
        return 1.0 if not len(other) else 0.0
    if np.array_equal(one, other):
        return 1.0
    size = FILTER_BYTES * 8
    held = np.bitwise_count(one).sum(axis=1, dtype=np.int64)
    others = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    full = others / size
    best = _NORMAL.inv_cdf((len(other) - 0.375) / (len(other) + 0.25))
    weights = -np.log1p(-np.minimum(held, size - 1) / size)
    total = 0.0
    for row, bits, weight in zip(one, held, weights, strict=True):
        common = np.bitwise_count(row & other).sum(axis=1, dtype=np.int64)
        chance = np.rint(bits * full + best * np.sqrt(bits * full * (1 - full)))
        room = np.minimum(bits, others) - chance
        part = np.where(room > 0, (common - chance) / np.maximum(room, 1e-9), 0.0)
        total += weight * float(np.clip(part, 0.0, 1.0).max())
    return float(min(total / weights.sum(), 1.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and digest (base64) of every row of ``docs``."""
    ranks = rarity(level_counts(docs))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in hashing.steps([t.encode() for t in batch["text"]], _STEP):
                out = batch[["doc_id", "text_hash"]].iloc[first : first + len(texts)].copy()
                out["digest"] = [as_text(d) for d in digests(texts, ranks)]
                yield out

    rows = docs.select(
        id_key().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")
    )
    made = rows.mapInPandas(make, "doc_id long, text_hash long, digest string")
    return made.withColumn("doc_id", real_id("doc_id"))


def _runs(docs: DataFrame) -> DataFrame:
    """The documents by descending id in bounded runs, each with its successor's copy at its end."""
    parts = shuffle_parts(docs) * RUNS
    ids = docs.select(id_key().alias("id")).repartitionByRange(parts, F.col("id").desc())
    ends = (
        ids.groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .select("low", "high")
        .toPandas()  # a row per run
    )
    highs = np.unique(ends["high"].to_numpy(dtype=np.int64))

    @F.pandas_udf("array<struct<run: int, copy: boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(highs, ids.to_numpy())
        return pd.Series(
            [
                [{"run": int(r), "copy": False}]
                + ([{"run": int(r + 1) % len(highs), "copy": True}] if highs[r] == i else [])
                for r, i in zip(own, ids, strict=True)
            ]
        )

    rows = docs.select(
        id_key().alias("id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text")
    )
    placed = rows.withColumn("at", F.explode(places("id"))).select("*", "at.*")
    return placed.repartition("run").sortWithinPartitions("run", "copy", F.col("id").desc(), "h")


def with_successors(docs: DataFrame) -> DataFrame:
    """Each document beside an edited text and its successor by descending id.

    The edited text is the document with its last half replaced by the start of its successor.
    """
    ranks = rarity(level_counts(docs))

    def compare(rows: list[tuple], after: tuple) -> pd.DataFrame:
        texts = [r[1] for r in rows] + [after[1]]
        edited = [
            own[: len(own) - len(own) // 2] + following[: len(own) // 2]
            for own, following in zip(texts[:-1], texts[1:], strict=True)
        ]
        changed = [t.encode() for t in edited]
        own, other = digests([t.encode() for t in texts], ranks), digests(changed, ranks)
        return pd.DataFrame(
            {
                "doc_id": [r[0] for r in rows],
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
                "fingerprint": [as_text(d) for d in own[:-1]],
                "edited_fingerprint": [as_text(d) for d in other],
                "near_edited": [likeness(a, b) for a, b in zip(own[:-1], other, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, at = [], 0, None
        for batch in batches:
            for doc_id, text, number, copy in zip(
                batch["id"], batch["text"], batch["run"], batch["copy"], strict=True
            ):
                if number != at:
                    held, size, at = [], 0, number
                row = (int(doc_id), text)
                if copy:
                    if held:
                        yield compare(held, row)
                    held, size = [], 0
                    continue
                if held and size > _STEP:
                    yield compare(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(text)

    found = _runs(docs).select("id", "text", "run", "copy").mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
    return found.withColumn("doc_id", real_id("doc_id"))
