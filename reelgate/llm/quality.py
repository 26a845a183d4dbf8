"""Quality classifier by importance resampling.

Two bag-of-n-gram models over hashed features are counted: one of the raw text (all documents)
and one of target text (documents labelled good). A document's log importance weight is the sum over its features
of log target probability minus log raw probability, divided by the square root of their number:
without that tempering a long document's weight drowns both the noise and the comparison with
short ones. Gumbel noise is added to the weights, multiplied by ``SHARPNESS``, and the documents
with the largest sums stay: sampling without replacement in proportion to that power of the
weights. The sharper, the less the noise decides; as it is set, documents near the cut change
places and others do not.

How many stay is measured, not guessed: the weight that best parts labelled good from labelled bad
documents is found, and as many documents are drawn as lie above it. Only every other good document
teaches the target model; the others show what weights good documents get that it has not seen,
as most documents are. A judgement outranks the model: a document labelled good always stays, also
where few labels teach the model too little to see it.

Shapes at scale: two passes over the texts without a shuffle of text. Counts leave a task as one
row per feature bucket and are summed per bucket; the model is ``BUCKETS`` numbers. Labelled ids
come from a sample of at most ``LABELLED`` ids per class (by hash, over all labels), which is what
bounds the list sent along with the tasks. The cut-off is an exact order statistic found by
counting 16 bits of the sort key at a time.

Defined cases: null and empty texts have no features and weight 0; a null id is no labelled
document; labels that contradict each other count as bad; repeated rows are scored alike and stay
or go by their own noise, which follows from id and text, hence together; without any labels of
one class nothing can be learned and every document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.llm import hashing
from reelgate.llm.tables import id_key, real_id, text_or_empty
from reelgate.session import pinned

#: Feature buckets of the models.
BUCKETS = 1 << 16
#: Labelled ids used per class, at most.
LABELLED = 20_000
#: Added to every bucket's count.
SMOOTHING = 1.0
#: A lost good document costs as much as this many bad ones kept (as shares of their classes).
CARE = 3.0
#: Weights are multiplied by this before noise is added.
SHARPNESS = 16.0

# 0: space, 1: letters, digits and bytes beyond ASCII, 2: punctuation
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[hashing.IS_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every token and pair of neighbouring tokens.

    Tokens are runs of letters or of punctuation. A pair of equal tokens is one feature
    whatever the token.
    """
    data, offsets = hashing.joined(texts)
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    tokens = hashing.span_hashes(hashing.prefix_sums(data), starts, ends)
    pairs = hashing.ngrams(tokens, 2)
    pairs = np.where(tokens[1:] == tokens[:-1], np.uint64(1), pairs) if len(tokens) > 1 else pairs
    inside = owner[1:] == owner[:-1]
    buckets = np.concatenate([tokens, pairs[inside]]) >> np.uint64(64 - 16)
    return buckets.astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode() for t in texts]


def labelled_ids(labels: DataFrame, limit: int = LABELLED) -> tuple[list[int], list[int]]:
    """Ids of good and of bad documents, a sample by hash where there are more than ``limit``."""
    judged = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    found = []
    for good in (True, False):
        side = judged.where((F.col("quality") > 0) == F.lit(good))
        found.append([r["doc_id"] for r in side.orderBy("draw", "doc_id").limit(limit).collect()])
    return found[0], found[1]


def fit(docs: DataFrame, good: list[int], smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probability ratio of each feature bucket, target over raw."""
    target = np.array(sorted(good), dtype=np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, wanted = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            chosen = np.isin(batch["doc_id"].to_numpy(), target)
            for first, texts in hashing.steps(_encoded(batch["text"])):
                buckets, owner = features(texts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                wanted += np.bincount(buckets[chosen[first + owner]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used.astype(np.int32), "raw": raw[used], "wanted": wanted[used]})

    rows = docs.select(id_key().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(
        count, "bucket int, raw long, wanted long"
    )
    # at most BUCKETS rows
    sums = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("wanted").alias("wanted")).toPandas()
    raw, wanted = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    raw[sums["bucket"]] += sums["raw"]
    wanted[sums["bucket"]] += sums["wanted"]
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Log importance weight of every document: doc_id, text_hash, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratios = shared.value
        for batch in batches:
            weights = np.zeros(len(batch))
            for first, texts in hashing.steps(_encoded(batch["text"])):
                buckets, owner = features(texts)
                sums = np.bincount(owner, weights=ratios[buckets], minlength=len(texts))
                count = np.bincount(owner, minlength=len(texts))
                weights[first : first + len(texts)] = sums / np.sqrt(np.maximum(count, 1))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "log_weight": weights}
            )

    rows = docs.select(
        id_key().alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")
    )
    weighed = rows.mapInPandas(weigh, "doc_id long, text_hash long, log_weight double")
    return weighed.withColumn("doc_id", real_id("doc_id"))


def parting_weight(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The weight with the least cost: ``care`` times the share of good lost plus that of bad kept."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[:-1] + cuts[1:]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    passed = 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmin(care * lost + passed)])


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column: four counts of at most 65,536 groups each."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright(F.col(column), shift)
        inside = rows if shift == 48 else rows.where(F.shiftright(F.col(column), shift + 16) == prefix)
        counts = inside.groupBy(part.alias("part")).count().toPandas().sort_values("part", ascending=False)
        reached = counts["count"].cumsum().to_numpy()
        at = int(np.searchsorted(reached, left))
        left -= int(reached[at - 1]) if at else 0
        prefix = int(counts["part"].iloc[at])
    return prefix


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sharpness: float = SHARPNESS,
    seed: int = 7,
    limit: int = LABELLED,
) -> DataFrame:
    """doc_id, text_hash, log_weight, noisy_weight and kept of every row of ``docs``."""
    good, bad = labelled_ids(labels, limit)
    # ids come in hash order, so every other one is a fair half
    taught, unseen = good[::2], good[1::2] or good
    sure = labels.groupBy("doc_id").agg((F.min("quality") > 0).alias("__good"))
    scored = pinned(score(docs, fit(docs, taught)).join(sure, "doc_id", "left"))
    known = docs.sparkSession.createDataFrame(
        [(i, True) for i in unseen] + [(i, False) for i in bad], "doc_id long, good boolean"
    )
    judged = scored.join(known, "doc_id").select("good", "log_weight").toPandas()  # 2 * limit ids
    cut = parting_weight(
        judged["log_weight"][judged["good"]].to_numpy(), judged["log_weight"][~judged["good"]].to_numpy()
    )
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), 11)
    uniform = (draw.cast("double") + 0.5) / F.lit(float(2**53))
    noisy = F.col("log_weight") * sharpness - F.log(-F.log(uniform))
    # a long that sorts like the double: 2**-24 steps, far below the noise
    key = F.round(F.greatest(F.least(noisy, F.lit(1e11)), F.lit(-1e11)) * 2.0**24).cast("long")
    drawn = scored.withColumn("noisy_weight", noisy).withColumn("__key", key)
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    if k == 0:
        drawn = drawn.withColumn("kept", F.lit(False))
    else:
        drawn = drawn.withColumn("kept", F.col("__key") >= kth_largest(drawn, "__key", k))
    kept = F.col("kept") | F.coalesce("__good", F.lit(False))
    return drawn.withColumn("kept", kept).drop("__key", "__good")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps."""
    kept = resample(docs, labels, **options).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (text_hash == kept["__hash"])
    return docs.join(kept, same, "left_semi")
