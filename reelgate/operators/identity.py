"""Identity evidence from embeddings: centroids, leave-one-out, thresholds, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles
from reelgate.functions.scalars import clip
from reelgate.functions.vectors import dot, doubles, mean_vector, normalise


def centroid(embeddings: DataFrame, key: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Unit-length mean vector per key."""
    return embeddings.groupBy(*key).agg(mean_vector(vector).alias("__mean")).select(
        *key, normalise(F.col("__mean")).alias("centroid")
    )


def leave_one_out_similarity(
    embeddings: DataFrame, key: Sequence[str], vector: str = "embedding"
) -> DataFrame:
    """Similarity of each member to the centroid of the others of its key; alone it is 1.

    The others' sum is the group's sum without the member, so no pairs are formed.
    """
    groups = embeddings.groupBy(*key).agg(
        mean_vector(vector).alias("__mean"), F.count(F.lit(1)).alias("__n")
    )
    joined = embeddings.join(groups, list(key)).withColumn("__own", doubles(vector))
    others = F.zip_with("__mean", "__own", lambda m, v: m * F.col("__n") - v)
    similarity = F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(
        dot(F.col("__own"), normalise(F.col("__others")))
    )
    return (
        joined.withColumn("__others", others)
        .withColumn("similarity", similarity)
        .drop("__mean", "__n", "__own", "__others")
    )


def window_calibration(
    scores: DataFrame, key: Sequence[str], score: str = "score"
) -> DataFrame:
    """Count, minimum, 10th percentile and mean of the window scores per reference."""
    plain = {"count": F.count(F.lit(1)), "minimum": F.min(score), "mean": F.avg(score)}
    found = exact_quantiles(scores, key, score, {"p10": 0.1}, extras=plain)
    return found.select(*key, "count", "minimum", "p10", "mean")


def adaptive_threshold(
    scores: DataFrame,
    key: Sequence[str],
    *,
    margin: float,
    floor: float,
    window: bool = False,
    score: str = "similarity",
    explicit: float | None = None,
) -> DataFrame:
    """Identity threshold per key from its weakest score.

    A whole item may fall short of it by the margin; a window has to exceed it by the
    margin. An explicit threshold wins.
    """
    weakest = F.min(score)
    bound = weakest + F.lit(float(margin)) if window else weakest - F.lit(float(margin))
    value = F.coalesce(clip(bound, floor, 1.0), F.lit(float(floor)))
    if explicit is not None:
        value = F.coalesce(F.lit(float(explicit)), value)
    return scores.groupBy(*key).agg(value.alias("threshold"))


def combined_score(own: Column, centre: Column, reference: Column) -> Column:
    return 0.7 * dot(own, centre) + 0.3 * dot(own, reference)


def identity_scores(
    windows: DataFrame,
    centroids: DataFrame,
    references: DataFrame,
    *,
    owner: str = "artist_id",
    candidate: Sequence[str] = ("phrase_index", "candidate_index"),
    vector: str = "embedding",
) -> DataFrame:
    """Weakest, mean and number of window scores per candidate.

    ``windows``: owner, reference_id, candidate keys, embedding.
    """
    prompts = references.select(owner, "reference_id", doubles(vector).alias("__ref"))
    scored = (
        windows.join(centroids, owner)
        .join(prompts, [owner, "reference_id"])
        .withColumn(
            "__score", combined_score(doubles(vector), F.col("centroid"), F.col("__ref"))
        )
    )
    return scored.groupBy(owner, *candidate, "reference_id").agg(
        F.min("__score").alias("minimum_window_identity_similarity"),
        F.avg("__score").alias("mean_window_identity_similarity"),
        F.count(F.lit(1)).alias("identity_window_count"),
    )
