"""Identity evidence over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import query, rounded, table
from reelgate.operators import identity

_CENTROID_SQL = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(x) AS m, sum(x) AS s, count(*) AS n FROM e GROUP BY label, i),
cent AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM mean)"""


@query(
    "centroids",
    f"WITH {_CENTROID_SQL} SELECT label, i - 1 AS dimension, round(c, 5) AS value FROM cent",
)
def centroids(spark, d):
    out = identity.centroid(table(spark, d, "embeddings"), ["label"])
    exploded = out.select("label", F.posexplode("centroid").alias("dimension", "value"))
    return exploded.select(
        "label", F.col("dimension").cast("long").alias("dimension"), F.round("value", 5).alias("value")
    )


@query(
    "centroid_similarity",
    f"""WITH {_CENTROID_SQL} SELECT vec_id, e.label, round(sum(x * c), 5) AS similarity
    FROM e JOIN cent ON e.label = cent.label AND e.i = cent.i GROUP BY 1, 2""",
)
def centroid_similarity(spark, d):
    from reelgate.functions.vectors import dot, doubles

    vectors = table(spark, d, "embeddings")
    joined = vectors.join(identity.centroid(vectors, ["label"]), "label")
    return joined.select(
        "vec_id",
        "label",
        F.round(dot(doubles("embedding"), F.col("centroid")), 5).alias("similarity"),
    )


_LOO_SQL = """o AS (SELECT vec_id, e.label, x, (s - x) AS r, n FROM e JOIN mean ON e.label = mean.label AND e.i = mean.i),
loo AS (SELECT vec_id, label, CASE WHEN max(n) = 1 THEN 1 ELSE sum(x * r) / sqrt(sum(r * r)) END AS sim FROM o GROUP BY 1, 2)"""


@query(
    "loo_similarity",
    f"WITH {_CENTROID_SQL}, {_LOO_SQL} SELECT vec_id, label, round(sim, 5) AS similarity FROM loo",
)
def loo_similarity(spark, d):
    out = identity.leave_one_out_similarity(table(spark, d, "embeddings"), ["label"])
    return rounded(out.select("vec_id", "label", "similarity"), 5)


@query(
    "window_calibration",
    f"""WITH {_CENTROID_SQL}, {_LOO_SQL} SELECT label, count(*) AS count, round(min(sim), 5) AS minimum,
      round(quantile_cont(sim, 0.1), 5) AS p10, round(avg(sim), 5) AS mean FROM loo GROUP BY 1""",
)
def window_calibration(spark, d):
    scores = identity.leave_one_out_similarity(table(spark, d, "embeddings"), ["label"])
    return rounded(identity.window_calibration(scores, ["label"], "similarity"), 5)


@query(
    "adaptive_threshold",
    f"""WITH {_CENTROID_SQL}, {_LOO_SQL} SELECT label, round(greatest(0.2, least(1, min(sim) - 0.08)), 5) AS whole,
      round(greatest(0.2, least(1, min(sim) + 0.04)), 5) AS "window", 0.5::DOUBLE AS explicit FROM loo GROUP BY 1""",
)
def adaptive_threshold(spark, d):
    scores = identity.leave_one_out_similarity(table(spark, d, "embeddings"), ["label"])

    def bound(name, **options):
        out = identity.adaptive_threshold(scores, ["label"], floor=0.2, **options)
        return out.withColumnRenamed("threshold", name)

    whole = bound("whole", margin=0.08)
    window = bound("window", margin=0.04, window=True)
    explicit = bound("explicit", margin=0.04, explicit=0.5)
    return rounded(whole.join(window, "label").join(explicit, "label"), 5)


@query(
    "identity_scores",
    f"""WITH {_CENTROID_SQL}, ref AS (SELECT label, min(vec_id) AS rid FROM embeddings GROUP BY 1),
    s AS (SELECT e.vec_id, e.label, sum(e.x * c) AS a, sum(e.x * r.x) AS b FROM e JOIN cent ON cent.label = e.label AND cent.i = e.i
      JOIN ref ON ref.label = e.label JOIN e r ON r.vec_id = rid AND r.i = e.i GROUP BY 1, 2)
    SELECT label, vec_id % 7 AS candidate_index, round(min(0.7 * a + 0.3 * b), 5) AS minimum_window_identity_similarity,
      round(avg(0.7 * a + 0.3 * b), 5) AS mean_window_identity_similarity, count(*) AS identity_window_count FROM s GROUP BY 1, 2""",
)
def identity_scores(spark, d):
    vectors = table(spark, d, "embeddings")
    windows = vectors.select(
        "label",
        (F.col("vec_id") % 7).alias("candidate_index"),
        F.lit("first").alias("reference_id"),
        "embedding",
    )
    references = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    ).withColumn("reference_id", F.lit("first"))
    out = identity.identity_scores(
        windows,
        identity.centroid(vectors, ["label"]),
        references,
        owner="label",
        candidate=["candidate_index"],
    )
    return rounded(out.drop("reference_id"), 5)
