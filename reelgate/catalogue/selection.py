"""Ranking and selection over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import FRAMES_SQL, event_frames, query, rounded, table
from reelgate.operators import qc, select
from reelgate.operators.frames import window_metrics

_REFS_SQL = """rf AS (SELECT p_brand AS b, p_type AS t, CASE WHEN avg(p_size) > 25 THEN 'approved' ELSE 'rejected' END AS st,
  quantile_cont(p_retailprice, 0.5) AS med, min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_size) AS lvl FROM part GROUP BY 1, 2),
k AS (SELECT b, count(*) AS n, count(*) FILTER (st = 'approved') AS good FROM rf GROUP BY 1),
pr AS (SELECT p_partkey, p_brand AS b, CASE WHEN p_size = 13 THEN NULL ELSE p_retailprice * 1.1 - 100 END AS pitch, p_size AS lvl FROM part),
sc AS (SELECT p_partkey, rf.t, CASE WHEN n > 1 AND pitch IS NOT NULL AND good > 0 THEN abs(1200 * log2(pitch / med)) / 600 + 0.35 * abs(pr.lvl - rf.lvl) / 12
  + CASE WHEN pitch < lo THEN abs(1200 * log2(pitch / lo)) / 600 WHEN pitch > hi THEN abs(1200 * log2(pitch / hi)) / 600 ELSE 0 END END AS score
  FROM pr JOIN rf USING (b) JOIN k USING (b) WHERE n = 1 OR pitch IS NULL OR good = 0 OR st = 'approved')"""


def _references(spark, d):
    from reelgate.functions.quantiles import exact_quantiles

    part = table(spark, d, "part")
    keys = ["p_brand", "p_type"]
    stats = part.groupBy(*keys).agg(
        F.when(F.avg("p_size") > 25, "approved").otherwise("rejected").alias("review_status"),
        F.min("p_retailprice").alias("f0_p05_hz"),
        F.max("p_retailprice").alias("f0_p95_hz"),
        F.avg("p_size").alias("active_rms_dbfs"),
    )
    medians = exact_quantiles(part, keys, "p_retailprice", {"median_f0_hz": 0.5})
    return stats.join(medians, keys).withColumnsRenamed(
        {"p_brand": "artist_id", "p_type": "reference_id"}
    )


def _part_phrases(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("artist_id"),
        "p_partkey",
        F.when(F.col("p_size") != 13, F.col("p_retailprice") * 1.1 - 100).alias("target_pitch"),
        F.col("p_size").alias("target_level_db"),
    )


@query(
    "rank_references",
    f"""WITH {_REFS_SQL} SELECT p_partkey, t AS reference_id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY p_partkey ORDER BY score, t) AS rank FROM sc""",
)
def rank_references(spark, d):
    out = select.rank_references(
        _part_phrases(spark, d), _references(spark, d), phrase=["p_partkey"]
    )
    return rounded(out.select("p_partkey", "reference_id", "score", "rank"))


@query(
    "select_reference",
    f"""WITH {_REFS_SQL} SELECT p_partkey, t AS reference_id, round(score, 6) AS score FROM sc
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score, t) = 1""",
)
def select_reference(spark, d):
    out = select.rank_references(
        _part_phrases(spark, d), _references(spark, d), phrase=["p_partkey"], best_only=True
    )
    return rounded(out.select("p_partkey", "reference_id", "score"))


_CANDS_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ci FROM lineitem),
c AS (SELECT l_orderkey, ci, l_suppkey % 5 AS ref, l_discount * 10 AS ident, CASE WHEN l_quantity = 50 THEN NULL ELSE l_tax * 10 END AS minw,
  l_discount * 5 + l_tax * 5 AS meanw, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS drops, l_quantity / 10 AS peak, l_extendedprice / 1000 AS med, l_discount / 2 AS gross,
  CASE WHEN l_suppkey % 3 > 0 THEN l_tax * 5 END AS refi, CASE WHEN l_partkey % 4 > 0 THEN l_tax END AS dropf,
  CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS spec, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 2 END AS red FROM lineitem_n),
p AS (SELECT *, coalesce(ident >= 0 AND minw >= 0.2 AND drops = 0 AND peak > 0 AND peak <= 4 AND med <= 50 AND gross < 0.045, false) AS passed FROM c)""".replace(
    "lineitem_n", "n"
)


def _candidates(spark, d):
    from reelgate.operators.frames import number_frames

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    items = number_frames(table(spark, d, "lineitem"), ["l_orderkey"], order)
    return select.candidate_passes(
        items.select(
            "l_orderkey",
            F.col("frame_idx").alias("candidate_index"),
            (F.col("l_suppkey") % 5).alias("reference_id"),
            (F.col("l_discount") * 10).alias("identity_similarity"),
            F.when(F.col("l_suppkey") % 3 > 0, F.col("l_tax") * 5).alias(
                "reference_identity_similarity"
            ),
            F.when(F.col("l_quantity") != 50, F.col("l_tax") * 10).alias(
                "minimum_window_identity_similarity"
            ),
            (F.col("l_discount") * 5 + F.col("l_tax") * 5).alias("mean_window_identity_similarity"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("sustained_dropout_count"),
            (F.col("l_quantity") / 10).alias("raw_peak"),
            (F.col("l_extendedprice") / 1000).alias("f0_median_error_cents"),
            (F.col("l_discount") / 2).alias("f0_gross_error_fraction"),
            F.when(F.col("l_partkey") % 4 > 0, F.col("l_tax")).alias("dropout_fraction"),
            F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 3).alias("spectral_distance_db"),
            F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 2).alias("peak_reduction_db"),
        ),
        0.2,
        gross=0.045,
    )


@query(
    "candidate_passes",
    f"WITH {_CANDS_SQL} SELECT l_orderkey, ci AS candidate_index, passed FROM p",
)
def candidate_passes(spark, d):
    return _candidates(spark, d).select("l_orderkey", "candidate_index", "passed")


@query(
    "select_candidate",
    f"""WITH {_CANDS_SQL} SELECT l_orderkey, ci AS candidate_index, NOT passed AS phrase_failed FROM p
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY passed DESC, coalesce(minw, ident, -1) DESC, coalesce(meanw, -1) DESC,
        coalesce(ident, -1) DESC, coalesce(refi, -1) DESC, drops, dropf NULLS LAST, spec NULLS LAST, red NULLS LAST, ci) = 1""",
)
def select_candidate(spark, d):
    return select.select_candidate(_candidates(spark, d), ["l_orderkey"]).select(
        "l_orderkey", "candidate_index", "phrase_failed"
    )


@query(
    "select_candidate_continuity",
    f"""WITH {_CANDS_SQL}, q AS (SELECT *, coalesce(drops = 0 AND peak <= 4 AND med <= 100 AND gross <= 0.2, false) AS ok FROM p)
    SELECT l_orderkey, ci AS candidate_index, NOT ok AS phrase_failed FROM q
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ok DESC, drops, dropf NULLS LAST, gross, med, spec NULLS LAST, red NULLS LAST, ci) = 1""",
)
def select_candidate_continuity(spark, d):
    judged = select.candidate_passes_continuity(_candidates(spark, d))
    return select.select_candidate(
        judged, ["l_orderkey"], select.continuity_order()
    ).select("l_orderkey", "candidate_index", "phrase_failed")


@query(
    "retry_budget",
    f"""WITH {_CANDS_SQL}, r AS (SELECT l_orderkey, ci, row_number() OVER (PARTITION BY l_orderkey ORDER BY ci) AS k FROM p WHERE passed AND ci < 6),
    s AS (SELECT l_orderkey, max(ci) AS ci FROM r WHERE k = 2 GROUP BY 1)
    SELECT l_orderkey, CASE WHEN s.ci IS NULL THEN 6 ELSE greatest(s.ci + 1, 3) END AS attempts, s.ci IS NOT NULL AS enough FROM (SELECT DISTINCT l_orderkey FROM p) LEFT JOIN s USING (l_orderkey)""",
)
def retry_budget(spark, d):
    return select.retry_budget(_candidates(spark, d), ["l_orderkey"], initial=3, maximum=6)


@query(
    "retry_order",
    f"""WITH {_CANDS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(minw, -1) DESC, coalesce(meanw, -1) DESC, ci) AS r FROM p WHERE drops = 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(minw, -1) DESC, coalesce(meanw, -1) DESC, drops, gross, ci) AS r FROM p),
    f AS (SELECT DISTINCT l_orderkey, unnest([4, 3, 2, 1, 0]) AS ref FROM p),
    u AS (SELECT l_orderkey, ref, 0 AS l, min(r) AS r FROM a GROUP BY 1, 2 UNION ALL SELECT l_orderkey, ref, 1, min(r) FROM b GROUP BY 1, 2
      UNION ALL SELECT l_orderkey, ref, 2, 4 - ref FROM f),
    m AS (SELECT l_orderkey, ref, min((l, r)) AS k FROM u GROUP BY 1, 2)
    SELECT l_orderkey, ref AS reference_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS position FROM m""",
)
def retry_order(spark, d):
    records = _candidates(spark, d)
    fallback = records.select("l_orderkey").distinct().select(
        "l_orderkey",
        F.posexplode(F.array(*[F.lit(i).cast("long") for i in (4, 3, 2, 1, 0)])).alias(
            "position", "reference_id"
        ),
    )
    return select.retry_order(records, fallback, ["l_orderkey"])


@query(
    "conversion_summary",
    f"""WITH {_CANDS_SQL} SELECT l_orderkey % 100 AS run_id, count(*) AS phrase_count,
      greatest(max(ref), sum(drops))::BIGINT AS sustained_dropout_count, round(min(ident), 6) AS minimum_identity_similarity,
      round(avg(ident), 6) AS mean_identity_similarity, round(min(minw), 6) AS minimum_window_identity_similarity,
      round(avg(meanw), 6) AS mean_window_identity_similarity FROM p GROUP BY 1""",
)
def conversion_summary(spark, d):
    decisions = _candidates(spark, d).withColumn("run_id", F.col("l_orderkey") % 100).withColumn(
        "joined_dropout_count", F.col("reference_id")
    )
    return rounded(qc.conversion_summary(decisions))


@query(
    "selected_references",
    "SELECT DISTINCT l_orderkey % 100 AS run_id, l_suppkey AS reference_id FROM lineitem",
)
def selected_references(spark, d):
    decisions = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("run_id"), F.col("l_suppkey").alias("reference_id")
    )
    return qc.selected_references(decisions)


_ROLES_SQL = """b AS (SELECT min(p_retailprice) AS p0, max(p_retailprice) AS p1, min(p_size) AS l0, max(p_size) AS l1 FROM part),
s AS (SELECT p_partkey, p_brand AS song_id, (p_retailprice - p0) / greatest(p1 - p0, 1e-6) AS p, (p_size - l0) / greatest(l1 - l0, 1e-6) AS l,
  0.2 * (abs(p_size / 50 - 0.85) + p_retailprice / 12000) AS q FROM part, b),
r AS (SELECT p_partkey AS pos, song_id, abs(p - 0.5) + abs(l - 0.5) + q AS neutral, l + 0.5 * abs(p - 0.5) + q AS soft, 1 - l + 0.5 * abs(p - 0.5) + q AS strong,
  p + 0.25 * abs(l - 0.5) + q AS low, 1 - p + 0.25 * abs(l - 0.5) + q AS high FROM s)"""


@query(
    "role_scores",
    f"""WITH {_ROLES_SQL} SELECT pos AS p_partkey, round(neutral, 6) AS score_neutral, round(soft, 6) AS score_soft,
      round(strong, 6) AS score_strong, round(low, 6) AS score_low, round(high, 6) AS score_high FROM r""",
)
def role_scores(spark, d):
    out = _roles(spark, d)
    return rounded(
        out.select(
            F.col("start_seconds").alias("p_partkey"), *[f"score_{r}" for r in select.ROLES]
        )
    )


def _roles(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_brand").alias("song_id"),
        F.col("p_partkey").alias("start_seconds"),
        F.col("p_retailprice").alias("median_f0_hz"),
        F.col("p_size").alias("active_rms_dbfs"),
        (F.col("p_size") / 50).alias("voiced_fraction"),
        (F.col("p_retailprice") / 1000).alias("one_second_level_range_db"),
    )
    return select.role_scores(part)


def _role_step(n: int, role: str) -> str:
    used = " AND ".join(f"song_id NOT IN (SELECT song_id FROM c{i})" for i in range(1, n)) or "true"
    return (
        f"c{n} AS (SELECT '{role}' AS role, song_id, pos, {role} AS score FROM r WHERE {used} "
        f"ORDER BY {role}, song_id, pos LIMIT 1)"
    )


@query(
    "role_assignment",
    f"WITH {_ROLES_SQL}, "
    + ", ".join(_role_step(i + 1, r) for i, r in enumerate(select.ROLES))
    + " SELECT role, song_id, pos::DOUBLE AS start_seconds, round(score, 6) AS score FROM ("
    + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, 6))
    + ")",
)
def role_assignment(spark, d):
    return rounded(select.assign_roles(_roles(spark, d)))


@query(
    "role_of",
    """SELECT p_partkey, CASE WHEN contains(t, 'neutral') OR id = 'neutral' THEN 'neutral' WHEN contains(t, 'soft') OR id = 'soft' THEN 'soft'
      WHEN contains(t, 'strong') OR id = 'strong' THEN 'strong' WHEN contains(t, 'low') OR id = 'low' THEN 'low' WHEN contains(t, 'high') OR id = 'high' THEN 'high' END AS role
    FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'soft' WHEN 1 THEN 'high' ELSE 'x' END AS id,
      CASE p_partkey % 4 WHEN 0 THEN 'low high' WHEN 1 THEN 'strong' WHEN 2 THEN 'x' ELSE 'high neutral' END AS t FROM part)""",
)
def role_of(spark, d):
    key = F.col("p_partkey") % 4
    tagged = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 6 == 0, "soft").when(F.col("p_size") % 6 == 1, "high").otherwise("x").alias("id"),
        F.split(
            F.when(key == 0, "low high").when(key == 1, "strong").when(key == 2, "x").otherwise("high neutral"),
            " ",
        ).alias("tags"),
    )
    return tagged.select("p_partkey", select.role_of("id", "tags").alias("role"))


def _spaced(spark, d):
    windows = window_metrics(event_frames(spark, d), 20, 5, rate=10)
    return windows.where("rejected is null").select(
        "series_id", "start_frame", F.abs(F.col("voiced_fraction") - 0.82).alias("a"),
        F.round("active_rms_dbfs", 6).alias("b"),
    )


_SPACED_SQL = """w AS (SELECT series_id, unnest(range(0, count(*) - 20 + 1, 5)) AS start_frame FROM frames GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT w.series_id, start_frame, f0, rms, (frame_idx - start_frame) // 10 AS s FROM w JOIN frames ON w.series_id = frames.series_id AND frame_idx >= start_frame AND frame_idx < start_frame + 20),
ok AS (SELECT DISTINCT series_id, start_frame FROM (SELECT series_id, start_frame, s FROM f GROUP BY ALL HAVING avg((f0 > 0)::INT) >= 0.2)),
m AS (SELECT series_id, start_frame, abs(avg((f0 > 0)::INT) - 0.82) AS a, round(20 * log10(greatest(sqrt(avg(rms * rms) FILTER (f0 > 0)), 1e-12)), 6) AS b FROM f GROUP BY ALL),
c0 AS (SELECT * FROM m JOIN ok USING (series_id, start_frame))"""


def topk_sql(k: int, spacing: int, grouped: str = "series_id") -> str:
    steps = []
    for i in range(1, k + 1):
        steps.append(
            f"b{i} AS (SELECT * FROM c{i - 1} QUALIFY row_number() OVER (PARTITION BY {grouped} ORDER BY a, b, start_frame) = 1), "
            f"c{i} AS (SELECT c.* FROM c{i - 1} c JOIN b{i} b USING ({grouped}) WHERE abs(c.start_frame - b.start_frame) >= {spacing})"
        )
    picked = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, k + 1))
    return ", ".join(steps) + f", picked AS ({picked})"


@query(
    "non_overlapping_topk",
    f"WITH {FRAMES_SQL}, {_SPACED_SQL}, {topk_sql(4, 10)} SELECT series_id, start_frame, round(a, 6) AS a, b FROM picked",
)
def non_overlapping_topk(spark, d):
    out = select.non_overlapping_topk(
        _spaced(spark, d), 4, 10, key=["series_id"], score=["a", "b"], start="start_frame"
    )
    return rounded(out)


@query(
    "off_grid_topk",
    f"""WITH c0 AS (SELECT l_suppkey AS series_id, l_extendedprice / 500 AS start_frame, l_quantity AS a, l_orderkey AS b FROM lineitem),
    {topk_sql(3, 40)} SELECT series_id, start_frame, min(a) AS a, min(b) AS b FROM picked GROUP BY 1, 2""",
)
def off_grid_topk(spark, d):
    """Starts that repeat and lie on no grid."""
    values = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        (F.col("l_extendedprice") / 500).alias("start_frame"),
        F.col("l_quantity").alias("a"),
        F.col("l_orderkey").alias("b"),
    )
    return select.non_overlapping_topk(
        values, 3, 40, key=["series_id"], score=["a", "b"], start="start_frame"
    )


@query(
    "train_validation_split",
    f"""WITH {FRAMES_SQL}, {_SPACED_SQL}, {topk_sql(4, 10)}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_frame) AS rn,
      count(*) OVER (PARTITION BY series_id) AS n FROM picked)
    SELECT series_id, start_frame, CASE WHEN n > 1 AND rn = n THEN 'validation' ELSE 'train' END AS split,
      CASE WHEN n > 1 AND rn = n THEN 0 ELSE rn - 1 END AS segment_idx FROM n""",
)
def train_validation_split(spark, d):
    picked = select.non_overlapping_topk(
        _spaced(spark, d), 4, 10, key=["series_id"], score=["a", "b"], start="start_frame"
    )
    out = select.train_validation_split(picked, key=["series_id"], start="start_frame")
    return out.select(
        "series_id", "start_frame", "split", F.col("segment_idx").cast("long").alias("segment_idx")
    )


@query(
    "split_counts",
    f"""WITH {FRAMES_SQL}, {_SPACED_SQL}, {topk_sql(4, 10)} SELECT series_id, CASE WHEN count(*) > 1 THEN count(*) - 1 ELSE 1 END AS training_segments,
      (CASE WHEN count(*) > 1 THEN 1 ELSE 0 END)::BIGINT AS validation_segments, NULL::VARCHAR AS violation FROM picked GROUP BY 1""",
)
def split_counts(spark, d):
    picked = select.non_overlapping_topk(
        _spaced(spark, d), 4, 10, key=["series_id"], score=["a", "b"], start="start_frame"
    )
    return qc.split_counts(
        select.train_validation_split(picked, key=["series_id"], start="start_frame"),
        ["series_id"],
    )


@query(
    "distinct_topk",
    f"""WITH c0 AS (SELECT l_suppkey AS series_id, (l_extendedprice / 500)::BIGINT AS start_frame, min(l_quantity) AS a, 0 AS b FROM lineitem GROUP BY 1, 2),
    {topk_sql(3, 40)} SELECT series_id, start_frame, a FROM picked""",
)
def distinct_topk(spark, d):
    values = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("series_id"),
        F.rint(F.col("l_extendedprice") / 500).cast("long").alias("start_frame"),
    ).agg(F.min("l_quantity").alias("a"))
    return select.non_overlapping_topk(
        values, 3, 40, key=["series_id"], score=["a"], start="start_frame"
    )


@query(
    "bank_reconcile",
    """WITH x AS (SELECT c_custkey, c_nationkey, 'r' || lpad(c_custkey::VARCHAR, 9, '0') AS id,
      CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soft' WHEN 2 THEN 'low' WHEN 3 THEN 'high' WHEN 4 THEN 'strong' ELSE 'neutral' END AS role,
      c_custkey % 5 <> 1 AS clean, c_custkey % 9 <> 0 AS approved, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal > 3000 END AS quality,
      c_custkey % 23 = 0 OR c_custkey % 19 = 0 OR (c_custkey % 5 <> 1 AND c_custkey % 11 = 0) AS gone FROM customer),
    v AS (SELECT *, CASE WHEN role IS NULL THEN 'ignored' WHEN gone AND approved THEN 'reject' WHEN gone THEN 'skip'
      WHEN approved AND coalesce(quality, false) AND clean THEN 'eligible' WHEN approved AND quality = false THEN 'reject' ELSE 'skip' END AS verdict FROM x)
    SELECT c_nationkey AS artist_id, id AS reference_id, role, CASE WHEN verdict <> 'eligible' THEN verdict
      WHEN id = min(id) FILTER (verdict = 'eligible') OVER (PARTITION BY c_nationkey, role) THEN 'keep' ELSE 'spare' END AS decision FROM v""",
)
def bank_reconcile(spark, d):
    return _bank(spark, d)[0]


@query(
    "missing_roles",
    """WITH x AS (SELECT c_nationkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soft' WHEN 2 THEN 'low' WHEN 3 THEN 'high' WHEN 4 THEN 'strong' ELSE 'neutral' END AS role
      FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey % 9 <> 0 AND c_custkey % 17 <> 0 AND c_acctbal > 3000 AND c_custkey % 23 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 11 <> 0)
    SELECT a.c_nationkey AS artist_id, r.role FROM (SELECT DISTINCT c_nationkey FROM customer) a, (SELECT unnest(['neutral', 'soft', 'strong', 'low', 'high']) AS role) r
    WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.c_nationkey = a.c_nationkey AND x.role = r.role)""",
)
def missing_roles(spark, d):
    return _bank(spark, d)[1]


def _bank(spark, d):
    key = F.col("c_custkey")
    role = (
        F.when(key % 7 == 0, "none").when(key % 7 == 1, "soft").when(key % 7 == 2, "low")
        .when(key % 7 == 3, "high").when(key % 7 == 4, "strong").otherwise("neutral")
    )
    references = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("artist_id"),
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 9, "0")).alias("reference_id"),
        F.array_compact(F.array(role, F.when(key % 5 != 1, "clean-vocal-stem"))).alias("tags"),
        F.when(key % 9 != 0, "approved").otherwise("rejected").alias("review_status"),
        (key % 23).alias("source_song_id"),
        (key % 11).alias("source_stem_sha256"),
        (key % 19).alias("parent_source_sha256"),
        F.when(key % 17 != 0, F.col("c_acctbal") > 3000).alias("quality"),
    )
    sources = references.where("parent_source_sha256 = 0").select(
        F.col("parent_source_sha256").alias("sha256")
    )
    songs = references.where("source_song_id = 0").select(F.col("source_song_id").alias("song_id"))
    stems = references.where("source_stem_sha256 <> 0").select(
        F.col("source_stem_sha256").alias("sha256")
    )
    return select.reconcile_bank(references, sources, songs, stems, F.col("quality"))


@query(
    "next_revision",
    """WITH e AS (SELECT DISTINCT p_brand AS b, p_type AS role, CASE WHEN p_size % 8 = 1 THEN p_type ELSE p_type || '-v' || p_size % 8 END AS id, p_size % 8 AS n FROM part WHERE p_size < 30 AND p_size % 8 <> 0),
    w AS (SELECT DISTINCT p_brand AS b, p_type AS role FROM part), c AS (SELECT unnest(range(2, 10)) AS n)
    SELECT b AS artist_id, role, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.b = w.b AND e.id = w.role) THEN role ELSE role || '-v' ||
      (SELECT min(c.n) FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.b = w.b AND e.id = w.role || '-v' || c.n)) END AS reference_id FROM w""",
)
def next_revision(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("artist_id"), F.col("p_type").alias("role"), "p_size")
    n = F.col("p_size") % 8
    existing = part.where((F.col("p_size") < 30) & (n != 0)).select(
        "artist_id",
        F.when(n == 1, F.col("role")).otherwise(F.concat("role", F.lit("-v"), n.cast("string"))).alias("reference_id"),
    )
    return select.next_revision(
        part.select("artist_id", "role").distinct(), existing, owner=["artist_id"]
    )


@query(
    "rank_songs",
    """SELECT l_partkey AS song_id, round(sum(l_quantity), 6) AS upbeat_score FROM lineitem GROUP BY 1""",
)
def rank_songs(spark, d):
    scored = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("song_id")).agg(
        F.round(F.sum("l_quantity"), 6).alias("upbeat_score")
    )
    return select.rank_songs(scored)
