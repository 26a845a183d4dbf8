"""Frame measurements over the events series."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import FRAMES_SQL, event_frames, query, rounded, table
from reelgate.functions.scalars import amplitude_db
from reelgate.operators import frames as measure
from reelgate.operators import tempo

SECOND = 10  # frames per second of the sample series


@query(
    "numbered_frames",
    f"WITH {FRAMES_SQL} SELECT series_id, frame_idx, round(value, 6) AS value FROM frames",
)
def numbered_frames(spark, d):
    return rounded(event_frames(spark, d).select("series_id", "frame_idx", "value"))


_SECONDS_SQL = """sec AS (SELECT series_id, frame_idx // 10 AS s, 20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12)) AS db
  FROM frames GROUP BY ALL HAVING count(*) = 10 AND avg((f0 > 0)::INT) >= 0.2),
range AS (SELECT series_id, least(quantile_cont(db, 0.95) - quantile_cont(db, 0.05), 120) AS r FROM sec GROUP BY 1)"""


@query(
    "series_metrics",
    f"""WITH {FRAMES_SQL}, {_SECONDS_SQL},
    m AS (SELECT series_id, count(*) / 10 AS dur, avg((f0 > 0)::INT) AS vf,
      quantile_cont(f0, 0.5) FILTER (f0 > 0) AS med, quantile_cont(f0, 0.05) FILTER (f0 > 0) AS p05,
      quantile_cont(f0, 0.95) FILTER (f0 > 0) AS p95,
      20 * log10(greatest(sqrt(avg(rms * rms) FILTER (f0 > 0)), 1e-12)) AS act,
      20 * log10(greatest(max(rms), 1e-12)) AS peak, avg((rms > 0.5)::INT) AS clip, count(*) AS n FROM frames GROUP BY 1)
    SELECT series_id, round(dur, 6) AS duration_seconds, round(vf, 6) AS voiced_fraction, round(med, 6) AS median_f0_hz,
      round(p05, 6) AS f0_p05_hz, round(p95, 6) AS f0_p95_hz, round(act, 6) AS active_rms_dbfs,
      round(CASE WHEN n < 10 AND med IS NOT NULL THEN 0 ELSE r END, 6) AS one_second_level_range_db,
      round(peak, 6) AS peak_dbfs, round(clip, 6) AS clipping_fraction,
      CASE WHEN med IS NULL THEN 'no voiced frame' WHEN n >= 10 AND r IS NULL THEN 'no sustained voiced second' END AS rejected
    FROM m LEFT JOIN range USING (series_id)""",
)
def series_metrics(spark, d):
    frames = (
        event_frames(spark, d, stored=True)
        .withColumn("peak", F.col("rms"))
        .withColumn("clipped_n", (F.col("rms") > 0.5).cast("long"))
        .withColumn("n", F.lit(1).cast("long"))
    )
    return rounded(measure.series_metrics(frames, rate=SECOND))


@query(
    "level_range",
    f"""WITH {FRAMES_SQL}, {_SECONDS_SQL} SELECT series_id, round(r, 6) AS one_second_level_range_db FROM range
    UNION ALL SELECT series_id, 0 FROM frames GROUP BY 1 HAVING count(*) < 10 AND max(f0) > 0""",
)
def level_range(spark, d):
    return rounded(measure.one_second_level_range(event_frames(spark, d), rate=SECOND))


@query(
    "sliding_window_metrics",
    f"""WITH {FRAMES_SQL}, n AS (SELECT series_id, count(*) AS n FROM frames GROUP BY 1),
    w AS (SELECT series_id, unnest(range(0, n - 30 + 1, 5)) AS start_frame FROM n WHERE n >= 30),
    f AS (SELECT w.start_frame, frames.*, frame_idx - start_frame AS i FROM w JOIN frames ON w.series_id = frames.series_id
      AND frame_idx >= start_frame AND frame_idx < start_frame + 30),
    m AS (SELECT series_id, start_frame, avg((f0 > 0)::INT) AS vf, quantile_cont(f0, 0.5) FILTER (f0 > 0) AS med,
      quantile_cont(f0, 0.05) FILTER (f0 > 0) AS p05, quantile_cont(f0, 0.95) FILTER (f0 > 0) AS p95,
      20 * log10(greatest(sqrt(avg(rms * rms) FILTER (f0 > 0)), 1e-12)) AS act FROM f GROUP BY ALL),
    s AS (SELECT series_id, start_frame, i // 10 AS s, 20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12)) AS db FROM f GROUP BY ALL
      HAVING avg((f0 > 0)::INT) >= 0.2),
    r AS (SELECT series_id, start_frame, least(quantile_cont(db, 0.95) - quantile_cont(db, 0.05), 120) AS r FROM s GROUP BY ALL),
    v AS (SELECT series_id, start_frame, i - row_number() OVER (PARTITION BY series_id, start_frame ORDER BY i) AS g FROM f WHERE f0 > 0),
    l AS (SELECT series_id, start_frame, max(c) AS c FROM (SELECT series_id, start_frame, g, count(*) AS c FROM v GROUP BY ALL) GROUP BY ALL)
    SELECT series_id, start_frame, round(vf, 6) AS voiced_fraction, round(med, 6) AS median_f0_hz, round(p05, 6) AS f0_p05_hz,
      round(p95, 6) AS f0_p95_hz, round(act, 6) AS active_rms_dbfs, round(r, 6) AS one_second_level_range_db,
      round(coalesce(c, 0) / 10, 6) AS longest_voicing_seconds
    FROM m LEFT JOIN r USING (series_id, start_frame) LEFT JOIN l USING (series_id, start_frame)""",
)
def sliding_window_metrics(spark, d):
    out = measure.window_metrics(event_frames(spark, d), 30, 5, rate=SECOND)
    return rounded(out.drop("end_frame", "duration_seconds", "rejected"))


@query(
    "centre_dominance",
    f"""WITH {FRAMES_SQL} SELECT series_id, CASE WHEN series_id % 10 = 0 THEN 60 ELSE round(greatest(-120, least(120,
      20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12) / greatest(sqrt(avg(f0 * f0)), 1e-12)))), 6) END AS centre_dominance_db
    FROM frames GROUP BY series_id""",
)
def centre_dominance(spark, d):
    frames = event_frames(spark, d).select(
        "series_id",
        (F.col("rms") * F.col("rms")).alias("mid_sq"),
        (F.col("f0") * F.col("f0")).alias("side_sq"),
        F.lit(1).alias("n"),
        F.when(F.col("series_id") % 10 == 0, 1).otherwise(2).alias("channels"),
    )
    return rounded(measure.centre_dominance(frames))


@query(
    "active_rms",
    f"""WITH {FRAMES_SQL} SELECT series_id, round(sqrt(coalesce(
      sum(rms * rms * 8) FILTER (frame_idx % 9 <> 0 AND rms >= pow(10, -0.75)) / sum(8) FILTER (frame_idx % 9 <> 0 AND rms >= pow(10, -0.75)),
      sum(CASE WHEN frame_idx % 9 = 0 THEN rms * rms * 3 ELSE rms * rms * 8 END) / sum(CASE WHEN frame_idx % 9 = 0 THEN 3 ELSE 8 END))), 6) AS active_rms
    FROM frames GROUP BY series_id""",
)
def active_rms(spark, d):
    n = F.when(F.col("frame_idx") % 9 == 0, 3).otherwise(8)
    frames = event_frames(spark, d).select(
        "series_id", n.alias("n"), (F.col("rms") * F.col("rms") * n).alias("sum_sq")
    )
    return rounded(measure.active_rms(frames, frame_length=8, threshold_dbfs=-15.0))


@query(
    "balance",
    f"""WITH {FRAMES_SQL}, a AS (SELECT series_id, frame_idx, rms FROM frames),
    b AS (SELECT series_id - 1 AS series_id, frame_idx, rms FROM frames),
    t AS (SELECT series_id, greatest(pow(10, -45 / 20), 0.1 * quantile_cont(rms, 0.6)) AS bar FROM a WHERE rms > 0.001 GROUP BY 1),
    x AS (SELECT a.series_id, quantile_cont(20 * log10(a.rms) - 20 * log10(b.rms), 0.5) AS v FROM a JOIN b USING (series_id, frame_idx)
      JOIN t USING (series_id) WHERE round(a.rms, 12) >= round(bar, 12) AND b.rms > 1e-8 GROUP BY 1)
    SELECT series_id, round(v, 6) AS balance_db FROM (SELECT DISTINCT series_id FROM a) LEFT JOIN x USING (series_id)""",
)
def balance(spark, d):
    frames = event_frames(spark, d, stored=True).select("series_id", "frame_idx", "rms")
    other = frames.withColumn("series_id", F.col("series_id") - 1)
    return rounded(measure.balance_db(frames, other))


@query(
    "dropout_fraction",
    f"""WITH {FRAMES_SQL}, m AS (SELECT series_id, greatest(quantile_cont(rms, 0.5) * 0.3, 1e-6) AS bar FROM frames WHERE f0 > 0 GROUP BY 1)
    SELECT series_id, round(avg((rms < bar)::INT), 6) AS dropout_fraction FROM frames JOIN m USING (series_id) WHERE f0 > 0 GROUP BY 1""",
)
def dropout_fraction(spark, d):
    return rounded(measure.dropout_fraction(event_frames(spark, d), factor=0.3))


@query(
    "pitch_error",
    f"""WITH {FRAMES_SQL}, j AS (SELECT t.series_id, t.f0 AS a, o.f0 AS b,
      CASE WHEN t.f0 > 0 AND o.f0 > 0 THEN abs(1200 * log2(o.f0 / t.f0)) END AS c
      FROM frames t JOIN frames o ON o.series_id = t.series_id + 1 AND o.frame_idx = t.frame_idx)
    SELECT series_id, round(coalesce(quantile_cont(c, 0.5), 1e6), 6) AS f0_median_error_cents,
      round(avg((c IS NULL OR c > 200)::INT) FILTER (a > 0), 6) AS f0_gross_error_fraction
    FROM j GROUP BY 1 HAVING count(*) FILTER (a > 0) > 0""",
)
def pitch_error(spark, d):
    frames = event_frames(spark, d).select("series_id", "frame_idx", "f0")
    other = frames.withColumn("series_id", F.col("series_id") - 1)
    pairs = measure.compare_series(frames, other)
    return rounded(measure.pitch_error(pairs, unmatched=1_000_000.0))


@query(
    "level_match",
    f"""WITH {FRAMES_SQL}, j AS (SELECT t.series_id, t.frame_idx, t.f0, t.rms AS g, o.rms AS r
      FROM frames t JOIN frames o ON o.series_id = t.series_id + 1 AND o.frame_idx = t.frame_idx),
    v AS (SELECT *, f0 > 0 AND g > 1e-8 AND r > 1e-8 AS valid, 20 * log10(greatest(g, 1e-12)) - 20 * log10(greatest(r, 1e-12)) AS diff FROM j),
    k AS (SELECT series_id, quantile_cont(diff, 0.5) AS gain FROM v WHERE valid GROUP BY 1)
    SELECT series_id, round(gain, 6) AS global_gain_db,
      round(sum(CASE WHEN valid THEN greatest(-6, least(6, diff - gain)) ELSE 0 END), 5) AS residual_sum
    FROM v JOIN k USING (series_id) GROUP BY ALL""",
)
def level_match(spark, d):
    frames = event_frames(spark, d, stored=True)
    guide = frames.select("series_id", "frame_idx", "f0", F.col("rms").alias("guide_rms"))
    other = frames.select(
        (F.col("series_id") - 1).alias("series_id"), "frame_idx", F.col("rms").alias("other_rms")
    )
    gains, rows = measure.level_match(guide.join(other, ["series_id", "frame_idx"]))
    total = rows.groupBy("series_id").agg(F.round(F.sum("residual_db"), 5).alias("residual_sum"))
    return rounded(gains.join(total, "series_id"))


@query(
    "contour_timing",
    f"""WITH {FRAMES_SQL}, n AS (SELECT series_id, count(*) AS n FROM frames GROUP BY 1)
    SELECT user_id AS series_id, coalesce(abs(n.n / 10 - max(hour(ts)) / 3) <= 1, false) AS timing_ok
    FROM events LEFT JOIN n ON user_id = series_id GROUP BY user_id, n.n""",
)
def contour_timing(spark, d):
    durations = table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg(
        (F.max(F.hour("ts")) / 3).alias("duration_seconds")
    )
    return measure.frame_count_matches(
        event_frames(spark, d), durations, rate=SECOND, tolerance=1.0
    )


@query(
    "robust_rank",
    """WITH r AS (SELECT l_partkey AS song_id, sum(l_extendedprice) AS rev, avg(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1),
    m AS (SELECT quantile_cont(rev, 0.5) AS mr, quantile_cont(qty, 0.5) AS mq, quantile_cont(n, 0.5) AS mn FROM r),
    s AS (SELECT mr, mq, mn, quantile_cont(abs(rev - mr), 0.5) * 1.4826 AS sr, quantile_cont(abs(qty - mq), 0.5) * 1.4826 AS sq,
      quantile_cont(abs(n - mn), 0.5) * 1.4826 AS sn, stddev_pop(n) AS dn FROM r, m GROUP BY ALL)
    SELECT song_id, round(0.6 * (rev - mr) / sr + 0.25 * (qty - mq) / sq
      + 0.15 * (n - mn) / (CASE WHEN sn >= 1e-12 THEN sn WHEN dn = 0 THEN 1 ELSE dn END), 6) AS score FROM r, s""",
)
def robust_rank(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("song_id")).agg(
        F.sum("l_extendedprice").alias("rev"),
        F.avg("l_quantity").alias("qty"),
        F.count(F.lit(1)).alias("n"),
    )
    scored = tempo.robust_zscore(per, {"rev": 0.6, "qty": 0.25, "n": 0.15}, name="score")
    return rounded(scored.select("song_id", "score"))


@query(
    "exact_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
      round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""",
)
def quantiles(spark, d):
    from reelgate.functions.quantiles import exact_quantiles

    return rounded(
        exact_quantiles(
            table(spark, d, "lineitem"),
            ["l_returnflag"],
            "l_extendedprice",
            {"p05": 0.05, "p50": 0.5, "p95": 0.95},
        )
    )


@query(
    "frame_levels_db",
    f"""WITH {FRAMES_SQL} SELECT series_id, frame_idx, round(20 * log10(greatest(f0, 1e-12)), 6) AS level_db FROM frames""",
)
def frame_levels_db(spark, d):
    return rounded(
        event_frames(spark, d).select("series_id", "frame_idx", amplitude_db("f0").alias("level_db"))
    )
