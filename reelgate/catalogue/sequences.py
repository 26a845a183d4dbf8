"""Windows, gaps, runs and smoothing over the events series."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import (
    FRAMES_SQL,
    event_frames,
    gap_fill_sql,
    query,
    rounded,
    spike_repair_sql,
    table,
)
from reelgate.catalogue.selection import topk_sql
from reelgate.operators import sequence, tempo
from reelgate.operators.frames import series_lengths
from reelgate.plans.rhythm import analyse_rhythm
from reelgate.session import pinned

_N_SQL = "n AS (SELECT series_id, count(*) AS n FROM frames GROUP BY 1)"


def _lengths(spark, d):
    return series_lengths(
        table(spark, d, "events").select(F.col("user_id").alias("series_id"))
    )


@query(
    "sliding_windows",
    f"""WITH {FRAMES_SQL}, {_N_SQL}, w AS (SELECT series_id, unnest(range(0, n - 15 + 1, 4)) AS start FROM n WHERE n >= 15)
    SELECT series_id, start // 4 AS window_idx, start, start + 15 AS "end" FROM w""",
)
def sliding_windows(spark, d):
    return sequence.sliding_windows(_lengths(spark, d), 15, 4)


@query(
    "covering_windows",
    f"""WITH {FRAMES_SQL}, {_N_SQL}, w AS (SELECT series_id, n, unnest(range(0, greatest(n - 40, 0) + 1, 7)) AS start FROM n
      UNION SELECT series_id, n, greatest(n - 40, 0) FROM n)
    SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY start) - 1 AS window_idx, start, least(start + 40, n) AS "end" FROM w""",
)
def covering_windows(spark, d):
    return sequence.covering_windows(_lengths(spark, d), 40, 7)


@query(
    "active_windows",
    f"""WITH {FRAMES_SQL}, {_N_SQL},
    w AS (SELECT series_id, n, unnest(range(0, n - 10 + 1, 10)) AS start FROM n WHERE n >= 10),
    m AS (SELECT w.series_id, start, avg((f0 > 0)::INT) AS v, sqrt(avg(rms * rms)) AS r FROM w JOIN frames
      ON frames.series_id = w.series_id AND frame_idx >= start AND frame_idx < start + 10 GROUP BY ALL),
    k AS (SELECT series_id, start, start + 10 AS "end" FROM m WHERE v >= 0.95 AND r >= 0.2)
    SELECT * FROM k UNION ALL SELECT series_id, 0, n FROM n WHERE series_id NOT IN (SELECT series_id FROM k)""",
)
def active_windows(spark, d):
    frames = event_frames(spark, d)
    windows = (
        frames.withColumn("start", F.expr("frame_idx div 10 * 10"))
        .groupBy("series_id", "start")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("f0") > 0).cast("double")).alias("voiced_fraction"),
            F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"),
        )
        .where("n = 10")
        .withColumn("end", F.col("start") + 10)
    )
    return sequence.active_windows(
        windows, _lengths(spark, d), minimum_voiced=0.95, minimum_rms=0.2
    )


@query(
    "phrase_plan",
    f"""WITH {FRAMES_SQL}, {_N_SQL}, a AS (SELECT series_id, n, n::DOUBLE AS d,
      CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 1.0) / 19) END AS c0 FROM n),
    b AS (SELECT *, CASE WHEN d <= 20 OR (d + (c0 - 1)) / c0 >= 12 THEN c0 ELSE greatest(floor((d - 1) / 11), 1) END AS c FROM a),
    g AS (SELECT *, (d + (c - 1)) / c AS len FROM b),
    p AS (SELECT series_id, n, c, len, unnest(range(0, c::BIGINT)) AS i FROM g WHERE d <= 20 OR len BETWEEN 12 AND 20),
    s AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE round_even(i * (len - 1), 0) END AS st FROM p)
    SELECT series_id, i AS phrase_idx, st::BIGINT AS start_frame,
      (CASE WHEN i = c - 1 THEN n ELSE round_even(st + len, 0) END)::BIGINT AS end_frame FROM s""",
)
def phrase_plan(spark, d):
    phrases, _ = sequence.plan_phrases(_lengths(spark, d), 12.0, 20.0, 1.0, rate=1)
    return phrases


@query(
    "gap_fill",
    f"""WITH {FRAMES_SQL}, {gap_fill_sql("frames", "filled", 2, 1500)}
    SELECT series_id, frame_idx, round(f0, 6) AS f0 FROM filled""",
)
def gap_fill(spark, d):
    frames = event_frames(spark, d).select("series_id", "frame_idx", "f0")
    return rounded(sequence.gap_fill(frames, 2, limit_cents=1500.0))


@query(
    "spike_repair",
    f"""WITH RECURSIVE {FRAMES_SQL}, {spike_repair_sql("frames", "repaired", 900, 1900)}
    SELECT series_id, frame_idx, round(f0, 6) AS f0 FROM repaired""",
)
def spike_repair(spark, d):
    frames = event_frames(spark, d).select("series_id", "frame_idx", "f0")
    return rounded(
        sequence.spike_repair(frames, neighbour_cents=900.0, spike_cents=1900.0)
    )


_RUNS_SQL = """g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS k FROM frames WHERE f0 > 0),
runs AS (SELECT series_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e, count(*) AS len FROM g GROUP BY series_id, k)"""


@query(
    "voiced_runs",
    f"""WITH {FRAMES_SQL}, {_RUNS_SQL} SELECT series_id, s AS start, e AS "end", len AS length FROM runs""",
)
def voiced_runs(spark, d):
    return sequence.runs(event_frames(spark, d), F.col("f0") > 0)


@query(
    "longest_run",
    f"""WITH {FRAMES_SQL}, {_RUNS_SQL} SELECT series_id, round(coalesce(max(len), 0) / 10, 6) AS longest_seconds
    FROM (SELECT DISTINCT series_id FROM frames) LEFT JOIN runs USING (series_id) GROUP BY 1""",
)
def longest_run(spark, d):
    return rounded(sequence.longest_run(event_frames(spark, d), F.col("f0") > 0, rate=10.0))


_DROPS_SQL = """m AS (SELECT series_id, greatest(quantile_cont(rms, 0.5) * 0.7, 1e-6) AS bar FROM frames WHERE f0 > 0 GROUP BY 1),
fl AS (SELECT frames.*, bar, coalesce(f0 > 0 AND rms < bar, false) AS dropout FROM frames LEFT JOIN m USING (series_id)),
g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS k FROM fl WHERE dropout),
runs AS (SELECT series_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e, count(*) AS len, sqrt(avg(rms * rms)) AS r, max(bar) AS bar FROM g GROUP BY series_id, k)"""


@query(
    "sustained_runs",
    f"""WITH {FRAMES_SQL}, {_DROPS_SQL} SELECT series_id, count(len) FILTER (len >= 3) AS sustained_runs
    FROM (SELECT DISTINCT series_id FROM frames) LEFT JOIN runs USING (series_id) GROUP BY 1""",
)
def sustained_runs(spark, d):
    flagged = sequence.with_dropouts(event_frames(spark, d, stored=True), factor=0.7)
    return sequence.sustained_runs(flagged, 3)


@query(
    "run_classes",
    f"""WITH {FRAMES_SQL}, {_DROPS_SQL}, c AS (SELECT *, CASE WHEN r > 1e-8 THEN least(pow(10, 0.3), bar * 1.05 / r) END AS gn FROM runs)
    SELECT series_id, s AS start, e AS "end", len AS length, round(r, 6) AS rms,
      round(CASE WHEN len BETWEEN 2 AND 3 AND gn > 1 THEN gn END, 6) AS gain,
      CASE WHEN len < 2 THEN 'none' WHEN len <= 3 AND gn > 1 THEN 'repairable' ELSE 'failing' END AS class FROM c""",
)
def run_classes(spark, d):
    flagged = (
        sequence.with_dropouts(event_frames(spark, d, stored=True), factor=0.7)
        .withColumn("n", F.lit(1))
        .withColumn("sum_sq", F.col("rms") * F.col("rms"))
    )
    return rounded(
        sequence.classify_runs(flagged, minimum=2, maximum_ms=60, maximum_gain_db=6.0)
    )


_FLUX_SQL = """fx AS (SELECT *, greatest(coalesce(ln(rms + 1e-7) - lag(ln(rms + 1e-7)) OVER (PARTITION BY series_id ORDER BY frame_idx), 0), 0) AS flux FROM frames)"""


@query(
    "log_flux",
    f"WITH {FRAMES_SQL}, {_FLUX_SQL} SELECT series_id, frame_idx, round(flux, 6) AS flux FROM fx",
)
def log_flux(spark, d):
    out = sequence.positive_log_flux(event_frames(spark, d), "rms")
    return rounded(out.select("series_id", "frame_idx", "flux"))


@query(
    "scaled_flux",
    f"""WITH {FRAMES_SQL}, {_FLUX_SQL}, t AS (SELECT series_id, quantile_cont(flux, 0.95) AS top FROM fx GROUP BY 1)
    SELECT series_id, frame_idx, round(greatest(0, least(2, flux / greatest(top, 1e-12))), 6) AS flux FROM fx JOIN t USING (series_id)""",
)
def scaled_flux(spark, d):
    out = sequence.positive_log_flux(event_frames(spark, d), "rms")
    return rounded(
        sequence.robust_scale(out, ["flux"]).select("series_id", "frame_idx", "flux")
    )


@query(
    "smooth_gain",
    f"""WITH {FRAMES_SQL}, x AS (SELECT series_id, frame_idx, CASE WHEN f0 > 0 THEN value ELSE 0 END AS x FROM frames),
    w AS (SELECT unnest(range(-10, 11)) AS o), h AS (SELECT o, 0.5 - 0.5 * cos(2 * pi() * (o + 10) / 20) AS h FROM w),
    k AS (SELECT o, h / (SELECT sum(h) FROM h) AS h FROM h)
    SELECT a.series_id, a.frame_idx, round(sum(b.x * k.h), 5) AS smoothed FROM x a JOIN k ON true
      JOIN x b ON b.series_id = a.series_id AND b.frame_idx = a.frame_idx + k.o GROUP BY 1, 2""",
)
def smooth_gain(spark, d):
    out = sequence.smooth_gain(event_frames(spark, d), "value", F.col("f0") > 0)
    return rounded(out.select("series_id", "frame_idx", "smoothed"), 5)


@query(
    "grid_interpolate",
    f"""WITH {FRAMES_SQL}, {_N_SQL}, o AS (SELECT series_id, n, 2 * n - 7 AS m, unnest(range(0, 2 * n - 7)) AS i FROM n WHERE n > 4),
    p AS (SELECT *, i * (n - 1) // (m - 1) AS lo, (i * (n - 1)) % (m - 1) / (m - 1) AS fr FROM o)
    SELECT p.series_id, i AS out_idx, round(a.value + fr * (coalesce(b.value, a.value) - a.value), 9) AS value FROM p
      JOIN frames a ON a.series_id = p.series_id AND a.frame_idx = lo LEFT JOIN frames b ON b.series_id = p.series_id AND b.frame_idx = lo + 1""",
)
def grid_interpolate(spark, d):
    lengths = _lengths(spark, d).where("n_frames > 4").withColumn("n_out", 2 * F.col("n_frames") - 7)
    return rounded(sequence.grid_interpolate(event_frames(spark, d), lengths), 9)


@query(
    "phrase_coverage",
    """WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_linenumber, l_quantity FROM lineitem),
    q AS (SELECT l_orderkey, i, (l_linenumber - 1) * 8.0 * (CASE WHEN i = 0 AND l_linenumber < 3 THEN 0 ELSE 1 END) AS s, (l_linenumber - 1) * 8.0 + l_quantity AS e FROM p),
    r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q)
    SELECT l_orderkey, coalesce(bool_and(s <= greatest(coalesce(m, 0), 0) + 0.001 AND e > s AND (i > 0 OR abs(s) <= 0.001)) AND max(e) >= 30 - 0.02, false) AS covered
    FROM r GROUP BY 1""",
)
def phrase_coverage(spark, d):
    from reelgate.operators.frames import number_frames

    items = number_frames(
        table(spark, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
        ),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
    )
    at = (F.col("l_linenumber") - 1) * 8.0
    early = (F.col("frame_idx") == 0) & (F.col("l_linenumber") < 3)
    phrases = items.select(
        "l_orderkey",
        F.col("frame_idx").alias("phrase_idx"),
        F.when(early, F.lit(0.0)).otherwise(at).alias("start_seconds"),
        (at + F.col("l_quantity")).alias("end_seconds"),
    )
    duration = phrases.select("l_orderkey").distinct().withColumn("duration_seconds", F.lit(30.0))
    return sequence.coverage_check(phrases, duration, keys=["l_orderkey"])


@query(
    "join_jumps",
    f"""WITH {FRAMES_SQL}, j AS (SELECT series_id, frame_idx, rms AS b, lead(rms) OVER (PARTITION BY series_id ORDER BY frame_idx) AS a FROM frames),
    x AS (SELECT j.* FROM j WHERE frame_idx % 5 = 0 AND a IS NOT NULL AND EXISTS (SELECT 1 FROM frames f WHERE f.series_id = j.series_id AND f.frame_idx = j.frame_idx AND f0 > 0)
      AND EXISTS (SELECT 1 FROM frames f WHERE f.series_id = j.series_id AND f.frame_idx = j.frame_idx - 1 AND f0 > 0))
    SELECT series_id, round(coalesce(max(abs(20 * log10(greatest(a, 1e-12) / greatest(b, 1e-12)))), 0), 6) AS max_join_jump_db
    FROM (SELECT DISTINCT series_id FROM frames) LEFT JOIN x USING (series_id) GROUP BY 1""",
)
def join_jumps(spark, d):
    frames = event_frames(spark, d, stored=True).select("series_id", "frame_idx", "f0", "rms")
    following = frames.select(
        "series_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("rms").alias("after_rms")
    )
    joins = (
        frames.where("frame_idx % 5 = 0")
        .select("series_id", "frame_idx", F.col("rms").alias("before_rms"))
        .join(following, ["series_id", "frame_idx"], "left")
    )
    return rounded(sequence.join_jump(joins, frames))


@query(
    "relative_level",
    """WITH c AS (SELECT l_suppkey AS song_id, l_orderkey, l_linenumber, l_partkey, l_quantity AS lvl, l_discount * 80 AS rng, l_tax * 12 AS vf FROM lineitem),
    t AS (SELECT song_id, quantile_cont(lvl, 0.75) AS top FROM c GROUP BY 1),
    x AS (SELECT c.*, greatest(0, top - lvl) AS d FROM c JOIN t USING (song_id))
    SELECT song_id, l_orderkey, l_linenumber, l_partkey, round(d, 6) AS relative_level_deficit_db,
      round(greatest(0, least(1, 1 - d / 6 * 0.35 - rng / 8 * 0.25 - abs(vf - 0.84) * 0.5)), 6) AS confidence FROM x WHERE d <= 6""",
)
def relative_level(spark, d):
    candidates = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("song_id"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("active_rms_dbfs"),
        (F.col("l_discount") * 80).alias("one_second_level_range_db"),
        (F.col("l_tax") * 12).alias("voiced_fraction"),
    )
    out = sequence.relative_level(candidates)
    return rounded(
        out.drop("active_rms_dbfs", "one_second_level_range_db", "voiced_fraction")
    )


@query(
    "peak_pick",
    f"""WITH RECURSIVE {FRAMES_SQL}, md AS (SELECT series_id, quantile_cont(value, 0.5) AS md FROM frames GROUP BY 1),
    bar AS (SELECT series_id, md + greatest(1.5 * quantile_cont(abs(value - md), 0.5), 0.08) AS bar FROM frames JOIN md USING (series_id) GROUP BY series_id, md),
    c AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS rn FROM (SELECT series_id, frame_idx, value,
      lag(value) OVER w AS l, lead(value) OVER w AS r FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) JOIN bar USING (series_id)
      WHERE value > l AND value >= r AND value >= bar),
    s AS (SELECT series_id, rn, frame_idx, value, false AS emitted, frame_idx AS was, value AS wasv FROM c WHERE rn = 1
      UNION ALL SELECT c.series_id, c.rn, CASE WHEN c.frame_idx - s.frame_idx >= 4 OR c.value > s.value THEN c.frame_idx ELSE s.frame_idx END,
        CASE WHEN c.frame_idx - s.frame_idx >= 4 OR c.value > s.value THEN c.value ELSE s.value END,
        c.frame_idx - s.frame_idx >= 4, s.frame_idx, s.value FROM s JOIN c ON c.series_id = s.series_id AND c.rn = s.rn + 1)
    SELECT series_id, was AS frame_idx, round(wasv, 6) AS value FROM s WHERE emitted
    UNION ALL SELECT series_id, arg_max(frame_idx, rn), round(arg_max(value, rn), 6) FROM s GROUP BY series_id""",
)
def peak_pick(spark, d):
    frames = event_frames(spark, d, stored=True).select("series_id", "frame_idx", "value")
    return rounded(sequence.peak_pick(frames, minimum_gap=4))


def _pieces(spark, d):
    """Each run of ten events of a user as a piece that overlaps its successor by two."""
    frames = event_frames(spark, d).select("series_id", "frame_idx", "rms")
    halo = frames.withColumn(
        "piece_idx",
        F.explode(
            F.expr(
                "array_distinct(array(frame_idx div 8, greatest((frame_idx - 2) div 8, 0)))"
            )
        ),
    )
    return halo.groupBy("series_id", "piece_idx").agg(
        F.min("frame_idx").alias("start"),
        (F.max("frame_idx") + 1).alias("end"),
        F.sort_array(F.collect_list(F.struct("frame_idx", "rms")))["rms"].alias("values"),
    )


_STITCH_SQL = f"""{FRAMES_SQL},
    p AS (SELECT series_id, unnest(list_distinct([frame_idx // 8, greatest((frame_idx - 2) // 8, 0)])) AS piece_idx, frame_idx, rms FROM frames),
    q AS (SELECT series_id, piece_idx, min(frame_idx) AS s, max(frame_idx) + 1 AS e FROM p GROUP BY ALL),
    n AS (SELECT *, row_number() OVER w AS rn, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM q WINDOW w AS (PARTITION BY series_id ORDER BY s)),
    l AS (SELECT n.series_id, n.piece_idx, rn, s, e, CASE WHEN pe IS NULL THEN 0 ELSE greatest(least(pe, e) - s, 0) END AS head, greatest(e - coalesce(ns, e), 0) AS tail,
      coalesce(sqrt(avg(rms * rms) FILTER (f.frame_idx < pe)), 0) AS hr, coalesce(sqrt(avg(rms * rms) FILTER (f.frame_idx >= ns)), 0) AS tr
      FROM n JOIN frames f ON f.series_id = n.series_id AND f.frame_idx >= s AND f.frame_idx < e GROUP BY n.series_id, n.piece_idx, rn, pe, ns, e, s),
    g AS (SELECT series_id, piece_idx, rn, s, e, head, tail, 0::DOUBLE AS gain, tr FROM l WHERE rn = 1
      UNION ALL SELECT l.series_id, l.piece_idx, l.rn, l.s, l.e, l.head, l.tail, CASE WHEN l.head > 0 AND g.tr * pow(10, g.gain / 20) > 1e-8 AND l.hr > 1e-8
        THEN greatest(-6, least(6, 20 * log10(g.tr * pow(10, g.gain / 20) / l.hr))) ELSE 0 END, l.tr
        FROM g JOIN l ON l.series_id = g.series_id AND l.rn = g.rn + 1)"""


@query(
    "overlap_stitch",
    f"""WITH RECURSIVE {_STITCH_SQL}
    SELECT f.series_id, f.frame_idx AS idx, round(sum(rms * pow(10, gain / 20)
      * CASE WHEN f.frame_idx - s < head THEN sin((f.frame_idx - s) / greatest(head - 1, 1) * pi() / 2) ELSE 1 END
      * CASE WHEN f.frame_idx >= e - tail THEN cos((f.frame_idx - e + tail) / greatest(tail - 1, 1) * pi() / 2) ELSE 1 END), 6) AS value
    FROM g JOIN frames f ON f.series_id = g.series_id AND f.frame_idx >= s AND f.frame_idx < e GROUP BY 1, 2""",
)
def overlap_stitch(spark, d):
    pieces = pinned(_pieces(spark, d))
    lengths = pieces.groupBy("series_id").agg(F.max("end").alias("total"))
    joined, _, _ = sequence.overlap_stitch(pieces, lengths)
    return rounded(joined)


@query(
    "stitch_gains",
    f"""WITH RECURSIVE {_STITCH_SQL} SELECT series_id, piece_idx, round(gain, 6) AS join_gain_db FROM g""",
)
def stitch_gains(spark, d):
    pieces = pinned(_pieces(spark, d))
    lengths = pieces.groupBy("series_id").agg(F.max("end").alias("total"))
    _, gains, _ = sequence.overlap_stitch(pieces, lengths)
    return rounded(gains)


RATE = 6.0  # frames per second at which the sample series is read as a rhythm


def _envelope(spark, d):
    frames = event_frames(spark, d, stored=True)
    return frames.select("series_id", "frame_idx", "rms", "value")


_LAGS_TEXT = """b AS (SELECT 55 + 135 * i / 540.0::DOUBLE AS bpm FROM (SELECT unnest(range(0, 541)) AS i)),
bl AS (SELECT bpm, greatest(round_even(6.0::DOUBLE * 60 / bpm, 0), 1)::BIGINT AS lag FROM b), ls AS (SELECT DISTINCT lag FROM bl),
ce AS (SELECT series_id, frame_idx, value - avg(value) OVER (PARTITION BY series_id) AS x FROM SOURCE),
ac AS (SELECT u.series_id, lag, sum(u.x * v.x) / (sqrt(sum(u.x * u.x)) * sqrt(sum(v.x * v.x))) AS c FROM ce u, ls, ce v
  WHERE v.series_id = u.series_id AND v.frame_idx = u.frame_idx + lag GROUP BY 1, 2)"""
_LAGS_SQL = _LAGS_TEXT.replace("SOURCE", "frames")


@query(
    "tempo_correlations",
    f"""WITH {FRAMES_SQL}, {_LAGS_SQL} SELECT s.series_id, round(bpm, 6) AS bpm, round(coalesce(c, 0), 6) AS correlation
    FROM (SELECT DISTINCT series_id FROM frames) s JOIN bl ON true LEFT JOIN ac ON ac.series_id = s.series_id AND ac.lag = bl.lag""",
)
def tempo_correlations(spark, d):
    return rounded(tempo.tempo_correlations(_envelope(spark, d), RATE))


@query(
    "tempo",
    f"""WITH {FRAMES_SQL}, {_LAGS_SQL}, c0 AS (SELECT ac.series_id, bpm AS start_frame, -c AS a, 0 AS b FROM ac JOIN bl USING (lag)),
    {topk_sql(5, 4)} SELECT series_id, round(start_frame, 6) AS bpm, round(-a, 6) AS correlation,
      row_number() OVER (PARTITION BY series_id ORDER BY a, start_frame)::INT AS rank FROM picked""",
)
def tempo_query(spark, d):
    return rounded(tempo.tempo_candidates(_envelope(spark, d), RATE))


_RHYTHM_SQL = f"""{FRAMES_SQL}, lg AS (SELECT series_id, frame_idx, rms, ln(rms + 1e-7) AS a, ln(abs(rms - f0 / 500) + 1e-7) AS b FROM frames),
fx AS (SELECT series_id, frame_idx, rms, greatest(coalesce(a - lag(a) OVER w, 0), 0) AS e, greatest(coalesce(b - lag(b) OVER w, 0), 0) AS f
  FROM lg WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)),
tp AS (SELECT series_id, quantile_cont(e, 0.95) AS te, quantile_cont(f, 0.95) AS tf, greatest(quantile_cont(rms, 0.2), 1e-7) AS p20 FROM fx GROUP BY 1),
env AS (SELECT series_id, frame_idx, rms, p20, 0.6 * greatest(0, least(2, e / greatest(te, 1e-12))) + 0.4 * greatest(0, least(2, f / greatest(tf, 1e-12))) AS value
  FROM fx JOIN tp USING (series_id)),
md AS (SELECT series_id, quantile_cont(value, 0.5) AS md FROM env GROUP BY 1),
br AS (SELECT series_id, md + greatest(1.5 * quantile_cont(abs(value - md), 0.5), 0.08) AS bar FROM env JOIN md USING (series_id) GROUP BY series_id, md),
nb AS (SELECT series_id, value, lag(value) OVER w AS l, lead(value) OVER w AS r FROM env WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)),
os AS (SELECT series_id, count(*) AS onsets FROM nb JOIN br USING (series_id) WHERE value > l AND value >= r AND value >= bar GROUP BY 1),
st AS (SELECT series_id, count(*) / 6.0::DOUBLE AS dur, avg(value) AS act, avg((rms > p20)::INT) AS fr FROM env GROUP BY 1),
{_LAGS_TEXT.replace("SOURCE", "env")},
c0 AS (SELECT ac.series_id, bpm AS start_frame, -coalesce(c, 0) AS a, 0 AS b FROM ac JOIN bl USING (lag)), {topk_sql(5, 4)},
pu AS (SELECT series_id, arg_min(start_frame, (a, start_frame)) AS bpm, greatest(max(-a) - quantile_cont(-a, 0.5), 0) AS conf FROM picked GROUP BY 1),
al AS (SELECT series_id, dur, coalesce(onsets, 0) / greatest(dur, 1) AS dens, act, fr, bpm, conf FROM st JOIN pu USING (series_id) LEFT JOIN os USING (series_id)),
m1 AS (SELECT quantile_cont(bpm, 0.5) AS m_b, quantile_cont(dens, 0.5) AS m_d, quantile_cont(conf, 0.5) AS m_c, quantile_cont(act, 0.5) AS m_a FROM al),
m2 AS (SELECT 1.4826 * quantile_cont(abs(bpm - m_b), 0.5) AS s_b, 1.4826 * quantile_cont(abs(dens - m_d), 0.5) AS s_d,
  1.4826 * quantile_cont(abs(conf - m_c), 0.5) AS s_c, 1.4826 * quantile_cont(abs(act - m_a), 0.5) AS s_a,
  stddev_pop(bpm) AS d_b, stddev_pop(dens) AS d_d, stddev_pop(conf) AS d_c, stddev_pop(act) AS d_a FROM al, m1),
m3 AS (SELECT CASE WHEN s_b >= 1e-12 THEN s_b WHEN d_b = 0 THEN 1 ELSE d_b END AS s_b, CASE WHEN s_d >= 1e-12 THEN s_d WHEN d_d = 0 THEN 1 ELSE d_d END AS s_d,
  CASE WHEN s_c >= 1e-12 THEN s_c WHEN d_c = 0 THEN 1 ELSE d_c END AS s_c, CASE WHEN s_a >= 1e-12 THEN s_a WHEN d_a = 0 THEN 1 ELSE d_a END AS s_a FROM m2)"""


@query(
    "song_rhythm",
    f"""WITH {_RHYTHM_SQL}
    SELECT series_id, round(dur, 6) AS duration_seconds, round(dens, 6) AS onset_density_per_second, round(act, 6) AS transient_activity,
      round(fr, 6) AS active_fraction, round(bpm, 6) AS pulse_bpm, round(conf, 6) AS pulse_confidence,
      round(0.45 * (bpm - m_b) / s_b + 0.25 * (dens - m_d) / s_d + 0.15 * (conf - m_c) / s_c + 0.15 * (act - m_a) / s_a, 6) AS upbeat_score FROM al, m1, m3""",
)
def song_rhythm(spark, d):
    frames = event_frames(spark, d, stored=True).withColumn("detail_rms", F.abs(F.col("rms") - F.col("f0") / 500))
    durations = series_lengths(frames).select(
        "series_id", (F.col("n_frames") / RATE).alias("duration_seconds")
    )
    return rounded(analyse_rhythm(frames, durations, RATE))


#: Frames per second of the onsets: an onset keeps others away for three frames.
ONSET_RATE = 25.0


@query(
    "onset_stats",
    f"""WITH RECURSIVE {FRAMES_SQL}, md AS (SELECT series_id, quantile_cont(value, 0.5) AS md FROM frames GROUP BY 1),
    bar AS (SELECT series_id, md + greatest(1.5 * quantile_cont(abs(value - md), 0.5), 0.08) AS bar FROM frames JOIN md USING (series_id) GROUP BY series_id, md),
    c AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS rn FROM (SELECT series_id, frame_idx, value,
      lag(value) OVER w AS l, lead(value) OVER w AS r FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) JOIN bar USING (series_id)
      WHERE value > l AND value >= r AND value >= bar),
    s AS (SELECT series_id, rn, frame_idx, value, 1 AS onsets FROM c WHERE rn = 1
      UNION ALL SELECT c.series_id, c.rn, CASE WHEN c.frame_idx - s.frame_idx >= 3 OR c.value > s.value THEN c.frame_idx ELSE s.frame_idx END,
        CASE WHEN c.frame_idx - s.frame_idx >= 3 OR c.value > s.value THEN c.value ELSE s.value END,
        s.onsets + (c.frame_idx - s.frame_idx >= 3)::INT FROM s JOIN c ON c.series_id = s.series_id AND c.rn = s.rn + 1),
    o AS (SELECT series_id, max(onsets) AS onsets FROM s GROUP BY 1),
    q AS (SELECT series_id, greatest(quantile_cont(rms, 0.2), 1e-7) AS p20, avg(value) AS t, count(*) / 25.0::DOUBLE AS dur FROM frames GROUP BY 1)
    SELECT series_id, round(dur, 6) AS duration_seconds, round(coalesce(onsets, 0) / greatest(dur, 1), 9) AS onset_density_per_second,
      round(t, 9) AS transient_activity, round(avg((rms > p20)::INT), 6) AS active_fraction
    FROM frames JOIN q USING (series_id) LEFT JOIN o USING (series_id) GROUP BY series_id, dur, t, onsets""",
)
def onset_stats(spark, d):
    frames = _envelope(spark, d)
    durations = series_lengths(frames).select(
        "series_id", (F.col("n_frames") / ONSET_RATE).alias("duration_seconds")
    )
    out = tempo.onset_stats(frames, durations, ONSET_RATE)
    return out.select(
        "series_id",
        F.round("duration_seconds", 6).alias("duration_seconds"),
        F.round("onset_density_per_second", 9).alias("onset_density_per_second"),
        F.round("transient_activity", 9).alias("transient_activity"),
        F.round("active_fraction", 6).alias("active_fraction"),
    )
