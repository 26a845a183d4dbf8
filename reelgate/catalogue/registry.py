"""Registration of sample queries and shared views of the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgate.operators.frames import number_frames
from reelgate.session import pinned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Events as one value series per user: voiced above 10, level as a fraction of 500.
FRAMES_SQL = """frames AS (
  SELECT user_id AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         value, event_type,
         CASE WHEN value > 10 THEN value ELSE 0 END AS f0, value / 500 AS rms
  FROM events)"""


def event_frames(spark: SparkSession, folder: str, stored: bool = False) -> DataFrame:
    """``stored`` writes the numbered frames once, for queries that read them many times."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("series_id"), "ts", "event_id", "event_type", "value"
    )
    numbered = number_frames(rows, ["series_id"], ["ts", "event_id"])
    frames = numbered.select(
        "series_id",
        "frame_idx",
        "value",
        "event_type",
        F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(0.0)).alias("f0"),
        (F.col("value") / 500).alias("rms"),
    )
    return pinned(frames) if stored else frames


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, as the SQL twins do."""
    return df.select(
        *[
            F.round(F.col(name), digits).alias(name) if kind in ("double", "float") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def gap_fill_sql(source: str, target: str, gap: int, cents: float) -> str:
    """CTEs that fill short gaps of ``source`` (series_id, frame_idx, f0)."""
    return f"""{target}_p AS (SELECT *, max(CASE WHEN f0 > 0 THEN frame_idx END) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
      min(CASE WHEN f0 > 0 THEN frame_idx END) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qi FROM {source}),
    {target} AS (SELECT p.series_id, p.frame_idx, CASE WHEN p.f0 = 0 AND qi - pi - 1 <= {gap} AND abs(1200 * log2(b.f0 / a.f0)) <= {cents}
      THEN a.f0 * pow(b.f0 / a.f0, (p.frame_idx - pi) / (qi - pi)) ELSE p.f0 END AS f0 FROM {target}_p p
      LEFT JOIN {source} a ON a.series_id = p.series_id AND a.frame_idx = pi LEFT JOIN {source} b ON b.series_id = p.series_id AND b.frame_idx = qi)"""


def spike_repair_sql(source: str, target: str, neighbour: float, spike: float) -> str:
    """Recursive CTEs that walk ``source`` and repair octave errors in order."""
    return f"""{target}_x AS (SELECT series_id, frame_idx, f0,
        lead(f0) OVER (PARTITION BY series_id ORDER BY frame_idx) AS q FROM {source}),
    {target} AS (SELECT series_id, frame_idx, f0 FROM {target}_x WHERE frame_idx = 0
      UNION ALL SELECT x.series_id, x.frame_idx, CASE WHEN x.q IS NOT NULL AND r.f0 > 0 AND x.f0 > 0 AND x.q > 0
        AND abs(1200 * log2(x.q / r.f0)) <= {neighbour} AND least(abs(1200 * log2(x.f0 / r.f0)), abs(1200 * log2(x.f0 / x.q))) >= {spike}
        THEN sqrt(r.f0 * x.q) ELSE x.f0 END FROM {target} r JOIN {target}_x x ON x.series_id = r.series_id AND x.frame_idx = r.frame_idx + 1)"""
