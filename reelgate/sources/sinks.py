"""Immutable dataset tables and report documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(
    segments: DataFrame, path: str, *, split: str = "split", cluster: Sequence[str] = ("song_id",)
) -> None:
    """Write once, partitioned by split; an existing dataset is never touched.

    Rows are spread by split and cluster key with the segment's start, so that neither a
    split nor one large source ends up in a single task. The commit marker of the writer
    tells a complete dataset from a broken one.
    """
    spread = [split, *cluster]
    start = [c for c in ("start_frame", "start_seconds") if c in segments.columns][:1]
    (
        segments.repartition(*spread, *start)
        .sortWithinPartitions(*spread, *start)
        .write.mode("errorifexists")
        .partitionBy(split)
        .parquet(path)
    )


def sorted_struct(df: DataFrame, columns: Sequence[str] | None = None):
    """A struct with its fields in alphabetical order, for reproducible JSON."""
    return F.struct(*sorted(columns or df.columns))


def report_lines(parts: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows (key, kind, body) of a report: a header and one JSON document per record.

    A manifest of any number of records stays a table of lines, never one nested row.
    """
    lines = None
    for kind, part in parts.items():
        rows = part.select(
            *key,
            F.lit(kind).alias("kind"),
            F.to_json(sorted_struct(part), {"ignoreNullFields": "false"}).alias("body"),
        )
        lines = rows if lines is None else lines.unionByName(rows)
    return lines


def write_report(parts: dict[str, DataFrame], key: Sequence[str], path: str) -> None:
    report_lines(parts, key).write.mode("errorifexists").partitionBy("kind").json(path)
