"""Columns and small measures that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a regular expression class without its brackets (fixed values).
SPACE = r"\x20\x09-\x0D"
#: The same characters, for functions that take a list of characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where a join or window needs a key that is never null.
NO_ID = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one used inside."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return df.select(
        *[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns]
    )


def real_id(column: str) -> Column:
    """Null again where ``id_key`` put its stand-in.

    Ids pass through pandas as ``id_key``: a column with nulls would turn into doubles there, and
    ids beyond 2**53 would change.
    """
    return F.when(F.col(column) != NO_ID, F.col(column))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
