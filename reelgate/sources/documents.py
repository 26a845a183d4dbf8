"""Governance documents as tables: stem manifests (JSON), rights and policies (YAML)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgate import schemas


def read_stem_manifests(
    spark: SparkSession, glob: str, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stem manifests, and the documents that do not parse or carry no identity."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    wanted = schemas.STEMS if strict else f"{schemas.STEMS}, _corrupt_record string"
    documents = (
        spark.read.schema(wanted).option("multiLine", "true").option("mode", mode).json(glob)
    ).withColumn("path", F.input_file_name())
    if strict:
        documents = documents.withColumn("_corrupt_record", F.lit(None).cast("string"))
    identity = (
        F.col("_corrupt_record").isNull()
        & F.col("artist_id").isNotNull()
        & F.col("song_id").isNotNull()
    )
    good = documents.where(identity).drop("_corrupt_record")
    bad = documents.where(~identity).select(
        "path",
        F.when(F.col("_corrupt_record").isNotNull(), "corrupt document")
        .otherwise("missing identity")
        .alias("violation"),
    )
    return good, bad


def _yaml_to_json(series: pd.Series) -> pd.Series:
    import yaml

    def one(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text), default=str, sort_keys=True)
        except yaml.YAMLError:
            return None

    return series.map(one)


def read_yaml(
    spark: SparkSession, glob: str, schema: str
) -> tuple[DataFrame, DataFrame]:
    """YAML documents under an explicit schema, and those that are not valid YAML objects."""
    texts = spark.read.text(glob, wholetext=True).withColumn("path", F.input_file_name())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(body=_yaml_to_json(pdf["value"]))[["path", "body"]]

    bodies = texts.mapInPandas(run, "path string, body string")
    parsed = bodies.withColumn("d", F.from_json("body", schema))
    usable = F.col("body").startswith("{") & F.col("d").isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    good = parsed.where(usable).select("path", "d.*")
    bad = parsed.where(~usable).select("path", F.lit("invalid document").alias("violation"))
    return good, bad


def read_rights(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    return read_yaml(spark, glob, schemas.RIGHTS)


def read_catalog(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Catalog documents (artist_id, songs) as one row per song."""
    fields = ", ".join(
        f"{'id' if f.name == 'song_id' else f.name}: {f.dataType.simpleString()}"
        for f in schemas.struct_of(schemas.CATALOG).fields
        if f.name != "artist_id"
    )
    schema = f"schema_version int, artist_id string, songs array<struct<{fields}>>"
    documents, bad = read_yaml(spark, glob, schema)
    songs = documents.select("artist_id", F.explode("songs").alias("s"))
    return songs.select("artist_id", "s.*").withColumnRenamed("id", "song_id"), bad


def read_policy(
    spark: SparkSession, glob: str, artists: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Policy tables: defaults, sources, music, voice, intervals; and the invalid documents.

    An artist without a document gets the restrictive default: live recordings are rejected.
    """
    documents, bad = read_yaml(spark, glob, schemas.POLICY)
    defaults = (
        artists.select("artist_id")
        .distinct()
        .join(documents.select("artist_id", "reject_live_voice_recordings"), "artist_id", "left")
        .select(
            "artist_id",
            F.coalesce("reject_live_voice_recordings", F.lit(True)).alias("reject_live"),
        )
    )
    sources = documents.select(
        "artist_id", F.posexplode("source_exclusions").alias("pos", "e")
    ).select("artist_id", "pos", "e.*")
    music = documents.select("artist_id", F.explode("music_songs").alias("e")).select(
        "artist_id", "e.*"
    )
    songs = documents.select("artist_id", F.explode("voice_songs").alias("e")).select(
        "artist_id", "e.*"
    )
    intervals = songs.select(
        "artist_id", "song_id", F.explode("excluded_intervals").alias("i")
    ).select(
        "artist_id",
        "song_id",
        F.col("i.start_seconds").alias("start_s"),
        F.col("i.end_seconds").alias("end_s"),
        F.col("i.reason").alias("reason"),
    )
    tables = {
        "defaults": defaults,
        "sources": sources,
        "music": music,
        "voice": songs.drop("excluded_intervals"),
        "intervals": intervals,
    }
    return tables, bad
