"""Resumable import of what arrives: gated, deduplicated, idempotent by content hash.

``start_media_ingest`` imports files with all gates; ``start_ingest`` rows whose hash is a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelgate.operators.gates import require_empty
from reelgate.operators.lineage import dedup_by_hash
from reelgate.plans.ingestion import ingest
from reelgate.session import scratch

TABLES = ("results", "denials", "catalog")


def media_paths(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """Arriving media files (path, length, filename); contents are never part of a row."""
    endings = "|".join(s.lstrip(".") for s in suffixes)
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .load(root)
        .where(F.lower("path").rlike(rf"\.({endings})$"))
    )
    return files.select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))


def start_media_ingest(
    arrivals: DataFrame,
    folder: str,
    *,
    rights: DataFrame,
    exclusions: DataFrame,
    at: Column,
    catalog: DataFrame | None = None,
    assets: DataFrame | None = None,
    strict: bool = False,
) -> StreamingQuery:
    """Import arriving files of (artist_id, path, filename) as ``ingest`` does, batch by batch.

    Every batch passes the capability gate, exclusions by hash and by name and the artist's list of
    assets; files are hashed where they lie, whatever their size, and what passes is probed
    and gets its catalog row. What earlier batches imported, and ``catalog``, is known content.
    With ``strict`` a denied file stops the stream.

    A batch has its own directory in each of ``TABLES`` and is announced when all are written: a batch
    that is run again after a failure replaces its rows, and readers (``read_table``) see whole batches.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = read_table(session, folder, "catalog", before=batch_id)
        columns = ["artist_id", "song_id", "source_sha256"]
        known = [c.select(*columns) for c in (catalog, earlier) if c is not None]
        if not known:
            known = [session.createDataFrame([], ", ".join(f"{c} string" for c in columns))]
        everything = known[0] if len(known) == 1 else known[0].unionByName(known[1])
        with scratch(session):
            done = ingest(
                batch.select("artist_id", "path", "filename"), rights, exclusions, everything, at, assets=assets, strict=strict
            )
            for name in TABLES:
                getattr(done, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        session.range(1).write.mode("overwrite").parquet(f"{folder}/announced/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def read_table(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    """Rows of all announced batches (those before ``before``) of one of ``TABLES``; None without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/announced")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    announced = spark.read.parquet(f"{folder}/announced")
    if before is not None:
        announced = announced.where(F.col("batch") < before)
    # batches are announced in order, so the last one tells which are whole
    last = announced.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    return spark.read.parquet(f"{folder}/{name}").where(F.col("batch") <= last).drop("batch")


def start_ingest(
    arrivals: DataFrame,
    folder: str,
    *,
    order: Sequence[str],
    excluded: DataFrame,
    allowed: DataFrame | None,
    strict: bool = False,
) -> StreamingQuery:
    """Import every arrival once and record what became of it.

    Each batch writes its own directory below ``folder``, so a batch that is replayed after
    a failure replaces its rows instead of repeating them. A hash is imported by the first
    arrival in ``order`` and is a duplicate everywhere else. ``excluded`` (sha256, reason)
    and ``allowed`` (sha256; None allows all) gate every arrival; with ``strict`` a denied
    one stops the stream.
    """
    spark = arrivals.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rules = excluded.groupBy(F.col("sha256").alias("__x")).agg(F.min("reason").alias("reason"))
        judged = batch.join(rules, F.col("sha256") == F.col("__x"), "left").drop("__x")
        denial = F.when(F.col("reason").isNotNull(), F.col("reason"))
        if allowed is not None:
            known = allowed.select(F.col("sha256").alias("__a")).distinct()
            judged = judged.join(known, F.col("sha256") == F.col("__a"), "left")
            denial = F.coalesce(denial, F.when(F.col("__a").isNull(), F.lit("not allow-listed")))
            judged = judged.withColumn("reason", denial).drop("__a")
        passed = judged.where(F.col("reason").isNull())
        if strict:
            require_empty(judged.where(F.col("reason").isNotNull()), "denied source")
        earlier = _imported_before(session, folder, batch_id)
        fresh = dedup_by_hash(passed.select("sha256", *order), list(order))
        if earlier is not None:
            fresh = fresh.join(earlier, "sha256", "left_anti")
        first = fresh.select(*[F.col(c).alias(f"__f_{c}") for c in ["sha256", *order]])
        match = [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in ["sha256", *order]]
        landed = judged.join(first, match, "left").withColumn(
            "status",
            F.when(F.col("reason").isNotNull(), "denied")
            .when(F.col("__f_sha256").isNotNull(), "imported")
            .otherwise("duplicate"),
        )
        landed.drop(*first.columns).write.mode("overwrite").parquet(
            f"{folder}/landed/batch={batch_id}"
        )

    return (
        arrivals.writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _imported_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    if batch_id == 0:
        return None
    landed = spark.read.parquet(f"{folder}/landed")
    return landed.where(
        (F.col("batch") < batch_id) & (F.col("status") == "imported")
    ).select("sha256")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that arrived so far, with its status."""
    return spark.read.parquet(f"{folder}/landed")
