"""Fingerprints, deduplication, lineage and integrity checks, run history folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.operators.scan import Running, ordered_scan

# The run stages and the transitions between them that are legal.
TRANSITIONS = {
    "created": ("music_generated", "failed"),
    "music_generated": ("vocals_separated", "mixed", "complete", "failed"),
    "vocals_separated": ("voice_converted", "failed"),
    "voice_converted": ("mixed", "failed"),
    "mixed": ("complete", "failed"),
    "complete": (),
    "failed": (),
}
FIRST_STAGE = "created"


def fingerprint(df: DataFrame, content: str, name: str = "sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(content), 256))


def dedup_by_hash(
    df: DataFrame, order: Sequence[Column | str], key: Sequence[str] = ("sha256",)
) -> DataFrame:
    """The first row per hash. Spark limits each map task to one row per hash first."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def id_collisions(df: DataFrame, key: str = "song_id", sha256: str = "sha256") -> DataFrame:
    """Ids that stand for more than one hash."""
    spread = df.groupBy(key).agg(F.min(sha256).alias("low"), F.max(sha256).alias("high"))
    return spread.where(F.col("low") != F.col("high")).select(key)


def attach_catalog(
    stems: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("artist_id", "song_id")
) -> DataFrame:
    return stems.join(catalog, list(keys))


def attach_title(dataset: DataFrame, catalog: DataFrame, key: str = "song_id") -> DataFrame:
    titles = catalog.select(F.col(key).alias("__tk"), F.col("title").alias("__title"))
    return (
        dataset.join(titles, F.col(key) == F.col("__tk"), "left")
        .withColumn("title", F.coalesce("__title", F.col(key).cast("string")))
        .drop("__tk", "__title")
    )


def lineage_check(
    children: DataFrame, parents: DataFrame, key: str, compared: Sequence[str]
) -> DataFrame:
    """Rows (key, violation, column) where a child disagrees with its parent."""
    side = parents.select(
        F.col(key).alias("__pk"), *[F.col(c).alias(f"__p_{c}") for c in compared]
    )
    joined = children.select(key, *compared).join(side, F.col(key) == F.col("__pk"), "left")
    problems = [
        F.when(F.col("__pk").isNull(), F.struct(F.lit("missing").alias("v"), F.lit("").alias("c")))
    ]
    for c in compared:
        kind = F.when(F.col(c).isNull(), "incomplete").when(
            ~F.col(c).eqNullSafe(F.col(f"__p_{c}")), "mismatch"
        )
        problems.append(
            F.when(
                F.col("__pk").isNotNull() & kind.isNotNull(),
                F.struct(kind.alias("v"), F.lit(c).alias("c")),
            )
        )
    exploded = joined.select(key, F.explode(F.array_compact(F.array(*problems))).alias("p"))
    return exploded.select(
        key, F.col("p.v").alias("violation"), F.col("p.c").alias("column_name")
    )


def integrity_check(
    recorded: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    *,
    null_recorded_passes: bool = False,
) -> DataFrame:
    """Add ``status`` to recorded (keys, sha256): ok, missing or mismatch."""
    side = actual.select(
        *[F.col(k).alias(f"__a_{k}") for k in keys],
        F.col("sha256").alias("__actual"),
        F.lit(True).alias("__present"),
    )
    match = [F.col(k) == F.col(f"__a_{k}") for k in keys]
    joined = recorded.join(side, match, "left")
    same = F.col("sha256").eqNullSafe(F.col("__actual"))
    if null_recorded_passes:
        same = same | F.col("sha256").isNull()
    status = (
        F.when(F.col("__present").isNull(), "missing").when(same, "ok").otherwise("mismatch")
    )
    return joined.withColumn("status", status).drop(
        "__actual", "__present", *[f"__a_{k}" for k in keys]
    )


def reconcile(
    requested: DataFrame,
    existing: DataFrame,
    key: str,
    *,
    lineage: Sequence[str],
    settings: dict[str, object],
    rebuild: bool = False,
) -> DataFrame:
    """Add ``decision`` to requested rows: create, reuse, rebuild or a refusal.

    ``requested`` has the key, ``output_exists`` and the lineage columns; ``existing`` the
    key, the lineage columns it was made from and its settings. ``settings`` maps a column
    to the default that stands in where it was not recorded.
    """
    side = existing.select(
        F.col(key).alias("__ek"),
        *[F.col(c).alias(f"__e_{c}") for c in lineage],
        *[F.col(c).alias(f"__e_{c}") for c in settings],
    )
    joined = requested.join(side, F.col(key) == F.col("__ek"), "left")
    same_source = F.lit(True)
    for c in lineage:
        same_source = same_source & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    same_settings = F.lit(True)
    for c, default in settings.items():
        recorded = F.col(f"__e_{c}")
        if default is not None:
            recorded = F.coalesce(recorded, F.lit(default))
        same_settings = same_settings & F.col(c).eqNullSafe(recorded)
    decision = (
        F.when(~F.col("output_exists"), "create")
        .when(F.col("__ek").isNull(), "refuse: untracked output")
        .when(~same_source, "refuse: lineage mismatch")
        .when(same_settings, "reuse")
        .otherwise("rebuild" if rebuild else "refuse: settings differ")
    )
    return joined.withColumn("decision", decision).drop(
        *[c for c in side.columns if c.startswith("__e")]
    )


def media_invariants(
    source: DataFrame, derived: DataFrame, key: str, *, tolerance: float | None = None
) -> DataFrame:
    """Violations between a source and what was derived from it.

    Both have sample_rate, channels, duration_seconds; ``derived`` also clipped and
    nonfinite counts. Without a ``tolerance`` durations may differ by one sample.
    """
    side = derived.select(
        F.col(key).alias("__dk"),
        *[
            F.col(c).alias(f"__d_{c}")
            for c in ("sample_rate", "channels", "duration_seconds", "clipped", "nonfinite")
        ],
    )
    joined = source.join(side, F.col(key) == F.col("__dk"))
    allowed = F.lit(tolerance) if tolerance is not None else F.try_divide(
        F.lit(1.0), F.col("sample_rate")
    )
    rules = {
        "sample_rate": F.col("sample_rate") == F.col("__d_sample_rate"),
        "channels": F.col("channels") == F.col("__d_channels"),
        "duration": F.abs(F.col("duration_seconds") - F.col("__d_duration_seconds")) <= allowed,
        "clipped": F.col("__d_clipped") == 0,
        "nonfinite": F.col("__d_nonfinite") == 0,
    }
    failed = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    return joined.select(key, F.array_compact(F.array(*failed)).alias("violations"))


def timing_spread(
    durations: DataFrame, key: str, *, tolerance: float = 0.05, duration: str = "duration_seconds"
) -> DataFrame:
    """Per key, whether all artifacts last equally long within the tolerance."""
    return durations.groupBy(key).agg(
        (F.max(duration) - F.min(duration)).alias("spread_seconds")
    ).withColumn("aligned", F.col("spread_seconds") <= tolerance)


def parent_child_runs(
    children: DataFrame, parents: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Per child run and artifact, whether the parent kept the hash the child recorded.

    ``children``: run_id, parent_run_id. ``parents``: run_id, stage. ``artifacts``: run_id,
    name, recorded_parent_sha256 (for children) and sha256 (actual).
    """
    expected = artifacts.where(F.col("recorded_parent_sha256").isNotNull()).select(
        "run_id", "name", F.col("recorded_parent_sha256").alias("expected")
    )
    actual = artifacts.select(
        F.col("run_id").alias("parent_run_id"), "name", F.col("sha256").alias("actual")
    )
    stage = parents.select(F.col("run_id").alias("parent_run_id"), F.col("stage"))
    joined = (
        children.select("run_id", "parent_run_id")
        .join(stage, "parent_run_id", "left")
        .join(expected, "run_id", "left")
        .join(actual, ["parent_run_id", "name"], "left")
    )
    return joined.select(
        "run_id",
        "parent_run_id",
        "name",
        (F.col("stage").eqNullSafe("complete")).alias("parent_complete"),
        (~F.col("expected").eqNullSafe(F.col("actual"))).alias("changed"),
    )


def changed_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, name, sha256) triples recorded before that no longer hold."""
    columns = ["run_id", "name", "sha256"]
    return before.select(*columns).exceptAll(after.select(*columns))


def segments_without_source(
    segments: DataFrame, sources: DataFrame, key: str = "song_id"
) -> DataFrame:
    return segments.join(sources.select(key), key, "left_anti")


def stale_policy(datasets: DataFrame, policy_sha256: Column) -> DataFrame:
    """Datasets prepared under another policy; no policy at all is a policy of its own."""
    return datasets.where(~F.col("dataset_policy_sha256").eqNullSafe(policy_sha256))


def allow_join(files: DataFrame, catalog: DataFrame, sha256: str = "sha256") -> DataFrame:
    """Add ``status`` (duplicate or imported) and the id under which a hash is known."""
    known = catalog.groupBy(F.col("source_sha256").alias("__ks")).agg(
        F.min("song_id").alias("known_song_id")
    )
    return (
        files.join(known, F.col(sha256) == F.col("__ks"), "left")
        .withColumn("status", F.when(F.col("__ks").isNotNull(), "duplicate").otherwise("imported"))
        .drop("__ks")
    )


def remove_hashes(df: DataFrame, denied: DataFrame, key: str = "source_sha256") -> DataFrame:
    return df.join(denied.select(key), key, "left_anti")


def latest_artifacts(
    events: DataFrame, maps: str = "artifacts", key: str = "run_id", order: str = "sequence"
) -> DataFrame:
    """Last writer per (run, name), as rows rather than one map per run."""
    entries = events.select(key, order, F.explode(maps).alias("name", "value"))
    return entries.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))


def tree_digest(files: DataFrame, root: str = "root", depths: Sequence[int] = (6, 3)) -> DataFrame:
    """One digest per directory of (relative path, hash) rows.

    Files fall into leaves by the leading hex digits of their path's hash and the digests
    are folded upwards, at most 4,096 children at a time: a directory of any size is
    digested without ever being collected into one row.
    """
    leaves = files.select(
        root,
        F.sha2("rel_path", 256).alias("__place"),
        F.concat_ws("\n", "rel_path", "sha256").alias("__entry"),
    )
    level = leaves.groupBy(root, F.substring("__place", 1, depths[0]).alias("__place")).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("__entry"))), 256).alias("__digest"),
        F.count(F.lit(1)).alias("__files"),
    )
    for depth in [*depths[1:], 0]:
        level = level.groupBy(
            root, F.substring("__place", 1, depth).alias("__place")
        ).agg(
            F.sha2(
                F.concat_ws(
                    "\n",
                    F.sort_array(F.collect_list(F.concat_ws("\n", "__place", "__digest"))),
                ),
                256,
            ).alias("__digest"),
            F.sum("__files").alias("__files"),
        )
    return level.select(
        root, F.col("__digest").alias("digest"), F.col("__files").alias("n_files")
    )


def legal_transitions(
    events: DataFrame,
    *,
    key: str = "run_id",
    order: str = "sequence",
    stage: str = "stage",
    allowed: dict[str, Sequence[str]] | None = None,
    first: str | Sequence[str] = FIRST_STAGE,
    large: bool | None = None,
) -> DataFrame:
    """Add ``previous_stage`` and ``violation`` to run events.

    The first event must be a first stage, the sequence dense from zero, and each step one
    of the allowed pairs; a stage without successors is final.
    """
    table = TRANSITIONS if allowed is None else allowed
    starts = [first] if isinstance(first, str) else list(first)
    pairs = [f"{a}>{b}" for a, followers in table.items() for b in followers]
    scanned = ordered_scan(
        events,
        [key],
        [order],
        {
            "__position": Running("ordinal"),
            "previous_stage": Running("lag", stage),
        },
        large=large,
    )
    step = F.concat_ws(">", "previous_stage", stage)
    violation = (
        F.when(F.col(order) != F.col("__position"), "sequence gap")
        .when(
            F.col("previous_stage").isNull() & ~F.col(stage).isin(*starts), "illegal first stage"
        )
        .when(F.col("previous_stage").isNotNull() & ~step.isin(*pairs), "illegal transition")
    )
    return scanned.withColumn("violation", violation).drop("__position")


def run_status(events: DataFrame, key: str = "run_id", order: str = "sequence") -> DataFrame:
    """Current state per run: last stage, event count, first and last instant."""
    return events.groupBy(key).agg(
        F.max_by("stage", order).alias("stage"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("occurred_at").alias("created_at"),
        F.max("occurred_at").alias("updated_at"),
    )


def list_runs(
    runs: DataFrame, artist_id: object | None = None, key: str = "run_id", owner: str = "artist_id"
) -> DataFrame:
    """Newest first; run ids sort by time."""
    if artist_id is not None:
        runs = runs.where(F.col(owner) == artist_id)
    return runs.orderBy(F.col(key).desc())


def provenance_records(
    runs: DataFrame, references: DataFrame, reports: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Provenance as a header row per run and one row per recorded hash.

    ``runs``: run_id, artist_id, prompt, lyrics_sha256, seed, parent_run_id, output_sha256.
    ``references``: run_id, reference_id, audio_sha256, f0_sha256, stem_sha256?,
    source_sha256, parent_source_sha256?. ``reports``: run_id, name, sha256.
    """
    source = F.coalesce("parent_source_sha256", "source_sha256")
    first = F.min(
        F.struct(
            "reference_id",
            F.col("audio_sha256").alias("voice_reference_sha256"),
            source.alias("voice_source_sha256"),
            F.col("f0_sha256").alias("voice_reference_f0_sha256"),
        )
    )
    lead = references.groupBy("run_id").agg(
        first.alias("lead"), F.count(F.lit(1)).alias("n_references")
    )
    header = (
        runs.join(lead, "run_id", "left")
        .select(
            *runs.columns,
            F.col("lead.reference_id").alias("voice_reference_id"),
            F.col("lead.voice_reference_sha256").alias("voice_reference_sha256"),
            F.col("lead.voice_source_sha256").alias("voice_source_sha256"),
            F.col("lead.voice_reference_f0_sha256").alias("voice_reference_f0_sha256"),
            F.coalesce("n_references", F.lit(0)).alias("n_references"),
        )
        .withColumn("ai_assisted", F.lit(True))
        .withColumn("release_approved", F.lit(False))
    )
    kinds = {
        "voice_reference_hashes": F.col("audio_sha256"),
        "voice_reference_f0_hashes": F.col("f0_sha256"),
        "voice_reference_stem_hashes": F.col("stem_sha256"),
        "voice_source_hashes": source,
    }
    entries = references.select(
        "run_id",
        F.col("reference_id").alias("name"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), value.alias("sha256"))
                    for kind, value in kinds.items()
                ]
            )
        ).alias("e"),
    ).select("run_id", F.col("e.kind").alias("kind"), "name", F.col("e.sha256").alias("sha256"))
    reported = reports.select("run_id", F.lit("reports").alias("kind"), "name", "sha256")
    hashes = entries.unionByName(reported).where(F.col("sha256").isNotNull())
    return header, hashes


def newest_checkpoint(
    files: DataFrame, target_epochs: int, key: str = "training_id"
) -> DataFrame:
    """Per training the newest complete checkpoint below the target; a final model refuses.

    ``files``: key, path relative to the output folder. A checkpoint is complete with its
    training state, adapter configuration and an adapter model.
    """
    path = F.col("path")
    name = F.regexp_extract(path, r"^checkpoints/(epoch_\d+_loss_[^/]+)/", 1)
    epoch = F.regexp_extract(path, r"^checkpoints/epoch_(\d+)_loss_[^/]+/", 1)
    parts = files.select(
        key,
        F.when(name != "", name).alias("checkpoint"),
        F.when(epoch != "", epoch).cast("long").alias("epoch"),
        path.rlike(r"^final/").alias("is_final"),
        path.rlike(r"^checkpoints/[^/]+/training_state\.pt$").alias("has_state"),
        path.rlike(r"^checkpoints/[^/]+/adapter/adapter_config\.json$").alias("has_config"),
        path.rlike(r"^checkpoints/[^/]+/adapter/adapter_model\.[^/]*$").alias("has_model"),
    )
    per = parts.groupBy(key, "checkpoint", "epoch").agg(
        F.max("is_final").alias("is_final"),
        (F.max("has_state") & F.max("has_config") & F.max("has_model")).alias("complete"),
    )
    usable = F.col("complete") & (F.col("epoch") < target_epochs)
    best = per.groupBy(key).agg(
        F.max("is_final").alias("has_final"),
        F.max(
            F.when(usable, F.struct("epoch", "checkpoint"))
        ).alias("best"),
    )
    return best.select(
        key,
        F.when(~F.col("has_final"), F.col("best.checkpoint")).alias("checkpoint"),
        F.when(~F.col("has_final"), F.col("best.epoch")).alias("epoch"),
        F.when(F.col("has_final"), "already final")
        .when(F.col("best").isNull(), "no complete checkpoint")
        .alias("refusal"),
    )
