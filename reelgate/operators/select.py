"""Ranking and selection: references, candidates, roles, spaced top-k, splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.functions.scalars import finite
from reelgate.operators.scan import Running, has_large_group, ordered_scan
from reelgate.session import pinned

# The roles of a bank, in order of priority.
ROLES = ("neutral", "soft", "strong", "low", "high")


def rank_references(
    phrases: DataFrame,
    references: DataFrame,
    *,
    owner: str = "artist_id",
    phrase: Sequence[str] = ("series_id", "phrase_idx"),
    best_only: bool = False,
) -> DataFrame:
    """Order an artist's references for each phrase by register and level.

    ``phrases``: owner, phrase keys, target_pitch (null when unvoiced), target_level_db.
    ``references``: owner, reference_id, review_status, median_f0_hz, f0_p05_hz, f0_p95_hz,
    active_rms_dbfs. The references are an artist's bank, one row per role.
    """
    usable = (F.col("review_status") == "approved") & F.col("median_f0_hz").isNotNull()
    marked = references.withColumn("__usable", F.coalesce(usable, F.lit(False)))
    if not has_large_group(references, [owner]):
        return _rank_in_banks(phrases, marked, owner, phrase, best_only)
    counts = marked.groupBy(owner).agg(
        F.count(F.lit(1)).alias("__refs"), F.sum(F.col("__usable").cast("long")).alias("__good")
    )
    bank = marked.join(counts, owner)
    pairs = phrases.join(bank, owner)
    pitch = F.col("target_pitch")
    score = _distance(pitch, F.col("target_level_db"), F.col)
    by_id = (F.col("__refs") == 1) | pitch.isNull() | (F.col("__good") == 0)
    scored = (
        pairs.where(by_id | F.col("__usable"))
        .withColumn("score", F.when(~by_id, score))
        .select(owner, *phrase, "reference_id", "score")
    )
    if best_only:
        order = F.struct(F.coalesce("score", F.lit(0.0)), F.col("reference_id"))
        return scored.groupBy(owner, *phrase).agg(
            F.min_by("reference_id", order).alias("reference_id"),
            F.min_by("score", order).alias("score"),
        )
    return ordered_scan(
        scored, [owner, *phrase], ["score", "reference_id"], {"rank": Running("ordinal")}
    ).withColumn("rank", F.col("rank") + 1)


def _distance(pitch: Column, level: Column, of: Callable[[str], Column]) -> Column:
    """How far a reference (``of`` names its measures) is from a phrase in register and level."""

    def away(reference: str) -> Column:
        return F.abs(1200 * F.log2(pitch / of(reference))) / 600

    outside = (
        F.when(pitch < of("f0_p05_hz"), away("f0_p05_hz"))
        .when(pitch > of("f0_p95_hz"), away("f0_p95_hz"))
        .otherwise(F.lit(0.0))
    )
    return away("median_f0_hz") + 0.35 * (F.abs(level - of("active_rms_dbfs")) / 12) + outside


def _rank_in_banks(
    phrases: DataFrame, marked: DataFrame, owner: str, phrase: Sequence[str], best_only: bool
) -> DataFrame:
    """The ranking where every bank fits a row: references are scored and sorted beside their phrase.

    Pairs of phrase and reference exist one phrase at a time, so a task holds no artist's pairs.
    """
    measures = ["median_f0_hz", "f0_p05_hz", "f0_p95_hz", "active_rms_dbfs"]
    banks = marked.groupBy(owner).agg(
        F.collect_list(F.struct("reference_id", *measures, "__usable")).alias("__bank"),
        F.sum(F.col("__usable").cast("long")).alias("__good"),
    )
    # a phrase that is listed twice is ranked over both of its rows
    asked = phrases.groupBy(owner, *phrase).agg(
        F.collect_list(F.struct("target_pitch", "target_level_db")).alias("__asked")
    )

    def scored(target: Column) -> Column:
        pitch, level = target["target_pitch"], target["target_level_db"]
        by_id = (F.size("__bank") == 1) | pitch.isNull() | (F.col("__good") == 0)
        fit = F.filter("__bank", lambda r: by_id | r["__usable"])
        return F.transform(
            fit,
            lambda r: F.struct(
                F.when(~by_id, _distance(pitch, level, lambda name: r[name])).alias("score"),
                r["reference_id"].alias("reference_id"),
            ),
        )

    ranked = asked.join(banks, owner).withColumn("__fit", F.flatten(F.transform("__asked", scored)))
    if best_only:
        best = F.array_min(
            F.transform(
                "__fit",
                lambda r: F.struct(F.coalesce(r["score"], F.lit(0.0)).alias("o"), r["reference_id"].alias("id"), r["score"].alias("score")),
            )
        )
        ranked = ranked.withColumn("__best", best)
        return ranked.select(
            owner, *phrase, F.col("__best.id").alias("reference_id"), F.col("__best.score").alias("score")
        )
    return ranked.select(owner, *phrase, F.posexplode(F.sort_array("__fit")).alias("__at", "__r")).select(
        owner, *phrase, "__r.reference_id", "__r.score", (F.col("__at") + 1).cast("long").alias("rank")
    )


def _or_minus_one(*columns: str) -> Column:
    """First known value, -1 without one; NaN counts as unknown and never as the best."""
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    return F.coalesce(*known, F.lit(-1.0))


def _least_known(*columns: str) -> list[Column]:
    """Smallest first; what was not measured (null or NaN) never beats a measurement."""
    return [F.col(c).asc_nulls_last() for c in columns]


def identity_order() -> list[Column]:
    """Strongest worst window first, among those that pass every gate."""
    return [
        F.col("passed").desc(),
        _or_minus_one("minimum_window_identity_similarity", "identity_similarity").desc(),
        _or_minus_one("mean_window_identity_similarity").desc(),
        _or_minus_one("identity_similarity").desc(),
        _or_minus_one("reference_identity_similarity").desc(),
        *_least_known("sustained_dropout_count", "dropout_fraction"),
        *_least_known("spectral_distance_db", "peak_reduction_db"),
        F.col("candidate_index").asc(),
    ]


def continuity_order() -> list[Column]:
    """Fewest dropouts first, then pitch, spectrum and peak."""
    return [
        F.col("passed").desc(),
        *_least_known("sustained_dropout_count", "dropout_fraction"),
        *_least_known("f0_gross_error_fraction", "f0_median_error_cents"),
        *_least_known("spectral_distance_db", "peak_reduction_db"),
        F.col("candidate_index").asc(),
    ]


def select_candidate(
    candidates: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """Best candidate per phrase; ``phrase_failed`` where even that one did not pass."""
    best = Window.partitionBy(*keys).orderBy(*(order or identity_order()))
    return (
        candidates.withColumn("__rn", F.row_number().over(best))
        .where("__rn = 1")
        .drop("__rn")
        .withColumn("phrase_failed", ~F.coalesce(F.col("passed"), F.lit(False)))
    )


def candidate_passes(
    candidates: DataFrame,
    threshold: Column | float,
    *,
    median_cents: float = 50.0,
    gross: float = 0.05,
    peak: float = 4.0,
) -> DataFrame:
    """Set ``passed`` from every gate; null, NaN and infinite measurements fail."""
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    window = "minimum_window_identity_similarity"
    checks = [
        finite("identity_similarity"),
        finite(window) & (F.col(window) >= threshold),
        F.col("sustained_dropout_count") == 0,
        finite("raw_peak") & (F.col("raw_peak") > 0) & (F.col("raw_peak") <= peak),
        finite("f0_median_error_cents") & (F.col("f0_median_error_cents") <= median_cents),
        finite("f0_gross_error_fraction") & (F.col("f0_gross_error_fraction") < gross),
    ]
    passed = F.lit(True)
    for check in checks:
        passed = passed & F.coalesce(check, F.lit(False))
    return candidates.withColumn("passed", passed)


def candidate_passes_continuity(candidates: DataFrame) -> DataFrame:
    """The looser gate: no dropouts, peak up to 4, pitch within 100 cents and 20 percent."""
    checks = [
        F.col("sustained_dropout_count") == 0,
        finite("raw_peak") & (F.col("raw_peak") <= 4.0),
        finite("f0_median_error_cents") & (F.col("f0_median_error_cents") <= 100),
        finite("f0_gross_error_fraction") & (F.col("f0_gross_error_fraction") <= 0.20),
    ]
    passed = F.lit(True)
    for check in checks:
        passed = passed & F.coalesce(check, F.lit(False))
    return candidates.withColumn("passed", passed)


def retry_order(
    records: DataFrame, fallback: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """References to retry per phrase, each once: continuity-safe, identity-strong, fallback.

    A reference's place in a ranked list is that of its best record, so each list reduces to
    one minimum per reference; a similarity that is not known counts as -1 and comes last.
    ``records``: keys, reference_id, candidate measurements; ``fallback``: keys, reference_id, position.
    """
    worst = -_or_minus_one("minimum_window_identity_similarity")
    mean = -_or_minus_one("mean_window_identity_similarity")
    dropouts = F.coalesce(F.col("sustained_dropout_count").cast("long"), F.lit(2**63 - 1))
    gross = F.coalesce(F.col("f0_gross_error_fraction").cast("double"), F.lit(float("inf")))
    safe = F.when(
        F.col("sustained_dropout_count") == 0,
        F.struct(
            worst.alias("a"),
            mean.alias("b"),
            F.lit(0).cast("long").alias("c"),
            F.lit(0.0).alias("d"),
            F.col("candidate_index").cast("long").alias("e"),
        ),
    )
    strong = F.struct(
        worst.alias("a"),
        mean.alias("b"),
        dropouts.alias("c"),
        gross.alias("d"),
        F.col("candidate_index").cast("long").alias("e"),
    )
    seen = records.groupBy(*keys, "reference_id").agg(
        F.min(safe).alias("__safe"), F.min(strong).alias("__strong")
    )
    ranked = seen.select(
        *keys,
        "reference_id",
        F.when(F.col("__safe").isNotNull(), 0).otherwise(1).alias("__list"),
        F.coalesce("__safe", "__strong").alias("__place"),
    )
    last = fallback.select(
        *keys,
        "reference_id",
        F.lit(2).alias("__list"),
        F.struct(
            F.col("position").cast("double").alias("a"),
            F.lit(0.0).alias("b"),
            F.lit(0).cast("long").alias("c"),
            F.lit(0.0).alias("d"),
            F.lit(0).cast("long").alias("e"),
        ).alias("__place"),
    )
    # stored, as the scan counts the groups before it orders them
    every = pinned(
        ranked.unionByName(last)
        .groupBy(*keys, "reference_id")
        .agg(F.min(F.struct("__list", "__place")).alias("__best"))
    )
    ordered = ordered_scan(
        every, keys, ["__best", "reference_id"], {"position": Running("ordinal")}
    )
    return ordered.drop("__best")


def retry_budget(
    candidates: DataFrame,
    keys: Sequence[str],
    *,
    initial: int = 5,
    maximum: int = 15,
    needed: int = 2,
) -> DataFrame:
    """Attempts used per phrase: up to the needed passes, at least ``initial``.

    Only the ``needed`` earliest passing attempts of a phrase decide that.
    """
    early = Window.partitionBy(*keys).orderBy("candidate_index")
    passes = (
        candidates.where(F.col("passed") & (F.col("candidate_index") < maximum))
        .withColumn("__rn", F.row_number().over(early))
        .where(F.col("__rn") <= needed)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__passes"),
            F.max("candidate_index").alias("__last"),
        )
    )
    enough = F.coalesce(F.col("__passes") >= needed, F.lit(False))
    used = F.when(enough, F.greatest(F.col("__last") + 1, F.lit(initial))).otherwise(maximum)
    return (
        candidates.select(*keys)
        .distinct()
        .join(passes, list(keys), "left")
        .select(*keys, used.cast("long").alias("attempts"), enough.alias("enough"))
    )


def role_scores(
    candidates: DataFrame,
    *,
    pitch: str = "median_f0_hz",
    level: str = "active_rms_dbfs",
    voiced: str = "voiced_fraction",
    level_range: str = "one_second_level_range_db",
) -> DataFrame:
    """Add one score column per role, from pitch and level scaled over all candidates."""
    bounds = candidates.agg(
        F.struct(
            F.min(pitch).alias("p0"),
            F.max(pitch).alias("p1"),
            F.min(level).alias("l0"),
            F.max(level).alias("l1"),
        ).alias("b")
    ).scalar()

    def scaled(value: str, low: Column, high: Column) -> Column:
        return (F.col(value) - low) / F.greatest(high - low, F.lit(1e-6))

    placed = candidates.withColumn("__b", bounds)
    placed = placed.withColumn("__p", scaled(pitch, F.col("__b.p0"), F.col("__b.p1"))).withColumn(
        "__l", scaled(level, F.col("__b.l0"), F.col("__b.l1"))
    )
    p, l = F.col("__p"), F.col("__l")
    mid_p, mid_l = F.abs(p - 0.5), F.abs(l - 0.5)
    quality = F.abs(F.col(voiced) - 0.85) + F.col(level_range) / 12
    formulas = {
        "neutral": mid_p + mid_l,
        "soft": l + 0.5 * mid_p,
        "strong": 1 - l + 0.5 * mid_p,
        "low": p + 0.25 * mid_l,
        "high": 1 - p + 0.25 * mid_l,
    }
    for role, formula in formulas.items():
        placed = placed.withColumn(f"score_{role}", formula + 0.2 * quality)
    return placed.drop("__b", "__p", "__l")


def assign_roles(
    scored: DataFrame,
    roles: Sequence[str] = ROLES,
    *,
    song: str = "song_id",
    start: str = "start_seconds",
) -> DataFrame:
    """Give each role, in order, the best candidate of a song no earlier role took.

    Earlier roles occupy fewer songs than there are roles, so the best candidate of the
    first ``len(roles)`` songs per role is all the greedy choice can ever look at: a table
    of at most len(roles) squared rows, whatever the number of candidates.
    """
    best = scored.groupBy(song).agg(
        *[F.min(F.struct(f"score_{r}", start)).alias(r) for r in roles]
    )
    entries = best.select(
        song,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("role_idx"),
                        F.col(f"{r}.score_{r}").alias("score"),
                        F.col(f"{r}.{start}").alias("at"),
                    )
                    for i, r in enumerate(roles)
                ]
            )
        ).alias("e"),
    ).select(song, "e.*")
    front = Window.partitionBy("role_idx").orderBy("score", song, "at")
    shortlist = (
        entries.withColumn("rank", F.row_number().over(front))
        .where(F.col("rank") <= len(roles))
        .groupBy("role_idx")
        .agg(F.sort_array(F.collect_list(F.struct("score", song, "at"))).alias("songs"))
        .agg(F.sort_array(F.collect_list(F.struct("role_idx", "songs"))).alias("roles"))
    )
    empty = F.array().cast(f"array<struct<role_idx:int,song:{dict(scored.dtypes)[song]},"
                           "score:double,at:double>>")

    def take(chosen: Column, role: Column) -> Column:
        free = F.filter(
            role["songs"], lambda s: ~F.exists(chosen, lambda c: c["song"] == s[song])
        )
        pick = F.coalesce(F.get(free, 0), role["songs"][0])
        return F.array_append(
            chosen,
            F.struct(
                role["role_idx"].alias("role_idx"),
                pick[song].alias("song"),
                pick["score"].cast("double").alias("score"),
                pick["at"].cast("double").alias("at"),
            ),
        )

    chosen = shortlist.select(F.explode(F.aggregate("roles", empty, take)).alias("c"))
    names = F.array(*[F.lit(r) for r in roles])
    return chosen.select(
        F.get(names, F.col("c.role_idx")).alias("role"),
        F.col("c.song").alias(song),
        F.col("c.at").alias(start),
        F.col("c.score").alias("score"),
    )


#: Rows per key that the bounded way of ``non_overlapping_topk`` may gather.
FOLDED_ROWS = 1_000
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def non_overlapping_topk(
    candidates: DataFrame,
    k: int,
    spacing: float,
    *,
    key: Sequence[str] = ("song_id",),
    score: Sequence[str] = ("score",),
    start: str = "start_seconds",
) -> DataFrame:
    """Greedy best-first choice of up to k rows per key whose starts lie ``spacing`` apart.

    Rows with equal starts exclude each other, so each start keeps its best row. Where starts
    are whole numbers, one choice then rules out at most 2 * spacing - 1 rows, the k-th choice is
    among the first (k - 1) * (2 * spacing - 1) + 1 by score, and only those are folded.
    Otherwise, or where that is too many, the choice takes k rounds, each a map-combined minimum
    per key followed by removing its neighbours. Both ways give the same rows.
    """
    key = list(key)
    columns = candidates.columns
    order = [*score, start]
    rest = [c for c in columns if c not in key]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    best = candidates.groupBy(*key, F.col(start).alias("__start")).agg(F.min(packed).alias("__x"))
    best = best.where(F.col("__start").isNotNull()).drop("__start")
    reach = (k - 1) * max(2 * math.ceil(spacing) - 1, 1) + 1
    if dict(candidates.dtypes)[start] not in _INTEGERS or reach > FOLDED_ROWS:
        return _topk_rounds(best, k, spacing, key, start, columns)
    front = Window.partitionBy(*key).orderBy("__x")
    few = (
        best.withColumn("__rn", F.row_number().over(front))
        .where(F.col("__rn") <= reach)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("__x")).alias("__c"))
    )

    def take(chosen: Column, c: Column) -> Column:
        fits = (F.size(chosen) < k) & F.forall(
            chosen, lambda x: F.abs(x[start] - c[start]) >= spacing
        )
        return F.when(fits, F.array_append(chosen, c)).otherwise(chosen)

    chosen = F.aggregate("__c", F.slice("__c", 1, 0), take)
    return _unpacked(few.select(*key, F.explode(chosen).alias("__x")), key, columns)


def _unpacked(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in key else F.col(f"__x.{c}").alias(c) for c in columns])


def _topk_rounds(
    best: DataFrame, k: int, spacing: float, key: list[str], start: str, columns: list[str]
) -> DataFrame:
    left, chosen = pinned(best), None
    for i in range(k):
        first = pinned(left.groupBy(*key).agg(F.min("__x").alias("__x")))
        taken = _unpacked(first, key, columns)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        if i + 1 < k:
            apart = F.abs(F.col(f"__x.{start}") - F.col("__at")) >= spacing
            at = first.select(*key, F.col(f"__x.{start}").alias("__at"))
            left = left.join(at, key).where(apart).drop("__at")
    return chosen


def train_validation_split(
    selected: DataFrame, *, key: Sequence[str] = ("song_id",), start: str = "start_seconds"
) -> DataFrame:
    """Add ``split`` and ``segment_idx``: the latest of several excerpts validates.

    ``selected`` holds the few excerpts per key that ``non_overlapping_topk`` kept.
    """
    group = Window.partitionBy(*key)
    order = group.orderBy(start)
    marked = selected.withColumn("__rn", F.row_number().over(order)).withColumn(
        "__n", F.count(F.lit(1)).over(group)
    )
    last = (F.col("__n") > 1) & (F.col("__rn") == F.col("__n"))
    return (
        marked.withColumn("split", F.when(last, "validation").otherwise("train"))
        .withColumn("segment_idx", F.when(last, 0).otherwise(F.col("__rn") - 1))
        .drop("__rn", "__n")
    )


def role_of(reference_id: str, tags: str, roles: Sequence[str] = ROLES) -> Column:
    """First role, by priority, that is the reference's id or one of its tags."""
    found = F.lit(None).cast("string")
    for role in reversed(roles):
        named = (F.col(reference_id) == role) | F.coalesce(
            F.array_contains(tags, role), F.lit(False)
        )
        found = F.when(named, F.lit(role)).otherwise(found)
    return found


def reconcile_bank(
    references: DataFrame,
    excluded_sources: DataFrame,
    excluded_songs: DataFrame,
    current_stems: DataFrame,
    quality: Column,
    *,
    owner: Sequence[str] = ("artist_id",),
    roles: Sequence[str] = ROLES,
    clean_tag: str = "clean-vocal-stem",
) -> tuple[DataFrame, DataFrame]:
    """Decide keep, reject or skip for every reference, and list the roles left open.

    ``references``: owner, reference_id, tags, review_status, source_song_id,
    source_stem_sha256, parent_source_sha256 and metrics. ``quality`` may be null where a
    reference was never measured.
    """
    owner = list(owner)

    def known(table: DataFrame, column: str, name: str) -> DataFrame:
        return table.select(F.col(column).alias(name)).distinct()

    joined = (
        references.join(
            known(excluded_sources, "sha256", "__xs"), F.col("parent_source_sha256") == F.col("__xs"), "left"
        )
        .join(known(excluded_songs, "song_id", "__xg"), F.col("source_song_id") == F.col("__xg"), "left")
        .join(
            known(current_stems, "sha256", "__cs"), F.col("source_stem_sha256") == F.col("__cs"), "left"
        )
    )
    clean = F.coalesce(F.array_contains("tags", clean_tag), F.lit(False))
    gone = (
        F.col("__xs").isNotNull()
        | F.col("__xg").isNotNull()
        | (clean & F.col("__cs").isNull())
    )
    approved = F.col("review_status").eqNullSafe("approved")
    verdict = (
        F.when(F.col("role").isNull(), "ignored")
        .when(gone & approved, "reject")
        .when(gone, "skip")
        .when(approved & F.coalesce(quality, F.lit(False)) & clean, "eligible")
        .when(approved & (quality == F.lit(False)), "reject")
        .otherwise("skip")
    )
    judged = (
        joined.withColumn("role", role_of("reference_id", "tags", roles))
        .withColumn("__verdict", verdict)
        .select(*owner, "reference_id", "role", "__verdict")
    )
    first = (
        judged.where(F.col("__verdict") == "eligible")
        .groupBy(*owner, "role")
        .agg(F.min("reference_id").alias("__first"))
    )
    decided = judged.join(first, [*owner, "role"], "left").select(
        *owner,
        "reference_id",
        "role",
        F.when(F.col("__verdict") != "eligible", F.col("__verdict"))
        .when(F.col("reference_id") == F.col("__first"), "keep")
        .otherwise("spare")
        .alias("decision"),
    )
    wanted = references.select(*owner).distinct().select(
        *owner, F.explode(F.array(*[F.lit(r) for r in roles])).alias("role")
    )
    missing = wanted.join(first.select(*owner, "role"), [*owner, "role"], "left_anti")
    return decided, missing


def next_revision(
    wanted: DataFrame, existing: DataFrame, *, owner: Sequence[str] = (), role: str = "role"
) -> DataFrame:
    """Smallest free reference id per role: the role itself, else role-v2, role-v3, ..."""
    owner = list(owner)
    number = F.regexp_extract("reference_id", r"-v([1-9][0-9]*)$", 1)
    used = existing.select(
        *owner,
        F.when(number != "", F.regexp_replace("reference_id", r"-v[1-9][0-9]*$", "")).alias("base"),
        F.when(number != "", number).cast("long").alias("n"),
        "reference_id",
    )
    plain = used.select(*owner, F.col("reference_id").alias(role), F.lit(True).alias("__taken"))
    numbered = used.where(F.col("n") >= 2).select(*owner, F.col("base").alias(role), "n").distinct()
    # the free numbers a role can need first: 2, or the successor of a used one
    after = numbered.select(*owner, role, (F.col("n") + 1).alias("n"))
    start = wanted.select(*owner, role, F.lit(2).cast("long").alias("n"))
    free = (
        start.unionByName(after)
        .join(numbered, [*owner, role, "n"], "left_anti")
        .groupBy(*owner, role)
        .agg(F.min("n").alias("__n"))
    )
    return (
        wanted.join(plain.distinct(), [*owner, role], "left")
        .join(free, [*owner, role], "left")
        .select(
            *owner,
            role,
            F.when(F.col("__taken").isNull(), F.col(role))
            .otherwise(F.concat(F.col(role), F.lit("-v"), F.col("__n").cast("string")))
            .alias("reference_id"),
        )
    )


def rank_songs(scored: DataFrame, score: str = "upbeat_score", key: str = "song_id") -> DataFrame:
    return scored.orderBy(F.col(score).desc(), F.col(key).asc())
