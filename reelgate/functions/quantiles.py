"""Exact interpolated quantiles per group, also for groups no single task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.operators.scan import Running, has_large_group, ordered_scan


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: dict[str, float],
    *,
    extras: dict[str, Column] | None = None,
    large: bool | None = None,
) -> DataFrame:
    """One row per key with the linearly interpolated quantiles of the non-null values.

    ``extras`` are further aggregates over ``df`` for the same keys; a key without values
    then still has a row. ``large`` tells whether a group may exceed what one task holds,
    where the caller knows; otherwise the groups are counted.

    Small groups use the ``percentile`` aggregate. Its buffer keeps every distinct value
    of a group, so a large group is counted per distinct value first and the ranks are read
    off a distributed running sum of those counts.
    """
    column = F.col(value) if isinstance(value, str) else value
    if large is None:
        large = has_large_group(df, keys)
    wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
    named = [F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
    if not large:
        more = [c.alias(name) for name, c in (extras or {}).items()]
        packed = df.withColumn("__v", column.cast("double"))
        if not extras:
            packed = packed.where(F.col("__v").isNotNull())
        packed = packed.groupBy(*keys).agg(F.percentile("__v", wanted).alias("__q"), *more)
        return packed.select(*keys, *named, *(extras or {}))
    if extras:
        found = exact_quantiles(df, keys, column, probs, large=True)
        rest = df.groupBy(*keys).agg(*[c.alias(name) for name, c in extras.items()])
        return rest.join(found, list(keys), "left").select(*keys, *probs, *extras)
    values = df.select(*keys, column.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = values.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_scan(
        counts, keys, ["__v"], {"__before": Running("sum_before", "__n")}, large=True
    )
    totals = ranked.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        match = [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys]
        totals = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__total")
        ranked = ranked.join(totals, match).drop(*[f"__t_{k}" for k in keys])
    else:
        ranked = ranked.withColumn("__total", totals.scalar())
    picks = []
    for i, p in enumerate(probs.values()):
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"__f{i}"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"__lo{i}") * (1 - F.col(f"__f{i}")) + F.col(f"__hi{i}") * F.col(f"__f{i}")
            ).alias(name)
            for i, name in enumerate(probs)
        ],
    )


def medians(
    df: DataFrame, columns: dict[str, Column], *, large: bool | None = None
) -> dict[str, float | None]:
    """Medians over the whole table, one number per column, from one pass where it fits."""
    if large is None:
        large = has_large_group(df, [])
    if large:
        return {
            name: exact_quantiles(df, [], column, {"q": 0.5}, large=True).first()["q"]
            for name, column in columns.items()
        }
    return df.agg(
        *[F.percentile(c.cast("double"), F.lit(0.5)).alias(n) for n, c in columns.items()]
    ).first().asDict()
