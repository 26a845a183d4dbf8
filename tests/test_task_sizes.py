"""What one task holds stays bounded as tables grow."""

from pyspark.sql import functions as F

from reelgate.operators import select
from reelgate.operators.scan import by_rows


def test_parts_follow_the_rows(spark):
    spark.conf.set("reelgate.groupRows", "100")
    try:
        assert by_rows(spark.range(5_000), "id").rdd.getNumPartitions() == 50
    finally:
        spark.conf.unset("reelgate.groupRows")


def _bank(spark):
    references = spark.createDataFrame(
        [
            ("a", "low", "approved", 140.0, 112.0, 168.0, -30.0),
            ("a", "mid", "approved", 220.0, 176.0, 264.0, -24.0),
            ("a", "off", "rejected", 330.0, 264.0, 396.0, -24.0),
            ("a", "none", "approved", None, None, None, None),
            ("b", "only", None, 200.0, 160.0, 240.0, -20.0),
            ("c", "y", "rejected", 200.0, 160.0, 240.0, -20.0),
            ("c", "x", "rejected", 210.0, 160.0, 240.0, -20.0),
        ],
        "artist_id string, reference_id string, review_status string, median_f0_hz double, f0_p05_hz double, f0_p95_hz double, active_rms_dbfs double",
    )
    phrases = spark.createDataFrame(
        [("a", 1, 230.0, -24.0), ("a", 2, None, -24.0), ("a", 3, 130.0, None), ("b", 4, 200.0, -20.0), ("c", 5, 200.0, -20.0),
         ("d", 6, 200.0, -20.0), ("a", 7, 150.0, -20.0), ("a", 7, 215.0, -20.0)],
        "artist_id string, p int, target_pitch double, target_level_db double",
    )
    return phrases, references


def test_ranks_are_the_same_whether_a_bank_fits_a_row(spark):
    phrases, references = _bank(spark)

    def ranked(best):
        out = select.rank_references(phrases, references, phrase=["p"], best_only=best)
        return out.dtypes, sorted(map(str, out.withColumn("score", F.round("score", 9)).collect()))

    for best in (False, True):
        inside = ranked(best)
        spark.conf.set("reelgate.groupRows", "1")
        try:
            assert ranked(best) == inside
        finally:
            spark.conf.unset("reelgate.groupRows")


def test_no_exchange_or_window_meets_pairs(spark):
    phrases, references = _bank(spark)
    for best in (False, True):
        plan = select.rank_references(phrases, references, phrase=["p"], best_only=best)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        above = text.split("Join")[0]
        assert "Window" not in above and "Aggregate" not in above
