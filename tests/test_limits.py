"""Values that meet a limit exactly, and tables that are folders of files."""

from itertools import permutations

from pyspark.sql import functions as F
from samples_dir import SAMPLE

from reelgate.catalogue import ORACLES, QUERIES
from reelgate.operators.frames import balance_db


def test_ingest_reads_a_table_that_is_a_folder(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SAMPLE}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = QUERIES["incremental_ingest"](spark, str(tmp_path))
    same = QUERIES["incremental_ingest"](spark, SAMPLE)
    assert sorted(rows.collect()) == sorted(same.collect())


def test_mean_on_its_limit_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    import duckdb

    rows = [
        (9 * (1 + n), i, 20.0, share / 100, 0.04, "N")
        for n, shares in enumerate(permutations((1, 5, 9)))
        for i, share in enumerate(shares)
    ]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    folder = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    found = QUERIES["acceptance_checks"](spark, str(tmp_path)).collect()
    assert len(found) == 6
    assert len({r["failures"] for r in found}) == 1
    assert "pitch_median" not in found[0]["failures"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    theirs = con.execute(ORACLES["acceptance_checks"]).fetchall()
    assert sorted(theirs) == sorted((r["l_orderkey"], r["failures"], r["accepted"]) for r in found)


def test_level_on_the_bar_is_active(spark):
    # the bar is a tenth of the 60th percentile; each series has a level of exactly that
    low = [v / 100 for v in range(300, 400)]
    levels = [(s, i, v / 500) for s, x in enumerate(low) for i, v in enumerate([x, x, x, *[round(10 * x, 2)] * 5])]
    frames = spark.createDataFrame(levels, "series_id int, frame_idx long, rms double")
    other = frames.withColumn("rms", F.when(F.col("frame_idx") < 3, F.col("rms") / 10).otherwise(F.col("rms")))
    # with the three on the bar the differences are 20, 20, 20, 0, 0; without them 0, 0
    found = {r["series_id"]: round(r["balance_db"], 6) for r in balance_db(frames, other.where("frame_idx < 5")).collect()}
    assert found == {s: 20.0 for s in range(len(low))}
