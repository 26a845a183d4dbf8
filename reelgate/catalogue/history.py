"""Run histories: transitions, folds, readiness, provenance, streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from reelgate.catalogue.registry import query, table
from reelgate.operators import lineage, qc
from reelgate.operators.scan import by_rows
from reelgate.session import shared_dir
from reelgate.sources.sinks import report_lines
from reelgate.streaming.ingest import read_back, start_ingest
from reelgate.streaming.runs import run_state_stream

# the transitions between the roles of a conversation
SPEAKERS = {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@query(
    "legal_transitions",
    """WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 AND turn = 2 THEN 'system' ELSE role END AS stage,
      turn + CASE WHEN conv_id % 7 = 0 AND turn > 2 THEN 1 ELSE 0 END AS seq FROM conversations),
    l AS (SELECT *, lag(stage) OVER (PARTITION BY conv_id ORDER BY seq) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS pos FROM e)
    SELECT conv_id AS run_id, seq AS sequence, stage, prev AS previous_stage, CASE WHEN seq <> pos THEN 'sequence gap'
      WHEN prev IS NULL AND stage NOT IN ('system', 'user') THEN 'illegal first stage'
      WHEN prev IS NOT NULL AND prev || '>' || stage NOT IN ('system>user', 'user>assistant', 'assistant>user') THEN 'illegal transition' END AS violation FROM l""",
)
def legal_transitions(spark, d):
    key = F.col("conv_id")
    events = table(spark, d, "conversations").select(
        key.alias("run_id"),
        (F.col("turn") + F.when((key % 7 == 0) & (F.col("turn") > 2), 1).otherwise(0)).alias("sequence"),
        F.when((key % 6 == 0) & (F.col("turn") == 2), "system").otherwise(F.col("role")).alias("stage"),
    )
    return lineage.legal_transitions(events, allowed=SPEAKERS, first=["system", "user"])


@query(
    "latest_artifacts",
    """SELECT user_id AS run_id, event_type AS name, arg_max(json_extract_string(props, '$.k'), event_id) AS value FROM events GROUP BY 1, 2
    UNION ALL SELECT user_id, 'k', arg_max(json_extract_string(props, '$.k'), event_id) FROM events GROUP BY 1""",
)
def latest_artifacts(spark, d):
    value = F.get_json_object("props", "$.k")
    events = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("sequence"),
        F.create_map(F.lit("k"), value, F.col("event_type"), value).alias("artifacts"),
    )
    return lineage.latest_artifacts(events)


@query(
    "run_status",
    """SELECT conv_id AS run_id, arg_max(role, turn) AS stage, count(*) AS n_events, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1""",
)
def run_status(spark, d):
    events = table(spark, d, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("sequence"),
        F.col("role").alias("stage"),
        F.col("turn").alias("occurred_at"),
    )
    return lineage.run_status(events).withColumnsRenamed(
        {"created_at": "first_turn", "updated_at": "last_turn"}
    )


@query(
    "list_runs",
    """SELECT o_orderkey, o_custkey, 'run-' || strftime(o_orderdate, '%Y%m%dt%H%M%Sz') || '-' || left(sha256(o_orderkey::VARCHAR), 8) AS run_id
    FROM orders WHERE o_orderstatus = 'F'""",
)
def list_runs(spark, d):
    from reelgate.functions.scalars import utc_id

    runs = table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        utc_id(
            "run", "o_orderdate", F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8)
        ).alias("run_id"),
    )
    return lineage.list_runs(runs, "F", owner="o_orderstatus").drop("o_orderstatus")


@query(
    "newest_checkpoint",
    """WITH f AS (SELECT l_suppkey AS t, l_quantity::BIGINT AS e, l_orderkey % 3 AS part, l_discount = 0.1 AND l_quantity = 50 AND l_tax = 0.08 AS fin FROM lineitem),
    c AS (SELECT t, e, bool_or(part = 0) AND bool_or(part = 1) AND bool_or(part = 2) AS complete FROM f WHERE NOT fin GROUP BY 1, 2),
    b AS (SELECT t, max(e) FILTER (complete AND e < 40) AS e FROM c GROUP BY 1), z AS (SELECT t, bool_or(fin) AS fin FROM f GROUP BY 1)
    SELECT t AS training_id, CASE WHEN NOT fin AND e IS NOT NULL THEN 'epoch_' || e || '_loss_0.5' END AS checkpoint, CASE WHEN NOT fin THEN e END AS epoch,
      CASE WHEN fin THEN 'already final' WHEN e IS NULL THEN 'no complete checkpoint' END AS refusal FROM z LEFT JOIN b USING (t)""",
)
def newest_checkpoint(spark, d):
    part = F.col("l_orderkey") % 3
    name = (
        F.when(part == 0, "training_state.pt")
        .when(part == 1, "adapter/adapter_config.json")
        .otherwise("adapter/adapter_model.safetensors")
    )
    final = (F.col("l_discount") == 0.1) & (F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08)
    epoch = F.col("l_quantity").cast("long").cast("string")
    files = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("training_id"),
        F.when(final, "final/adapter_model.bin")
        .otherwise(F.concat(F.lit("checkpoints/epoch_"), epoch, F.lit("_loss_0.5/"), name))
        .alias("path"),
    )
    return lineage.newest_checkpoint(files, 40)


@query(
    "manifest_counts",
    """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS dataset_id, o_custkey % 6 AS training_segment_count, coalesce(n, 0) AS counted, coalesce(n, 0) = o_custkey % 6 AS matches
    FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""",
)
def manifest_counts(spark, d):
    segments = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("validation").alias("split"),
    )
    manifests = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("dataset_id"),
        (F.col("o_custkey") % 6).alias("training_segment_count"),
    )
    return qc.manifest_matches(segments, manifests)


@query(
    "artist_status",
    """WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'revoked' ELSE 'approved' END AS st, n_nationkey % 4 <> 0 AS tr, n_nationkey % 3 = 0 AS mu, true AS si, false AS co FROM nation WHERE n_nationkey <> 5),
    c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1), v AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT n_nationkey AS artist_id, st AS rights_status, coalesce(st = 'approved' AND tr, false) AS can_training, coalesce(st = 'approved' AND mu, false) AS can_music_style,
      coalesce(st = 'approved' AND si, false) AS can_singing_voice, coalesce(st = 'approved' AND co, false) AS can_commercial_release,
      coalesce(c.n, 0) AS catalog_songs, coalesce(v.n, 0) AS voice_references, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS adapter_selected
    FROM nation LEFT JOIN r ON r.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey LEFT JOIN v ON v.k = n_nationkey""",
)
def artist_status(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey")
    rights = nation.where(key != 5).select(
        key.alias("artist_id"),
        F.when(F.col("n_regionkey") == 1, "revoked").otherwise("approved").alias("status"),
        F.lit(None).cast("timestamp").alias("effective_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(1).alias("n_approvals"),
        (key % 4 != 0).alias("training"),
        (key % 3 == 0).alias("music_style"),
        F.lit(True).alias("singing_voice"),
        F.lit(False).alias("commercial_release"),
    )
    supplier = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "artist_id")
    return qc.artist_status(
        nation.select(key.alias("artist_id")),
        rights,
        table(spark, d, "customer").where("c_acctbal > 9000").withColumnRenamed("c_nationkey", "artist_id"),
        supplier,
        supplier.where("s_acctbal > 9000"),
        F.lit("2024-06-01").cast("timestamp"),
    )


def _provenance(spark, d):
    # hashes are wide: a task gets whole runs, and as many of them whatever the table's size
    lines = by_rows(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity"), "l_orderkey")
    items = lines.groupBy(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("reference_id")
    ).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    references = items.select(
        "run_id",
        F.lpad(F.col("reference_id").cast("string"), 9, "0").alias("reference_id"),
        F.sha2(F.col("reference_id").cast("string"), 256).alias("audio_sha256"),
        F.sha2(F.col("p").cast("string"), 256).alias("f0_sha256"),
        F.when(F.col("q") > 25, F.sha2(F.col("q").cast("int").cast("string"), 256)).alias("stem_sha256"),
        F.lit("own").alias("source_sha256"),
        F.when(F.col("q") > 40, F.lit("parent")).alias("parent_source_sha256"),
    )
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("artist_id")
    )
    reports = runs.select(
        "run_id",
        F.lit("quality_control").alias("name"),
        F.sha2(F.col("artist_id").cast("string"), 256).alias("sha256"),
    )
    return lineage.provenance_records(runs, references, reports)


_PROVENANCE_SQL = """i AS (SELECT l_orderkey AS run_id, l_suppkey AS s, min(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT run_id, lpad(s::VARCHAR, 9, '0') AS reference_id, sha256(s::VARCHAR) AS a, sha256(p::VARCHAR) AS f, CASE WHEN q > 25 THEN sha256(q::INT::VARCHAR) END AS st,
  CASE WHEN q > 40 THEN 'parent' ELSE 'own' END AS src FROM i)"""


@query(
    "provenance_headers",
    f"""WITH {_PROVENANCE_SQL}, l AS (SELECT run_id, min(reference_id) AS reference_id, count(*) AS n FROM r GROUP BY 1)
    SELECT o_orderkey AS run_id, o_custkey AS artist_id, l.reference_id AS voice_reference_id, a AS voice_reference_sha256, src AS voice_source_sha256,
      f AS voice_reference_f0_sha256, coalesce(n, 0) AS n_references, true AS ai_assisted, false AS release_approved
    FROM orders LEFT JOIN l ON l.run_id = o_orderkey LEFT JOIN r ON r.run_id = o_orderkey AND r.reference_id = l.reference_id""",
)
def provenance_headers(spark, d):
    return _provenance(spark, d)[0]


@query(
    "provenance_hashes",
    f"""WITH {_PROVENANCE_SQL} SELECT run_id, 'voice_reference_hashes' AS kind, reference_id AS name, a AS sha256 FROM r
    UNION ALL SELECT run_id, 'voice_reference_f0_hashes', reference_id, f FROM r
    UNION ALL SELECT run_id, 'voice_reference_stem_hashes', reference_id, st FROM r WHERE st IS NOT NULL
    UNION ALL SELECT run_id, 'voice_source_hashes', reference_id, src FROM r
    UNION ALL SELECT o_orderkey, 'reports', 'quality_control', sha256(o_custkey::VARCHAR) FROM orders""",
)
def provenance_hashes(spark, d):
    return _provenance(spark, d)[1]


@query(
    "report_lines",
    """SELECT source, 'header' AS kind, '{"n":' || count(*) || ',"source":"' || source || '"}' AS body FROM documents GROUP BY source
    UNION ALL SELECT source, 'segment', '{"doc_id":' || doc_id || ',"source":"' || source || '"}' FROM documents""",
)
def report(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    header = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return report_lines({"header": header, "segment": docs}, ["source"])


@query(
    "incremental_ingest",
    """WITH h AS (SELECT *, sha256(text) AS sha256 FROM documents),
    x AS (SELECT DISTINCT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM h)
    SELECT doc_id, sha256, CASE WHEN sha256 IN (SELECT sha256 FROM x) THEN 'denied' WHEN rn > 1 THEN 'duplicate' ELSE 'imported' END AS status FROM r""",
)
def incremental_ingest(spark, d):
    docs = lineage.fingerprint(table(spark, d, "documents"), "text")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    denied = docs.join(toxic, "doc_id", "left_semi").select("sha256").distinct()
    denied = denied.withColumn("reason", F.lit("toxic"))
    # the table may be one file or a folder of files; a pattern takes either
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
    folder = f"{shared_dir(spark)}/ingest-{uuid4().hex}"
    arrivals = lineage.fingerprint(stream, "text").select("doc_id", "sha256")
    start_ingest(
        arrivals, folder, order=["doc_id"], excluded=denied, allowed=None
    ).awaitTermination()
    return read_back(spark, folder).select("doc_id", "sha256", "status")


@query(
    "run_state_stream",
    """WITH RECURSIVE e AS (SELECT conv_id, turn, role, CASE WHEN turn < 2 THEN 0 ELSE 1 + (conv_id + turn) % 2 END AS part FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS rn FROM e),
    s AS (SELECT conv_id, 0::BIGINT AS rn, NULL::BIGINT AS turn, NULL::VARCHAR AS role, NULL::VARCHAR AS alert, -1::BIGINT AS seen, NULL::VARCHAR AS held
        FROM n WHERE rn = 1
      UNION ALL SELECT conv_id, rn, turn, role, alert, CASE WHEN alert IS NULL THEN turn ELSE seen END, CASE WHEN alert IS NULL THEN role ELSE held END
        FROM (SELECT n.*, s.seen, s.held, CASE WHEN n.turn <= s.seen THEN 'late event' WHEN n.turn <> s.seen + 1 THEN 'sequence gap'
            WHEN s.held IS NULL AND n.role NOT IN ('system', 'user') THEN 'illegal first stage'
            WHEN s.held || '>' || n.role NOT IN ('system>user', 'user>assistant', 'assistant>user') THEN 'illegal transition' END AS alert
          FROM s JOIN n ON n.conv_id = s.conv_id AND n.rn = s.rn + 1))
    SELECT conv_id AS run_id, turn AS sequence, role AS stage, alert, seen AS run_sequence, held AS run_stage FROM s WHERE rn > 0""",
)
def run_state(spark, d):
    """Three parts of the events arrive one after the other, the last two out of sequence."""
    part = F.when(F.col("turn") < 2, 0).otherwise(1 + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)))
    events = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.col("turn").alias("sequence"),
        F.col("role").alias("stage"),
        part.alias("part"),
    )
    folder = f"{shared_dir(spark)}/runs-{uuid4().hex}"
    for number in range(3):
        events.where(F.col("part") == number).drop("part").write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.drop("part").schema).parquet(f"{folder}/events")
        # each start takes up the state that the one before it left
        (
            run_state_stream(stream, allowed=SPEAKERS, first=["system", "user"])
            .writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    rows = spark.read.parquet(f"{folder}/out")
    return rows.withColumn("run_id", F.col("run_id").cast("long"))
