"""Gates over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import query, rounded, table
from reelgate.functions.scalars import recording_kind, safe_relative_path
from reelgate.operators import gates
from reelgate.operators.lineage import dedup_by_hash, fingerprint
from reelgate.sources.media import inventory


def _hashed(spark, d):
    return fingerprint(table(spark, d, "documents"), "text")


def _good_hashes(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return _hashed(spark, d).join(good, "doc_id", "left_semi").select("sha256").distinct()


def _toxic_hashes(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return _hashed(spark, d).join(toxic, "doc_id", "left_semi").select("sha256").distinct()


@query(
    "eligible_corpus",
    """WITH h AS (SELECT *, sha256(text) AS sha256 FROM documents),
    good AS (SELECT DISTINCT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    bad AS (SELECT DISTINCT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS rn FROM h) WHERE rn = 1)
    SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM first
    WHERE sha256 IN (SELECT sha256 FROM good) AND sha256 NOT IN (SELECT sha256 FROM bad)
    GROUP BY source""",
)
def eligible_corpus(spark, d):
    kept = gates.source_allowlist(
        dedup_by_hash(_hashed(spark, d).drop("text"), ["doc_id"]), _good_hashes(spark, d)
    )
    kept = gates.source_denied(kept, _toxic_hashes(spark, d))
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


@query(
    "inventory_flags",
    """WITH h AS (SELECT doc_id, source, sha256(text) AS sha256 FROM documents)
    SELECT doc_id, source, sha256,
      sha256 IN (SELECT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS is_authorized
    FROM h""",
)
def inventory_flags(spark, d):
    files = _hashed(spark, d).select("doc_id", "source", "sha256")
    return inventory(files, _good_hashes(spark, d))


@query(
    "denial_audit",
    """WITH h AS (SELECT doc_id, source, lang, sha256(text) AS sha256 FROM documents),
    toxic AS (SELECT sha256, min(doc_id) AS pos FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY sha256),
    s AS (SELECT h.doc_id, 'source' AS scope, 'toxic as document ' || pos AS reason FROM h JOIN toxic USING (sha256)),
    v AS (SELECT doc_id, 'voice_training' AS scope,
            CASE WHEN source IN ('src1', 'src2') THEN CASE source WHEN 'src1' THEN 'withdrawn' ELSE 'live recordings are excluded' END
                 ELSE 'live recordings are excluded' END AS reason
          FROM h WHERE source IN ('src1', 'src2') OR contains(lower(source || ' ' || lang), '1 de'))
    SELECT * FROM s UNION ALL SELECT * FROM v""",
)
def denial_audit(spark, d):
    docs = _hashed(spark, d).select("doc_id", "source", "lang", "sha256")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    excluded = docs.join(toxic, "doc_id", "left_semi").select(
        "sha256",
        F.lit("").alias("filename"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("toxic as document "), F.col("doc_id").cast("string")).alias("reason"),
    )
    source = gates.source_exclusions(docs, excluded, filename=None).where(
        "exclusion_reason is not null"
    )
    policy = docs.where(F.col("source").isin("src1", "src2")).select("source").distinct().select(
        "source",
        F.lit(True).alias("exclude_entire_song"),
        F.when(F.col("source") == "src1", "withdrawn").alias("reason"),
    )
    voice = gates.voice_song_gate(
        docs, policy, F.col("lang"), markers=("1 de",), key="source"
    ).where("voice_excluded")
    return gates.exclusion_audit(source, voice, key="doc_id")


@query(
    "exclusion_by_hash_or_name",
    """WITH x AS (SELECT sha256(p_partkey::VARCHAR) AS sha256, upper(p_name) AS filename,
                 p_partkey AS pos, 'size ' || p_size AS reason FROM part WHERE p_size = 50 AND p_type = 'PROMO'),
    p AS (SELECT p_partkey, p_name, sha256(p_partkey::VARCHAR) AS sha256 FROM part),
    m AS (SELECT p.p_partkey, x.pos, x.reason FROM p JOIN x ON p.sha256 = x.sha256
          UNION ALL SELECT p.p_partkey, x.pos, x.reason FROM p JOIN x ON lower(p.p_name) = lower(x.filename))
    SELECT p_partkey, (SELECT arg_min(reason, pos) FROM m WHERE m.p_partkey = p.p_partkey) AS exclusion_reason FROM p""",
)
def exclusion_by_hash_or_name(spark, d):
    part = table(spark, d, "part").withColumn(
        "sha256", F.sha2(F.col("p_partkey").cast("string"), 256)
    )
    excluded = part.where("p_size = 50 and p_type = 'PROMO'").select(
        "sha256",
        F.upper("p_name").alias("filename"),
        F.col("p_partkey").alias("pos"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("reason"),
    )
    out = gates.source_exclusions(part, excluded, filename="p_name")
    return out.select("p_partkey", "exclusion_reason")


@query(
    "marker_filter",
    """SELECT p_partkey, p_name,
      contains(lower(p_brand || ' ' || p_name), 'ring') OR p_size IN (SELECT 7) AS voice_excluded,
      CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 'live' ELSE 'studio' END AS recording_kind
    FROM part""",
)
def marker_filter(spark, d):
    part = table(spark, d, "part")
    policy = part.select("p_partkey").where("p_size = 7").select(
        "p_partkey", F.lit(True).alias("exclude_entire_song"), F.lit("seven").alias("reason")
    )
    out = gates.voice_song_gate(
        part, policy, F.concat_ws(" ", "p_brand", "p_name"), markers=("ring",), key="p_partkey"
    )
    kind = recording_kind("p_name", "p_type", markers=("ring",))
    return out.select("p_partkey", "p_name", "voice_excluded", kind.alias("recording_kind"))


@query(
    "music_song_gate",
    """SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN
    (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 26)""",
)
def music_song_gate(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "song_id")
    policy = part.groupBy("song_id").agg(
        (F.avg("p_size") > 26).alias("exclude_from_training")
    )
    kept = gates.music_song_gate(part, policy)
    return kept.select("p_partkey", F.col("song_id").alias("p_brand"))


_INSTANT = "timestamp_ntz'2024-06-01 00:00:00'"


@query(
    "capability_gate",
    """WITH r AS (SELECT n_nationkey,
      CASE n_nationkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'revoked' ELSE 'approved' END AS status,
      CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-06-01' + INTERVAL 1 DAY * (n_nationkey - 10) END AS eff,
      CASE WHEN n_nationkey % 4 = 0 THEN TIMESTAMP '2024-06-01' + INTERVAL 1 DAY * (n_nationkey - 8) END AS exp,
      n_nationkey % 7 AS n_approvals, n_regionkey % 2 = 0 AS training, n_regionkey % 3 <> 1 AS music_style,
      CASE WHEN n_nationkey % 6 <> 2 THEN n_regionkey % 2 = 1 END AS singing_voice, n_nationkey % 9 = 3 AS commercial_release FROM nation WHERE n_nationkey <> 13)
    SELECT s_suppkey, reason IS NULL AS allowed, reason AS denial_reason FROM (
      SELECT s_suppkey, CASE
        WHEN r.n_nationkey IS NULL THEN 'no rights manifest'
        WHEN n_approvals < 1 THEN 'no approval evidence'
        WHEN s_suppkey % 5 = 4 THEN 'unknown capability'
        WHEN status <> 'approved' THEN 'not approved'
        WHEN eff IS NOT NULL AND TIMESTAMP '2024-06-01' < eff THEN 'not yet effective'
        WHEN exp IS NOT NULL AND TIMESTAMP '2024-06-01' >= exp THEN 'expired'
        WHEN NOT coalesce(CASE s_suppkey % 5 WHEN 0 THEN training WHEN 1 THEN music_style WHEN 2 THEN singing_voice ELSE commercial_release END, false)
          THEN 'capability not granted' END AS reason
      FROM supplier LEFT JOIN r ON s_nationkey = r.n_nationkey)""",
)
def capability_gate(spark, d):
    at = F.expr(_INSTANT)
    key = F.col("n_nationkey")
    rights = table(spark, d, "nation").where(key != 13).select(
        key.alias("artist_id"),
        F.when(key % 5 == 0, "pending").when(key % 5 == 1, "revoked").otherwise("approved").alias("status"),
        F.when(key % 3 == 0, F.expr(f"{_INSTANT} + make_dt_interval(n_nationkey - 10)")).alias("effective_at"),
        F.when(key % 4 == 0, F.expr(f"{_INSTANT} + make_dt_interval(n_nationkey - 8)")).alias("expires_at"),
        (key % 7).alias("n_approvals"),
        (F.col("n_regionkey") % 2 == 0).alias("training"),
        (F.col("n_regionkey") % 3 != 1).alias("music_style"),
        F.when(key % 6 != 2, F.col("n_regionkey") % 2 == 1).alias("singing_voice"),
        (key % 9 == 3).alias("commercial_release"),
    )
    # every capability is asked for, and one that there is not
    asked = F.array(*[F.lit(c) for c in (*gates.CAPABILITIES, "resale")])
    requests = table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("artist_id"), F.get(asked, (F.col("s_suppkey") % 5).cast("int")).alias("capability")
    )
    return gates.capability_gate(requests, rights, at).select(
        "s_suppkey", "allowed", "denial_reason"
    )


@query(
    "interval_exclusion",
    """WITH e AS (SELECT user_id, epoch(ts) AS s, event_type, event_id FROM events),
    w AS (SELECT user_id, event_id, s AS start_s, s + 14400 AS end_s FROM e),
    x AS (SELECT user_id, s - 3600 AS a, s + 3600 AS b FROM e WHERE event_type = 'error')
    SELECT user_id, event_id FROM w WHERE NOT EXISTS
      (SELECT 1 FROM x WHERE x.user_id = w.user_id AND w.start_s < x.b AND w.end_s > x.a)""",
)
def interval_exclusion(spark, d):
    seconds = F.expr("unix_micros(cast(ts as timestamp))") / 1e6
    events = table(spark, d, "events").withColumn("s", seconds)
    windows = events.select(
        "user_id", "event_id", F.col("s").alias("start_s"), (F.col("s") + 14400).alias("end_s")
    )
    walls = events.where("event_type = 'error'").select(
        "user_id", (F.col("s") - 3600).alias("start_s"), (F.col("s") + 3600).alias("end_s")
    )
    kept = gates.interval_exclusion(windows, walls, key="user_id", window_id=("event_id",))
    return kept.select("user_id", "event_id")


@query(
    "metric_gate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::VARCHAR AS shipped,
      concat_ws(',', CASE WHEN NOT (l_quantity BETWEEN 5 AND 45) THEN 'l_quantity' END,
        CASE WHEN NOT l_discount <= 0.08 THEN 'l_discount' END,
        CASE WHEN NOT l_extendedprice >= 2000 THEN 'l_extendedprice' END) AS failed_rules
    FROM lineitem""",
)
def metric_gate(spark, d):
    rules = {
        "l_quantity": (5.0, 45.0),
        "l_discount": (None, 0.08),
        "l_extendedprice": (2000.0, None),
    }
    out = gates.metric_gate(table(spark, d, "lineitem"), rules)
    return out.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


@query(
    "row_violations",
    """SELECT o_orderkey, concat_ws(',',
        CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z]+') THEN 'priority' END,
        CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'price' END,
        CASE WHEN NOT (o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1995-01-01') THEN 'finished' END) AS violations
    FROM orders""",
)
def row_violations(spark, d):
    rules = {
        "priority": F.col("o_orderpriority").rlike("^[1-5]-[A-Z]+$"),
        "price": F.col("o_totalprice").between(1000, 400000),
        "finished": (F.col("o_orderstatus") != "F")
        | (F.col("o_orderdate") >= F.expr("timestamp_ntz'1995-01-01 00:00:00'")),
    }
    out = gates.validate_rows(table(spark, d, "orders"), rules)
    return out.select("o_orderkey", F.concat_ws(",", "violations").alias("violations"))


@query(
    "schema_violations",
    """SELECT r_regionkey, r_name, 'column r_name is string, not binary' AS problem FROM region
    UNION ALL SELECT r_regionkey, r_name, 'missing column r_comment' FROM region""",
)
def schema_violations(spark, d):
    from pyspark.sql import types as T

    region = table(spark, d, "region")
    expected = T.StructType.fromDDL("r_regionkey int, r_name binary, r_comment string")
    problems = gates.validate_schema(region, expected)
    return region.select(
        "r_regionkey", "r_name", F.explode(F.array(*[F.lit(p) for p in problems])).alias("problem")
    )


@query(
    "safe_paths",
    """SELECT page_id, NOT (starts_with(p, '/') OR regexp_matches(p, '(^|/)\\.\\.(/|$)') OR p = '') AS safe FROM
    (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'b/' ELSE '..' END
       || CASE WHEN page_id % 4 = 3 AND contains(url, 'en') THEN '' ELSE replace(url, 'http', 'x') END AS p FROM pages)""",
)
def safe_paths(spark, d):
    key = F.col("page_id") % 4
    head = F.when(key == 0, "/").when(key == 1, "a/../").when(key == 2, "b/").otherwise("..")
    tail = F.when((key == 3) & F.contains("url", F.lit("en")), "").otherwise(
        F.replace(F.col("url"), F.lit("http"), F.lit("x"))
    )
    return table(spark, d, "pages").select(
        "page_id", safe_relative_path(F.concat(head, tail)).alias("safe")
    )


@query(
    "text_required",
    """WITH k AS (SELECT DISTINCT conv_id FROM conversations),
    a AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations WHERE turn = 3 AND role = 'assistant'),
    b AS (SELECT conv_id, text FROM conversations WHERE turn = 0)
    SELECT conv_id, sha256(coalesce(a.text, b.text)) AS text_sha256,
      CASE WHEN coalesce(a.text, b.text) IS NULL THEN 'missing'
           WHEN trim(coalesce(a.text, b.text)) = '' THEN 'blank' END AS violation
    FROM k LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id)""",
)
def text_required(spark, d):
    conv = table(spark, d, "conversations")
    first = conv.where("turn = 3 and role = 'assistant'").select(
        "conv_id",
        F.when(F.col("conv_id") % 5 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"),
    )
    second = conv.where("turn = 0").select("conv_id", "text")
    out = gates.text_required(conv.select("conv_id").distinct(), [first, second], "conv_id")
    return out.select("conv_id", F.sha2("text", 256).alias("text_sha256"), "violation")


@query(
    "review_gate",
    """SELECT user_id, 'approved' AS review_status FROM events GROUP BY user_id
    HAVING arg_max(event_type, (ts, event_id)) IN ('purchase', 'signup')""",
)
def review_gate(spark, d):
    decisions = table(spark, d, "events").withColumn(
        "review_status",
        F.when(F.col("event_type").isin("purchase", "signup"), "approved").otherwise("rejected"),
    )
    return gates.review_gate(decisions, "user_id", ["ts", "event_id"])


@query(
    "acceptance_checks",
    """WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, sum(round(l_discount * 100)::BIGINT) / (100 * count(*)) AS disc,
        max(l_tax) AS tax, min(l_discount) AS mind, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT l_orderkey, abs(q - 2 * n * 13) <= 60 AS c1, n % 7 <> 0 AS c2, n <> 5 AS c3, l_orderkey % 9 <> 4 AS c4,
      abs(-14 + disc * 10 - 0.5 + 14) <= 0.5 AS c5, -1 - tax + 0.03 <= -0.99 AS c6,
      q / 20 - 4 BETWEEN -4 AND 6 AS c7, mind = 0 OR n > 2 AS c8, r <= 1 AS c9, n * 1.1 <= 6 AS c10,
      disc * 1000 <= 50 AS c11, CASE WHEN n = 4 THEN NULL ELSE tax END < 0.05 AS c12,
      CASE WHEN n % 2 = 0 THEN disc * 10 >= 0.4 WHEN n % 3 = 0 THEN tax * 10 >= 0.3 ELSE true END AS c13, q > 10 AS c14 FROM o),
    f AS (SELECT l_orderkey, concat_ws(',', CASE WHEN NOT c1 THEN 'duration' END, CASE WHEN NOT c2 THEN 'sample_rate' END,
      CASE WHEN NOT c3 THEN 'channels' END, CASE WHEN NOT c4 THEN 'pcm_24' END, CASE WHEN NOT c5 THEN 'integrated_loudness' END, CASE WHEN NOT c6 THEN 'true_peak' END,
      CASE WHEN NOT c7 THEN 'vocal_presence' END, CASE WHEN NOT c8 THEN 'clipping' END, CASE WHEN NOT c9 THEN 'dropouts' END,
      CASE WHEN NOT c10 THEN 'join_level' END, CASE WHEN NOT c11 THEN 'pitch_median' END,
      CASE WHEN NOT coalesce(c12, false) THEN 'pitch_gross' END, CASE WHEN NOT c13 THEN 'voice_identity' END,
      CASE WHEN NOT c14 THEN 'phrase_coverage' END) AS failures FROM m)
    SELECT l_orderkey, failures, failures = '' AS accepted FROM f""",
)
def acceptance_checks(spark, d):
    from reelgate.operators.qc import acceptance_checks as check

    # means meet the limits exactly, so they come from whole hundredths, whose order of addition is free
    hundredths = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("q"),
        (hundredths / (100 * F.count(F.lit(1)))).alias("disc"),
        F.max("l_tax").alias("tax"),
        F.min("l_discount").alias("mind"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
    )
    n, q, disc, tax = (F.col(c) for c in ("n", "q", "disc", "tax"))
    measured = per.select(
        "l_orderkey",
        q.alias("duration_seconds"),
        (2 * n * 13).alias("expected_seconds"),
        F.when(n % 7 != 0, 48000).otherwise(44100).alias("sample_rate"),
        F.when(n != 5, 2).otherwise(1).alias("channels"),
        F.when(F.col("l_orderkey") % 9 != 4, "PCM_24").when(F.col("l_orderkey") % 2 == 0, "FLOAT").alias("codec"),
        (-14 + disc * 10 - 0.5).alias("integrated_lufs"),
        (-1 - tax + 0.03).alias("true_peak_dbfs"),
        (q / 20 - 4).alias("vocal_to_instrumental_db"),
        F.when((F.col("mind") == 0) | (n > 2), 0.0).otherwise(0.1).alias("clipping_fraction"),
        F.greatest(F.col("r") - 1, F.lit(0)).alias("sustained_dropout_count"),
        (n * 1.1).alias("max_voiced_join_jump_db"),
        (disc * 1000).alias("f0_median_error_cents"),
        F.when(n != 4, tax).alias("f0_gross_error_fraction"),
        F.when(n % 2 == 0, F.lit(0.4)).alias("identity_window_threshold"),
        (disc * 10).alias("minimum_window_identity_similarity"),
        F.when(n % 3 == 0, F.lit(0.3)).alias("identity_threshold"),
        (tax * 10).alias("minimum_identity_similarity"),
        (q > 10).alias("covered"),
    )
    out = check(measured, {"duration_tolerance_s": 60.0})
    return out.select(
        "l_orderkey", F.concat_ws(",", "failures").alias("failures"), "accepted"
    )


@query(
    "version_support",
    """SELECT p_partkey, p_size BETWEEN 1 AND 40 AS version_ok FROM part""",
)
def version_support(spark, d):
    out = gates.version_supported(table(spark, d, "part"), 40, column="p_size")
    return rounded(out.select("p_partkey", "version_ok"))
