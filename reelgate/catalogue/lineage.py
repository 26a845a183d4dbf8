"""Lineage, integrity and reconciliation over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgate.catalogue.registry import query, rounded, table
from reelgate.functions import scalars
from reelgate.operators import lineage, qc


@query(
    "first_of_copies",
    """SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256,
      row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def first_of_copies(spark, d):
    docs = lineage.fingerprint(table(spark, d, "documents"), "text")
    return lineage.dedup_by_hash(docs.select("doc_id", "source", "sha256"), ["source", "doc_id"]).select(
        "doc_id", "sha256"
    )


@query(
    "id_collisions",
    """SELECT 'song-' || n_chars AS song_id FROM documents GROUP BY n_chars HAVING count(DISTINCT sha256(text)) > 1""",
)
def id_collisions(spark, d):
    docs = lineage.fingerprint(table(spark, d, "documents"), "text").select(
        F.concat(F.lit("song-"), F.col("n_chars").cast("string")).alias("song_id"), "sha256"
    )
    return lineage.id_collisions(docs)


@query(
    "attach_catalog",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, l_quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 25""",
)
def attach_catalog(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.col("l_partkey").alias("song_id"), F.col("l_suppkey").alias("artist_id"),
    )
    parts = table(spark, d, "part").where("p_size < 25").select(
        F.col("p_partkey").alias("song_id"), "p_name"
    )
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("artist_id"), "s_name")
    stems = lineage.attach_catalog(items, parts, ["song_id"])
    out = lineage.attach_catalog(stems, owners, ["artist_id"])
    return out.withColumnsRenamed({"song_id": "l_partkey", "artist_id": "l_suppkey"}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "l_quantity"
    )


@query(
    "attach_title",
    """SELECT l_partkey AS song_id, count(*) AS n, coalesce(max(CASE WHEN p_size > 10 THEN p_name END), l_partkey::VARCHAR) AS title
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""",
)
def attach_title(spark, d):
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("song_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    titles = table(spark, d, "part").where("p_size > 10").select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title")
    )
    return lineage.attach_title(used, titles).select("song_id", "n", "title")


@query(
    "lineage_violations",
    """WITH c AS (SELECT l_orderkey AS k, count(*) AS n_lines, CASE WHEN count(*) = 6 THEN NULL ELSE count(*) % 3 END AS grp FROM lineitem GROUP BY 1),
    p AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS n_lines, (o_custkey % 7 + 1) % 3 AS grp FROM orders WHERE o_orderstatus <> 'P'),
    j AS (SELECT c.k, p.k AS pk, c.n_lines, c.grp, p.n_lines AS pn, p.grp AS pg FROM c LEFT JOIN p ON c.k = p.k)
    SELECT k AS order_id, 'missing' AS violation, '' AS column_name FROM j WHERE pk IS NULL
    UNION ALL SELECT k, 'mismatch', 'n_lines' FROM j WHERE pk IS NOT NULL AND n_lines <> pn
    UNION ALL SELECT k, CASE WHEN grp IS NULL THEN 'incomplete' ELSE 'mismatch' END, 'grp' FROM j WHERE pk IS NOT NULL AND grp IS DISTINCT FROM pg""",
)
def lineage_violations(spark, d):
    n = F.count(F.lit(1))
    children = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        n.alias("n_lines"), F.when(n != 6, n % 3).alias("grp")
    )
    expected = F.col("o_custkey") % 7 + 1
    parents = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("order_id"), expected.alias("n_lines"), (expected % 3).alias("grp")
    )
    return lineage.lineage_check(children, parents, "order_id", ["n_lines", "grp"])


@query(
    "integrity_status",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN max(l_quantity) > 48 THEN NULL ELSE max(l_suppkey)::VARCHAR END AS sha256 FROM lineitem GROUP BY 1, 2),
    a AS (SELECT l_orderkey, l_linenumber, min(l_suppkey)::VARCHAR AS sha256 FROM lineitem WHERE l_discount < 0.09 GROUP BY 1, 2)
    SELECT r.*, CASE WHEN a.l_orderkey IS NULL THEN 'missing' WHEN r.sha256 IS NULL OR r.sha256 = a.sha256 THEN 'ok' ELSE 'mismatch' END AS status
    FROM r LEFT JOIN a USING (l_orderkey, l_linenumber)""",
)
def integrity_status(spark, d):
    items = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    recorded = items.groupBy(*keys).agg(
        F.when(F.max("l_quantity") <= 48, F.max("l_suppkey").cast("string")).alias("sha256")
    )
    actual = items.where("l_discount < 0.09").groupBy(*keys).agg(
        F.min("l_suppkey").cast("string").alias("sha256")
    )
    return lineage.integrity_check(recorded, actual, keys, null_recorded_passes=True)


@query(
    "reconcile_status",
    """WITH e AS (SELECT c_custkey, c_nationkey, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN 0.9 END AS strength FROM customer WHERE c_custkey % 3 <> 0),
    r AS (SELECT c_custkey, c_custkey % 5 <> 0 AS output_exists, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey,
      CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment, 0.9 AS strength FROM customer)
    SELECT r.c_custkey, CASE WHEN NOT output_exists THEN 'create' WHEN e.c_custkey IS NULL THEN 'refuse: untracked output'
      WHEN r.c_nationkey <> e.c_nationkey THEN 'refuse: lineage mismatch'
      WHEN r.segment = e.segment AND r.strength = coalesce(e.strength, 1.0) THEN 'reuse' ELSE 'rebuild' END AS decision
    FROM r LEFT JOIN e USING (c_custkey)""",
)
def reconcile_status(spark, d):
    customer = table(spark, d, "customer")
    key = F.col("c_custkey")
    existing = customer.where(key % 3 != 0).select(
        key, "c_nationkey", F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.lit(0.9)).alias("strength"),
    )
    requested = customer.select(
        key,
        (key % 5 != 0).alias("output_exists"),
        F.when(key % 11 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(key % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit(0.9).alias("strength"),
    )
    out = lineage.reconcile(
        requested, existing, "c_custkey", lineage=["c_nationkey"],
        settings={"segment": None, "strength": 1.0}, rebuild=True,
    )
    return out.select("c_custkey", "decision")


@query(
    "media_invariants",
    """WITH s AS (SELECT o_orderkey, o_custkey % 3 AS rate, o_custkey % 2 AS ch, o_totalprice AS dur FROM orders),
    t AS (SELECT l_orderkey, count(*) % 3 AS rate, count(*) % 2 AS ch, sum(l_extendedprice) AS dur,
      count(*) FILTER (l_discount = 0.1) AS clipped, count(*) FILTER (l_tax = 0) AS nonfinite FROM lineitem GROUP BY 1)
    SELECT o_orderkey, concat_ws(',', CASE WHEN s.rate <> t.rate THEN 'sample_rate' END, CASE WHEN s.ch <> t.ch THEN 'channels' END,
      CASE WHEN abs(s.dur - t.dur) > 100000 THEN 'duration' END, CASE WHEN clipped <> 0 THEN 'clipped' END,
      CASE WHEN nonfinite <> 0 THEN 'nonfinite' END) AS violations
    FROM s JOIN t ON o_orderkey = l_orderkey""",
)
def media_invariants(spark, d):
    n = F.count(F.lit(1))
    source = table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 3).alias("sample_rate"),
        (F.col("o_custkey") % 2).alias("channels"),
        F.col("o_totalprice").alias("duration_seconds"),
    )
    derived = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (n % 3).alias("sample_rate"),
        (n % 2).alias("channels"),
        F.sum("l_extendedprice").alias("duration_seconds"),
        F.count_if(F.col("l_discount") == 0.1).alias("clipped"),
        F.count_if(F.col("l_tax") == 0).alias("nonfinite"),
    )
    out = lineage.media_invariants(source, derived, "o_orderkey", tolerance=100000.0)
    return out.select("o_orderkey", F.concat_ws(",", "violations").alias("violations"))


@query(
    "timing_spread",
    """SELECT l_orderkey, round(max(l_quantity) - min(l_quantity), 6) AS spread_seconds,
      max(l_quantity) - min(l_quantity) <= 20 AS aligned FROM lineitem GROUP BY 1""",
)
def timing_spread(spark, d):
    return rounded(
        lineage.timing_spread(
            table(spark, d, "lineitem"), "l_orderkey", tolerance=20.0, duration="l_quantity"
        )
    )


@query(
    "parent_child_runs",
    """WITH c AS (SELECT o_orderkey AS run_id, o_custkey AS parent_run_id FROM orders),
    r AS (SELECT c_custkey AS parent_run_id, c_mktsegment = 'BUILDING' AS done FROM customer),
    e AS (SELECT o_orderkey AS run_id, 'n' || o_orderstatus AS name, (o_custkey % 50)::VARCHAR AS expected FROM orders),
    a AS (SELECT c_custkey AS parent_run_id, 'nF' AS name, c_nationkey::VARCHAR AS actual FROM customer)
    SELECT c.run_id, c.parent_run_id, e.name, coalesce(r.done, false) AS parent_complete,
      e.expected IS DISTINCT FROM a.actual AS changed
    FROM c LEFT JOIN r USING (parent_run_id) LEFT JOIN e USING (run_id) LEFT JOIN a ON a.parent_run_id = c.parent_run_id AND a.name = e.name""",
)
def parent_child_runs(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    children = orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("parent_run_id")
    )
    parents = customer.select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "complete").otherwise("failed").alias("stage"),
    )
    recorded = orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("n"), F.col("o_orderstatus")).alias("name"),
        (F.col("o_custkey") % 50).cast("string").alias("expected"),
    )
    actual = customer.select(
        F.col("c_custkey").alias("run_id"), F.lit("nF").alias("name"),
        F.col("c_nationkey").cast("string").alias("sha256"),
    )
    artifacts = recorded.select(
        "run_id", "name", F.col("expected").alias("recorded_parent_sha256"),
        F.lit(None).cast("string").alias("sha256"),
    )
    # runs and their parents are different tables here: keep the id spaces apart
    up = 10**15
    artifacts = artifacts.unionByName(
        actual.select(
            (F.col("run_id") + up).alias("run_id"), "name",
            F.lit(None).cast("string").alias("recorded_parent_sha256"), "sha256",
        )
    )
    out = lineage.parent_child_runs(
        children.withColumn("parent_run_id", F.col("parent_run_id") + up),
        parents.withColumn("run_id", F.col("run_id") + up),
        artifacts,
    )
    return out.withColumn("parent_run_id", F.col("parent_run_id") - up)


@query(
    "changed_artifacts",
    """WITH b AS (SELECT l_orderkey AS run_id, l_linenumber::VARCHAR AS name, l_suppkey::VARCHAR AS sha256 FROM lineitem),
    a AS (SELECT l_orderkey AS run_id, l_linenumber::VARCHAR AS name, l_suppkey::VARCHAR AS sha256 FROM lineitem WHERE l_returnflag <> 'R')
    SELECT run_id, name, sha256 FROM b EXCEPT ALL SELECT run_id, name, sha256 FROM a""",
)
def changed_artifacts(spark, d):
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("string").alias("name"),
        F.col("l_suppkey").cast("string").alias("sha256"),
        "l_returnflag",
    )
    return lineage.changed_artifacts(items, items.where("l_returnflag <> 'R'"))


@query(
    "orphan_segments",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN
    (SELECT p_partkey FROM part WHERE p_size <= 30)""",
)
def orphan_segments(spark, d):
    sources = table(spark, d, "part").where("p_size <= 30").select(
        F.col("p_partkey").alias("l_partkey")
    )
    segments = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lineage.segments_without_source(segments, sources, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "stale_policy",
    """SELECT o_orderkey FROM orders WHERE (CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE sha256(o_orderstatus) END)
    IS DISTINCT FROM sha256('F')""",
)
def stale_policy(spark, d):
    datasets = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 10 != 0, F.sha2("o_orderstatus", 256)).alias("dataset_policy_sha256"),
    )
    return lineage.stale_policy(datasets, F.sha2(F.lit("F"), 256)).select("o_orderkey")


@query(
    "import_status",
    """WITH k AS (SELECT sha256(text) AS h, min('song-' || item_id) AS id FROM benchmark GROUP BY 1
                UNION SELECT sha256(text), 'song-d' || min(doc_id) FROM documents WHERE lang = 'de' GROUP BY 1)
    SELECT doc_id, CASE WHEN h IS NULL THEN 'imported' ELSE 'duplicate' END AS status, id AS known_song_id
    FROM documents LEFT JOIN (SELECT h, min(id) AS id FROM k GROUP BY h) ON h = sha256(text)""",
)
def import_status(spark, d):
    bench = table(spark, d, "benchmark").select(
        F.sha2("text", 256).alias("source_sha256"),
        F.concat(F.lit("song-"), F.col("item_id").cast("string")).alias("song_id"),
    )
    german = (
        table(spark, d, "documents").where("lang = 'de'")
        .groupBy(F.sha2("text", 256).alias("source_sha256"))
        .agg(F.concat(F.lit("song-d"), F.min("doc_id").cast("string")).alias("song_id"))
    )
    files = lineage.fingerprint(table(spark, d, "documents"), "text").select("doc_id", "sha256")
    out = lineage.allow_join(files, bench.unionByName(german))
    return out.select("doc_id", "status", "known_song_id")


@query(
    "remove_hashes",
    """SELECT doc_id FROM documents WHERE sha256(text) NOT IN
    (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def remove_hashes(spark, d):
    docs = lineage.fingerprint(table(spark, d, "documents"), "text", "source_sha256")
    toxic = table(spark, d, "labels").where("toxic = 1")
    denied = docs.join(toxic, "doc_id", "left_semi").select("source_sha256").distinct()
    return lineage.remove_hashes(docs.select("doc_id", "source_sha256"), denied).select("doc_id")


@query(
    "batch_manifest",
    """SELECT count(*) AS source_count, count(*) FILTER (l_returnflag = 'N') AS created_count,
      count(*) FILTER (l_returnflag <> 'N') AS reused_count FROM lineitem""",
)
def batch_manifest(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    created = items.where("l_returnflag = 'N'").withColumn("status", F.lit("created"))
    reused = items.where("l_returnflag <> 'N'").withColumn("status", F.lit("reused"))
    return qc.batch_counts(created.unionByName(reused))


@query(
    "tree_digests",
    """WITH f AS (SELECT source AS root, lang || '/' || doc_id AS rel_path, sha256(text) AS h FROM documents),
    l AS (SELECT root, substr(sha256(rel_path), 1, 6) AS p, sha256(string_agg(rel_path || chr(10) || h, chr(10) ORDER BY rel_path || chr(10) || h)) AS g, count(*) AS n FROM f GROUP BY ALL),
    m AS (SELECT root, substr(p, 1, 3) AS p, sha256(string_agg(p || chr(10) || g, chr(10) ORDER BY p || chr(10) || g)) AS g, sum(n) AS n FROM l GROUP BY root, substr(l.p, 1, 3))
    SELECT root, sha256(string_agg(p || chr(10) || g, chr(10) ORDER BY p || chr(10) || g)) AS digest, sum(n)::BIGINT AS n_files FROM m GROUP BY root""",
)
def tree_digests(spark, d):
    files = lineage.fingerprint(table(spark, d, "documents"), "text").select(
        F.col("source").alias("root"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"),
        "sha256",
    )
    return lineage.tree_digest(files)


@query(
    "seeds_slugs_ids",
    """SELECT p_partkey,
      'song-' || rtrim(left(CASE WHEN s = '' THEN 'recording' ELSE s END, 12), '-') || '-' || left(sha256(p_name), 8) AS song_id,
      ((9223372036854775000::HUGEINT + p_partkey * 1009 + p_size) % 9223372036854775807)::VARCHAR AS seed,
      'run-' || strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * p_partkey, '%Y%m%dt%H%M%Sz') || '-' || left(sha256(p_brand), 8) AS run_id,
      strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * p_partkey, '%Y-%m-%d %H:%M:%S') AS parsed,
      p_brand || ', ' || p_name || chr(10) AS caption, p_type || chr(10) AS lyrics
    FROM (SELECT *, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)""",
)
def seeds_slugs_ids(spark, d):
    part = table(spark, d, "part")
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(p_partkey as int))")
    stem = F.concat_ws(" ", "p_name", F.concat(F.lit("("), F.col("p_type"), F.lit(")")))
    run_id = scalars.utc_id("run", at, F.substring(F.sha2("p_brand", 256), 1, 8))
    return part.select(
        "p_partkey",
        F.concat(
            F.lit("song-"), scalars.slug(stem, 12), F.lit("-"), F.substring(F.sha2("p_name", 256), 1, 8)
        ).alias("song_id"),
        scalars.candidate_seed(F.lit(9223372036854775000), "p_partkey", "p_size").cast("string").alias("seed"),
        run_id.alias("run_id"),
        F.date_format(scalars.parse_utc_id(run_id), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        scalars.caption(F.concat(F.lit(" "), F.col("p_brand")), F.concat(F.col("p_name"), F.lit(" "))).alias("caption"),
        scalars.clean_lyrics(F.concat(F.lit("\n "), F.col("p_type"), F.lit(" \n"))).alias("lyrics"),
    )


@query(
    "level_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(20 * log10(greatest(l_discount, 1e-12)), 6) AS db,
      CASE WHEN l_tax > 0 AND l_discount > 0 THEN round(1200 * log2(l_tax / l_discount), 6) END AS cents,
      round(greatest(0, 20 * log10(greatest(l_quantity / 25, 1e-12)) + 1), 6) AS reduction_db,
      round(c, 6) AS correction_db, round(CASE WHEN c < -0.01 THEN c ELSE 0 END, 6) AS vocal_adjustment_db,
      round(CASE WHEN c > 0.01 THEN -c ELSE 0 END, 6) AS instrumental_adjustment_db
    FROM (SELECT *, greatest(-12, least(12, 1.5 - (l_quantity - 25)))::DOUBLE AS c FROM lineitem)""",
)
def level_functions(spark, d):
    balance = scalars.balance_correction(F.col("l_quantity") - 25, 1.5)
    return rounded(
        table(spark, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            scalars.amplitude_db("l_discount").alias("db"),
            scalars.cents("l_tax", "l_discount").alias("cents"),
            scalars.peak_protect(F.col("l_quantity") / 25).alias("reduction_db"),
            *[balance[c].alias(c) for c in ("correction_db", "vocal_adjustment_db", "instrumental_adjustment_db")],
        )
    )


@query(
    "array_functions",
    """SELECT vec_id, len(embedding) AS n_in, 48 AS n_cut, 80 AS n_padded,
      round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 5) AS cut_sum,
      round((embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2, 6) AS mono
    FROM embeddings""",
)
def array_functions(spark, d):
    vector = F.col("embedding").cast("array<double>")
    return rounded(
        table(spark, d, "embeddings").select(
            "vec_id",
            F.size(vector).cast("long").alias("n_in"),
            F.size(scalars.fit_length(vector, 48)).alias("n_cut"),
            F.size(scalars.fit_length(vector, 80)).alias("n_padded"),
            F.round(
                F.aggregate(scalars.fit_length(vector, 48), F.lit(0.0), lambda a, x: a + x), 5
            ).alias("cut_sum"),
            scalars.set_channels(F.slice(vector, 1, 2), 1)[0].alias("mono"),
        )
    )


@query(
    "aware_instants",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN epoch_ms(date_trunc('second', ts))
      ELSE epoch_ms(date_trunc('second', ts) - INTERVAL 2 HOUR) END AS millis FROM events""",
)
def aware_instants(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+02:00")
    return table(spark, d, "events").select(
        "event_id", F.unix_millis(scalars.aware_instant(F.concat(text, offset))).alias("millis")
    )
