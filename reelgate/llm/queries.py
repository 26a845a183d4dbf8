"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgate.llm.chat import perspectives
from reelgate.llm.filter_audit import audit
from reelgate.llm.fingerprints import with_successors
from reelgate.llm.jaccard import near_duplicates
from reelgate.llm.line_dedup import with_bitmaps
from reelgate.llm.mixing import mix
from reelgate.llm.packing import pack
from reelgate.llm.prefix_trie import prefix_trie
from reelgate.llm.quality import resample
from reelgate.llm.secrets import find_secrets
from reelgate.llm.suffix_dedup import dedup_substrings
from reelgate.llm.tables import table, text_or_empty
from reelgate.llm.topk import top_k
from reelgate.llm.url_filter import judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what the mix takes of it, in training order of its first copy."""
    plan = mix(table(spark, folder, "documents"))
    first = F.try_element_at("copies", F.lit(1))["position"]
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("position")
    ).orderBy("position", "doc_id")


ORACLES["op2_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS no
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, 1 + no % 3 AS w, 3 * source_size AS lim FROM sources
), levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl,
         row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY lim::DOUBLE / w::DOUBLE, no)
), level AS (
  SELECT arg_min(lvl, place) AS lvl FROM levelled WHERE lim::DOUBLE / w::DOUBLE > lvl
), targets AS (
  SELECT source, no, source_size, least(lim::DOUBLE, coalesce(level.lvl * w, lim::DOUBLE)) AS target
  FROM levelled LEFT JOIN level ON true
), placed AS (
  SELECT doc_id, size, source_size, target, no,
         floor(target + 0.5)::BIGINT AS wanted,
         sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id) - size AS bef
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, wanted // greatest(source_size, 1) AS rounds FROM placed
), taken AS (
  SELECT *, greatest(least(wanted - rounds * source_size - bef, size), 0) AS rest,
         bef::DOUBLE / greatest(wanted, 1)::DOUBLE AS f
  FROM cut
)
SELECT doc_id, size, source_size, target, (rounds * size + rest)::BIGINT AS taken,
       CASE WHEN rounds * size + rest = 0 THEN NULL
            WHEN no % 3 = 0 THEN CASE WHEN f < 1 THEN least(f * 2 / (1 + sqrt(1.0)), 1.0) ELSE 1.0 END
            WHEN no % 3 = 1 THEN
              CASE WHEN f < 0.625 THEN least(f * 2 / (1.5 + sqrt(greatest(2.25 - 2 * f, 0))), 0.5)
                   ELSE 0.5 + least((f - 0.625) * 2 / (1.0 + sqrt(greatest(1.0 - 2 * (f - 0.625), 0))), 0.5) END
            ELSE
              CASE WHEN f * 0.78125 < 0.46875
                   THEN least(f * 0.78125 * 2 / (0.25 + sqrt(0.0625 + 2 * f * 0.78125)), 0.75)
                   ELSE 0.75 + least((f * 0.78125 - 0.46875) * 2 / (1.0 + sqrt(1.0 + 4 * (f * 0.78125 - 0.46875))), 0.25) END
       END AS "position"
FROM taken
"""


@_query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its importance weight and whether the resampling keeps it."""
    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return drawn.select("doc_id", "log_weight", "noisy_weight", "kept")


@_query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its count of lines, of dropped lines and a digest of what stays."""
    done = with_bitmaps(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "row.doc_id",
        F.size(F.split(text_or_empty("row.text"), "\n")).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLES["op3_line_dedup"] = r"""
WITH docs AS (
  -- rows of an id are one document, rows without an id are one that is smaller than all others
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id,
         string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), lines AS (
  SELECT r, doc_id, id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT id) >= 3
), judged AS (
  SELECT keyed.*, often.k IS NOT NULL AND id <> keeper AS gone
  FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


@_query
def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its set size and the smallest document it is linked to."""
    return near_duplicates(table(spark, folder, "documents"))


@_query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return pack(table(spark, folder, "documents")).drop("ids")


@_query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    return judge(table(spark, folder, "pages"))


@_query
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every dialogue from every participant's side, in segments: a digest of each segment's text
    behind the instructions carried into it, and its mask, counted from the dialogue's beginning.
    """
    seen = perspectives(table(spark, folder, "conversations"))
    span = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["length"]))
    return seen.select(
        "conv_id",
        "segment",
        "speaker",
        "n_turns",
        "n_targets",
        F.char_length("rendered").cast("long").alias("n_chars"),
        F.sha2(F.concat("context", "rendered").cast("binary"), 256).alias("rendered_sha256"),
        F.array_join(span, ",").alias("mask"),
    )


ORACLES["op6_chat"] = r"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) - 1 AS place FROM said
), people AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), seen AS (
  SELECT placed.*, place // 64 AS segment, speaker, coalesce(role = speaker, false) AS target,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
           WHEN role IS NULL THEN 'user'
           ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM placed JOIN people USING (conv_id)
), offsets AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER w - length(body) - 1)::BIGINT AS begins
  FROM seen WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY place ROWS UNBOUNDED PRECEDING)
), rendered AS (
  SELECT conv_id, segment, speaker, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE target)::BIGINT AS n_targets,
         sum(length(head) + length(body) + 1)::BIGINT AS n_chars,
         string_agg(head || body || chr(10), '' ORDER BY place) AS text,
         coalesce(string_agg(begins || ':' || length(body), ',' ORDER BY place) FILTER (WHERE target), '') AS mask
  FROM offsets GROUP BY conv_id, segment, speaker
), carried AS (
  -- the instructions of all earlier segments
  SELECT s.conv_id, s.segment, string_agg('<|im_start|>system' || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS context
  FROM (SELECT DISTINCT conv_id, segment FROM rendered) s
  JOIN placed p ON p.conv_id = s.conv_id AND p.role = 'system' AND p.place // 64 < s.segment
  GROUP BY s.conv_id, s.segment
)
SELECT conv_id, segment, speaker, n_turns, n_targets, n_chars, sha256(coalesce(context, '') || text) AS rendered_sha256, mask
FROM rendered LEFT JOIN carried USING (conv_id, segment)
"""


@_query
def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best candidates of every query row."""
    return top_k(table(spark, folder, "embeddings"))


ORACLES["op8_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's digest, its likeness to an edited text and to the next document."""
    return with_successors(table(spark, folder, "documents"))


@_query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bytes, those removed as repeated, and a digest of what stays."""
    done = dedup_substrings(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per language, order of the filters and step: what is kept, removed, redundant and lost."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM docs GROUP BY t
), judged AS (
  SELECT part,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS bad
  FROM docs JOIN firsts USING (t)
), grouped AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b
  FROM judged GROUP BY part, f
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), placed AS (
  SELECT *, list_position(list_transform(o, lambda i: f[i]), true) AS hit FROM grouped, orders
), steps AS (
  SELECT part, o, step, o[step] AS i,
         sum(n) FILTER (WHERE hit IS NULL OR hit > step) AS kept,
         sum(n) FILTER (WHERE hit = step) AS removed,
         sum(n) FILTER (WHERE f[o[step]] AND hit < step) AS redundant,
         sum(n) FILTER (WHERE f[o[step]] AND len(list_filter(f, lambda y: y)) = 1) AS unique_fails,
         sum(g) FILTER (WHERE hit = step) AS good_lost, sum(b) FILTER (WHERE hit = step) AS toxic_lost
  FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step::INTEGER AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM steps
"""


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations with the totals of its subtree."""
    return prefix_trie(table(spark, folder, "conversations")).drop("node", "parent")


ORACLES["op12_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  -- the CRC-32 of the decimal id, bit by bit
  SELECT conv_id AS c, conv_id - conv_id % 20 AS donor, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
           lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)),
             lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), heads AS (
  SELECT c, p, role, text FROM convs JOIN own ON own.conv_id = donor AND p < h
), joined AS (
  SELECT c, 0 AS side, p, role, text FROM heads
  UNION ALL SELECT c, 1, p, role, text FROM convs JOIN own ON own.conv_id = c AND p >= h
), rebuilt AS (
  SELECT *, row_number() OVER w AS d,
         md5(to_json(list({r: role, t: text}) OVER (w ROWS UNBOUNDED PRECEDING))::VARCHAR) AS node
  FROM joined WINDOW w AS (PARTITION BY c ORDER BY side, p)
), chained AS (
  SELECT c, d, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), 'root') AS parent,
         lead(node) OVER (PARTITION BY c ORDER BY d) IS NULL AS stops,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
  UNION ALL SELECT c, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.c = convs.c), 0 FROM convs
), nodes AS (
  SELECT node, any_value(parent) AS parent, d, min(c) AS conv_id, count(*) AS n_convs,
         bool_and(stops) AS leaf, (count(*) - 1) * any_value(words) AS saved,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stops), '') AS ends
  FROM chained GROUP BY node, d
), under AS (
  -- every node with the nodes above it, found through its smallest member
  SELECT a.node AS top, n.node, n.leaf, n.saved
  FROM nodes n JOIN chained a ON a.c = n.conv_id AND a.d <= n.d
), totals AS (
  SELECT top AS node, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens FROM under GROUP BY top
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN totals USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""


@_query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets by fixed patterns and by the field taught on them."""
    found = find_secrets(table(spark, folder, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")
