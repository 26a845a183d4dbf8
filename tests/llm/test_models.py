"""Mixing, quality, URLs, chat, packing, search and fingerprints."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from samples import PROSE, edge_rows, rows
from oracle import _rows, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelgate.llm import fingerprints, topk
from reelgate.llm.chat import perspectives
from reelgate.llm.mixing import _position, mix, mixed_documents
from reelgate.llm.packing import pack
from reelgate.llm.quality import keep_good, kth_largest, resample
from reelgate.llm.queries import ORACLES, QUERIES
from reelgate.llm.tokens import encode
from reelgate.llm.url_filter import hashed, judge, longest_rule, parts, train

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    found = QUERIES[name](spark, SAMPLE)
    ours = _rows(found.columns, [tuple(r) for r in found.collect()])
    result = connect(SAMPLE).execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert ours == _rows(columns, result.fetchall()) and ours


def test_mix_reaches_its_targets(documents):
    data = [(i, f"{PROSE} w{i}", "en", "abcdefg"[i % 7] if i % 9 else None, None) for i in range(90)]
    data += [(i, PROSE, "en", "tiny", None) for i in range(90, 92)]
    plan = mix(documents(data)).collect()
    total = sum(r.size for r in plan)
    by = {}
    for r in plan:
        assert r.taken <= 3 * r.size and sum(c.words for c in r.copies) == r.taken
        assert all(0 <= c.position <= 1 for c in r.copies)
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 0.5 + 1e-9 and target <= 3 * size
    assert sum(t for _, t, _ in by.values()) == pytest.approx(total)
    mixed = mixed_documents(documents(data, extra=True))
    assert mixed.columns == documents(data, extra=True).columns
    words = mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert words == sum(t for t, _, _ in by.values())


def test_mix_of_edge_rows(documents):
    data = edge_rows()
    plan = mix(documents(data, extra=True)).collect()
    assert len(plan) == len(data) and all(r.taken == 0 for r in plan if r.size == 0)
    again = mix(documents(data)).collect()
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert mix(documents([])).count() == 0 and mixed_documents(documents([])).count() == 0
    assert sum(r.taken for r in mix(documents([(1, None, "x", "a", 0)])).collect()) == 0


def test_positions_invert_the_integrated_curve(spark):
    curve = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    at = spark.range(101).select((F.col("id") / 100).alias("f"))
    for f, t in at.select("f", _position(F.col("f"), F.lit(0), [curve])).collect():
        grid = np.linspace(0, t, 2001)
        height = np.interp(grid, *zip(*curve, strict=True))
        area = float(((height[1:] + height[:-1]) / 2 * np.diff(grid)).sum())
        assert area == pytest.approx(f, abs=1e-6)


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    # half of the labels teach, the other half judges
    held = labels.where("doc_id % 2 = 1")
    drawn = resample(docs, labels.where("doc_id % 2 = 0")).join(held, "doc_id").collect()
    good = [r.kept for r in drawn if r.quality == 1]
    bad = [r.kept for r in drawn if r.quality == 0]
    # half of the labels are few: 85 documents teach
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 20


def test_quality_of_edge_rows(spark, documents):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    data = edge_rows()
    assert resample(documents(data, extra=True), labels).count() == len(data)
    none = labels.limit(0)
    assert keep_good(documents(data, extra=True), none).count() == len(data)
    assert keep_good(documents([]), labels).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 2**40, -(2**50), 5, 0, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [kth_largest(df, "v", k) for k in range(1, 10)] == sorted(values, reverse=True)


def test_url_rules_and_model(spark):
    urls = [
        ("http://a.example.org/es/1", "example.org", "example.org/es/", "block"),
        ("http://Example.ORG/en/12?x#y", "example.org", "example.org/en/1", "block"),
        ("https://x.org/", "x.org", "org/", "allow"),
        ("https://x.com/de/q", "x.com", "com/de/", "block"),
        ("http://org/", "org", "org/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in judge(df).collect()}
    for i, (_, host, rule, verdict) in enumerate(urls):
        assert got[i].host.endswith(host) and (got[i].rule, got[i].verdict) == (rule, verdict)
    odd = [None, "", "no scheme", "http://", "http://x.org", "x://é" + "a" * 50_000 + "/de/" * 2000, "http://notorg/"]
    data = spark.createDataFrame([(None if i == 0 else 1, u, "x") for i, u in enumerate(odd)], "page_id long, url string, host string")
    rows_ = judge(data).collect()
    assert len(rows_) == len(odd) and all(r.verdict in ("allow", "block") and r.rule is None for r in rows_)
    assert all((r.host, r.path) == ("", "") for r in rows_ if r.page_id is None)
    assert judge(data.limit(0)).count() == 0


def test_url_model_on_held_out_urls(spark):
    host, path = parts(F.col("url"))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    _, verdict = longest_rule(F.col("host"), F.col("path"))
    known = pages.withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
    model = train(known.where("page_id % 3 > 0"))
    held = model.transform(hashed(known.where("page_id % 3 = 0")))
    right = held.select(F.avg(((F.col("verdict") == "block") == (F.col("prediction") == 1)).cast("double"))).first()[0]
    # 665 URLs teach, a quarter of the others is blocked; 0.936 when this was written
    assert right > 0.9


def test_chat_edge_rows(spark):
    turns = [
        (1, 0, "system", "rules"), (1, 1, "ann b", "hi"), (1, 2, "bob", None), (1, 2, "bob", None),
        (1, None, "ann b", "late"), (1, 3, None, "who"), (1, 200, "bob", "far"), (None, 0, "ann", "lost"), (2, 0, "system", "only"),
    ]
    df = spark.createDataFrame(
        [(*t, "x", "y", "z", "v") for t in turns],
        "conv_id long, turn long, role string, text string, speaker string, segment string, context string, rules string",
    )
    got = {(r.conv_id, r.segment, r.speaker): r for r in perspectives(df).collect()}
    assert set(got) == {(1, 0, "ann b"), (1, 0, "bob")}
    seen = got[1, 0, "bob"]
    assert seen.n_turns == 6 and "<|im_start|>user name=ann_b\nhi<|im_end|>" in seen.rendered
    assert [seen.rendered[m.start : m.start + m.length] for m in seen.mask] == ["<|im_end|>", "far<|im_end|>"]
    other = got[1, 0, "ann b"]
    assert [other.rendered[m.start : m.start + m.length] for m in other.mask] == ["hi<|im_end|>", "late<|im_end|>"]
    assert perspectives(df.limit(0)).count() == 0


def plain_views(turns, segment):
    """The whole rendering and mask of every participant, and the instructions before each segment."""
    order = lambda t: (t[1] is None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or "")
    views = {}
    for conv in {t[0] for t in turns}:
        said = sorted({t for t in turns if t[0] == conv}, key=order)
        for who in {t[2] for t in said} - {None, "system"}:
            text, mask, rules = "", [], []
            for i, (_, _, role, words) in enumerate(said):
                if i % segment == 0:
                    rules.append("".join(f"<|im_start|>system\n{t[3]}<|im_end|>\n" for t in said[:i] if t[2] == "system"))
                name = "assistant" if role == who else role if role == "system" else f"user name={role}" if role else "user"
                text += f"<|im_start|>{name}\n"
                body = (words or "") + "<|im_end|>"
                mask += [(len(text), len(body))] if role == who else []
                text += body + "\n"
            views[conv, who] = text, mask, rules
    return views


def long_dialogues():
    turns = [(1, 0, "system", "rules"), (1, 1, "guest", "only once \U0001f600"), (1, 90, "system", "more rules"), (1, None, "bob", "late")]
    turns += [(1, i, ("ann", "bob", None)[i % 3], f"word {i}" if i % 5 else None) for i in range(2, 150) if i != 90]
    turns += [(1, 100, "ann", f"many at once {i}") for i in range(70)]
    return turns + [(2, -3, "ann", "x"), (2, 64, "bob", "y"), (2, None, "eve", "z")]


def check_whole_dialogues(spark):
    turns = long_dialogues()
    df = spark.createDataFrame([*turns, turns[0]], "conv_id long, turn long, role string, text string")
    wanted = plain_views(turns, 64)
    got = {}
    for r in sorted(perspectives(df).collect(), key=lambda r: r.segment):
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    assert set(got) == set(wanted)
    for key, parts_ in got.items():
        text, mask, rules = wanted[key]
        assert [r.segment for r in parts_] == list(range(len(rules))) and max(r.n_turns for r in parts_) <= 64
        assert "".join(r.rendered for r in parts_) == text and [r.context for r in parts_] == rules
        assert [(m.start, m.length) for r in parts_ for m in r.mask] == mask
        assert all(text[r.start :].startswith(r.rendered) and r.n_targets == len(r.mask) for r in parts_)


def test_chat_renders_whole_dialogues(spark):
    check_whole_dialogues(spark)


def test_chat_renders_whole_dialogues_in_chunks(spark):
    spark.conf.set("reelgate.groupRows", "5")
    try:
        check_whole_dialogues(spark)
    finally:
        spark.conf.unset("reelgate.groupRows")


def test_chat_query_covers_every_participant(spark, tmp_path):
    turns = long_dialogues()
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.conv_id, r.segment, r.speaker): r for r in QUERIES["op6_chat"](spark, str(tmp_path)).collect()}
    for (conv, who), (text, mask, rules) in plain_views(turns, 64).items():
        mine = [found.pop((conv, i, who)) for i in range(len(rules))]
        assert sum(r.n_chars for r in mine) == len(text)
        assert ",".join(r.mask for r in mine if r.mask) == ",".join(f"{a}:{n}" for a, n in mask)
    assert not found
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(ORACLES["op6_chat"])
    rows_ = QUERIES["op6_chat"](spark, str(tmp_path))
    assert _rows([c[0] for c in result.description], result.fetchall()) == _rows(rows_.columns, [tuple(r) for r in rows_.collect()])


def check_packing(pieces, texts, window):
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: vocabulary.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    by, sequences = {}, {}
    for r in pieces:
        ids = wanted[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(wanted[r.doc_id])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in wanted.items():
        ends = [s + n for s, n in sorted(by[i])]
        assert [s for s, _ in sorted(by[i])] == [0, *ends[:-1]] and ends[-1] == len(ids)
    fill = []
    for parts_ in sequences.values():
        ends = [o + n for o, n in sorted(parts_)]
        assert [o for o, _ in sorted(parts_)] == [0, *ends[:-1]] and ends[-1] <= window
        fill.append(ends[-1])
    return fill


def test_packing_round_trip(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SAMPLE}/documents.parquet'").fetchall()
    fill = check_packing(QUERIES["op7_packing"](spark, SAMPLE).collect(), texts, 2048)
    assert sum(n < 2048 for n in fill) <= 1


def test_packing_merges_many_leftovers(documents):
    data = rows(*[f"{PROSE} {i}" for i in range(60)])
    fill = check_packing(pack(documents(data).repartition(11), window=256, most_open=2, group=3).collect(), [(r[0], r[1]) for r in data], 256)
    assert sum(n < 256 for n in fill) <= 1


def test_packing_edge_rows(documents):
    data = edge_rows()
    pieces = pack(documents(data, extra=True), with_ids=True).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in data}
    assert sum(r.length for r in pieces if r.doc_id == 3) == 2 * [r for r in pieces if r.doc_id == 3][0].doc_tokens
    assert all(len(r.ids) == 4 * r.length for r in pieces)
    assert [r.length for r in pieces if r.doc_id == 1] == [1] and pack(documents([])).count() == 0


def test_token_ids_are_the_vocabularys():
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a <|endoftext|> b\r\n\x0b  é", "x" * 5000, " " * 3000 + "y", "日本語 \u200b\U0001f600 it's we'll 12 345"):
        assert encode(text).tolist() == vocabulary.encode(text, add_special_tokens=False).ids


def test_search_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5, 0.25]), (20, [0.5, 0.25]), (1, [0.1, -0.3]), (2, [0.1, -0.3]), (2, [0.1, -0.3]), (3, None), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (40, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<float>, label int, shard string")
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q, v = (32, 16), {0: (32, 16), 20: (32, 16), 1: (6, -20), 2: (6, -20)}
    for own in (0, 20):
        scored = sorted((-(q[0] * x + q[1] * y), i) for i, (x, y) in v.items() if i != own)
        assert sorted(got[own]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got[40] == [(1, 8, 64 * 64 * 4)] and set(got) == {0, 20, 40}
    assert topk.top_k(df.limit(0)).count() == 0


def test_search_prunes_but_stays_exact():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 60
    vectors = np.round(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 3).astype(np.int64)
    order, spans, nodes, radii = topk.ball_tree(vectors)
    ids = np.arange(3000)[order]
    queries, names = vectors[::100], np.arange(0, 3000, 100)
    best = topk.search(names, queries, np.full(30, topk.NOTHING), ids, vectors[order], (spans, nodes, radii), 20)
    scores = (queries @ vectors.T).astype(float)
    scores[np.arange(30), names] = -np.inf
    for i in range(30):
        wanted = np.lexsort((np.arange(3000), -scores[i]))[:20]
        assert best.ids[i].tolist() == wanted.tolist()


@pytest.mark.parametrize("size", [0.3, 2.0**20, 2.0**26, 2.0**40])
def test_search_scores_are_exact_integers(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "LEAST_SHARD", 8)
    rng = np.random.default_rng(5)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * size]) for i in range(70)]
    # the last ones repeat, so that ties are decided by id
    data += [(i, data[i - 70][1]) for i in range(70, 80)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=7).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in data}
    limit = 2**63 - 1

    def score(a, b):
        return max(-limit, min(limit, sum(x * y for x, y in zip(whole[a], whole[b]))))

    for q in range(0, 80, 20):
        want = sorted((-score(q, i), i) for i in whole if i != q)[:7]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_fingerprints_on_the_sample(spark):
    docs = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SAMPLE}/documents.parquet'").fetchall(), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, SAMPLE).collect()}
    seen = {}
    for at, (doc_id, text) in enumerate(docs):
        after = docs[(at + 1) % len(docs)]
        r, half = got[doc_id], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert r.edited_sha256 == __import__("hashlib").sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
        assert r.near_next == fingerprints.likeness(
            fingerprints.from_text(r.fingerprint), fingerprints.from_text(got[after[0]].fingerprint)
        )
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.median([r.near_edited for r in long]) > 0.3 > np.median([r.near_next for r in long]) + 0.2


def test_levels_against_counting():
    text = ("hello wörld " * 12 + "a" * 90 + "xyz" * 9).encode()
    found = fingerprints.levels(np.frombuffer(text + b"\n", dtype=np.uint8))
    for at in range(len(text) - 63):
        counts = np.bincount(np.frombuffer(text[at : at + 64], dtype=np.uint8))
        total = int(fingerprints._weights[counts].sum())
        assert found[at] == 1000 - total * 1000 // fingerprints._MOST


def random_prose(rng, size):
    return bytes(rng.choice(np.frombuffer(b"etaoin shrdlu cmfwyp", dtype=np.uint8), size))


def test_fingerprints_of_short_texts_see_every_byte():
    rng = np.random.default_rng(6)
    texts = [random_prose(rng, size) for size in (100, 120, 141, 160, 180) for _ in range(40)]
    ranks = fingerprints.rarity(np.arange(1001))
    own = fingerprints.digests(texts, ranks)
    for at in (0.0, 0.999):
        edited = [t[: (p := int(at * len(t)))] + b"#" + t[p + 1 :] for t in texts]
        scores = [fingerprints.likeness(a, b) for a, b in zip(own, fingerprints.digests(edited, ranks), strict=True)]
        # an edited end is seen, and leaves most of the rest
        assert max(scores) < 1.0 and np.median(scores) > 0.4


def test_short_texts_are_not_found_in_long_ones_by_chance():
    rng = np.random.default_rng(7)
    ranks = fingerprints.rarity(np.arange(1001))
    (long,) = fingerprints.digests([random_prose(rng, 200_000)], ranks)
    shorts = fingerprints.digests([random_prose(rng, size) for size in (30, 64, 100, 141) for _ in range(50)], ranks)
    scores = np.array([fingerprints.likeness(s, long) for s in shorts]).reshape(4, 50)
    assert len(long) > 10 and (np.median(scores, axis=1) < 0.15).all()


def test_fingerprints_of_edge_rows(documents):
    data = edge_rows()
    got = fingerprints.with_successors(documents(data, extra=True)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "" and by[3].fingerprint == by[4].fingerprint != ""
    assert by[4].near_next == 1.0 and by[2].near_next == 1.0  # 2 is followed by 1, both empty
    assert fingerprints.with_successors(documents([])).count() == 0
    one = fingerprints.with_successors(documents([(1, PROSE, "en", "a", 1)])).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprints(documents(data)).count() == len(data)
