"""Secret scans, the prefix trie and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from samples import PROSE, edge_rows

from reelgate.llm import secrets
from reelgate.llm.filter_audit import audit
from reelgate.llm.prefix_trie import SpillingQueue, prefix_trie
from reelgate.llm.queries import QUERIES

#: The smallest sample with secrets.
SAMPLE = "/root/testdata/sf0.01"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(spans)


def as_text(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_against_plain_patterns():
    draw = random.Random(5)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "passwd", "ſecret", "toKen", "=", ":", " ", '"', "'", "é", "\n"]
    parts += ["AKIA", "AKIAABCDEFGHIJKL", "abcdef0123456789", "a" * 16, "x.y/z+_-", "Z9", "==", "  ", "12345678", "secrettoken"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(3000)]
    texts += ["token" + " " * 50_000 + ":" + " " * 50_000 + "abcdefgh", "token=a token==bcdefghi", "=" * 1000 + ":abcdefghi", ""]
    for begin in range(0, len(texts), 7):
        part = texts[begin : begin + 7]
        tokens = secrets.tokens_of([t.encode() for t in part])
        rows = secrets._rows(np.arange(len(part)), tokens, secrets.base_spans(tokens), [])
        assert [r[4] for r in rows] == [as_text(plain_base(t)) for t in part]


def all_scores(field, scores):
    """Score of every sequence of tags, outside before and after."""
    full = np.concatenate([scores, np.zeros((len(scores), 1))], 1)
    for tags in itertools.product(range(3), repeat=len(scores)):
        steps = zip((secrets.O, *tags), (*tags, secrets.O), strict=True)
        yield sum(field.changes[a, b] for a, b in steps) + sum(full[i, t] for i, t in enumerate(tags)), tags


def test_viterbi_finds_the_best_tags():
    rng = np.random.default_rng(1)
    for _ in range(60):
        field = secrets.Field(np.zeros((1, 2)), rng.normal(size=(3, 3)) * 2)
        owner = np.repeat(np.arange(4), rng.integers(0, 6, size=4))
        scores = rng.normal(size=(len(owner), 2)) * 4 - 4
        tags = secrets.decode(field, scores, owner)
        for text in np.unique(owner):
            best = max(all_scores(field, scores[owner == text]))[1]
            assert tuple(tags[owner == text]) == best


def test_likelihood_and_gradient_against_enumeration():
    rng = np.random.default_rng(2)
    field = secrets.Field(rng.normal(size=(secrets.BUCKETS + 1, 2)), rng.normal(size=(3, 3)))
    buckets = rng.integers(0, 40, size=(3, 4, 2))
    tags = np.array([[2, 0, 1, -1], [0, 2, 2, 0], [0, -1, -1, -1]])

    def plain():
        total = 0.0
        for rows, marks in zip(buckets, tags, strict=True):
            size = (marks >= 0).sum()
            found = {t: s for s, t in all_scores(field, field.weights[rows[:size]].sum(1))}
            total += found[tuple(marks[:size])] - np.logaddexp.reduce(list(found.values()))
        return total / len(tags)

    value, by_score, by_change = secrets.likelihood(field, buckets, tags)
    assert value == pytest.approx(plain())
    step = 1e-5
    for a, b in itertools.product(range(3), repeat=2):
        field.changes[a, b] += step
        up = plain()
        field.changes[a, b] -= 2 * step
        assert by_change[a, b] == pytest.approx((up - plain()) / 2 / step, abs=1e-6)
        field.changes[a, b] += step
    for bucket in np.unique(buckets[0]):
        field.weights[bucket, 0] += step
        up = plain()
        field.weights[bucket, 0] -= 2 * step
        slope = (by_score[:, :, 0] * (buckets == bucket).sum(2)).sum()
        assert slope == pytest.approx((up - plain()) / 2 / step, abs=1e-6)
        field.weights[bucket, 0] += step


def test_field_finds_what_patterns_do_not(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    field = secrets.train(docs)
    draw = random.Random(3)
    words = PROSE.split()

    def said(middle):
        return " ".join(draw.sample(words, 30)) + " " + middle + " " + " ".join(draw.sample(words, 30))

    hidden = ["".join(draw.choice("0123456789ABCDEF") for _ in range(31)) for _ in range(40)]
    texts = [said(f'{draw.choice(["credential", "auth", "pin"])} = "{h}"') for h in hidden]
    clean = [said(x) for x in ("une.92@mail6.example.com", "+1 (545) 555-1234", "http://a.example.org/p/12345", "7844238401328224")]
    data = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts + clean)]
    rows = secrets.scan(spark.createDataFrame(data, docs.schema.simpleString()[7:-1].replace(":", " ")), field).collect()
    found = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in rows}
    caught = sum(any(texts[i][a:b] == h for a, b in found[i]) for i, h in enumerate(hidden))
    assert caught >= 0.9 * len(hidden) and not any(found[len(texts) + i] for i in range(len(clean)))
    assert all(r.n_assign == r.n_access == r.n_hex == 0 and r.base == "" for r in rows)


def test_secret_query_on_the_sample(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SAMPLE}/documents.parquet'").fetchall())
    rows = QUERIES["op11_secret_scan"](spark, SAMPLE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert set(as_text(base).split(",")) <= set(r.spans.split(",")) or not base
    assert sum(bool(r.n_assign) for r in rows) > 0


def test_secrets_of_edge_rows(spark, documents):
    data = edge_rows() + [(8, "é token: abcdefghi", "en", None, 1)] * 2
    got = secrets.find_secrets(documents(data, extra=True)).collect()
    want = [(r[0], as_text(plain_base(r[1] or ""))) for r in data]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.base)) for r in got)
    again = secrets.find_secrets(documents(data)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert secrets.find_secrets(documents([])).count() == 0
    assert secrets.train(documents([(1, "nothing here", "en", "a", 1)])) is None


def test_spilling_queue_keeps_order():
    draw = random.Random(4)
    queue, held = SpillingQueue(8), []
    for number in range(5000):
        if held and draw.random() < 0.4:
            key, value = queue.pop()
            assert key == min(held)[0] and (key, value) in held
            held.remove((key, value))
        else:
            item = ((-draw.randrange(20), str(draw.randrange(30))), number)
            queue.push(*item)
            held.append(item)
        assert queue.head() == (min(held)[0] if held else None)
    assert queue.spills > 10
    while held:
        key, value = queue.pop()
        assert key == min(held)[0]
        held.remove((key, value))
    assert queue.head() is None


def plain_trie(data):
    said = {}
    for conv, turn, role, text in data:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(turns)] for c, turns in said.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c > 0 else -1)
        whole[c] = own.get(donor, [])[:h] + turns[h:]
    held = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            held.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, convs in held.items():
        under = [n for n in held if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(held[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        above = min(held[node[:-1]]) if node else None
        rows.append((min(convs), len(node), above, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def trie_rows(spark, data, **options):
    df = spark.createDataFrame(data, TURNS)
    for name in ("node", "path", "place", "shard", "n", "head", "words"):
        df = df.selectExpr("*", f"'x' AS {name}")
    rows = prefix_trie(df, **options).drop("node", "parent").collect()
    return sorted((tuple(r) for r in rows), key=str)


def random_turns(seed, convs=120):
    draw = random.Random(seed)
    data = []
    for conv in range(-3, convs):
        for turn in range(draw.randrange(12)):
            data.append((conv, turn, draw.choice("us"), draw.choice(["a", "b c", "b c"])))
    return data


@pytest.mark.parametrize("options", [{}, {"shard": 3, "held": 2}])
def test_trie_against_a_plain_version(spark, options):
    data = random_turns(1)
    # one deep conversation, and one that many repeat
    data += [(1000 + c, t, "u", f"t {t}") for c in (0, 3) for t in range(90 + c)]
    data += [(1100 + c, t, "s", "same words") for c in range(40) for t in range(9)]
    assert trie_rows(spark, data, **options) == plain_trie(data)


def test_trie_in_chunks(spark, tiny_chunks):
    data = random_turns(2, 50)
    assert trie_rows(spark, data, shard=40) == plain_trie(data)


def test_trie_of_edge_rows(spark):
    data = [
        (20, None, "u", "null first"),
        (20, 0, None, None),
        (20, 0, None, None),
        (20, 0, "u", "b"),
        (20, 0, "u", "a"),
        (21, 5, "u", ""),
        (23, 1, "u", "only one"),
        (43, 1, "u", "no donor"),
        (None, 1, "u", "no conversation"),
        (2**60 + 1, 0, "u", " ".join(["long"] * 200_000)),
    ]
    assert trie_rows(spark, data) == plain_trie(data)
    assert trie_rows(spark, []) == []


def plain_audit(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[n] == 1} for n in (0, 1))
    judged = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            letter
            for letter, bad in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    re.search(r"[#$%&*|]", t),
                    i is not None and t in first and first[t] < i,
                ),
                strict=True,
            )
            if bad
        )
        judged.append((lang or "", fails, i in good, i in toxic))
    rows = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        orders = ["".join(o) for o in itertools.permutations("ABCDE")]
        hit = {o: [next((s for s, x in enumerate(o, 1) if x in j[1]), 9) for j in mine] for o in orders}
        shapley = {x: sum(h == o.index(x) + 1 for o in orders for h in hit[o]) for x in "ABCDE"}
        for o in orders:
            for step, x in enumerate(o, 1):
                here = [j for j, h in zip(mine, hit[o], strict=True) if h == step]
                earlier = sum(x in j[1] and h < step for j, h in zip(mine, hit[o], strict=True))
                alone = sum(j[1] == x for j in mine)
                kept = sum(h > step for h in hit[o])
                rows.append((part, o, step, kept, len(here), earlier, alone, sum(j[2] for j in here), sum(j[3] for j in here), shapley[x]))
    return sorted(rows)


def test_audit_of_edge_rows(spark, documents):
    data = edge_rows()
    data += [(20 + i, " ".join(["Word"] * (150 + 10 * i)), None if i % 3 else "", None, 0) for i in range(12)]
    data += [(40 + i, "copies of one text " + PROSE * 3, "en", "a", 0) for i in range(30)]
    data += [(None, "copies of one text " + PROSE * 3, "en", "a", 0), (60, "50 % off", "de", "a", 0)]
    known = [(3, 1, 0), (20, 1, 1), (20, 0, 0), (41, 0, 1), (None, 1, 1), (5, None, None)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = audit(documents(data, extra=True), labels).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(data, known)
    assert audit(documents([]), labels).count() == 0
    assert len(audit(documents(data), labels.limit(0)).collect()) == len(got)


def test_audit_salts_large_groups_of_copies(spark, documents, monkeypatch):
    monkeypatch.setattr("reelgate.llm.filter_audit.COPIES", 4)
    data = [(i, "one text" if i % 3 else "another", "en", "a", 0) for i in range(60)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in audit(documents(data), labels).collect()) == plain_audit(data, [])
