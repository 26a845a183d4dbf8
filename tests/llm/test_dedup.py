"""Substring, line and near-duplicate removal against plain versions."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from samples import DOCS, PROSE, edge_rows, rows

from reelgate.llm import hashing, jaccard, suffix_dedup
from reelgate.llm.bwt import collection_bwt, repeated_windows
from reelgate.llm.components import components
from reelgate.llm.jaccard import near_duplicates, one_of_each
from reelgate.llm.line_dedup import dedup_lines, with_bitmaps
from reelgate.llm.queries import ORACLES, QUERIES
from reelgate.llm.suffix_dedup import dedup_substrings

SAMPLE = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample_texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SAMPLE}/documents.parquet' ORDER BY 1").fetchall()


def plain_removal(docs, size=100):
    seen, out = set(), {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - size + 1):
            window = raw[at : at + size]
            if window in seen:
                gone[at : at + size] = b"\1" * size
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(raw), sum(gone), spans, kept)
    return out


def removal(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(df, **options).collect()}


def test_transform_and_prefixes_of_random_strings():
    rng = random.Random(1)
    for _ in range(60):
        strings = ["".join(rng.choices("abc", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 8))]
        order = sorted(
            (tuple(c + 1 for c in s[i:]) + (0, n), n, i) for n, s in enumerate(strings) for i in range(len(s) + 1)
        )
        bwt, lcp = collection_bwt(strings)
        assert bwt.tolist() == [strings[n][i - 1] + 1 if i else 0 for _, n, i in order]
        bare = [o[0][:-2] for o in order]
        common = [0] + [
            next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            for a, b in zip(bare[:-1], bare[1:], strict=True)
        ]
        assert lcp.tolist() == common
        group, owner, offset = repeated_windows(strings, 3)
        found = {}
        for g, o, f in zip(group, owner, offset, strict=True):
            found.setdefault(g, set()).add((o, f))
        wanted = {}
        for n, s in enumerate(strings):
            for i in range(len(s) - 2):
                wanted.setdefault(s[i : i + 3], set()).add((n, i))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in wanted.values() if len(v) > 1)


def test_substrings_on_the_sample(spark):
    wanted = plain_removal(sample_texts())
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, SAMPLE).collect()}
    assert got.keys() == wanted.keys()
    for doc_id, (size, gone, spans, kept) in wanted.items():
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, gone, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [1, 50_000])
def test_substrings_in_ever_new_contexts(documents, hot):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    passage = noise(150)
    texts = [noise(rng.randint(0, 200)) + passage + noise(rng.randint(0, 200)) for _ in range(40)]
    texts += ["ab" * 200, "c" * 400, texts[0], texts[1] + texts[2], passage[:99], passage[:100]]
    data = rows(*texts)
    assert removal(documents(data), hot=hot) == plain_removal([(r[0], r[1]) for r in data])


def test_substrings_of_edge_rows(documents):
    data = edge_rows()
    got = {}
    for r in dedup_substrings(documents(data, extra=True)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, bytes(r.kept)))
    # without an id comes first; the repeated row is the same document
    wanted = plain_removal(sorted({(r[0] if r[0] is not None else -1, r[1]) for r in data}, key=lambda r: r[0]))
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    for doc_id, results in got.items():
        size, gone, _, kept = wanted[-1 if doc_id is None else doc_id]
        assert set(results) == {(size, gone, kept)}


def test_substrings_of_rows_in_another_order_each_run(spark, monkeypatch):
    def dealt_anew(batches):
        yield pd.concat(list(batches)).sample(frac=1, random_state=np.random.default_rng())

    data = [(i, PROSE * 3, "en", "a", None) for i in range(40)]
    df = spark.createDataFrame(data, DOCS).coalesce(1)
    monkeypatch.setattr(suffix_dedup, "SETTLED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = removal(df.mapInPandas(dealt_anew, df.schema))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == plain_removal([r[:2] for r in data])


def test_substrings_of_nothing(documents):
    assert dedup_substrings(documents([])).count() == 0


def plain_lines(docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    held = {}
    for doc_id, text in docs:
        for line in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(line, set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == own]
        out.append((doc_id, len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_of(df):
    done = with_bitmaps(df.select("doc_id", "text"))
    return [
        (r.doc_id, r.dropped or 0, r.kept_text or "") for r in done.select("row.doc_id", "dropped", "kept_text").collect()
    ]


def _sorted(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_lines_against_a_plain_version(documents):
    rng = random.Random(2)
    common = [f"This common line has number {i}" for i in range(6)] + ["short", ""]
    texts = []
    for _ in range(60):
        lines = rng.choices(common, k=rng.randint(0, 6)) + [f"own line {rng.random()} of it"]
        rng.shuffle(lines)
        texts.append("\n".join(rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \r"]) for x in lines))
    data = rows(*texts, None, "", "\n\n", common[0], common[0], f"{common[0]}\n{common[0]}")
    assert _sorted(lines_of(documents(data))) == _sorted(plain_lines([(r[0], r[1]) for r in data]))


def test_lines_of_a_hot_key_span_slices(documents):
    hot = "a line that everybody has got in here"
    data = rows(*[f"{hot}\nown text number {i} is here" for i in range(700)])
    got = lines_of(documents(data))
    assert sorted(d for d, n, _ in got if n == 0) == [699] and sum(n for _, n, _ in got) == 699


def test_lines_of_edge_rows(documents):
    data = edge_rows()
    out = dedup_lines(documents(data, extra=True))
    assert out.columns == documents(data, extra=True).columns and out.count() == len(data)
    # three rows of two documents hold the prose, which is too few
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[3] == kept[4] == PROSE and kept[1] is None
    kept = {r.doc_id: r.text for r in dedup_lines(documents(data + [(9, PROSE, "en", "a", 1)])).collect()}
    assert kept[3] == kept[4] == "" and kept[9] == PROSE
    assert dedup_lines(documents([])).count() == 0


def test_lines_of_repeated_rows_agree_with_sql(spark, documents, tmp_path):
    line = "a line of more than twenty characters"
    data = [(1, line, "en", "a", 1), (1, line, "en", "a", 1), (2, line, "en", "a", 1)]
    data += [(i, f"{line} too\nown {i}", "en", "a", 1) for i in (5, 5, 6, None, None)]
    data += [(7, None, "en", "a", 1), (None, None, "en", "a", 1), (8, "x" * 30 + "\n" + " " * 30, "en", "a", 1)]
    documents(data).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_line_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op3_line_dedup"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    dropped = {r.doc_id: r.n_dropped for r in got.collect()}
    assert dropped[1] == dropped[2] == 0 and dropped[5] == dropped[None] == 1 and dropped[6] == 0


def test_lines_of_long_blanks(documents):
    texts = [" " * 300_000 + "x\n" + "\t" * 300_000 + f"the same line in all of them{' ' * 100_000}" for _ in range(4)]
    begin = time.time()
    got = lines_of(documents(rows(*texts)))
    assert sorted(n for _, n, _ in got) == [0, 1, 1, 1]
    # in proportion to the length: minutes if every blank were tried from every other
    assert time.time() - begin < 60


def plain_components(docs, size=4, percent=85):
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


def found_components(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **options).collect()}


def test_near_duplicates_on_the_sample(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard"](spark, SAMPLE).collect()}
    assert got == plain_components(sample_texts())


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_chains_of_edits(documents, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 8)  # pairs across components in several cells
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(50):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    chain = list(base)
    for i in range(12):  # each close to the one before, the ends far apart
        chain[7 * i] = f"y{i}"
        texts.append(" ".join(chain))
    texts += ["", None, "one", "ONE", "one two", "a b c d", "a b c d e", "A b\tc  d\n"]
    data = rows(*texts)
    assert found_components(documents(data), percent=percent, size=size) == plain_components(
        [(r[0], r[1]) for r in data], size, percent
    )


def test_near_duplicates_of_edge_rows(documents):
    data = edge_rows()
    found = near_duplicates(documents(data, extra=True)).collect()
    assert len(found) == len(data)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert by[3] == by[4] == (97, 3) and by[1] == (0, 1) and by[6] == (0, 6) and by[None][1] is None
    kept = one_of_each(documents(data, extra=True))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 5, 6, 7], key=str)
    assert kept.columns == documents(data, extra=True).columns
    assert near_duplicates(documents([])).count() == 0


def test_one_id_with_several_texts(documents):
    other = " ".join(f"other{i}" for i in range(100))
    third = " ".join(f"third{i}" for i in range(100))
    data = [(1, PROSE), (2, PROSE), (2, other), (5, other + " more"), (7, third), (7, ""), (8, third + " more"), (9, ""), (3, "alone")]
    found = near_duplicates(documents([(i, t, "en", "a", 1) for i, t in data])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(
        [(1, 97, 1), (2, 97, 1), (2, 97, 1), (5, 98, 1), (7, 97, 7), (7, 0, 7), (8, 98, 7), (9, 0, 9), (3, 1, 3)]
    )


def test_words_that_meet_under_polynomials_are_told_apart(documents):
    # every block of this pattern is followed by its complement
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    found = found_components(documents(rows(*[f"{t} w x y z" for t in texts])))
    assert found == {0: (2, 0), 1: (2, 1)}
    data, offsets = hashing.joined([b"ab cd ab", b"abcdefgh abcdefgh1 abcdefgh2 abcdefgh1"])
    hashed = hashing.word_hashes(data, *hashing.words(data, offsets)[:2])
    assert len(set(hashed.tolist())) == 5 and hashed[0] == hashed[2] and hashed[4] == hashed[6]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for size in (3, 40, 500):
        band, blocks, _ = jaccard.band_views(size)[0]
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        other = np.unique(np.concatenate([one[size // 5 :], rng.integers(0, 2**63, size // 7).astype(np.uint64)]))
        bits = [jaccard.sketch(s, band, blocks)[1].view(np.uint64) for s in (one, other)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, other))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_documents_schema_is_the_tables(spark):
    assert spark.read.parquet(f"{SAMPLE}/documents.parquet").columns == [c.split()[0] for c in DOCS.split(", ")]
