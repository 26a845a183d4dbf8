"""URL rules and importance weights against plain versions."""

import math
import re

import pytest
from samples import PROSE, edge_rows

from reelgate.llm import quality, url_filter
from reelgate.llm.queries import QUERIES

SAMPLE = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_rule(url):
    """Host, path, text and verdict of the deciding rule."""
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = re.search(r"[/?#]|\Z", rest).start()
    host, path = rest[:end].translate(LOWER), re.split(r"[?#]", rest[end:])[0]
    fits = [
        r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if not fits:
        return host, path, None, None
    best = max(fits, key=lambda r: len(r.host + r.path))
    return host, path, best.host + best.path, best.verdict


def test_url_query_against_plain_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op5_url_filter"](spark, SAMPLE).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    ruled = 0
    for r in rows:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        ruled += rule is not None
    assert 0 < ruled < len(rows)


def test_odd_urls_against_plain_rules(spark):
    hosts = ["org", "example.org", "www.Example.ORG", "notexample.org", "a.com", "com", "x.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a?b/de/", "/de/#x", "?q=/de/", "#/es/", "/a://b.org/es/"]
    urls = [f"{scheme}{h}{p}" for scheme in ("http://", "://", "x:y://") for h in hosts for p in paths] + [None, "", "org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(df).collect():
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert verdict in (None, r.verdict)


M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def spread(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M64
    return h ^ (h >> 31)


def plain_features(text):
    """Buckets of all tokens and pairs of neighbours, one by one."""
    found, before = [], None
    for token in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+", text.encode()):
        h = spread(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(token)) & M64)
        found.append(h >> 48)
        if before is not None:
            pair = 1 if before == h else spread(((before * BASE + h) * BASE) & M64)
            found.append(pair >> 48)
        before = h
    return found


def test_importance_weights_against_a_plain_version(spark, documents):
    texts = {i: f"{PROSE[i * 3:]} word, word; word... {i} é!{'!' * i}" for i in range(40)}
    data = [(i, t, "en", "a", len(t)) for i, t in texts.items()]
    data += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, " \n", "en", "a", 0)]
    good = [3, 5, 8, 13, 21]
    model = quality.fit(documents(data), good)
    counts = {i: plain_features(t or "") for i, t, *_ in data}
    raw, wanted = [1.0] * quality.BUCKETS, [1.0] * quality.BUCKETS
    for i, buckets in counts.items():
        for b in buckets:
            raw[b] += 1
            wanted[b] += i in good
    raws, wants = sum(raw), sum(wanted)
    for r in quality.score(documents(data), model).collect():
        buckets = counts[r.doc_id]
        weight = sum(math.log(wanted[b] / wants) - math.log(raw[b] / raws) for b in buckets) / math.sqrt(max(len(buckets), 1))
        assert r.log_weight == pytest.approx(weight, abs=1e-9)


def test_resampling_takes_the_largest_noisy_weights(spark, documents):
    texts = [(i, f"good words {i} of a kind" if i % 2 else f"### {i} $$$ %%", "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)] + [(i, 1, 0) for i in range(1, 30, 2)], "doc_id long, quality int, toxic int")
    rows = quality.resample(documents(texts + edge_rows()[4:]), labels).collect()
    sure = {i for i in range(1, 30, 2)}
    drawn = [r.noisy_weight for r in rows if r.kept and r.doc_id not in sure]
    others = [r.noisy_weight for r in rows if not r.kept]
    assert sure <= {r.doc_id for r in rows if r.kept} and others
    # beside documents that are sure to stay, what stays has the larger sums
    assert min(drawn) >= max(others)
