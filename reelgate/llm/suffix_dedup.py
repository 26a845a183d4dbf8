"""Removal of repeated substrings by column-wise suffix sorting of document pieces.

Bytes covered by a substring of ``LENGTH`` bytes that also starts earlier (smaller document, or same
document and earlier start) are removed. Suffixes of a whole corpus fit no task, so the
collection is cut by content first and each part is sorted by itself:

1. Cut. Every window of ``LENGTH`` bytes names its anchor, the ``ANCHOR`` bytes of least hash in
   it. Equal windows have equal anchors. Successive windows with one anchor make a piece
   (``LENGTH`` to 152 bytes), known by the hashes of its anchor and of its bytes. Pieces that repeat
   inside a task are settled there: only the earliest travels. Both kinds are stored by one run, as
   another run may split the rows in another way.
2. Meet. Pieces are sorted by anchor, bytes and place. Of equal pieces all but the earliest are
   covered. Anchors that are left with several different pieces are what needs sorting.
3. Sort. The bytes of those pieces are fetched and the collection's Burrows-Wheeler transform and
   common prefixes are built column by column: each round puts one byte in front of every
   piece (``bwt.collection_bwt``), one sequential rewrite of the transform a round. Suffixes whose
   common prefix reaches ``LENGTH`` are equal windows; the earliest stays.
4. Remove. Covered spans come together per document.

The transform's rounds rewrite plain arrays of at most about ``COLLECTION`` bytes per task where the
published method rewrites files, because tasks of a cluster share no disk; what is external here is
the exchange that cuts the collection.

Hot content: exact copies are settled per task, so a piece that a third of all documents share
arrives once per task. An anchor with very many different pieces (a passage in ever new
contexts) is not sorted in one task: its pieces are cut on into single windows, and the earliest
of each is found by a combining aggregate.

Defined cases: a null text is empty; a document is an id with a text, so rows that repeat both are
one document and have one result; rows without an id come first. Equal 64-bit hashes are taken
for equal bytes where pieces are compared, texts of one id are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.llm import hashing
from reelgate.llm.bwt import repeated_windows
from reelgate.llm.tables import id_key, real_id, text_or_empty
from reelgate.session import pinned

LENGTH = 100
ANCHOR = 48
#: Pieces that a task settles among themselves before any travels.
SETTLED = 1 << 20
#: Bytes of pieces that are sorted as one collection.
COLLECTION = 1 << 21
#: Different pieces of one anchor beyond which windows are compared one by one.
HOT = 50_000
_PLACE = (1 << 24) - 1


def pieces(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, piece hash, text number, start and size of all pieces."""
    found = []
    parts, owners, starts = [], [], []
    for number, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), hashing.STEP_BYTES):
            parts.append(text[begin : begin + hashing.STEP_BYTES + length - 1])
            owners.append(number)
            starts.append(begin)
    for first, some in hashing.steps(parts):
        found.append(_cut(some, np.array(owners[first : first + len(some)]), np.array(starts[first : first + len(some)]), length, anchor))
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cut(parts: list[bytes], owners: np.ndarray, begins: np.ndarray, length: int, anchor: int):
    data, offsets = hashing.joined(parts)
    sums = hashing.prefix_sums(data)
    spots = np.arange(len(data) - anchor + 1)
    hashes = hashing.span_hashes(sums, spots, spots + anchor)
    key = (hashes & ~np.uint64(_PLACE)) | spots.astype(np.uint64)
    width = length - anchor + 1  # anchors of a window
    reach = 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    rest = width - reach
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    # windows that lie in one part; every part has at least one
    counts = np.diff(offsets) - length
    at = np.arange(int(counts.sum())) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    part = np.repeat(np.arange(len(parts)), counts)
    spot = (key[at] & np.uint64(_PLACE)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (part[1:] != part[:-1])]))
    last = np.concatenate([edge[1:], [len(at)]]) - 1
    begin, end, part = at[edge], at[last] + length, part[edge]
    return (
        hashes[spot[edge]],
        hashing.span_hashes(sums, begin, end),
        owners[part],
        begin - offsets[part] + begins[part],
        end - begin,
    )


def _joined_spans(keys: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each key (id, hash) with those that overlap or touch made one."""
    order = np.lexsort((start, *keys[::-1]))
    keys, start, end = tuple(k[order] for k in keys), start[order], end[order]
    if not len(start):
        return (*keys, start, end)
    owner = np.zeros(len(start), dtype=np.int64)
    for k in keys:
        owner[1:] |= k[1:] != k[:-1]
    owner = np.cumsum(owner)
    # a running maximum of the ends inside each owner
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * span) - owner * span
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return (*[k[first] for k in keys], start[first], reach[last])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        id_key().alias("id"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text")
    )


def _settled(docs: DataFrame, length: int) -> DataFrame:
    """Pieces settled inside each task: the earliest of each, and the spans (gone) of all others.

    Which piece is held back depends on the order and the split of the rows, so both must come out
    of one run.
    """

    def settle(held: list[tuple]) -> pd.DataFrame:
        a, s, doc, h, start, size = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, h, doc, s))
        a, s, doc, h, start, size = (c[order] for c in (a, s, doc, h, start, size))
        first = np.concatenate([[True], s[1:] != s[:-1]])
        leader = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        same = (doc == doc[leader]) & (h == h[leader]) & (start == start[leader])  # a repeated row
        gone = ~first & ~same
        docs_, hashes, begin, end = _joined_spans((doc[gone], h[gone]), start[gone], (start + size)[gone])
        none = np.zeros(len(begin), dtype=np.int64)
        out = {
            "gone": np.repeat([False, True], [int(first.sum()), len(begin)]),
            "anchor": np.concatenate([a.view(np.int64)[first], none]),
            "piece": np.concatenate([s.view(np.int64)[first], none]),
            "id": np.concatenate([doc[first], docs_]),
            "h": np.concatenate([h[first], hashes]),
            "start": np.concatenate([start[first], begin]),
            "size": np.concatenate([size[first], (end - begin).astype(np.int32)]),
        }
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["h"].to_numpy()
            for first, texts in hashing.steps([t.encode() for t in batch["text"]], 8 * hashing.STEP_BYTES):
                a, s, owner, start, size = pieces(texts, length)
                held.append((a, s, ids[first + owner], hashes[first + owner], start, size.astype(np.int32)))
                count += len(a)
                if count >= SETTLED:
                    yield settle(held)
                    held, count = [], 0
        if count:
            yield settle(held)

    return _documents(docs).select("id", "h", "text").mapInPandas(
        run, "gone boolean, anchor long, piece long, id long, h long, start long, size int"
    )


_MET = "met int, anchor long, id long, h long, start long, size int"


def _met(travelling: DataFrame) -> DataFrame:
    """From sorted pieces: 0 for a piece that is covered, 1 for one of several different pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the run of equal pieces that the last batch ended in, as it may go on: its anchor, its
        # piece, its leader, and whether its anchor is known to have several pieces
        last_anchor = last_piece = last_leader = None
        last_several = False
        for batch in batches:
            if not len(batch):
                continue
            a, s = batch["anchor"].to_numpy(), batch["piece"].to_numpy()
            own = [batch[c].to_numpy() for c in ("id", "h", "start", "size")]
            same_anchor = last_leader is not None and a[0] == last_anchor
            same_piece = same_anchor and s[0] == last_piece
            starts = np.concatenate([[not same_anchor], a[1:] != a[:-1]])
            leads = np.concatenate([[not same_piece], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
            leader = np.maximum.accumulate(np.where(leads, np.arange(len(a)), -1))
            head = [np.where(leader < 0, last_leader[i] if same_piece else 0, c[leader]) for i, c in enumerate(own)]
            repeated = (own[0] == head[0]) & (own[1] == head[1]) & (own[2] == head[2])
            covered = ~leads & ~repeated
            group = np.cumsum(starts) - starts[0]
            runs = np.bincount(group, weights=leads)
            if same_anchor:
                runs[0] = 2 if last_several else runs[0] + 1
            several = (runs > 1)[group]
            give = covered | (leads & several)
            out = {"met": np.where(covered, 0, 1)[give], "anchor": a[give]}
            out |= {name: column[give] for name, column in zip(("id", "h", "start", "size"), own, strict=True)}
            yield pd.DataFrame(out)
            if same_anchor and several[0] and not last_several:
                names = ("id", "h", "start", "size")
                yield pd.DataFrame([{"met": 1, "anchor": a[0]} | dict(zip(names, last_leader, strict=True))])
            last_anchor, last_piece, last_several = a[-1], s[-1], bool(several[-1])
            last_leader = [c[-1] for c in head]

    ordered = travelling.repartition("anchor").sortWithinPartitions("anchor", "piece", "id", "h", "start")
    return ordered.mapInPandas(run, _MET)


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, id, h, start and bytes of the wanted pieces (one row of spans per document)."""
    spans = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("anchor", "start", "size")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, h, text, some in zip(batch["id"], batch["h"], batch["text"], batch["spans"], strict=True):
                raw = text.encode()
                rows += [(p["anchor"], key, h, p["start"], raw[p["start"] : p["start"] + p["size"]]) for p in some]
            yield pd.DataFrame(rows, columns=["anchor", "id", "h", "start", "bytes"])

    return (
        _documents(docs).join(spans, ["id", "h"]).mapInPandas(
            cut, "anchor long, id long, h long, start long, bytes binary"
        )
    )


def _sorted_pieces(fetched: DataFrame, length: int) -> DataFrame:
    """Spans covered by windows that an earlier piece of the same anchor holds as well."""

    def spans(held: list[tuple]) -> pd.DataFrame:
        doc, h, start = (np.array([row[i] for row in held]) for i in (1, 2, 3))
        group, owner, offset = repeated_windows([row[4] for row in held], length)
        place = start[owner] + offset
        order = np.lexsort((place, h[owner], doc[owner], group))
        group, owner, place = group[order], owner[order], place[order]
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
        leader = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        doc, h = doc[owner], h[owner]
        same = (doc == doc[leader]) & (h == h[leader]) & (place == place[leader]) if len(group) else first
        gone = ~first & ~same
        found = _joined_spans((doc[gone], h[gone]), place[gone], place[gone] + length)
        return pd.DataFrame(dict(zip(("id", "h", "start", "end"), found, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch[c] for c in ("anchor", "id", "h", "start", "bytes")], strict=True):
                if size >= COLLECTION and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(
        run, "id long, h long, start long, end long"
    )


def _single_windows(fetched: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many pieces: the earliest of every window by an aggregate."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, h, start, raw in zip(batch["id"], batch["h"], batch["start"], batch["bytes"], strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                at = np.arange(len(data) - length + 1)
                hashes = hashing.span_hashes(hashing.prefix_sums(data), at, at + length)
                yield pd.DataFrame({"window": hashes.view(np.int64), "id": key, "h": h, "start": start + at})

    windows = pinned(
        fetched.select("id", "h", "start", "bytes").mapInPandas(cut, "window long, id long, h long, start long")
    )
    place = F.struct("id", "h", "start")
    first = pinned(windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    return (
        windows.join(first.select("window", "first"), "window")
        .where(place != F.col("first"))
        .select("id", "h", "start", (F.col("start") + length).alias("end"))
    )


def covered_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """id, h (of the text), start and end of byte spans to remove; spans may overlap."""
    settled = pinned(_settled(docs, length))
    met = pinned(_met(settled.where("not gone").drop("gone")))
    several = met.where("met = 1")
    many = pinned(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    few = several.join(many, "anchor", "left_anti")
    span = ("id", "h", "start", (F.col("start") + F.col("size")).alias("end"))
    spans = (
        settled.where("gone").select(*span)
        .unionByName(met.where("met = 0").select(*span))
        .unionByName(_sorted_pieces(_fetched(docs, few), length))
    )
    if not many.isEmpty():
        spans = spans.unionByName(_single_windows(_fetched(docs, several.join(many, "anchor", "left_semi")), length))
    return spans


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of start, end) and kept bytes per row."""
    gone = covered_spans(docs, length, hot).groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, some in zip(batch["id"], batch["text"], batch["spans"], strict=True):
                raw = text.encode()
                some = [] if some is None else some
                start = np.array([p["start"] for p in some], dtype=np.int64)
                end = np.array([p["end"] for p in some], dtype=np.int64)
                start, end = _joined_spans((), start, end)
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(removed), removed, kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    done = _documents(docs).join(gone, ["id", "h"], "left").mapInPandas(
        remove,
        "doc_id long, n_bytes long, n_removed long, n_spans long,"
        " removed array<struct<start: long, end: long>>, kept binary",
    )
    return done.withColumn("doc_id", real_id("doc_id"))
