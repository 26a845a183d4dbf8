"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Patterns (``base_spans``) find assigned credentials, access keys and long hex strings. The field adds
what their letters do not spell out: it tags each token as begin (B), inside (I) or outside (O) of a
secret from the token's shape, the words and shapes beside it and features of its file, and
Viterbi gives the best sequence of tags. Tokens are runs of letters and digits, or single marks.

Training: no table says what is a secret, so spans of the patterns are the labels, in windows of tokens
around them; other windows lie around tokens that look odd without being one (digits, long tokens)
and around any token. A labelled window is also taught with the words beside it hidden, so that shape
counts by itself, and with the closest description of the secret's shape hidden, so that what stands around
an odd token counts too. Likelihood is maximised with its exact gradient (forward-backward).

Shapes at scale: two passes over the texts without a shuffle. The sample is at most ``WINDOWS``
windows of each of three kinds, the first by hash, wherever they lie; tasks keep no more than that of
each. The model is ``BUCKETS`` pairs of numbers and is sent along. A token whose score is below
any gain that the tags beside it could bring is outside for sure, which cuts a text into short stretches;
only those are decoded, by the same exact recursion. Work is linear in the length of a text.

Defined cases: a null text is empty; every row is scanned by itself, so repeated rows give the same; where
the patterns find nothing in the whole table nothing can be learned and only they count; spans
count code points, ends are exclusive, and a pattern's span is its whole match. A span of the field that
lies inside a pattern's span is not repeated.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.llm import hashing
from reelgate.llm.tables import id_key, real_id, text_or_empty
from reelgate.session import pinned

KINDS = ("assign", "access", "hex")
#: Windows of each kind that teach, at most.
WINDOWS = 1_500
#: Tokens on each side of a window's middle.
REACH = 8
#: Feature buckets of the model.
BUCKETS = 1 << 15
#: The first features, which describe a token's shape most closely.
SHAPES = 3
ROUNDS = 80
#: Weight of the quadratic penalty.
PENALTY = 0.02
B, I, O = 0, 1, 2  # noqa: E741
#: Stands for a start or change of tag that cannot be.
NEVER = -1e4

_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_BEFORE_SIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*\Z""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")

_LOWER, _UPPER, _DIGIT, _HIGH = (np.zeros(256, dtype=bool) for _ in range(4))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58], _HIGH[128:] = True, True, True, True
_WORDY = _LOWER | _UPPER | _DIGIT | _HIGH
_CLASS = np.select([_LOWER, _UPPER, _DIGIT, _HIGH], [1, 2, 3, 4], 0).astype(np.uint8)
#: Upper ends of length classes.
_LENGTHS = np.array([1, 2, 4, 7, 11, 15, 19, 23, 31, 39, 63])


@dataclass
class Tokens:
    """The tokens of several texts, in bytes of ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    data, offsets = hashing.joined(texts)
    wordy, blank = _WORDY[data], hashing.IS_SPACE[data]
    begins = ~blank
    begins[1:] &= ~(wordy[1:] & wordy[:-1])
    stops = ~blank
    stops[:-1] &= ~(wordy[1:] & wordy[:-1])
    starts = np.flatnonzero(begins)
    return Tokens(
        data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, side="right") - 1
    )


def base_spans(tokens: Tokens) -> list[tuple[int, int, int, int, int]]:
    """(text, start, kind, end, start of the secret part) in bytes of ``data``, sorted."""
    found = []
    data, offsets, starts, ends, owner = tokens.data, tokens.offsets, tokens.starts, tokens.ends, tokens.owner
    raw = data.tobytes()
    done = 0
    # each match has its sign right behind its word, of which no two end alike
    for sign in np.flatnonzero((data == 58) | (data == 61)).tolist():
        if sign < done:
            continue
        back = sign
        while back and raw[back - 1] == 32:
            back -= 1
        word = _BEFORE_SIGN.search(raw, max(back - 9, done), sign)
        match = word and _ASSIGN.match(raw, word.start())
        if match:
            done = match.end()
            if match.end(2) - match.start(2) >= 8:
                text = int(np.searchsorted(offsets, match.start(), side="right")) - 1
                found.append((text, match.start(), 0, match.end(), match.start(2)))
    # the other two consist of letters and digits, so they lie inside one token
    for number in np.flatnonzero(ends - starts >= 16).tolist():
        begin, end, text = int(starts[number]), int(ends[number]), int(owner[number])
        for kind, pattern, least in ((1, _ACCESS, 16), (2, _HEX, 32)):
            for match in pattern.finditer(raw, begin, end):
                if match.end() - match.start() >= least:
                    found.append((text, match.start(), kind, match.end(), match.start()))
    return sorted(found)


def _per_token(mask: np.ndarray, tokens: Tokens) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[tokens.ends] - sums[tokens.starts]


def features(tokens: Tokens, file_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (features x tokens) and which features are words beside the token.

    ``file_hash`` is one number per text: what is known of its file.
    """
    data, starts, ends, owner = tokens.data, tokens.starts, tokens.ends, tokens.owner
    length = ends - starts
    kind = _CLASS[data]
    lower, upper, digit, high = (_per_token(kind == c, tokens) for c in (1, 2, 3, 4))
    turns = _per_token(np.concatenate([[False], (kind[1:] != kind[:-1])]), tokens)
    size = np.searchsorted(_LENGTHS, length)
    sort = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (high > 0)
    mark = np.where(sort == 0, data[starts], 0).astype(np.int64)
    mix = np.minimum(8 * turns // np.maximum(length, 1), 4)
    share = np.minimum(4 * digit // np.maximum(length, 1), 4)
    shape = (((sort * 256 + mark) * 16 + size) * 8 + mix).astype(np.int64)
    coarse = (sort * 256 + mark).astype(np.int64)
    folded = hashing.ASCII_LOWER[data]
    word = hashing.span_hashes(hashing.prefix_sums(folded), starts, ends).view(np.int64)

    # share of digits and of marks in the file, in eighths of a power of two
    texts = len(tokens.offsets) - 1
    chars = np.maximum(np.bincount(owner, weights=length, minlength=texts), 1)
    digits = np.ceil(np.log2(1 + 256 * np.bincount(owner, weights=digit, minlength=texts) / chars)).astype(np.int64)
    marks = np.ceil(np.log2(1 + 256 * np.bincount(owner[sort == 0], minlength=texts) / chars)).astype(np.int64)

    def beside(values: np.ndarray, by: int) -> np.ndarray:
        """The value of the token ``by`` places away, -1 beyond the text."""
        out = np.full(len(values), -1, dtype=np.int64)
        if by < 0:
            out[-by:] = np.where(owner[-by:] == owner[:by], values[:by], -1)
        else:
            out[:-by] = np.where(owner[:-by] == owner[by:], values[by:], -1)
        return out if len(values) > abs(by) else np.full(len(values), -1, dtype=np.int64)

    odd = (sort & 4 > 0) * 2 + (length > 12)
    rows = [
        shape,
        coarse * 16 + size,
        (sort * 16 + size) * 8 + share,
        (odd * 8 + mix) * 8 + share,
        odd * 16 + digits[owner],
        odd * 16 + marks[owner],
        odd * (1 << 32) + file_hash[owner],
    ]
    near = []
    for by in (-3, -2, -1, 1):
        near.append(beside(word, by))
        rows.append(beside(coarse, by) * 64 + odd)
    near.append(np.where(length <= 12, word, -2))
    count = len(rows)
    rows += near
    table = np.empty((len(rows), len(starts)), dtype=np.int64)
    for number, row in enumerate(rows):
        seeded = row.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
        mixed = hashing.mixed(seeded * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0x51ED27))
        table[number] = (mixed >> np.uint64(64 - 15)).astype(np.int64)
    words = np.zeros(len(rows), dtype=bool)
    words[count:] = True
    return table, words


def _labels(tokens: Tokens, spans: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tags by the patterns' spans, and which tokens lie in any part of such a span."""
    tags = np.full(len(tokens.starts), O, dtype=np.int8)
    near = np.zeros(len(tags), dtype=bool)
    for _, start, _, end, secret in spans:
        first, last = np.searchsorted(tokens.ends, start, side="right"), np.searchsorted(tokens.starts, end)
        near[first:last] = True
        first = np.searchsorted(tokens.ends, secret, side="right")
        fresh = np.flatnonzero(tags[first:last] == O) + first
        tags[fresh] = I
        if len(fresh) == last - first:
            tags[first] = B
    return tags, near


def _texts(docs: DataFrame) -> DataFrame:
    """id, file, text of every row."""
    about = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang") if c in docs.columns]
    file = F.pmod(F.xxhash64(*about), F.lit(4096)) if about else F.lit(0).cast("long")
    return docs.select(id_key().alias("id"), file.alias("file"), text_or_empty().alias("text"))


def _steps(batch: pd.DataFrame) -> Iterator[tuple[int, int, Tokens, np.ndarray]]:
    files = batch["file"].to_numpy()
    for first, texts in hashing.steps([t.encode() for t in batch["text"]]):
        yield first, len(texts), tokens_of(texts), files[first : first + len(texts)]


def training_windows(docs: DataFrame, limit: int = WINDOWS) -> DataFrame:
    """kind (0 labelled, 1 odd, 2 any), draw, buckets, tags: at most ``limit`` windows per kind."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # largest draws on top
        held: list[list[tuple[int, list, list]]] = [[], [], []]
        for batch in batches:
            for _, _, tokens, files in _steps(batch):
                count = len(tokens.starts)
                if not count:
                    continue
                tags, near = _labels(tokens, base_spans(tokens))
                table, _ = features(tokens, files)
                seeds = np.zeros(count, dtype=np.uint64)
                for row in table:
                    seeds = hashing.mixed(seeds + row.astype(np.uint64) + np.uint64(1))
                draws = (seeds >> np.uint64(1)).astype(np.int64)
                length = tokens.ends - tokens.starts
                odd = ~near & (length >= 6) & ((_per_token(_DIGIT[tokens.data], tokens) > 0) | (length > 12))
                chosen = [np.flatnonzero(tags == B), _least(draws, tokens.owner, odd), _least(draws, tokens.owner, ~near)]
                for kind, places in enumerate(chosen):
                    heap = held[kind]
                    for place in places[np.argsort(draws[places], kind="stable")][:limit].tolist():
                        if len(heap) == limit and draws[place] >= -heap[0][0]:
                            break
                        low, high = max(place - REACH, 0), min(place + REACH + 1, count)
                        inside = np.flatnonzero(tokens.owner[low:high] == tokens.owner[place]) + low
                        # no window begins inside a secret
                        inside = inside[np.argmax(tags[inside] != I) :]
                        item = (-int(draws[place]), table[:, inside].T.ravel().tolist(), tags[inside].tolist())
                        (heapq.heappush if len(heap) < limit else heapq.heappushpop)(heap, item)
        rows = [(kind, -draw, buckets, tags) for kind, heap in enumerate(held) for draw, buckets, tags in heap]
        yield pd.DataFrame(rows, columns=["kind", "draw", "buckets", "tags"])

    schema = "kind int, draw long, buckets array<int>, tags array<int>"
    return _texts(docs).mapInPandas(gather, schema).dropDuplicates(["kind", "draw"])


def _least(draws: np.ndarray, owner: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place with the smallest draw of each text, among some."""
    places = np.flatnonzero(among)
    places = places[np.lexsort((draws[places], owner[places]))]
    return places[np.flatnonzero(np.diff(owner[places], prepend=-1))]


@dataclass
class Field:
    """Scores of B and I against O per bucket, and of each tag after each."""

    weights: np.ndarray
    changes: np.ndarray

    def emissions(self, table: np.ndarray) -> np.ndarray:
        scores = np.zeros((2, table.shape[1]), dtype=np.float32)
        for tag, weights in enumerate(np.ascontiguousarray(self.weights.T)):
            for row in table:
                scores[tag] += weights.take(row)
        return scores.T


def _logsumexp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, buckets: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of windows, and its gradient by emission scores and by changes of tag.

    ``buckets`` is (windows, tokens, features), ``tags`` (windows, tokens) with -1 behind a window's end;
    beyond its edges a window is outside.
    """
    n, size = tags.shape
    real = tags >= 0
    scores = np.zeros((n, size, 3))
    for number in range(buckets.shape[2]):
        scores[:, :, :2] += field.weights[buckets[:, :, number]]
    change = field.changes.astype(float)
    ahead, back = np.zeros((n, size, 3)), np.zeros((n, size, 3))
    state = np.where(np.arange(3) == O, 0.0, NEVER)[None].repeat(n, 0)
    for at in range(size):
        step = _logsumexp(state[:, :, None] + change, 1) + scores[:, at]
        state = np.where(real[:, at, None], step, state)
        ahead[:, at] = state
    total = _logsumexp(state + change[:, O], 1)
    state = change[:, O][None].repeat(n, 0)
    for at in reversed(range(size)):
        back[:, at] = state
        step = _logsumexp(change + (scores[:, at] + state)[:, None, :], 2)
        state = np.where(real[:, at, None], step, state)
    chance = np.exp(ahead + back - total[:, None, None]) * real[:, :, None]
    gold = np.eye(3)[np.maximum(tags, 0)] * real[:, :, None]
    by_score = gold - chance

    padded = np.where(real, tags, O)
    before = np.concatenate([np.full((n, 1), O), padded], 1)
    after = np.concatenate([padded, np.full((n, 1), O)], 1)
    # a change of tag counts up to the one behind a window's last token
    lengths = real.sum(1)
    counts = np.arange(size + 1)[None] <= lengths[:, None]
    log_gold = (scores * gold).sum() + (change[before, after] * counts).sum()
    by_change = np.zeros((3, 3))
    np.add.at(by_change, (before[counts], after[counts]), 1.0)
    first = np.where(np.arange(3) == O, 0.0, NEVER)[None].repeat(n, 0)
    for at in range(size):
        left = ahead[:, at - 1] if at else first
        pair = left[:, :, None] + change + (scores[:, at] + back[:, at])[:, None, :] - total[:, None, None]
        by_change -= (np.exp(pair) * real[:, at, None, None]).sum(0)
    last = np.exp(state_at(ahead, lengths) + change[:, O] - total[:, None])
    by_change[:, O] -= last.sum(0)
    return (log_gold - total.sum()) / n, by_score / n, by_change / n


def state_at(ahead: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return ahead[np.arange(len(ahead)), lengths - 1]


def fit(windows: list[tuple[list[int], list[int]]], words: np.ndarray, rounds: int = ROUNDS) -> Field | None:
    """A field from (buckets, tags) windows; None without a labelled secret."""
    if not any(B in tags for _, tags in windows):
        return None
    count, size = len(words), 2 * REACH + 1
    buckets = np.full((len(windows), size, count), BUCKETS, dtype=np.int64)
    tags = np.full((len(windows), size), -1, dtype=np.int64)
    for number, (flat, marks) in enumerate(windows):
        buckets[number, : len(marks)] = np.reshape(flat, (len(marks), count))
        tags[number, : len(marks)] = marks
    labelled = (tags == B).any(1)
    wordless, shapeless = buckets[labelled].copy(), buckets[labelled].copy()
    wordless[:, :, words] = BUCKETS
    own = np.arange(count) < SHAPES
    shapeless[((tags[labelled] == B) | (tags[labelled] == I))[:, :, None] & own] = BUCKETS
    buckets = np.concatenate([buckets, wordless, shapeless])
    tags = np.concatenate([tags, tags[labelled], tags[labelled]])

    # the last bucket is what is hidden or behind the end and stays 0
    field = Field(np.zeros((BUCKETS + 1, 2)), np.zeros((3, 3)))
    flat = buckets.ravel()
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.changes)]
    for number in range(1, rounds + 1):
        _, by_score, by_change = likelihood(field, buckets, tags)
        by_weight = np.stack(
            [np.bincount(flat, np.repeat(by_score[:, :, k].ravel(), count), BUCKETS + 1) for k in (B, I)], 1
        )
        by_weight[BUCKETS] = 0
        for part, slope, (mean, square) in zip(
            (field.weights, field.changes), (by_weight, by_change), moments, strict=True
        ):
            # Adam on the penalised likelihood
            slope = slope - PENALTY / len(tags) * part
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope**2 - square)
            part += 0.1 * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.999**number)) + 1e-8)
    return Field(field.weights.astype(np.float32), field.changes.astype(np.float32))


def decode(field: Field, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The best tags of every text (Viterbi); outside before and after each."""
    change = field.changes
    tags = np.full(len(scores), O, dtype=np.int8)
    # no tags beside it can make up for what such a token loses by not being outside
    gain = [(change[:, s] - change[:, O]).max() + (change[s] - change[O]).max() for s in (B, I)]
    open_ = (scores[:, B] + gain[B] > -1e-3) | (scores[:, I] + gain[I] > -1e-3)
    places = np.flatnonzero(open_)
    if not len(places):
        return tags
    fresh = np.diff(places, prepend=-2) > 1
    fresh |= np.diff(owner[places], prepend=-1) != 0
    begins = np.flatnonzero(fresh)
    lengths = np.diff(np.append(begins, len(places)))
    # all stretches at once, the longest first, so that those still running are a prefix
    order = np.argsort(-lengths, kind="stable")
    heads, lengths = places[begins[order]], lengths[order]
    full = np.concatenate([scores, np.zeros((len(scores), 1), dtype=scores.dtype)], 1)
    state = change[O] + full[heads]
    came = []
    for at in range(1, int(lengths[0])):
        running = int(np.searchsorted(-lengths, -at))
        paths = state[:running, :, None] + change
        came.append(paths.argmax(1).astype(np.int8))
        state[:running] = paths.max(1) + full[heads[:running] + at]
    best = (state + change[:, O]).argmax(1)
    for at in range(int(lengths[0]) - 1, -1, -1):
        running = int(np.searchsorted(-lengths, -at))
        tags[heads[:running] + at] = best[:running]
        if at:
            best[:running] = came[at - 1][np.arange(running), best[:running]]
    return tags


def field_spans(tokens: Tokens, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the tagged secrets in bytes of ``data``."""
    found: list[tuple[int, int, int]] = []
    last = -2
    for place in np.flatnonzero(tags != O).tolist():
        text, start, end = int(tokens.owner[place]), int(tokens.starts[place]), int(tokens.ends[place])
        if tags[place] == I and place == last + 1 and found[-1][0] == text:
            found[-1] = (text, found[-1][1], end)
        else:
            found.append((text, start, end))
        last = place
    return found


def train(docs: DataFrame, limit: int = WINDOWS) -> Field | None:
    """A field taught on windows of ``docs``; at most three times ``limit`` windows reach the driver."""
    rows = pinned(training_windows(docs, limit))
    windows = []
    for kind in range(3):
        drawn = rows.where(F.col("kind") == kind).orderBy("draw").limit(limit)
        windows += [(r["buckets"], r["tags"]) for r in drawn.collect()]
    _, words = features(tokens_of([b"a"]), np.zeros(1, dtype=np.int64))
    return fit(windows, words)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end, comma-joined) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS pairs of numbers

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for first, size, tokens, files in _steps(batch):
                base = base_spans(tokens)
                extra = []
                if model is not None and len(tokens.starts):
                    table, _ = features(tokens, files)
                    extra = field_spans(tokens, decode(model, model.emissions(table), tokens.owner))
                out += _rows(batch["id"].to_numpy()[first : first + size], tokens, base, extra)
            yield pd.DataFrame(out, columns=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    schema = "id long, n_assign long, n_access long, n_hex long, base string, spans string"
    scanned = _texts(docs).mapInPandas(found, schema)
    return scanned.select(real_id("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base", "spans")


def _rows(ids: np.ndarray, tokens: Tokens, base: list, extra: list) -> list[tuple]:
    heads = np.zeros(len(tokens.data) + 1, dtype=np.int64)
    np.cumsum((tokens.data & 0xC0) != 0x80, out=heads[1:])
    texts: list[tuple[list, list]] = [([], []) for _ in ids]
    for text, start, kind, end, _ in base:
        texts[text][0].append((start, kind, end))
    for text, start, end in extra:
        if not any(s <= start and end <= e for s, _, e in texts[text][0]):
            texts[text][1].append((start, len(KINDS), end))
    names = (*KINDS, "field")
    out = []
    for number, (ours, more) in enumerate(texts):
        zero = heads[tokens.offsets[number]]

        def joined(spans: list, zero: int = zero) -> str:
            return ",".join(f"{names[k]}:{heads[s] - zero}:{heads[e] - zero}" for s, k, e in spans)

        counts = [sum(k == kind for _, k, _ in ours) for kind in range(len(KINDS))]
        out.append((ids[number], *counts, joined(ours), joined(sorted(ours + more))))
    return out


def find_secrets(docs: DataFrame, *, limit: int = WINDOWS) -> DataFrame:
    """Teach a field on ``docs`` and scan them with it."""
    return scan(docs, train(docs, limit))
