"""Packing token streams into training windows with a fixed number of open windows.

Each task reads its documents once and keeps ``OPEN`` windows open. A document's full windows leave
at once; what remains of it goes to the open window that it fits best. Where none fits and no
further window may be opened, the fullest is completed with the head of the piece and emitted, and
the rest is placed again, so an emitted window has no padding. At its end a task merges its open
windows into full ones and hands on at most one. These leftovers are merged in groups of
``GROUP`` tasks, again and again, until one group is left: the whole result has one window
that is not full.

Shapes at scale: nothing is shuffled but one leftover window per task, memory is the open windows
and one batch of texts. First-pass pieces are stored, so texts are tokenized once. Sequence
ids are unique, not dense: they name the task and its count.

Defined cases: a null text is empty and still has its end id; every row is packed, also rows
without an id and repeated rows (each has pieces of its own, told apart by ``sequence_id`` and
``offset``); an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.llm.tables import id_key, real_id, text_or_empty
from reelgate.llm.tokens import VOCABULARY, encode
from reelgate.session import pinned

WINDOW = 2048
OPEN = 16
#: Leftover windows that one task merges.
GROUP = 64
END_ID = 1

_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long, ids binary, part long"
)

# a piece: (doc_id, start, ids, doc_tokens)
Piece = tuple[int, int, np.ndarray, int]


class Packer:
    """The open windows of one task; finished pieces gather in ``rows``."""

    def __init__(self, first_sequence: int, window: int, most_open: int, with_ids: bool):
        self.window, self.most_open, self.with_ids = window, most_open, with_ids
        self.sequence = first_sequence
        self.open: list[tuple[int, list[Piece]]] = []  # room left, pieces
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        self._write(pieces, self.sequence, self.with_ids, None)
        self.sequence += 1

    def _write(self, pieces: list[Piece], sequence: int | None, with_ids: bool, part: int | None) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            kept = raw if with_ids else None
            self.rows.append(
                (doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, kept, part)
            )
            offset += len(ids)

    def place(self, piece: Piece) -> None:
        doc_id, start, ids, total = piece
        while len(ids) >= self.window:
            self.emit([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fits = [(room, i) for i, (room, _) in enumerate(self.open) if room >= len(ids)]
            if fits:
                room, at = min(fits)
                self.open[at][1].append((doc_id, start, ids, total))
                self.open[at] = (room - len(ids), self.open[at][1])
                if self.open[at][0] == 0:
                    self.emit(self.open.pop(at)[1])
                return
            if len(self.open) < self.most_open:
                self.open.append((self.window - len(ids), [(doc_id, start, ids, total)]))
                return
            at = min(range(len(self.open)), key=lambda i: self.open[i][0])
            room, pieces = self.open.pop(at)
            self.emit([*pieces, (doc_id, start, ids[:room], total)])
            start, ids = start + room, ids[room:]

    def merge(self, part: int | None) -> None:
        """Fill the fullest open windows from the emptiest; hand on the one that stays open."""
        loose = sorted(self.open, key=lambda w: w[0])
        self.open, self.most_open = [], 1
        for _, pieces in loose:
            for piece in pieces:
                self.place(piece)
        if self.open:
            self._write(self.open.pop()[1], None, True, part)

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
        # nullable integers from the start: by way of floats, large ids would lose digits
        return pd.DataFrame(
            {
                name: list(values) if name == "ids" else pd.array(values, dtype="Int64")
                for name, values in zip(_COLUMNS, columns, strict=True)
            }
        )


def pack(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    most_open: int = OPEN,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers where ``with_ids`` asks for them.
    """

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packer = Packer(part << 36, window, most_open, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text, vocabulary), np.uint32(end_id))
                packer.place((int(doc_id), 0, ids, len(ids)))
                if len(packer.rows) > 10_000:
                    yield packer.taken()
        packer.merge(part)
        yield packer.taken()

    texts = docs.select(id_key().alias("doc_id"), text_or_empty().alias("text"))
    placed = pinned(texts.mapInPandas(first_pass, _SCHEMA))
    done = [placed.where(F.col("sequence_id").isNotNull())]
    loose = placed.where(F.col("sequence_id").isNull())
    level = 0
    while True:
        level += 1
        last = loose.agg(F.max("part")).first()[0]
        if last is None:
            break
        merged = pinned(_merged(loose, level, last < group, window, with_ids, group))
        done.append(merged.where(F.col("sequence_id").isNotNull()))
        loose = merged.where(F.col("sequence_id").isNull())
        if last < group:
            break
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    return everything.drop("part").withColumn("doc_id", real_id("doc_id"))


def _merged(
    loose: DataFrame, level: int, final: bool, window: int, with_ids: bool, size: int
) -> DataFrame:
    """Merge the leftover windows of each group of tasks; the last group emits its rest as well."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["part"].iloc[0]) // size
        packer = Packer((1 << 62) + (level << 54) + (group << 16), window, 1, with_ids)
        for row in pdf.sort_values(["part", "offset"]).itertuples(index=False):
            ids = np.frombuffer(row.ids, dtype="<u4")
            packer.place((int(row.doc_id), int(row.start), ids, int(row.doc_tokens)))
        if final and packer.open:
            packer.emit(packer.open.pop()[1])
        packer.merge(group)
        return packer.taken()

    return loose.groupBy(F.floor(F.col("part") / size).alias("g")).applyInPandas(merge, _SCHEMA)
