"""Current state of runs from a stream of append-only events."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgate.operators.lineage import FIRST_STAGE, TRANSITIONS

COLUMNS = ["run_id", "sequence", "stage", "alert", "run_sequence", "run_stage"]


def run_state_stream(
    events: DataFrame,
    *,
    allowed: dict[str, Sequence[str]] | None = None,
    first: str | Sequence[str] = FIRST_STAGE,
) -> DataFrame:
    """One row per event of (run_id string, sequence, stage): the event, its ``alert`` and the run after it.

    A legal next event moves the run on. One that is late, out of sequence or illegal is reported
    and leaves the run as it was. ``run_sequence`` and ``run_stage`` are the run's last
    legal event by then (-1 and null before the first), so a run's latest row tells its current stage.

    The rows of a run within a micro-batch pass through the state as they come. Only those ahead of
    the next sequence number wait, until it arrives or the micro-batch ends; what still waits then
    is a gap. Rows that carry the same number are taken as they come.
    """
    table = {k: tuple(v) for k, v in (TRANSITIONS if allowed is None else allowed).items()}
    starts = (first,) if isinstance(first, str) else tuple(first)

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, stage = state.get if state.exists else (-1, None)
        ahead: list[tuple[int, int, str | None]] = []
        out: list[tuple] = []

        def take(sequence: int, new: str | None) -> None:
            nonlocal last, stage
            if sequence <= last:
                alert = "late event"
            elif sequence != last + 1:
                alert = "sequence gap"
            elif stage is None and new not in starts:
                alert = "illegal first stage"
            elif stage is not None and new not in table.get(stage, ()):
                alert = "illegal transition"
            else:
                alert, last, stage = None, sequence, new
            out.append((key[0], sequence, new, alert, last, stage))

        def emitted() -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=COLUMNS)
            out.clear()
            return rows

        arrived = 0
        for pdf in batches:
            ordered = pdf.sort_values("sequence", kind="stable")
            for sequence, new in zip(ordered["sequence"].tolist(), ordered["stage"].tolist(), strict=True):
                if sequence > last + 1:
                    heapq.heappush(ahead, (sequence, arrived, new))
                    arrived += 1
                    continue
                take(sequence, new)
                while ahead and ahead[0][0] <= last + 1:
                    sequence, _, new = heapq.heappop(ahead)
                    take(sequence, new)
            yield emitted()
        while ahead:
            sequence, _, new = heapq.heappop(ahead)
            take(sequence, new)
        if stage is not None:
            state.update((last, stage))
        yield emitted()

    return events.groupBy("run_id").applyInPandasWithState(
        advance,
        "run_id string, sequence bigint, stage string, alert string, run_sequence bigint, run_stage string",
        "last bigint, stage string",
        "append",
        GroupStateTimeout.NoTimeout,
    )
