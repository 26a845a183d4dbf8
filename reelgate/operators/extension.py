"""Where user code plugs in: feature extractors over rows, transforms over series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from reelgate.operators.scan import map_sorted_groups, with_halo
from reelgate.operators.sequence import SERIES

Extractor = Callable[[pd.DataFrame], pd.DataFrame]


def extract_features(
    rows: DataFrame, make_extractor: Callable[[], Extractor], schema: str
) -> DataFrame:
    """Run a batch extractor over all rows; it must return one row per row it was given.

    ``make_extractor`` runs once per task, before the first batch, which is where a model
    is loaded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for pdf in batches:
            out = extract(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"Extractor returned {len(out)} results for {len(pdf)} rows.")
            yield out

    return rows.mapInPandas(run, schema)


def transform_series(
    frames: DataFrame,
    transform: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    *,
    keys: Sequence[str] = SERIES,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Apply a transform to each series in order, one chunk of frames at a time.

    The transform sees up to ``before`` frames ahead of a chunk and ``after`` frames behind
    it, and keeps ``frame_idx``; only the chunk's own frames are kept of its result.
    """
    near = with_halo(frames, before, after)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.loc[pdf["__home"] == pdf["__chunk"], "frame_idx"]
        out = transform(pdf.drop(columns=["__home", "__chunk"]))
        return out[out["frame_idx"].isin(own)]

    return map_sorted_groups(near, [*keys, "__chunk"], ["frame_idx"], run, schema)
