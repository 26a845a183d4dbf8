"""Every operator run over the sample tables, each beside the same question in plain SQL."""

from reelgate.catalogue import (  # noqa: F401
    frames,
    governance,
    history,
    identity,
    lineage,
    media,
    plugins,
    records,
    selection,
    sequences,
)
from reelgate.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
