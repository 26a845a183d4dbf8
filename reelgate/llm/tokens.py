"""Token ids of texts by a public vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
END = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def _reference(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@lru_cache(maxsize=2)
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=END
    )


def encode(text: str, name: str = VOCABULARY) -> np.ndarray:
    """The ids that the vocabulary's JSON file gives with ``tokenizers``, as unsigned 32-bit.

    The rank file holds the same vocabulary and is read several times faster; the few texts that its
    library refuses (very long runs without a break) go to ``tokenizers`` itself.
    """
    try:
        ids = _fast(name).encode(text, allowed_special="all")
    except BaseException as error:  # noqa: BLE001  its panics are no Exceptions
        if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
            raise
        ids = _reference(name).encode(text, add_special_tokens=False).ids
    return np.asarray(ids, dtype=np.uint32)
