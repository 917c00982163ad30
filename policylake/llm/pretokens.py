"""Pre-tokens of byte-level BPE: vectorised for plain texts, by the published pattern for the rest.

A text is plain if it has only ASCII and the letters U+00C0-U+00FF without the two signs among
them, no apostrophe, no separator control (0x1C-0x1F) and no special token. All other texts go
through the library itself, so both ways give the library's tokens.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from policylake.llm import bytewise

SPECIAL = b"<|endoftext|>"
_KIND = np.full(256, 3, np.uint8)
_KIND[bytewise.SPACES] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[39, *range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows are plain."""
    odd = _ODD[data]
    if len(data) > 1:
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    rows = len(at) - 1
    bad = np.bincount(np.searchsorted(at, np.flatnonzero(odd), "right") - 1, minlength=rows)[:rows] > 0
    if np.any((data[:-1] == 60) & (data[1:] == 124)):
        raw = data.tobytes()
        found = raw.find(SPECIAL)
        while found >= 0:
            bad[np.searchsorted(at, found, "right") - 1] = True
            found = raw.find(SPECIAL, found + 1)
    return ~bad


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pre-tokens of plain texts."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = edge[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    space = kind == 0
    begins = first.copy()
    begins[:-1] |= space[:-1] & last[:-1] & ~edge[1:n]
    joined = np.zeros(n, bool)
    joined[1:] = (data[:-1] == 32) & ~edge[1:n]
    begins &= space | ~joined
    start = np.flatnonzero(begins)
    return start, np.r_[start[1:], n], np.searchsorted(at, start, "right") - 1
