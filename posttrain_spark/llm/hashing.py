"""Vectorised word and shingle hashes over batches of texts.

Words are maximal runs of bytes other than space and \\x09-\\x0D.  All hashes are 64 bits wide; two
different words or shingles share one with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

# Texts are hashed together up to about this many bytes, so that work arrays stay in cache.
BLOCK_BYTES = 1 << 20

_SEED = np.random.default_rng(20_240_117)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT[_WHITE] = 0
_LOWER = _EXACT.copy()
_LOWER[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E6C63D0676A9A99)
_POWERS = np.cumprod(np.full(4096, _STEP))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _STEP))
    return _POWERS


def text_blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of neighbouring texts joined by a line feed, and where each text starts.

    A NULL text counts as empty.  The starts carry one further entry, the end.
    """
    held: list[bytes] = []
    size = 0

    def block():
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), starts

    for scalar in texts:
        raw = scalar.as_buffer()
        raw = b"" if raw is None else raw.to_pybytes()
        if held and size + len(raw) > BLOCK_BYTES:
            yield block()
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield block()


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in ``data``."""
    solid = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_WHITE[data], out=solid[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    first, used = starts[0], data[starts[0] : ends[-1]]
    spans = np.diff(np.append(starts, ends[-1]))
    place = np.arange(len(used)) - np.repeat(starts - first, spans)
    values = (_LOWER if lower else _EXACT)[used] * _powers(int(spans.max()))[place]
    return starts, ends, mix(np.add.reduceat(values, starts - first))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by the place of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _STEP + words[j : j + n]
    return mix(total + np.uint64(width))


def shingle_sets(texts: Sequence | pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, lower-casing A-Z.

    A text of fewer than ``width`` words has one shingle, the whole of it; a text without words, an
    empty text and NULL have none.
    """
    texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    for data, bounds in text_blocks(texts):
        starts, _, words = word_hashes(data, lower=True)
        at = np.searchsorted(starts, bounds)
        windows = window_hashes(words, width)
        for i, j in zip(at[:-1], at[1:], strict=True):
            if j - i >= width:
                yield np.unique(windows[i : j - width + 1])
            elif j > i:
                yield window_hashes(words[i:j], int(j - i))
            else:
                yield np.empty(0, np.uint64)
