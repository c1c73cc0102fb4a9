"""Vectorised text work in numpy: word hashes and byte n-grams of many texts at once.

A buffer of bytes is hashed by one wrapping prefix sum of byte * B**position; the difference of two prefix sums times
B**-start is a polynomial hash of any span, so words and n-grams cost a few array operations for the whole buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in buffers of about this many bytes; a longer text is cut at separators only.
CHUNK = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            fwd, inv = np.full(size, _B, np.uint64), np.full(size, pow(_B, -1, 1 << 64), np.uint64)
            fwd[0] = inv[0] = 1
            _powers[size] = (np.cumprod(fwd), np.cumprod(inv))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _prefix(buf: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.empty(len(buf) + 1, np.uint64)
        out[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _pow(len(buf))[0][: len(buf)], out=out[1:])
    return out


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the alphanumeric runs of a buffer, and where each starts."""
    edge = np.flatnonzero(np.diff(_alnum[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint32), start
    c = _prefix(buf)
    with np.errstate(over="ignore"):
        h = (c[end] - c[start]) * _pow(len(buf))[1][start]
    return (mix(h) >> np.uint64(32)).astype(np.uint32), start


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 32-bit hashes of its words (runs of letters, digits and non-ASCII characters), in order."""
    out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            h, start = _words(np.frombuffer(b" ".join([texts[i] for i in group]), np.uint8))
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            for i, part in zip(group, np.split(h, np.searchsorted(start, ends[:-1]))):
                out[i] = part
        group, held = [], 0

    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            out[i] = np.concatenate([_words(np.frombuffer(p, np.uint8))[0] for p in pieces(t)] or [np.zeros(0, np.uint32)])
            continue
        if held + len(t) > CHUNK:
            flush()
        group.append(i)
        held += len(t) + 1
    flush()
    return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes that end where a word ends."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and _alnum[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def ngram_ids(text: bytes, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashed ids of all byte n-grams of a text, a part of at most CHUNK bytes at a time."""
    longest = max(sizes)
    for at in range(0, max(1, len(text)), CHUNK):
        buf = np.frombuffer(text[at : at + CHUNK + longest - 1], np.uint8)
        c, inv = _prefix(buf), _pow(len(buf))[1]
        for n in sizes:
            count = min(len(buf) - n + 1, CHUNK)
            if count > 0:
                with np.errstate(over="ignore"):
                    h = (c[n : n + count] - c[:count]) * inv[:count]
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53 + 2 * n)
                yield (h >> np.uint64(64 - bits)).astype(np.uint32)
