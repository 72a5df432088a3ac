"""Words of Arrow text columns as 64-bit hashes, by numpy over the bytes: no Python object for any word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters, digits and all bytes of characters beyond ASCII.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        size = max(n, 1 << 20)
        for name, base in (("up", _P), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the column and each text's bounds in them; a null is empty."""
    texts = pc.fill_null(texts, "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about size bytes, with the place of the first; one longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(lengths):
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 100_000]), size, side="right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def words(data: np.ndarray, bounds: np.ndarray, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash of each word, the first byte of each word, and for each text the place of its first word (and one past the last).

    letters: words are runs of letters and digits instead. prefixes: then the
    hashes of each word's first so many bytes follow, of shorter words 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), *[np.zeros(0, np.uint64) for _ in prefixes]
    inside = _LETTER[data] if letters else ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = bounds[:-1][np.diff(bounds) > 0]
    first[begins] = inside[begins]
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    heads = [np.where(e - s > size, mix((sums[np.minimum(s + size, n)] - sums[s]) * down[s] + np.uint64(size)), np.uint64(0)) for size in prefixes]
    return mix((sums[e] - sums[s]) * down[s]), s, np.searchsorted(s, bounds), *heads


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words and the number of its text; a text of fewer words is one shingle, one of none has none."""
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * _P) | np.uint64(1)
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        total += hashes[j : j + len(total)] * weights[j]
    same = text[: len(total)] == text[width - 1 : width - 1 + len(total)] if len(total) else np.zeros(0, bool)
    out, of = mix(total[same]), text[: len(total)][same]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            own[has] += hashes[at[short[has]] + j] * weights[j]
        out, of = np.concatenate([out, mix(own + counts[short].astype(np.uint64))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
