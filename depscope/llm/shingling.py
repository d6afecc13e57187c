"""Word shingles of many texts at once, as sorted distinct 64-bit hashes.

A word's hash is a polynomial over its bytes, taken from running sums over a slice of text, so all
words of a slice are hashed by a few array operations. Slices are bounded in bytes; longer texts are
cut between words, and a word longer than a slice is hashed by itself. Nothing is remembered between slices
but two tables of powers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes of text hashed at once.
SLICE = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_BASE = 0x9FB21C651E98DF25


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    """A number for each byte; A-Z have those of a-z."""
    values = mixed(mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _FACTORS[0]))
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words start, their hashes) of at most SLICE bytes; words end at white space and where texts begin."""
    solid, cut = _SOLID[data], np.zeros(len(data) + 1, dtype=bool)
    cut[begins] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _UP[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * _DOWN[start]
    return start, mixed(h + (end - start).astype(np.uint64) * _FACTORS[1])


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text of any length."""
    out, at = [], 0
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            spaces = np.nonzero(~_SOLID[data[at:end]])[0]
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                # One word fills the slice.
                while end < len(data) and _SOLID[data[end : end + SLICE]].all():
                    end += SLICE
                if end < len(data):
                    end += int(np.argmin(_SOLID[data[end : end + SLICE]]))
                end = min(end, len(data))
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes().translate(lower))], dtype=np.uint64))
                at = end
                continue
        out.append(_words(data[at:end], np.array([0]))[1])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many words; mixed after each word, so that the order counts."""
    n = len(words) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + words[k : k + n] * _FACTORS[k % len(_FACTORS)])
    return total


def _distinct(windows: np.ndarray) -> np.ndarray:
    out = np.sort(windows)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _set_of(words: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return mixed(_shingled(words, len(words)) + np.uint64(len(words)))
    return _distinct(windows)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, in order, its sorted distinct shingle hashes; null and blank texts have none, short ones have one."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
        low, high = int(ends[first]), int(ends[last])
        if high - low > SLICE:
            words = _long_words(data[low:high])
            yield _set_of(words, _shingled(words, size) if len(words) >= size else words, size)
        else:
            start, words = _words(data[low:high], ends[first : last + 1] - low)
            windows = _shingled(words, size) if len(words) >= size else words[:0]
            at = np.searchsorted(start, ends[first : last + 1] - low)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield _set_of(words[s:e], windows[s : max(s, e - size + 1)], size)
        first = last
