"""Hashes of words and of runs of words, for whole Arrow columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
#: Texts that are hashed at a time, and about how many bytes.
SLICE_ROWS, SLICE_BYTES = 1000, 2_000_000
#: Bytes from which a word is hashed by itself; a multiple of 8.
LONG_WORD = 64
#: Bytes that belong to words, and masks of the lowest bytes of 64 bits.
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _odd(seed: int) -> int:
    """A fixed odd 64-bit number for each seed (a splitmix step)."""
    z = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return (z ^ (z >> 31)) | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch):
    """Parts of a batch that need little memory, however long the texts."""
    rows = max(1, min(SLICE_ROWS, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the bounds of each text among them.

    Words are runs of anything but U+0020 and U+0009 to U+000D; null has none.
    ``lower`` turns A-Z into lower case and leaves other letters.
    """
    texts = texts.fill_null("")
    texts = pc.ascii_lower(texts) if lower else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = _IN_WORD[data]
    # a word begins behind white space or at the start of a text, and ends likewise
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[offsets] = word[offsets]
    starts = np.flatnonzero(first)
    last = word[:-1] & ~word[1:]
    inner = offsets[offsets > 0] - 1
    last[inner] = word[inner]
    return word_hashes(data, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word of ``data`` (bytes), eight bytes at a time for all words at once; words beyond ``LONG_WORD`` bytes one by one."""
    import xxhash

    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) * np.uint64(_odd(2000)))
    out = mixed(out ^ (eights[starts] & _LOW_BYTES[np.minimum(lengths, 8)]))
    more = np.flatnonzero(lengths > 8)
    for k in range(8, LONG_WORD, 8):
        if not len(more):
            break
        out[more] = mixed(out[more] ^ (eights[starts[more] + k] & _LOW_BYTES[np.minimum(lengths[more] - k, 8)]))
        more = more[lengths[more] > k + 8]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on, wherever so many follow."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words[i : i + n] * np.uint64(_odd(i + 1))
    return mixed(total)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` values from each position on, wherever so many follow."""
    width = 1
    while width < size:
        step = min(width, size - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


def run_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which ``size`` words follow in the same text, and the bounds of each text among these positions."""
    lengths = np.diff(bounds)
    whole = np.arange(bounds[-1]) + size <= np.repeat(bounds[1:], lengths)
    return np.flatnonzero(whole), np.concatenate([[0], np.cumsum(np.maximum(lengths - size + 1, 0))])


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z taken in lower case.

    With fewer words than ``size`` the whole sequence is the only shingle;
    without words there is none.
    """
    words, bounds = hashed_words(texts, lower=True)
    at, ends = run_starts(bounds, size)
    found = runs(words, size)[at]
    out = []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(found[a:b])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            few = words[bounds[k] : bounds[k + 1]]
            out.append(runs(few, len(few)) ^ np.uint64(_odd(1000 + len(few))) if len(few) else np.zeros(0, np.uint64))
    return out


def joined(parts: list[np.ndarray]) -> pa.Array:
    """Hashes as one Arrow column of longs."""
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
