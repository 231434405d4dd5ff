"""Vectorised reading of whole texts, shared by the operators of this package.

An Arrow string column is one UTF-8 buffer with offsets, so the words of a batch of
documents are found and hashed with a few numpy passes over that buffer instead of a
Python step per word.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2 ** 64 - 1], dtype=np.uint64)
LONG_WORD = 256     # bytes; longer words are hashed by blake2b instead of 8 bytes a step

# 1 where a byte separates words
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
# for matching passages: everything in ASCII that is no letter or digit separates
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x *= _M2
    x ^= x >> _U(27)
    x *= _M3
    x ^= x >> _U(31)
    return x


class Texts:
    """The texts of an Arrow string column as one byte buffer; text i is
    ``data[off[i]:off[i + 1]]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if lower:
            column = pc.utf8_lower(column)
        _, offsets, values = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else \
            np.zeros(0, dtype=np.uint8)
        # a copy, padded: 8 bytes can be read from any position
        self.data = np.concatenate([raw[off[0]:off[-1]], np.zeros(8, dtype=np.uint8)])
        self.off = off - off[0]
        self.n = len(column)

    def __len__(self) -> int:
        return self.n

    @property
    def bytes(self) -> np.ndarray:
        return self.data[:-8]

    def pieces(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of non-separator bytes: (start, end, text index); none crosses
        from one text into the next."""
        inside = np.frombuffer(self.bytes.tobytes().translate((~separator).tobytes()), dtype=bool)
        before, after = np.zeros((2, len(inside) + 1), dtype=bool)
        before[1:], after[:-1] = inside, inside
        before[self.off] = after[self.off] = False
        start, end = np.flatnonzero(inside > before[:-1]), np.flatnonzero(inside > after[1:]) + 1
        first = np.searchsorted(start, self.off)
        return start, end, np.repeat(np.arange(self.n), np.diff(first))

    def lead(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first 8 bytes of each byte range as a number (shorter ranges zero-filled)."""
        eight = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        return eight[start] & KEEP[np.minimum(end - start, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range (equal bytes, equal hash, in any batch)."""
        size = end - start
        eight = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        h = mix(size.astype(np.uint64) * _M1 ^ (eight[start] & KEEP[np.minimum(size, 8)]))
        rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        step = 8
        while len(rest):
            left = size[rest] - step
            chunk = eight[start[rest] + step] & KEEP[np.minimum(left, 8)]
            h[rest] = mix(h[rest] ^ chunk)
            step += 8
            rest = rest[left > 8]
        for i in np.flatnonzero(size > LONG_WORD):
            d = hashlib.blake2b(self.data[start[i]:end[i]].tobytes(), digest_size=8).digest()
            h[i] = int.from_bytes(d, "little")
        return h


def shingle_hashes(word: np.ndarray, text: np.ndarray, n_texts: int, k: int = 5
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text of each.  A text of 1 to k-1 words
    has one shingle, all its words; an empty text has none."""
    per = np.bincount(text, minlength=n_texts)
    if len(word) >= k:
        h = word[:len(word) - k + 1].copy()
        for j in range(1, k):
            h *= _M1
            h += word[j:len(word) - k + 1 + j]
        h = mix(h)
        same = text[:len(word) - k + 1] == text[k - 1:]
        out, owner = h[same], text[:len(word) - k + 1][same]
    else:
        out, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = per[short] > j
            extra[has] = mix(extra[has] * _M1 + word[first[short][has] + j])
        extra = mix(extra ^ per[short].astype(np.uint64))
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


SLICE = 256               # texts handled together: small enough for the CPU caches
SLICE_BYTES = 2 << 20     # and their bytes: what a worker holds at once follows them


def give_back() -> None:
    """Return this worker's freed memory to the system.  Workers are used again for later stages,
    and the C allocator keeps what arrays below its (growing) threshold took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc; other libraries have none
    if trim is not None:
        trim(0)


def slices(column: pa.Array, step: int = SLICE, beside: pa.Array | None = None):
    """(first row, slice) of a column in steps of at most ``step`` texts and ``SLICE_BYTES``, or
    one longer text.  ``beside``: a second column whose bytes count as well."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.zeros(len(column), dtype=np.int64)
    for c in (column, beside):
        if c is not None:
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + step, len(column))
        yield at, column.slice(at, to - at)
        at = to
    give_back()


def distinct_per_text(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(56-bit hash, text, count) of the distinct hashes of each text, by text and hash.
    For slices of at most ``SLICE`` texts: text and hash are sorted as one number."""
    key = np.sort((owner.astype(np.uint64) << _U(56)) | (h >> _U(8)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key, count = key[at], np.diff(np.concatenate([at, [len(key)]]))
    return key & _U(2 ** 56 - 1), (key >> _U(56)).astype(np.int64), count


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of blank-separated words of each text."""
    out = [np.bincount(Texts(part).pieces(BLANKS)[2], minlength=len(part)) for _, part in slices(column)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
