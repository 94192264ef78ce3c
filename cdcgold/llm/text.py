"""Words of whole Arrow text columns as arrays of 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are taken up to this many bytes at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of one very long word hashed at a time.
BLOCK_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words are ASCII letters and digits and all characters beyond ASCII.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def noise(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_OF_BYTE = noise(256, 1)
_WEIGHT = noise(64, 4)


@dataclass
class Words:
    """The words of the texts of one slice, in order."""

    hash: np.ndarray  # uint64, one a word
    first: np.ndarray  # words of text i are first[i] .. first[i + 1]
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray  # uint8, all texts
    offset: np.ndarray  # bytes of text i are offset[i] .. offset[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and the offsets of its values; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    data, offset = raw(texts)
    is_word = inside[data]
    starts, ends = is_word.copy(), is_word.copy()
    if len(data):
        starts[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        edge = offset[(offset > 0) & (offset < len(data))]
        starts[edge], ends[edge - 1] = is_word[edge], is_word[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    table = np.where(inside, _OF_BYTE[LOWER] if lower else _OF_BYTE, U(0))
    size = end - start
    hashes = size.astype(U)
    left = np.arange(len(start))
    for d in range(int(min(size.max(initial=0), len(_WEIGHT)))):
        hashes[left] += table[data[start[left] + d]] * _WEIGHT[d]
        left = left[size[left] > d + 1]
    for i in left:  # words longer than the weights, in blocks
        for at in range(start[i] + len(_WEIGHT), end[i], BLOCK_BYTES):
            part = table[data[at : min(at + BLOCK_BYTES, end[i])]]
            hashes[i : i + 1] = mix(hashes[i : i + 1] + U(at - start[i])) + (part * noise(len(part), 2)).sum()
    hashes = mix(hashes)
    return Words(hashes, np.searchsorted(start, offset), start, end, data, offset)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and where each text's runs begin.

    A text of fewer words, but not none, has its whole sequence as its only run.
    """
    counts = w.counts()
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(runs)])
    factor = noise(k, 3) | U(1)
    n = len(w.hash)
    whole = np.zeros(n, U)
    for d in range(min(k, n)):
        whole[: n - d] += w.hash[d:] * factor[d]
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], runs)
    out = mix(whole[at])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = w.hash[w.first[i] : w.first[i + 1]]
        out[first[i]] = mix(np.array([(own * factor[: len(own)]).sum() + U(len(own))], U))[0]
    return out, first


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offset = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offset, offset[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of flat values."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
