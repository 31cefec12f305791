"""Words of a batch of texts as 64-bit hashes, computed over the whole byte buffer at once.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over randomised
bytes modulo 2**64, taken as a difference of running sums and then mixed; two different words share
a hash with a chance of about 2**-64 times their length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_FACTOR = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * _FACTOR)
_STEP = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR, _STEP), _powers(_INVERSE, _STEP)
_UP_BLOCK = U(pow(int(_FACTOR), _STEP, 2**64))
_DOWN_BLOCK = U(pow(int(_INVERSE), _STEP, 2**64))


@dataclass
class Words:
    """``starts``/``ends`` are byte places in ``data``; ``first`` has the first word of each text, and the total."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of whole words, or of their first ``length`` bytes."""
        ends = self.ends if length is None else np.minimum(self.ends, self.starts + length)
        diff = self.sums[ends] - self.sums[self.starts]
        blocks = _powers(_DOWN_BLOCK, max(1, (len(self.data) >> 16) + 1))
        diff *= blocks[self.starts >> 16] * _DOWN[self.starts & (_STEP - 1)]
        return mix(diff ^ ((ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93)))


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of an Arrow string array; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    whole = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    data = whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0]
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False  # a text begins here, whatever the one before it ended with
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    blocks = _powers(_UP_BLOCK, max(1, (len(data) >> 16) + 1))
    terms = _BYTES[data]
    for k in range(0, len(data), _STEP):
        terms[k : k + _STEP] *= _UP[: len(terms[k : k + _STEP])] * blocks[k >> 16]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(terms, out=sums[1:])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), sums)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of a shorter one, of the whole sequence."""
    n = len(hashes)
    size = min(size, n)
    out = np.full(max(0, n - size + 1) if n else 0, U(size), U)
    for k in range(size if n else 0):
        out = mix(out * _FACTOR + hashes[k : n - size + 1 + k])
    return out


#: Bytes of the slices of work that makes many arrays from each: the arrays of a slice are some forty times as large.
FINE = 1 << 19


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches that leaves no unused Arrow memory with its worker process, which Spark keeps for later tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()  # by now nothing of the work refers to a batch

    return run


def slices(texts: pa.Array, most_bytes: int = 1 << 21) -> list[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``most_bytes``, to bound the arrays made from each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.cast(pa.large_binary()).buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    out, begin = [], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
        out.append((begin, min(end, len(texts))))
        begin = out[-1][1]
    return out
