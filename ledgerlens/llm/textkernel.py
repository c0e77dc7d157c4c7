"""Vectorised work on whole UTF-8 texts inside tasks: word spans, hashes of spans, windows of words.

Everything here takes the Arrow buffers of one batch and works in blocks of a few megabytes, so the memory of
a task follows the block and its longest text, not the partition. A hash of a span adds up its eight-byte pieces,
each scrambled together with its position, so no regular pattern of letters cancels out; two different spans meet
with a chance of about 2^-64. Where a result must not rest on that, ``same_spans`` compares the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in blocks of at most this many bytes (a longer text is a block of its own).
BLOCK_BYTES = 4_000_000


def mix(x):
    """A bijective scrambling of 64-bit values (shift and multiply rounds)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(count, seed):
    """``count`` pseudo-random 64-bit values made from a seed."""
    return mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15) + mix(np.array([seed], U)))


#: Words are separated by the space and the characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Terms of search and decontamination consist of letters, digits and all bytes beyond ASCII.
TERM_SPACE = np.zeros(256, bool)
TERM_SPACE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_places = np.empty(0, U)


def _place(n):
    """A pseudo-random value for each position 0 to n - 1; kept in the worker."""
    global _places
    if len(_places) < n:
        _places = constants(1 << int(n).bit_length(), 12)
    return _places


def ranges(start, length):
    """start[0], ..., start[0] + length[0] - 1, start[1], ..."""
    ends = np.cumsum(length)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(start - (ends - length), length)


def _summed(values, length):
    """A hash of each run of ``length`` values: every value is scrambled with its position, then added."""
    ends = np.cumsum(length)
    position = ranges(np.zeros(len(length), np.int64), length)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values ^ _place(int(length.max(initial=0)))[position]), out=total[1:])
    return total[ends] - total[ends - length]


def span_hash(values, starts, ends):
    """A hash of each span ``values[start:end]`` of 64-bit values; starts and ends are in order."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, int(starts[at]) + BLOCK_BYTES // 8, "right")))
        length = ends[at:stop] - starts[at:stop]
        out[at:stop] = _summed(values[ranges(starts[at:stop], length)], length)
        at = stop
    return mix(out ^ (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


_TAIL = np.array([~U(0) if k == 0 else U((1 << 8 * k) - 1) for k in range(8)], U)


def pieces(buffer, starts, ends):
    """Each span of bytes as eight-byte values (the last filled with zeros), and their number per span."""
    length = ends - starts
    count = -(-length // 8)
    base = int(starts[0]) if len(starts) else 0
    top = int(ends.max(initial=base))
    padded = np.zeros(top - base + 8, np.uint8)
    padded[: top - base] = buffer[base:top]
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    position = ranges(np.zeros(len(count), np.int64), count)
    out = words[np.repeat(starts - base, count) + 8 * position]
    ending = np.cumsum(count)[count > 0] - 1
    out[ending] &= _TAIL[(length[count > 0]) % 8]
    return out, count


def byte_hash(buffer, starts, ends):
    """A hash of each span of bytes, block by block; starts and ends are in order."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, int(starts[at]) + BLOCK_BYTES // 2, "right")))
        out[at:stop] = _summed(*pieces(buffer, starts[at:stop], ends[at:stop]))
        at = stop
    return mix(out ^ (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def same_spans(one, starts, ends, other, from_, to):
    """Whether span i of ``one`` and span i of ``other`` hold the same bytes; spans in any order."""
    equal = (ends - starts) == (to - from_)
    some = np.flatnonzero(equal)
    for at in range(0, len(some), 100_000):
        rows = some[at : at + 100_000]
        length = ends[rows] - starts[rows]
        differ = one[ranges(starts[rows], length)] != other[ranges(from_[rows], length)]
        total = np.zeros(len(differ) + 1, np.int64)
        np.cumsum(differ, out=total[1:])
        last = np.cumsum(length)
        equal[rows] = total[last] == total[last - length]
    return equal


class Texts:
    """The texts of a block: bytes, where each text begins, its words."""

    def __init__(self, buffer, offsets, lower=False, space=SPACE):
        self.buffer = LOWER[buffer] if lower else buffer
        self.offsets = offsets
        n = len(self.buffer)
        self.space = space[self.buffer]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = self.space[:-1]
        after = np.ones(n, bool)
        after[:-1] = self.space[1:]
        self.starts = np.flatnonzero(~self.space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~self.space & (after | edge[1:])) + 1
        #: The words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self):
        return len(self.offsets) - 1

    def word_hashes(self):
        return byte_hash(self.buffer, self.starts, self.ends)

    def total(self, flags):
        """How many bytes of each text are flagged."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def lines(self):
        """Starts and ends of all ``\\n``-split lines, and the first line of each text."""
        breaks = np.flatnonzero(self.buffer == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        per_text = np.searchsorted(breaks, self.offsets)
        return starts, ends, per_text + np.arange(len(self.offsets))


_ROTATE = constants(64, 13) | U(1)


def windows(hashes, size):
    """A hash of every ``size`` consecutive word hashes (the caller leaves out those across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U)
    out = hashes[:n] * _ROTATE[0]
    for j in range(1, size):
        out += hashes[j : n + j] * _ROTATE[j]
    return mix(out)


def shingles(hashes, size):
    """The distinct windows of one text, sorted; a shorter text is one window, an empty one has none."""
    if len(hashes) == 0:
        return np.empty(0, U)
    return np.unique(windows(hashes, min(size, len(hashes))) ^ U(0 if len(hashes) >= size else len(hashes)))


def blocks(batch, column, limit=BLOCK_BYTES):
    """(rows, bytes, offsets) of an Arrow batch's text column in blocks of about ``limit`` bytes; a null text is
    empty."""
    text = batch.column(batch.schema.get_field_index(column))
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    if len(text) == 0:
        return
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, stop), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def signed(values):
    """64-bit hashes as Spark's signed longs."""
    return np.asarray(values, U).view(np.int64)


def list_array(values, lengths, kind):
    """An Arrow list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
