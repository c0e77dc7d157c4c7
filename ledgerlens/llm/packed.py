"""Packed columns: numpy arrays as compressed bytes, sorted hashes as differences, buckets by leading bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerlens.llm.textkernel import U


def fold(x):
    """An array as bytes; the first eight say how long it is."""
    x = np.ascontiguousarray(x)
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unfold(data, kind):
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def fold_numbers(x):
    """Small 32-bit numbers, byte by byte of all: the upper bytes are nearly empty."""
    return fold(np.asarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T)


def unfold_numbers(data):
    return np.ascontiguousarray(unfold(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def pack_keys(keys):
    """Sorted 64-bit keys as differences of as few bytes as the largest needs."""
    step = np.diff(keys, prepend=U(0))
    width = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data):
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    step = np.zeros((len(raw), 8), np.uint8)
    step[:, :width] = raw
    return np.cumsum(step.view(U).ravel(), dtype=U)


def bucket_edges(keys, bits):
    """Where each bucket (the leading ``bits``) begins in sorted keys, and their number."""
    edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits) if bits else np.empty(0, U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
