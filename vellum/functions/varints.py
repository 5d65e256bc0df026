"""Whole numbers in seven bits a byte, many lists at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of non-negative numbers, which begin at ``starts``, as one binary value each; the top bit tells that a number goes on."""
    values = values.astype(np.uint64)
    widths = np.ones(len(values), np.int64)
    top, k = int(values.max(initial=0)), 1
    while top >> (7 * k):
        widths += values >> np.uint64(7 * k) > 0
        k += 1
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.uint8)
    for place in range(k):
        rows = np.flatnonzero(widths > place)
        part = (values[rows] >> np.uint64(7 * place)) & np.uint64(127)
        out[ends[rows] - widths[rows] + place] = part | np.where(widths[rows] > place + 1, np.uint64(128), np.uint64(0))
    offsets = np.append((ends - widths)[starts] if len(starts) else [], total).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(column: pa.Array) -> np.ndarray:
    """The numbers of all lists one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).astype(np.int64)


def heads(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes begin."""
    return np.cumsum(sizes) - sizes


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each list's first number, then what is added from one to the next."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lists whose ``gaps`` these are."""
    starts, sums = heads(sizes), np.cumsum(values)
    return sums - np.repeat(sums[starts] - values[starts], sizes)
