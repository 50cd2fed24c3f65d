"""Whole numbers packed for a shuffle, and tables of them cut at their keys."""

from __future__ import annotations

import numpy as np


def packed(a: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers, or the differences of neighbours if they are mostly in order, laid out by byte and compressed."""
    import pyarrow as pa

    a = a.astype(np.int64, copy=False)
    if ordered:
        d = np.diff(a, prepend=np.int64(0))
        a = (d << 1) ^ (d >> 63)  # small numbers of either sign have their upper bytes 0
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int, ordered: bool = False) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(b, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    a = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)
    if ordered:
        return np.cumsum((a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).astype(np.int64))
    return a.view(np.int64)


def whole_keys(batches, rows: int):
    """Batches that are sorted by their first column -> lists of their columns as numpy arrays, of about `rows` rows; no key is cut."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
        if n >= rows:
            a = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(a[0], a[0][-1]))  # where the last key begins: it may go on
            held, n = [[c[cut:] for c in a]], len(a[0]) - cut
            if cut:
                yield [c[:cut] for c in a]
            else:
                rows = max(rows, 2 * n)
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def slices(weights: np.ndarray, most: int):
    """(from, to) of runs whose weights come to `most` at most, or of single places."""
    up, at = np.cumsum(weights), 0
    while at < len(up):
        to = max(at + 1, int(np.searchsorted(up, (up[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to
