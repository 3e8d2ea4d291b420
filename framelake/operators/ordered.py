"""Sorted rows that stream through a task, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of consecutive rows with equal keys starts."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows in their order, cut only between groups; keys aren't null."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        start = int(_starts(pa.Table.from_batches([b]), keys)[-1])
        if held and start == 0 and all(held[-1].column(k)[-1] == b.column(k)[0] for k in keys):
            held.append(b)
            continue
        if whole := [*held, b.slice(0, start)] if start else held:
            yield pa.Table.from_batches(whole)
        held = [b.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def groups_of(t: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    starts = _starts(t, keys)
    for a, z in zip(starts, [*starts[1:], len(t)]):
        yield t.slice(a, z - a)
