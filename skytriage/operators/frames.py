"""Whole frames out of batches of sorted rows, for work on the arrays of many frames at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FRAME = ["source_video", "frame_index"]

#: Rows that are settled at a time, to the end of a frame.
AT_ONCE = 1 << 15


def changes(t: pa.Table, columns: list[str], nulls_equal: bool = False) -> np.ndarray:
    """Rows that differ from the row before; the first one does. Nulls are equal as in a group, or not as in a join."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        here, last = t.column(c).slice(1), t.column(c).slice(0, max(t.num_rows - 1, 0))
        unlike = pc.fill_null(pc.not_equal(here, last), True)
        new[1:] |= (pc.and_(unlike, pc.or_(here.is_valid(), last.is_valid())) if nulls_equal else unlike).to_numpy()
    return new


def whole_frames(batches: Iterator[pa.RecordBatch], settled: Callable[[pa.Table], pa.RecordBatch],
                 nulls_equal: bool = False) -> Iterator[pa.RecordBatch]:
    """What ``settled`` makes of some ten thousand rows at a time, never a part of a frame."""
    held: list[pa.RecordBatch] = []

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        # Rows of the last frame wait for the rest of it.
        end = t.num_rows if last else int(np.flatnonzero(changes(t, FRAME, nulls_equal))[-1])
        if end:
            yield settled(t.slice(0, end))
        held = t.slice(end).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            yield from whole(False)
    if sum(b.num_rows for b in held):
        yield from whole(True)
