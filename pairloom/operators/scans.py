"""Running values over sorted Arrow batches of one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def _changes(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row has another key than the row before it."""
    out = np.zeros(batch.num_rows, bool)
    for i, key in enumerate(keys):
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
        out[0] |= last is None or batch.column(key)[0].as_py() != last[i]
    return out


def _series(column: pa.Array) -> pd.Series:
    return column.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)


def scan_batches(
    batches: Iterator[pa.RecordBatch], keys: list[str], kinds: dict[str, str], kept: list[str], names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Rows with their number in the key, running values, and marks of the first key and the last row.

    ``_first`` is set on the task's first row, ``_last`` on its last. Batches arrive in order; one
    batch is held back, so that the last row is known, and the state between batches is one row.
    """
    last: tuple | None = None
    state: dict[str, object] = {}
    held: pa.RecordBatch | None = None
    count, begun = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes(batch, keys, last)
        segment = pd.Series(np.cumsum(change))
        goes_on = segment == 0  # rows of the key that the batch before ended in
        number = segment.groupby(segment).cumcount().to_numpy() + 1
        number = number + np.where(goes_on, count, 0)
        columns = {"_n": pa.array(number, pa.int64())}
        for name, kind in kinds.items():
            column = batch.column(f"_v_{name}")
            value = _series(column)
            groups = value.groupby(segment)
            if kind == "sum":
                run = groups.cumsum()
            else:
                run = groups.cummin() if kind == "min" else groups.cummax()
            run = run.groupby(segment).ffill()
            before = state.get(name)
            if goes_on.any() and before is not None and not pd.isna(before):
                own = run[goes_on]
                if kind == "sum":
                    own = own.fillna(0) + before
                else:
                    own = own.fillna(before).clip(**{"upper" if kind == "min" else "lower": before})
                run[goes_on] = own
            if kind == "first_max":
                previous = run.groupby(segment).shift(1)
                previous[(segment == 0) & (np.arange(len(run)) == 0)] = before
                rises = run.notna() & (previous.isna() | (run > previous))
                place = pd.Series(np.where(rises, number, 0)).groupby(segment).cummax()
                held_place = state.get(f"{name} place", 0)
                place = np.where(goes_on & (place == 0), held_place, place)
                columns[f"_p_{name}"] = pa.array(place, pa.int64(), mask=run.isna().to_numpy())
                state[f"{name} place"] = int(place[-1])
            columns[f"_l_{name}"] = pa.Array.from_pandas(run, type=column.type)
            state[name] = run.iloc[-1]
        count = int(number[-1])
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        first = np.zeros(batch.num_rows, bool)
        first[0], begun = not begun, True
        columns["_first"] = pa.array(first)
        columns["_last"] = pa.array(np.zeros(batch.num_rows, bool))
        made = pa.RecordBatch.from_arrays(
            [batch.column(n) if n in kept else columns[n] for n in names], names
        )
        if held is not None:
            yield held
        held = made
    if held is not None:
        end = np.zeros(held.num_rows, bool)
        end[-1] = True
        yield held.set_column(names.index("_last"), "_last", pa.array(end))
