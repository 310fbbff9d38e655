"""Python functions over whole groups of rows, many small groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROWS_AT_ONCE = 10_000


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that lie together by ``keys``, null being a value; a group may reach over several batches."""
    held: list[pd.DataFrame] = []
    last: tuple = ()
    for pdf in batches:
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), dtype=bool)
        ends = []
        for k in keys:
            values, empty = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
            new[1:] |= ~((values[1:] == values[:-1]).astype(bool) & ~empty[1:] & ~empty[:-1] | empty[1:] & empty[:-1])
            ends.append([None if empty[i] else values[i] for i in (0, -1)])
        new[0] = not held or any(a != b for (a, _), b in zip(ends, last, strict=True))
        last = tuple(b for _, b in ends)
        edges = np.flatnonzero(new).tolist()
        if held and edges:
            held.append(pdf.iloc[: edges[0]])
            yield pd.concat([p for p in held if len(p)], ignore_index=True)
            held = []
        for a, b in zip(edges, edges[1:], strict=False):
            yield pdf.iloc[a:b]
        held.append(pdf.iloc[edges[-1] :] if edges else pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of many small frames in frames of ``ROWS_AT_ONCE`` rows or a little more."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= ROWS_AT_ONCE:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else frame
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, keys: Sequence[str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``func`` of every group's rows, like ``groupBy(keys).applyInPandas``: a group is held whole, so its size must be bounded.

    The results of small groups travel together, so a group costs little more than its rows.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from together(func(part) for part in whole_groups(batches, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
