"""Sums of products of all column pairs, as matrices over the batches of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PAIR_SUMS = "a int, b int, n long, x double, y double, xx double, yy double, xy double"
#: A spread below this share of the squares is rounding.
NO_SPREAD = 1e-13
#: Rows whose products are summed at a time.
ROWS = 4096


def pair_sums(centres: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of numbers to a row a pair of columns: how many rows have both, and their sums and sums of products.

    Values are taken as distances from their column's centre, so large values with small differences keep
    them. With V the values, 0 where missing, and M what is there: V'V, V'M, (V*V)'M and M'M hold the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centres)
        there, plain, squares, products = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]) - centres
                mask = ~np.isnan(values)
                values[~mask] = 0.0
                held = mask.astype(float)
                there += held.T @ held
                plain += values.T @ held
                squares += (values * values).T @ held
                products += values.T @ values
        a, b = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.rint(there[a, b]).astype(np.int64)), pa.array(plain[a, b]),
            pa.array(plain[b, a]), pa.array(squares[a, b]), pa.array(squares[b, a]), pa.array(products[a, b]),
        ], ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return run
