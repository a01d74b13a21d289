"""Ordered per-key folds over a sorted partition: memory is one key's state, not its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def keyed_fold(df: DataFrame, keys: Sequence[str], order: Sequence, init: Callable[[], dict],
               step: Callable[[dict, object], list[tuple]], schema: str,
               close: Callable[[dict, tuple], list[tuple]] | None = None) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in ``order``; it returns output rows.

    Rows are hashed by key and sorted inside partitions, then streamed in Arrow
    batches. ``close(state, key)`` may add rows when a key ends.
    """
    keys = list(keys)
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if close is not None and current is not None:
                        out.extend(close(state, current))
                    current, state = key, init()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=columns)
        if close is not None and current is not None:
            yield pd.DataFrame(close(state, current), columns=columns)

    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))
