"""Plug-in points: batched vector providers and page functions with row-level failure capture."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_with(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]], batch: int = 32,
               out: str = "embedding") -> DataFrame:
    """Add a vector column from a provider; null (and ``<out>_error``) where it is unavailable.

    ``load()`` runs once per Python worker task and returns ``fn(values) -> vectors``.
    """
    @F.pandas_udf("vector array<float>, error string")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            fn, broken = load(), None
        except Exception as exc:  # the provider is missing: other weights apply downstream
            fn, broken = None, f"{type(exc).__name__}: {exc}"
        for part in parts:
            vectors, errors = [], []
            values = part.tolist()
            for i in range(0, len(values), max(1, batch)):
                chunk = values[i:i + batch]
                try:
                    if fn is None:
                        raise RuntimeError(broken)
                    vectors += [None if v is None else [float(e) for e in v] for v in fn(chunk)]
                    errors += [None] * len(chunk)
                except Exception as exc:
                    vectors += [None] * len(chunk)
                    errors += [broken or f"{type(exc).__name__}: {exc}"] * len(chunk)
            yield pd.DataFrame({"vector": vectors, "error": errors})
    d = df.withColumn("__e", embed(F.col(column)))
    return d.select(*df.columns, F.col("__e.vector").alias(out), F.col("__e.error").alias(f"{out}_error"))


def map_pages(df: DataFrame, fn: Callable[[dict], dict], schema: str, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Run a page function over rows; a failing row keeps its key and reports the error.

    ``schema`` lists the output fields of ``fn``; columns in ``keep`` travel along.
    """
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                key = [record[c] for c in keep]
                try:
                    got = fn(record)
                    rows.append((*key, *[got.get(n) for n in names], None))
                except Exception as exc:
                    rows.append((*key, *[None] * len(names), f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=[*keep, *names, "error"])
    return df.mapInPandas(run, f"{kept}, {schema}, error string")
