"""Run an ordered rule or the page status as a Structured Streaming query."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chromaframe.streaming.log import append_latest, read_latest
from chromaframe.streaming.state import Rule, page_status


def stream_rule(rule: Rule, stream: DataFrame) -> DataFrame:
    """The rule's events, with ``late`` set (and nothing applied) for rows that come too late.

    Rows of a key are ordered within a micro-batch. A row is late if it does not come after the last row of earlier
    batches in the rule's whole order, so a page whose rows arrive in order may be cut anywhere.
    The state of a key is one JSON value in the state store. Use the RocksDB provider, append mode.
    """
    names = [p.strip().split(" ")[0] for p in rule.schema.split(",")]

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.value = handle.getValueState("state", "body string, last string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
            frames = [r for r in rows if len(r)]
            if not frames:
                return
            pdf = pd.concat(frames).sort_values(list(rule.order), kind="stable")
            body, last = self.value.get() if self.value.exists() else (None, None)
            state = json.loads(body) if body else rule.init()
            place = lambda row: [getattr(v, "item", lambda v=v: v)() for v in (getattr(row, c) for c in rule.order)]
            out, last = [], json.loads(last) if last else None
            top = last
            for row in pdf.itertuples(index=False):
                at = place(row)
                if last is not None and at <= last:
                    out.append(tuple(getattr(row, n) if n in rule.keys or n == "seq" else None for n in names) + (True,))
                else:
                    out.extend(e + (False,) for e in rule.step(state, row))
                    top = at
            self.value.update((json.dumps(state), json.dumps(top)))
            yield pd.DataFrame(out, columns=[*names, "late"])

        def close(self) -> None:
            pass

    return (stream.select(*rule.columns).groupBy(*rule.keys)
            .transformWithStateInPandas(Fold(), rule.schema + ", late boolean", "Append", "None"))


def upsert_status(stream: DataFrame, table_path: str, checkpoint: str, buckets: int = 16, fan: int = 8):
    """Keep the latest status per page in a log of micro-batches (see ``append_latest``); read it with ``read_status``.

    A batch writes its own pages, not the table; a batch that is run again changes nothing. Returns the query (not started).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_latest(batch.select("page_id", "status", "message", "seq"), table_path, batch_id, page_status, "page_id", buckets, fan)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_status(spark: SparkSession, table_path: str) -> DataFrame:
    """Latest status per page: base and deltas of the last commit, merged."""
    return read_latest(spark, table_path, page_status)


def stream_status(stream: DataFrame) -> DataFrame:
    """Streaming aggregate form (update or complete mode)."""
    return page_status(stream.withColumn("seq", F.col("seq").cast("long")))
