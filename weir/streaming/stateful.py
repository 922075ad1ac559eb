"""dedupe and every_nth over streams: one keyed state for each tenant and key.

State ends by the clock, as in a store with a time to live: a holder after its window and LATE more, so that
records which arrive late still meet it; a counter after a day without records, when it starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weir.operators.dedupe import Dedupe, judge
from weir.operators.sample import Sample
from weir.plans.frames import Frame


#: Milliseconds that a holder outlives its window.
LATE = 3_600_000
DAY = 86_400_000


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch by time and id. The last three columns are time, id and row, whatever they are called."""
    return pd.concat(list(rows)).iloc[:, -3:].set_axis(["_time", "_id", "_row"], axis=1).sort_values(["_time", "_id"], kind="stable")


class _Holders(StatefulProcessor):
    """Keeps the holder (time, id) of a key; records of a batch are judged in order of time and id."""

    def __init__(self, window: int, ttl_ms: int):
        self.window, self.ttl_ms = window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "time bigint, id bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        found = self.holder.get()
        holder = (found[0], found[1]) if found is not None else None
        before = holder
        batch = _in_order(rows)
        kept = []
        for time, ident in zip(batch["_time"], batch["_id"], strict=True):
            passed, holder = judge(holder, int(time), int(ident), self.window)
            kept.append(passed)
        if holder != before:
            self.holder.update(holder)
        yield batch[kept][["_row"]]

    def close(self) -> None:
        pass


class _Counter(StatefulProcessor):
    """Counts a tenant's records; the first of each n stays."""

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "count bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        found = self.count.get()
        count = found[0] if found is not None else 0
        batch = _in_order(rows)
        kept = [(count + k) % self.n == 0 for k in range(len(batch))]
        self.count.update((count + len(batch),))
        yield batch[kept][["_row"]]

    def close(self) -> None:
        pass


def _through(frame: Frame, keys: list, processor: StatefulProcessor) -> Frame:
    """The records a processor keeps. Rows travel as JSON text beside what it judges by."""
    kind = frame.df.schema
    row = F.to_json(F.struct("record", "meta"), {"ignoreNullFields": "false"})
    rows = frame.df.select(*keys, F.col("meta.ingestion_time").alias("_time"), F.col("meta.id").alias("_id"), row.alias("_row"))
    kept = rows.groupBy(*[k for k in rows.columns if k.startswith("_k")]).transformWithStateInPandas(processor, outputStructType="_row string", outputMode="Append", timeMode="ProcessingTime")
    return Frame(kept.select(F.from_json("_row", kind).alias("_row")).select("_row.record", "_row.meta"))


def dedupe(stage: Dedupe, frame: Frame, ttl_ms: int | None = None) -> Frame:
    ttl = ttl_ms or -(-stage.window // 10**6) + LATE
    return _through(frame, [F.col("meta.tenant").alias("_k1"), frame.shape.key(stage.key).alias("_k2")], _Holders(stage.window, ttl))


def every_nth(stage: Sample, frame: Frame, ttl_ms: int | None = None) -> Frame:
    return _through(frame, [F.col("meta.tenant").alias("_k1")], _Counter(stage.n, ttl_ms or DAY))


def stateful_stage(stage: Dedupe | Sample, frame: Frame, ttl_ms: int | None = None) -> Frame:
    return dedupe(stage, frame, ttl_ms) if isinstance(stage, Dedupe) else every_nth(stage, frame, ttl_ms)
