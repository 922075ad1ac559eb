"""dedupe: drops repeats of a key within a window that its holder opened.

The first record of a key becomes its holder. A later one is dropped if less than the window has
passed since the holder, else it takes over. A record with the holder's id (a redelivery), or one older
than the holder, passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.base import PASS, Result, Stage
from weir.plans.frames import Frame

_UNITS = {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}

#: Bytes above which a key is replaced by its digest.
LONG_KEY = 96

Holder = tuple[int, int]


def nanoseconds(text: object) -> int:
    found = re.fullmatch(r"(\d+)([a-z]*)", str(text))
    if not found or found[2] not in _UNITS or int(found[1]) < 1:
        raise ValueError(f"`{text}` is no span of time; write a count from 1 and one of {', '.join(_UNITS)}, such as 90s")
    return int(found[1]) * _UNITS[found[2]]


def judge(holder: Holder | None, time: int, ident: int, window: int) -> tuple[bool, Holder]:
    """Whether a record passes, and who holds the key then."""
    if holder is None or time - holder[0] >= window:
        return True, (time, ident)
    return ident == holder[1] or time < holder[0], holder


def fold(times: np.ndarray, ids: np.ndarray, window: int, holder: Holder | None) -> tuple[np.ndarray, Holder | None]:
    """judge() over the records of one key in order."""
    out = np.zeros(len(times), bool)
    at = 0
    back = np.flatnonzero(np.diff(times) < 0)
    in_order = int(back[-1]) + 1 if len(back) else 0  # from here on times do not fall
    if holder is not None or in_order:
        while at < len(times) and (holder is None or times[at] - holder[0] < window or at < in_order):
            out[at], holder = judge(holder, int(times[at]), int(ids[at]), window)
            at += 1
    while at < len(times):  # in order of time: jump from holder to holder
        holder = (int(times[at]), int(ids[at]))
        end = int(np.searchsorted(times, times[at] + window))
        out[at:end] = ids[at:end] == ids[at]
        out[at] = True
        at = end
    return out, holder


class Dedupe(Stage):
    required, optional = ("key", "window"), ("on_state_error",)
    stateful = True

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.key = [self.path(p, "`key`") for p in self.listed(params["key"], "`key`")]
        self.choice(params.get("on_state_error", "pass"), "pass", "nak")
        try:
            self.window = nanoseconds(params["window"])
        except ValueError as e:
            raise self.error("bad_window", e) from None

    def keyed(self, frame: Frame) -> DataFrame:
        """Long keys are told apart by their SHA-256, so that they need not be moved and compared as texts; no key looks like one."""
        key = F.col("_key")
        short = F.when(F.octet_length(key) > LONG_KEY, F.sha2(key, 256)).otherwise(key)
        return frame.df.select(F.col("meta.tenant").alias("_tenant"), frame.shape.key(self.key).alias("_key"), "record", "meta").withColumn("_key", short)

    def apply(self, frame: Frame, arrival: Column | None = None) -> Result:
        """Batch: records of a key are judged in order of time and id, or of `arrival`.

        Keys are dealt to tasks, sorted, and read as a stream with one holder in memory, so a
        key with a third of all records costs time in one task but no memory.
        """
        order = [F.col("meta.ingestion_time"), F.col("meta.id")] if arrival is None else [arrival]
        keyed = self.keyed(frame)
        window = self.window

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, holder = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                tenants, keys = batch.column("_tenant"), batch.column("_key")
                meta = batch.column("meta")
                times, ids = (meta.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("ingestion_time", "id"))
                out = np.zeros(batch.num_rows, bool)
                new = np.zeros(batch.num_rows - 1, bool)
                for column in (tenants, keys):
                    known, text = column.is_valid(), pc.fill_null(column, "")
                    for x in (known, text):
                        new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
                ends = [*(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
                for first, end in zip([0, *ends], ends, strict=False):
                    own = (tenants[first].as_py(), keys[first].as_py())
                    out[first:end], holder = fold(times[first:end], ids[first:end], window, holder if own == before else None)
                    before = own
                yield batch.append_column("_pass", pa.array(out))

        ordered = keyed.repartition("_tenant", "_key").sortWithinPartitions("_tenant", "_key", *order)
        schema = keyed.schema.add("_pass", "boolean")
        marked = ordered.mapInArrow(judged, schema)
        return Result({PASS: Frame(marked.filter("_pass").select("record", "meta"))}, {"dedupe": marked.filter("not _pass").select("record", "meta")})
