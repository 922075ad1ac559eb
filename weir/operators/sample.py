"""sample: random by record id, every nth of a tenant, or consistent by key."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from weir.functions import hashing
from weir.operators.base import PASS, Result, Stage
from weir.plans.frames import Frame

MODES = ("random", "every_nth", "consistent")
_OF = {"percent": ("random", "consistent"), "n": ("every_nth",), "key": ("consistent",), "on_state_error": ("every_nth",)}
#: Records of a tenant are ranked within stretches of time of this many nanoseconds; results do not depend on it.
STRETCH = 3_600_000_000_000


class Sample(Stage):
    required, optional = (), ("mode", "percent", "n", "key", "on_state_error")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.mode = params.get("mode")
        if self.mode is None:
            raise self.error("missing_field", "say how to sample with `mode`: " + ", ".join(MODES))
        self.choice(self.mode, *MODES)
        for key, modes in _OF.items():
            if key in params and self.mode not in modes:
                raise self.error("field_of_other_mode", f"`{self.mode}` takes no `{key}`; that is for " + " and ".join(modes))
        self.stateful = self.mode == "every_nth"
        if self.mode == "every_nth":
            self.n = params.get("n")
            if self.n is None:
                raise self.error("missing_field", "`n` says of how many records one stays")
            if self.number(self.n, "`n`", whole=True) < 1:
                raise self.error("out_of_range", "`n` starts at 1")
            self.choice(params.get("on_state_error", "pass"), "pass", "nak")
            return
        percent = params.get("percent")
        if percent is None:
            raise self.error("missing_field", "`percent` says how many records of a hundred stay")
        if not 0 < self.number(percent, "`percent`") <= 100:
            raise self.error("out_of_range", f"{percent} is no share that could stay; `percent` goes from just over 0 to 100")
        self.limit = hashing.threshold(percent)
        if self.mode == "consistent":
            if "key" not in params:
                raise self.error("missing_field", "`key` lists the fields whose equal values stay or go as one")
            self.key = [self.path(p, "`key`") for p in self.listed(params["key"], "`key`")]

    def kept(self, frame: Frame) -> tuple[Frame, Column]:
        """The frame, with a column _key where one is needed, and which of its records stay."""
        if self.mode == "random":
            salt = hashing.signed(hashing.fnv1a64_py(self.node.encode()))
            return frame, hashing.at_most(hashing.mix(F.col("meta.id").bitwiseXOR(F.lit(salt).cast("long"))), self.limit)
        keyed = Frame(frame.df.withColumn("_key", frame.shape.key(self.key)))
        return keyed, hashing.at_most(hashing.mix(hashing.fnv1a64(F.col("_key"))), self.limit)

    def apply(self, frame: Frame) -> Result:
        if self.mode != "every_nth":
            keyed, kept = self.kept(frame)
            return Result({PASS: Frame(keyed.filter(kept).df.drop("_key"))}, {"sample": keyed.filter(~kept).df.drop("_key")})
        marked = self.ranked(frame)
        kept = F.col("_rank") % self.n == 0
        return Result({PASS: Frame(marked.filter(kept).drop("_rank"))}, {"sample": marked.filter(~kept).drop("_rank")})

    def ranked(self, frame: Frame):
        """Adds _rank, from 0, of each record of its tenant by time and id.

        A tenant with most of the records is spread over stretches of time: their counts give each
        stretch its first rank, and records are ordered inside stretches only.
        """
        df = frame.df.withColumn("_tenant", F.col("meta.tenant")).withColumn("_stretch", F.floor(F.col("meta.ingestion_time") / STRETCH))
        counts = df.groupBy("_tenant", "_stretch").count()
        before = F.sum("count").over(Window.partitionBy("_tenant").orderBy("_stretch")) - F.col("count")
        starts = counts.select(F.col("_tenant").alias("_t"), F.col("_stretch").alias("_s"), before.alias("_before"))
        inside = F.row_number().over(Window.partitionBy("_tenant", "_stretch").orderBy("meta.ingestion_time", "meta.id")) - 1
        df = df.withColumn("_inside", inside).join(starts, F.col("_tenant").eqNullSafe(F.col("_t")) & F.col("_stretch").eqNullSafe(F.col("_s")))
        return df.withColumn("_rank", F.col("_before") + F.col("_inside")).select("record", "meta", "_rank")
