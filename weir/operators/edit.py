"""edit: set, rename, copy, hash and delete, in order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import paths
from weir.operators.base import PASS, Result, Stage
from weir.plans.config import known_keys
from weir.plans.frames import Frame, Structured, canonical, rewritten

OPS = {"set": ("field", "value"), "rename": ("from", "to"), "copy": ("from", "to"), "hash": ("field",), "delete": ("fields",)}
_NAMES = "`set`, `rename`, `copy`, `hash` or `delete`"


class Edit(Stage):
    """An operation that finds nothing to work on is unapplied: skipped and counted, or, with on_unapplied: drop, the end of the record."""

    required, optional = ("ops",), ("on_unapplied",)

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.drop = self.choice(params.get("on_unapplied", "skip"), "skip", "drop") == "drop"
        self.ops: list[tuple[str, dict]] = []
        for k, entry in enumerate(self.listed(params["ops"], "`ops`")):
            if not isinstance(entry, dict) or len(entry) != 1:
                raise self.error("bad_op", f"op {k} is not one mapping with one of {_NAMES}")
            ((op, given),) = entry.items()
            if op not in OPS:
                raise self.error("bad_op", f"op {k}: `{op}` is none of {_NAMES}")
            where = f"op {k} (`{op}`)"
            given = self.mapping(given or {}, where)
            known_keys(given, tuple(OPS[op]), (), node, f"{where}: ")
            read = dict(given)
            for key in ("field", "from", "to"):
                if key in given:
                    read[key] = self.path(given[key], f"{where}: `{key}`", target=not (op == "copy" and key == "from"))
            if op == "set" and isinstance(given["value"], (list, dict)):
                raise self.error("wrong_type", f"{where}: only a text, a number, a bool or null can be set")
            if op == "delete":
                read["fields"] = [self.path(f, f"{where}: `fields`", target=True) for f in self.listed(given["fields"], f"{where}: `fields`")]
            if op in ("copy", "rename") and read["from"] == read["to"]:
                raise self.error("same_field", f"{where}: a field cannot become itself")
            self.ops.append((op, read))

    def apply(self, frame: Frame) -> Result:
        return self._free(frame) if frame.free_form else self._structured(frame)

    def _result(self, flagged: Frame, flags: Column) -> Result:
        clean = Frame(flagged.df.drop("_flags", "flags"))
        counted = {("edit_unapplied_total", ""): flagged.df.withColumn("_flag", F.explode(flags)).filter("_flag is not null")}
        if not self.drop:
            return Result({PASS: clean}, {}, counted)
        bad = F.exists(flags, lambda x: x.isNotNull())
        return Result({PASS: Frame(flagged.filter(~bad).df.drop("_flags", "flags"))}, {"edit_unapplied": flagged.filter(bad).df}, counted)

    def _structured(self, frame: Frame) -> Result:
        """Operations one after another on the typed record; each adds a flag where a row has nothing to work on."""
        df = frame.df.withColumn("_flags", F.array().cast("array<string>"))
        for op, given in self.ops:
            shape = Structured(df.schema["record"].dataType, df.schema["meta"].dataType)
            record, flag = F.col("record"), None
            if op == "set":
                record = shape.put(given["field"], F.lit(given["value"]))
            elif op in ("copy", "rename"):
                bound = shape.bind(given["from"])
                if bound is None:
                    flag = F.lit("absent")
                else:
                    missing = bound[0].isNull()
                    flag = F.when(missing, F.lit("absent"))
                    # what is at the target stays where there is nothing to write
                    old = shape.bind(given["to"])
                    value = F.coalesce(bound[0], old[0]) if old and old[1] == bound[1] else bound[0]
                    if op == "copy":
                        record = shape.put(given["to"], value)
                    else:
                        df = df.withColumn("_flags", F.concat("_flags", F.array(flag))).withColumn("_value", value).withColumn("record", shape.removed(given["from"]))
                        flag = None
                        record = Structured(df.schema["record"].dataType, shape.meta).put(given["to"], F.col("_value"))
            elif op == "hash":
                bound = shape.bind(given["field"])
                if bound is None:
                    flag = F.lit("absent")
                elif isinstance(bound[1], (T.ArrayType, T.StructType, T.MapType)):
                    flag = F.when(bound[0].isNull(), F.lit("absent")).otherwise(F.lit("type"))
                else:
                    text = bound[0] if isinstance(bound[1], T.StringType) else shape.json(given["field"])
                    flag = F.when(bound[0].isNull(), F.lit("absent"))
                    record = shape.put(given["field"], F.when(bound[0].isNotNull(), F.sha2(text.cast("binary"), 256)))
            else:
                flags = []
                for p in given["fields"]:
                    shape = Structured(df.schema["record"].dataType, df.schema["meta"].dataType)
                    bound = shape.bind(p)
                    flags.append(F.lit("absent") if bound is None else F.when(bound[0].isNull(), F.lit("absent")))
                    if bound is not None:
                        df = df.withColumn("_flags", F.concat("_flags", F.array(flags[-1]))).withColumn("record", shape.removed(p))
                    else:
                        df = df.withColumn("_flags", F.concat("_flags", F.array(flags[-1])))
                continue
            if flag is not None:
                df = df.withColumn("_flags", F.concat("_flags", F.array(flag)))
            df = df.withColumn("record", record).drop("_value")
        return self._result(Frame(df), F.col("_flags"))

    def _free(self, frame: Frame) -> Result:
        ops = self.ops

        def change(record: object, meta: dict) -> tuple[object, list[str]]:
            flags: list[str] = []
            for op, given in ops:
                if op == "set":
                    record = paths.put(record, given["field"], given["value"])
                elif op == "delete":
                    for p in given["fields"]:
                        if paths.get(record, p) is None:
                            flags.append("absent")
                        record = paths.remove(record, p)
                elif op == "hash":
                    value = paths.get(record, given["field"])
                    if value is None or isinstance(value, (list, dict)):
                        flags.append("absent" if value is None else "type")
                        continue
                    text = value if isinstance(value, str) else canonical(value)
                    record = paths.put(record, given["field"], hashlib.sha256(text.encode()).hexdigest())
                else:
                    source = given["from"]
                    value = meta[source.meta] if source.meta else paths.get(record, source)
                    if value is None:
                        flags.append("absent")
                        continue
                    if op == "rename":
                        record = paths.remove(record, source)
                    record = paths.put(record, given["to"], value)
            return record, flags

        return self._result(Frame(rewritten(frame, change)), F.col("flags"))
