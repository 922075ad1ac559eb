"""Records as DataFrames: columns `record` and `meta`, in one of two shapes.

Structured: `record` is a struct whose fields are typed; paths bind to it when the plan is made, so
filters reach the scan and unused columns are never read. Free-form: `record` is JSON text, each row of
its own shape; conditions read it as VARIANT, writes go through one Arrow UDF for each operator.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import conditions as C
from weir.functions import paths, regexes
from weir.functions.paths import Path

META = "struct<id:bigint,tenant:string,ingestion_time:bigint,delivery_count:bigint>"


@dataclass(frozen=True)
class Frame:
    df: DataFrame

    @property
    def free_form(self) -> bool:
        return isinstance(self.df.schema["record"].dataType, T.StringType)

    @property
    def shape(self) -> Structured | FreeForm:
        return FreeForm() if self.free_form else Structured(self.df.schema["record"].dataType, self.df.schema["meta"].dataType)

    def filter(self, condition: Column) -> Frame:
        return replace(self, df=self.df.filter(condition))

    def with_record(self, record: Column) -> Frame:
        return replace(self, df=self.df.withColumn("record", record))


def of_table(table: DataFrame, id: Column | str, tenant: Column | str = "unknown", time: Column | None = None) -> Frame:
    """A table as records: every row is a record, every column a field. tenant is a Column or a constant; time is in nanoseconds."""
    ident = F.col(id) if isinstance(id, str) else id
    who = F.lit(tenant) if isinstance(tenant, str) else tenant
    meta = F.struct(ident.cast("bigint").alias("id"), who.alias("tenant"), (F.lit(0) if time is None else time).cast("bigint").alias("ingestion_time"), F.lit(1).cast("bigint").alias("delivery_count"))
    return Frame(table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("record"), meta.alias("meta")))


def nanoseconds(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp")) * 1000


def _ordered(column: Column, op: str, literal: object, isnan: bool = False) -> Column:
    made = {"==": lambda: column == literal, "<": lambda: column < literal, "<=": lambda: column <= literal, ">": lambda: column > literal, ">=": lambda: column >= literal}[op]()
    return made & ~F.isnan(column) if isnan and op in (">", ">=") else made


class Shape:
    """How to read records."""

    def text(self, path: Path) -> Column | None:
        """The value if it is text, else null; None if it can never be text."""
        raise NotImplementedError

    def compared(self, path: Path, op: str, literal: C.Literal) -> Column | bool:
        """A comparison that is null or false where it does not hold; a bool if that is known beforehand."""
        raise NotImplementedError

    def condition(self, c: C.Condition, pattern: Callable[[str], regexes.Pattern], positive: bool = True) -> Column:
        """The condition as a Column. In a positive place (a filter, and below `and` and `or`) null may stand for false, so plain
        comparisons reach the scan; elsewhere it is true or false."""
        if isinstance(c, C.Both):
            left, right = (self.condition(x, pattern, positive) for x in (c.left, c.right))
            return left & right if c.op == "and" else left | right
        if isinstance(c, C.Not):
            return ~self.condition(c.of, pattern, False)
        if isinstance(c, C.Match):
            text = self.text(c.path)
            if text is None:
                return F.lit(c.negated)
            found = pattern(c.pattern).found_in(text)
            if c.negated:
                return ~F.coalesce(found, F.lit(False))
            return found if positive else F.coalesce(found, F.lit(False))
        if c.op == "!=":
            return self._differs(c)
        made = self.compared(c.path, c.op, c.literal)
        if isinstance(made, bool):
            return F.lit(made)
        return made if positive else F.coalesce(made, F.lit(False))

    def _differs(self, c: C.Compare) -> Column:
        made = self.compared(c.path, "==", c.literal)
        return F.lit(not made) if isinstance(made, bool) else ~F.coalesce(made, F.lit(False))


def double_text(x: Column) -> Column:
    """The shortest text of a double, in plain digits from 1e-5 to 1e16 and with a small e beyond: 2.0, 0.0001, 1e16."""
    short = x.cast("string")
    sign = F.when(short.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.replace(F.split_part(F.replace(short, F.lit("-E"), F.lit("E")), F.lit("E"), F.lit(1)), F.lit("-"), F.lit(""))
    power = F.split_part(short, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    bare = F.regexp_replace(digits, "(?<=.)0$", "")
    raised = F.concat(F.rpad(bare, F.greatest(power + 1, F.length(bare)), "0"))
    up = F.concat(F.substring(raised, F.lit(1), power + 1), F.lit("."), F.when(F.length(raised) > power + 1, F.substring(raised, power + 2, F.length(raised))).otherwise(F.lit("0")))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare)
    science = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power.cast("string"))
    return F.when(power.isNull(), short).otherwise(F.concat(sign, F.when((power >= 0) & (power < 16), up).when((power < 0) & (power >= -5), down).otherwise(science)))


class Structured(Shape):
    def __init__(self, record: T.StructType, meta: T.StructType):
        self.record, self.meta = record, meta

    def bind(self, path: Path) -> tuple[Column, T.DataType] | None:
        """The column at a path and its type; None if no row has one."""
        if path.meta:
            return F.col("meta").getField(path.meta), self.meta[path.meta].dataType
        column, kind = F.col("record"), self.record
        for s in path.segments:
            if isinstance(kind, T.StructType) and s in kind.names:
                column, kind = column.getField(s), kind[s].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                column, kind = F.try_element_at(column, F.lit(s)), kind.valueType
            elif isinstance(kind, T.ArrayType) and paths.is_position(s):
                column, kind = F.get(column, int(s)), kind.elementType
            else:
                return None
        return column, kind

    def text(self, path: Path) -> Column | None:
        bound = self.bind(path)
        return bound[0] if bound and isinstance(bound[1], T.StringType) else None

    def compared(self, path: Path, op: str, literal: C.Literal) -> Column | bool:
        bound = self.bind(path)
        if literal is None:
            return (bound[0].isNull() if bound else True) if op == "==" else False
        if bound is None:
            return False
        column, kind = bound
        if isinstance(literal, bool):
            return column == literal if isinstance(kind, T.BooleanType) and op == "==" else False
        if isinstance(literal, str):
            return _ordered(column, op, literal) if isinstance(kind, T.StringType) else False
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return _ordered(column.cast("double") if isinstance(kind, T.FloatType) else column, op, float(literal), True)
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            if isinstance(literal, float):
                return _ordered(column.cast("double"), op, literal)
            return _ordered(column, op, F.lit(literal) if abs(literal) < 2**63 else F.lit(str(literal)).cast("decimal(38,0)"))
        return False

    def _differs(self, c: C.Compare) -> Column:
        made = self.compared(c.path, "==", c.literal)
        if isinstance(made, bool):
            return F.lit(not made)
        bound = self.bind(c.path)
        if c.literal is None:
            return bound[0].isNotNull()
        if isinstance(c.literal, (str, bool)) or isinstance(bound[1], T.IntegralType) and isinstance(c.literal, int) and abs(c.literal) < 2**63:
            return ~bound[0].eqNullSafe(c.literal)
        return ~F.coalesce(made, F.lit(False))

    def json(self, path: Path) -> Column:
        """Canonical JSON text: sorted keys, no spaces, `null` for nothing."""
        bound = self.bind(path)
        return F.lit("null") if bound is None else F.coalesce(_json(*bound), F.lit("null"))

    def key(self, key: list[Path]) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *[self.json(p) for p in key]), F.lit("]"))

    def put(self, path: Path, value: Column) -> Column:
        if not path.segments:
            return value
        return _put(F.col("record"), self.record, path.segments, value, True)

    def removed(self, path: Path) -> Column:
        return _removed(F.col("record"), self.record, path.segments)


def _json(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        quoted = F.to_json(F.array(column))
        return F.when(column.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(None)).otherwise(double_text(column.cast("double")))
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), F.coalesce(_json(column.getField(n), kind[n].dataType), F.lit("null"))) for n in sorted(kind.names)]
        return F.when(column.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.coalesce(_json(x, kind.elementType), F.lit("null"))), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_json(e["key"].cast("string"), T.StringType()), F.lit(":"), F.coalesce(_json(e["value"], kind.valueType), F.lit("null")))), ","), F.lit("}"))
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return column.cast("string")
    return _json(column.cast("string"), T.StringType())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _put(column: Column, kind: T.DataType, segments: tuple[str, ...], value: Column, top: bool = False) -> Column:
    if not segments:
        return value
    head, rest = segments[0], segments[1:]
    if isinstance(kind, T.StructType):
        inner = column.getField(head) if head in kind.names else F.lit(None)
        new = _put(inner, kind[head].dataType if head in kind.names else T.NullType(), rest, value)
        # a struct that is null is made; the record itself never is
        there = column if top else F.coalesce(column, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]))
        return there.withField(_quoted(head), new)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        old = F.coalesce(column, F.create_map().cast(kind))
        new = _put(F.try_element_at(column, F.lit(head)), kind.valueType, rest, value)
        return F.map_concat(F.map_filter(old, lambda k, _: k != head), F.create_map(F.lit(head), new))
    if isinstance(kind, T.ArrayType) and paths.is_position(head):
        at = int(head)
        changed = F.transform(column, lambda x, i: F.when(i == at, _put(x, kind.elementType, rest, value)).otherwise(x))
        return changed
    return F.struct(_put(F.lit(None), T.NullType(), rest, value).alias(head))


def _removed(column: Column, kind: T.DataType, segments: tuple[str, ...]) -> Column:
    if not segments:
        return F.lit(None).cast(kind)
    head, rest = segments[0], segments[1:]
    if isinstance(kind, T.StructType) and head in kind.names:
        if not rest and len(kind.names) == 1:
            return F.lit(None).cast(kind)
        if not rest:
            return column.dropFields(_quoted(head))
        return column.withField(_quoted(head), _removed(column.getField(head), kind[head].dataType, rest))
    if isinstance(kind, T.MapType):
        if not rest:
            return F.map_filter(column, lambda k, _: k != head)
        return F.transform_values(column, lambda k, v: F.when(k == head, _removed(v, kind.valueType, rest)).otherwise(v))
    if isinstance(kind, T.ArrayType) and paths.is_position(head):
        at = int(head)
        if not rest:
            return F.filter(column, lambda _, i: i != at)
        return F.transform(column, lambda x, i: F.when(i == at, _removed(x, kind.elementType, rest)).otherwise(x))
    return column


class FreeForm(Shape):
    def value(self, path: Path) -> Column:
        """The VARIANT at a path; a digit segment is a list position or else a key."""
        ways = [""]
        for s in path.segments:
            key = "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
            ways = [w + k for w in ways for k in ([f"[{s}]", key] if paths.is_position(s) else [key])]
        record = F.try_parse_json(F.col("record"))
        found = [F.try_variant_get(record, "$" + w, "variant") for w in ways]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    def text(self, path: Path) -> Column | None:
        if path.meta:
            return F.col("meta.tenant") if path.meta == "tenant" else None
        value = self.value(path)
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def compared(self, path: Path, op: str, literal: C.Literal) -> Column | bool:
        if path.meta:
            return Structured(T.StructType(), T._parse_datatype_string(META)).compared(path, op, literal)
        value = self.value(path)
        kind = F.schema_of_variant(value)
        if literal is None:
            return F.coalesce(value.isNull() | (kind == "VOID"), F.lit(True)) if op == "==" else False
        if isinstance(literal, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == literal) if op == "==" else False
        if isinstance(literal, str):
            return (kind == "STRING") & _ordered(F.try_variant_get(value, "$", "string"), op, literal)
        as_double = kind.isin("DOUBLE", "FLOAT", "BIGINT") | kind.startswith("DECIMAL")
        rough = as_double & _ordered(F.try_variant_get(value, "$", "double"), op, float(literal))
        if isinstance(literal, int) and abs(literal) < 10**37:
            whole = (kind == "BIGINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)"))
            return F.when(whole, _ordered(F.try_variant_get(value, "$", "decimal(38,0)"), op, F.lit(str(literal)).cast("decimal(38,0)"))).otherwise(rough)
        return rough

    def key(self, key: list[Path]) -> Column:
        @F.pandas_udf("string")
        def keyed(records: pd.Series, meta: pd.DataFrame) -> pd.Series:
            out = []
            for k, record in enumerate(records):
                value = json.loads(record)
                out.append(canonical([_plain(meta[p.meta].iat[k]) if p.meta else paths.get(value, p) for p in key]))
            return pd.Series(out, dtype=object)

        return keyed(F.col("record"), F.col("meta"))


def _plain(x: object) -> object:
    return None if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x


def _float(x: float) -> str:
    text = repr(x)
    if "e" not in text and abs(x) < 1e16:
        return text
    mantissa, _, power = f"{x:e}".partition("e") if "e" not in text else text.partition("e")
    if "e" in text and -5 <= int(power) < 16:
        return f"{x:.{max(1, len(mantissa.replace('.', '').replace('-', '')) - 1 - int(power))}f}"
    return f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}e{int(power)}"


_flat = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def canonical(value: object) -> str:
    """JSON text with sorted keys and no spaces; floats keep their point: 2.0."""
    if type(value) is dict and all(type(k) is str and type(v) in (str, int, bool, type(None)) for k, v in value.items()):
        return _flat(value)
    if isinstance(value, float):
        return _float(value)
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(v) for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def rewritten(frame: Frame, change: Callable[[object, dict], tuple[object, list[str]]]) -> DataFrame:
    """A free-form frame's rows with `record` changed and `flags` that change() gave, by one Arrow UDF."""

    @F.pandas_udf("struct<record:string,flags:array<string>>")
    def each(records: pd.Series, meta: pd.DataFrame) -> pd.DataFrame:
        made = [change(json.loads(r), {c: _plain(meta[c].iat[k]) for c in meta.columns}) for k, r in enumerate(records)]
        return pd.DataFrame({"record": [canonical(m[0]) for m in made], "flags": [m[1] for m in made]})

    rows = frame.df.withColumn("_made", each(F.col("record"), F.col("meta")))
    return rows.withColumn("record", F.col("_made.record")).withColumn("flags", F.col("_made.flags")).drop("_made")
