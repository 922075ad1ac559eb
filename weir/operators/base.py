"""What all stages share: their parameters and what they give back."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from weir.functions import conditions, paths, regexes
from weir.plans.config import ConfigError, known_keys
from weir.plans.frames import Frame

PASS = ""


@dataclass
class Result:
    """outputs by label (PASS for stages without labels); rows dropped, by reason; rows that count for a metric, by its name and label."""

    outputs: dict[str, Frame]
    dropped: dict[str, DataFrame] = field(default_factory=dict)
    counted: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    #: Persisted frames, which Run.close() gives back.
    held: list[DataFrame] = field(default_factory=list)


class Stage:
    """A transform of frames, made once at load, when all its parameters are checked."""

    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    #: Whether outputs depend on more than one record at a time.
    stateful = False

    def __init__(self, node: str, params: dict):
        self.node = node
        known_keys(params, self.required, self.optional, node)

    def error(self, code: str, message: object) -> ConfigError:
        return ConfigError(code, message, self.node)

    def choice(self, value: object, *known: str) -> str:
        if value not in known:
            raise self.error("unknown_choice", f"`{value}` is none of " + ", ".join(known))
        return str(value)

    def text(self, value: object, where: str) -> str:
        if not isinstance(value, str):
            raise self.error("wrong_type", f"{where} is a text, not {value!r}")
        return value

    def number(self, value: object, where: str, whole: bool = False) -> float:
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
            raise self.error("wrong_type", f"{where} is a {'whole ' if whole else ''}number, not {value!r}")
        return value

    def listed(self, value: object, where: str) -> list:
        """A list that is not empty."""
        if not isinstance(value, list):
            raise self.error("wrong_type", f"{where} is a list, not {value!r}")
        if not value:
            raise self.error("empty_list", f"{where} is an empty list")
        return value

    def mapping(self, value: object, where: str) -> dict:
        if not isinstance(value, dict):
            raise self.error("wrong_type", f"{where} is a mapping, not {value!r}")
        return value

    def path(self, text: object, where: str, target: bool = False) -> paths.Path:
        try:
            return paths.parse_target(text) if target else paths.parse(text)
        except paths.PathError as e:
            raise self.error("bad_path", f"{where}: {e}") from None

    def pattern(self, text: object, params: dict) -> regexes.Pattern:
        limits = self.mapping(params.get("limits") or {}, "`limits`")
        for key, value in limits.items():
            if self.number(value, f"`limits.{key}`", whole=True) < 0:
                raise self.error("out_of_range", f"`limits.{key}` is below 0")
        try:
            return regexes.compiled(self.text(text, "a pattern"), limits, params.get("on_redos_risk", "reject"))
        except regexes.PatternError as e:
            raise self.error(e.code, f"pattern `{text}`: {e}") from None

    def condition(self, text: object, params: dict) -> Compiled:
        try:
            parsed = conditions.parse(self.text(text, "`condition`"))
        except conditions.ConditionError as e:
            raise self.error("bad_condition", f"condition `{text}`: {e}") from None
        return Compiled(parsed, {m.pattern: self.pattern(m.pattern, params) for m in conditions.patterns(parsed)})

    def apply(self, frame: Frame) -> Result:
        raise NotImplementedError


@dataclass(frozen=True)
class Compiled:
    """A condition with its patterns."""

    parsed: conditions.Condition
    patterns: dict[str, regexes.Pattern]

    def holds(self, frame: Frame, positive: bool = True) -> Column:
        return frame.shape.condition(self.parsed, self.patterns.__getitem__, positive)

    def too_long(self, frame: Frame) -> Column | None:
        """Whether the condition would search a text over the limit, read from left to right; None if it has no pattern."""
        return _too_long(self.parsed, frame, self.patterns)


def _too_long(c: conditions.Condition, frame: Frame, patterns: dict[str, regexes.Pattern]) -> Column | None:
    from pyspark.sql import functions as F

    if isinstance(c, conditions.Match):
        text = frame.shape.text(c.path)
        return None if text is None else F.coalesce(patterns[c.pattern].too_long(text), F.lit(False))
    if isinstance(c, conditions.Not):
        return _too_long(c.of, frame, patterns)
    if isinstance(c, conditions.Both):
        left, right = (_too_long(x, frame, patterns) for x in (c.left, c.right))
        if right is not None:
            first = frame.shape.condition(c.left, patterns.__getitem__, False)
            right = (first if c.op == "and" else ~first) & right
        return right if left is None else left if right is None else left | right
    return None


def united(frames: Iterable[Frame]) -> Frame:
    """All records of some frames, repeats included."""
    frames = list(frames)
    if len({f.free_form for f in frames}) > 1:
        frames = [to_free_form(f) for f in frames]
    if len({f.df.schema["record"].dataType.simpleString() for f in frames}) > 1:
        frames = same_schema(frames)
    out = frames[0].df
    for f in frames[1:]:
        out = out.unionByName(f.df)
    return Frame(out)


def to_free_form(frame: Frame) -> Frame:
    """The same records as JSON text. Fields that are null are left out."""
    from pyspark.sql import functions as F

    return frame if frame.free_form else frame.with_record(F.to_json("record"))


def same_schema(frames: list[Frame]) -> list[Frame]:
    """Structured frames brought to the union of their fields, level by level; types that clash make all free-form."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def merged(kinds: list[T.DataType]) -> T.DataType | None:
        kinds = [k for k in kinds if not isinstance(k, T.NullType)] or kinds[:1]
        if all(isinstance(k, T.StructType) for k in kinds):
            out = T.StructType()
            for name in dict.fromkeys(n for k in kinds for n in k.names):
                kind = merged([k[name].dataType for k in kinds if name in k.names])
                if kind is None:
                    return None
                out = out.add(name, kind)
            return out
        return kinds[0] if len({k.simpleString() for k in kinds}) == 1 else None

    def brought(column: Column, kind: T.DataType, to: T.DataType) -> Column:
        if not isinstance(to, T.StructType) or not isinstance(kind, T.StructType):
            return column.cast(to)
        return F.when(column.isNotNull(), F.struct(*[(brought(column.getField(f.name), kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to]))

    kind = merged([f.df.schema["record"].dataType for f in frames])
    if kind is None:
        return [to_free_form(f) for f in frames]
    return [f.with_record(brought(F.col("record"), f.df.schema["record"].dataType, kind)) for f in frames]
