"""extract and redact: patterns over text fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import paths
from weir.operators.base import PASS, Result, Stage
from weir.plans.frames import Frame, Structured, rewritten


def _python(source: str):
    import regex

    return regex.compile(source.replace("$", r"\Z") if "[" not in source and "\\$" not in source else _end(source))


def _end(source: str) -> str:
    """`$` outside classes as the end of the text."""
    out, at, in_class = [], 0, False
    while at < len(source):
        c = source[at]
        if c == "\\":
            out.append(source[at : at + 2])
            at += 2
            continue
        in_class = (in_class or c == "[") and not (in_class and c == "]")
        out.append(r"\Z" if c == "$" and not in_class else c)
        at += 1
    return "".join(out)


class Extract(Stage):
    """Writes what the named groups of a pattern matched to <into>.<name>, as text. Without a match the record passes unchanged."""

    required, optional = ("field", "pattern"), ("into", "limits", "on_redos_risk")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.field = self.path(params["field"], "`field`")
        self.regex = self.pattern(params["pattern"], params)
        self.into = self.path(params.get("into", "attributes"), "`into`", target=True)

    def apply(self, frame: Frame) -> Result:
        if frame.free_form:
            return self._free(frame)
        shape = frame.shape
        text = shape.text(self.field)
        if text is None:
            return Result({PASS: frame}, {}, {("regex_nonmatch_total", ""): frame.df})
        over = F.coalesce(self.regex.too_long(text), F.lit(False))
        hit = F.coalesce(self.regex.found_in(text), F.lit(False))
        df = frame.df.withColumn("_text", text).filter(~over).withColumn("_hit", F.coalesce(self.regex.found_in(F.col("_text")), F.lit(False)))
        for name, k in self.regex.groups:
            found = F.regexp_extract("_text", self.regex.java, k)
            # an empty group took part if a reference to it matches at the leftmost match
            took = (found != "") | F.col("_text").rlike(self._probe(k))
            target = paths.Path((*self.into.segments, name))
            shape = Structured(df.schema["record"].dataType, df.schema["meta"].dataType)
            old = shape.bind(target)
            kept = old[0].cast("string") if old else F.lit(None).cast("string")
            df = df.withColumn("record", shape.put(target, F.when(F.col("_hit") & took, found).otherwise(kept)))
        return Result({PASS: Frame(df.drop("_text", "_hit"))}, {"regex_limit": frame.filter(over).df}, {("regex_nonmatch_total", ""): frame.filter(~over & ~hit).df})

    def _probe(self, group: int) -> str:
        body = self.regex.java.removeprefix("(?Ud)")
        return rf"(?Ud)\A(?>[\s\S]*?(?:{body.removeprefix('^')}))\{group}" if not body.startswith("^") else rf"(?Ud)\A(?>{body[1:]})\{group}"

    def _free(self, frame: Frame) -> Result:
        text = frame.shape.text(self.field)
        over = F.coalesce(self.regex.too_long(text), F.lit(False))
        field, into, search = self.field, self.into, _python(self.regex.source)

        def change(record: object, meta: dict) -> tuple[object, list[str]]:
            value = meta.get(field.meta) if field.meta else paths.get(record, field)
            found = search.search(value) if isinstance(value, str) else None
            if not found:
                return record, ["nonmatch"]
            for name, got in found.groupdict().items():
                if got is not None:
                    record = paths.put(record, paths.Path((*into.segments, name)), got)
            return record, []

        made = Frame(rewritten(frame.filter(~over), change))
        return Result({PASS: Frame(made.df.drop("flags"))}, {"regex_limit": frame.filter(over).df}, {("regex_nonmatch_total", ""): made.filter(F.size("flags") > 0).df})


class Redact(Stage):
    """Replaces every match in some text fields by a literal text."""

    required, optional = ("fields", "pattern", "replace"), ("limits", "on_redos_risk")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.fields = [self.path(f, "`fields`", target=True) for f in self.listed(params["fields"], "`fields`")]
        self.regex = self.pattern(params["pattern"], params)
        self.replace = self.text(params["replace"], "`replace`")

    def apply(self, frame: Frame) -> Result:
        texts = [(p, t) for p in self.fields if (t := frame.shape.text(p)) is not None]
        over, hit = F.lit(False), F.lit(False)
        for _, text in texts:
            over = over | F.coalesce(self.regex.too_long(text), F.lit(False))
            hit = hit | F.coalesce(self.regex.found_in(text), F.lit(False))
        kept = frame.filter(~over)
        counted = {("regex_nonmatch_total", ""): kept.filter(~hit).df}
        dropped = {"regex_limit": frame.filter(over).df}
        if frame.free_form:
            fields, search, literal = self.fields, _python(self.regex.source), self.replace

            def change(record: object, meta: dict) -> tuple[object, list[str]]:
                for p in fields:
                    if isinstance(value := paths.get(record, p), str):
                        record = paths.put(record, p, search.sub(lambda _: literal, value))
                return record, []

            return Result({PASS: Frame(rewritten(kept, change).drop("flags"))}, dropped, counted)
        literal = self.replace.replace("\\", "\\\\").replace("$", "\\$")
        df = kept.df
        for p, _ in texts:
            shape = Structured(df.schema["record"].dataType, df.schema["meta"].dataType)
            df = df.withColumn("record", shape.put(p, F.regexp_replace(shape.text(p), F.lit(self.regex.java), F.lit(literal))))
        return Result({PASS: Frame(df)}, dropped, counted)
