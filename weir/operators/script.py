"""script: a Python function over each record, for what the other stages cannot say.

The source defines `process(record, meta)`, which returns the record (pass), None (drop) or a list of
records (split). It runs over Arrow batches in the Python workers, without imports and without names
that reach outside; that keeps honest scripts honest and is no sandbox for hostile ones.

A script that names `state` has a store of its tenant's: get, set_nx, incr and delete, with times to live that
run by the records' ingestion times. Its tenants are dealt to tasks and their records read in order of
time and id, so a tenant is one task's work; what has expired leaves the store. log.info and log.warn write to the worker's
log.
"""

from __future__ import annotations

import ast
import json
import logging
import math
import sys
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weir.operators.base import PASS, Result, Stage, to_free_form
from weir.plans.frames import META, Frame, _plain, canonical

FORBIDDEN = ("open", "exec", "eval", "compile", "__import__", "input", "breakpoint", "globals", "locals", "vars", "getattr", "setattr", "delattr")
DEFAULTS = {"instructions": 1_000_000, "output_kib": 1024}
DEPTH = 128


class OutputError(ValueError):
    """What a script returned is no record."""


def checked(value: object, limit: int, depth: int = 0) -> object:
    if depth > DEPTH:
        raise OutputError("nested too deeply")
    if isinstance(value, float) and not math.isfinite(value):
        raise OutputError("a number that is not finite")
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise OutputError("keys are text")
        for v in value.values():
            checked(v, limit, depth + 1)
    elif isinstance(value, list):
        for v in value:
            checked(v, limit, depth + 1)
    elif not (value is None or isinstance(value, (str, int, float, bool))):
        raise OutputError(f"a {type(value).__name__} is no JSON value")
    return value


class State:
    """The store of one tenant and node. Values are texts; times to live are in milliseconds."""

    def __init__(self):
        self._held: dict[str, tuple[str, int]] = {}
        self._now, self._swept = 0, 0

    def _at(self, now: int) -> None:
        """Sets the time, in nanoseconds; what has expired goes whenever the store has doubled since the last time."""
        self._now = now
        if len(self._held) > 2 * self._swept + 1000:
            self._held = {k: v for k, v in self._held.items() if v[1] > now}
            self._swept = len(self._held)

    def get(self, key: str) -> str | None:
        value, end = self._held.get(key, (None, 0))
        return value if end > self._now else None

    def set_nx(self, key: str, value: object, ttl_ms: int) -> str | None:
        """Sets a value where there is none; else gives the one there is."""
        if (there := self.get(key)) is None:
            self._held[key] = (str(value), self._now + ttl_ms * 10**6)
        return there

    def incr(self, key: str, by: int, ttl_ms: int) -> int:
        """Adds to a whole number, from 0, and begins its time to live anew."""
        value = int(self.get(key) or 0) + by
        self._held[key] = (str(value), self._now + ttl_ms * 10**6)
        return value

    def delete(self, key: str) -> None:
        self._held.pop(key, None)


class Log:
    def __init__(self, node: str):
        logger = logging.getLogger(f"weir.script.{node}")
        self.info, self.warn = logger.info, logger.warning


def bounded(tree: ast.Module, instructions: int) -> bool:
    """Whether a script cannot run more lines than that: it has one function and nothing that repeats, so each of its nodes is come to once at most."""
    nodes = list(ast.walk(tree))
    repeats = (ast.For, ast.While, ast.AsyncFor, ast.comprehension, ast.Lambda, ast.ClassDef, ast.AsyncFunctionDef)
    functions = [x for x in nodes if isinstance(x, ast.FunctionDef)]
    # a function that is never named is called by no one but the stage
    named = any(isinstance(x, ast.Name) and x.id == "process" for x in nodes)
    return len(functions) == 1 and not functions[0].decorator_list and not named and not any(isinstance(x, repeats) for x in nodes) and 2 * len(nodes) <= instructions


def reads_meta(tree: ast.Module) -> bool:
    """Whether a script's process() names its second parameter, or may reach it otherwise."""
    functions = [x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef)]
    if len(functions) != 1 or functions[0].args.vararg or functions[0].args.kwarg or len(functions[0].args.args) != 2:
        return True
    return any(isinstance(x, ast.Name) and x.id == functions[0].args.args[1].arg or isinstance(x, ast.Attribute) and x.attr.endswith("_frame") for x in ast.walk(tree))


def compiled(source: str, instructions: int, node: str = "", state: State | None = None) -> Callable[[object, dict], object]:
    """The script's process(), stopped after so many lines; untraced where it cannot run so many."""
    import builtins

    allowed = {n: getattr(builtins, n) for n in dir(builtins) if not n.startswith("_") and n not in FORBIDDEN}
    space = {"__builtins__": allowed, "json_null": None, "now_ns": time.time_ns, "math": math, "state": state, "log": Log(node)}
    exec(compile(source, "script", "exec"), space)
    process = space["process"]
    if bounded(ast.parse(source), instructions):
        return process

    def limited(record: object, meta: dict) -> object:
        left = instructions

        def trace(frame, event, arg):
            nonlocal left
            if event == "line":
                left -= 1
                if left < 0:
                    raise RuntimeError("out of instructions")
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            return process(record, meta)
        finally:
            sys.settrace(before)

    return limited


class Script(Stage):
    required, optional = ("source",), ("limits", "on_error", "on_state_error")

    def __init__(self, node: str, params: dict):
        super().__init__(node, params)
        self.on_error = self.choice(params.get("on_error", "pass"), "pass", "drop", "nak")
        self.limits = DEFAULTS | self.mapping(params.get("limits") or {}, "`limits`")
        for key in self.limits:
            if key not in DEFAULTS:
                raise self.error("unknown_field", f"there is no limit `{key}`; there are " + ", ".join(DEFAULTS))
            if self.number(self.limits[key], f"`limits.{key}`", whole=True) < 1:
                raise self.error("out_of_range", f"`limits.{key}` starts at 1")
        self.source = self.text(params["source"], "`source`")
        try:
            tree = ast.parse(self.source)
        except SyntaxError as e:
            raise self.error("bad_script", f"line {e.lineno}: {e.msg}") from None
        for x in ast.walk(tree):
            name = "import" if isinstance(x, (ast.Import, ast.ImportFrom)) else x.id if isinstance(x, ast.Name) and x.id in FORBIDDEN else x.attr if isinstance(x, ast.Attribute) and x.attr.startswith("_") else None
            if name:
                raise self.error("forbidden_name", f"line {x.lineno}: scripts cannot use `{name}`")
        self.stateful = any(isinstance(x, ast.Name) and x.id == "state" for x in ast.walk(tree))
        self.reads_meta = reads_meta(tree)
        self.choice(params.get("on_state_error", "nak"), "pass", "nak")
        if "on_state_error" in params and not self.stateful:
            raise self.error("no_state", "`on_state_error` is for scripts that use `state`")
        if not any(isinstance(x, ast.FunctionDef) and x.name == "process" for x in tree.body):
            raise self.error("no_process", "the script defines no function `process(record, meta)`")

    def apply(self, frame: Frame) -> Result:
        frame = to_free_form(frame)
        node, stateful, whole = self.node, self.stateful, self.reads_meta
        source, instructions, output, policy = self.source, self.limits["instructions"], self.limits["output_kib"] * 1024, self.on_error

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            process, tenant = compiled(source, instructions, node), None
            state = None
            for batch in batches:
                records, rows, verdicts = [], [], []
                column = batch.column("meta")
                metas = [{k: _plain(v) for k, v in meta.items()} for meta in column.to_pylist()] if whole else [{} for _ in range(len(column))]
                tenants, times = ((column.field(k).to_pylist() for k in ("tenant", "ingestion_time")) if stateful else (metas, metas))
                for row, (text, meta, own, now) in enumerate(zip(batch.column("record").to_pylist(), metas, tenants, times, strict=True)):
                    record = json.loads(text)
                    flag = isinstance(record, bool)
                    if stateful:
                        if state is None or own != tenant:
                            state, tenant = State(), own
                            process = compiled(source, instructions, node, state)
                        state._at(now or 0)
                    try:
                        made = process(record, meta)
                        if isinstance(made, bool) and not flag:
                            raise OutputError("a boolean is no record")
                        if isinstance(made, list) and (not made or not all(isinstance(x, dict) for x in made)):
                            raise OutputError("a split is a list of objects that is not empty")
                        out = [] if made is None else [canonical(checked(x, output)) for x in (made if isinstance(made, list) else [made])]
                        if sum(map(len, out)) > output:
                            raise OutputError("output is too large")
                        verdict = "pass" if out else "drop"
                    except Exception as e:
                        out, verdict = [], "output" if isinstance(e, OutputError) else "instructions" if str(e) == "out of instructions" else "runtime"
                    if not out:  # dropped or failed: the record as it came
                        out = [text]
                    records += out
                    rows += [row] * len(out)
                    verdicts += [verdict] * len(out)
                yield pa.record_batch([pa.array(records, pa.string()), column.take(pa.array(rows, pa.int64())), pa.array(verdicts, pa.string())], ["record", "meta", "_verdict"])

        # kept until Run.close(), so that the script runs once for all its outputs
        rows = frame.df.select("record", "meta")
        if stateful:
            rows = rows.repartition("meta.tenant").sortWithinPartitions("meta.tenant", "meta.ingestion_time", "meta.id")
        made = rows.mapInArrow(run, f"record string, meta {META}, _verdict string").persist()

        def part(condition: str) -> DataFrame:
            return made.filter(condition).drop("_verdict")

        error = "_verdict not in ('pass', 'drop')"
        counted = {("script_errors_total", kind): part(f"_verdict = '{kind}'") for kind in ("instructions", "runtime", "output")}
        passed, dropped = Frame(part("_verdict != 'drop'" if policy == "pass" else "_verdict = 'pass'")), {"script_drop": part("_verdict = 'drop'")}
        if policy == "nak":
            counted |= {("failed", "stage_error"): part(error)}
        if policy == "drop":
            dropped |= {"script_error": part(error)}
        return Result({PASS: passed}, dropped, counted, [made])
