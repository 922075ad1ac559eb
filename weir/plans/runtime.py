"""From a pipeline to DataFrames: one for each sink, and the ledger of what happened to every record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import traces
from weir.operators import STAGES
from weir.operators.base import PASS, Result, Stage, to_free_form, united
from weir.plans.config import SOURCE, Config, ConfigError, Node, known_keys, load, ordered
from weir.plans.frames import Frame
from weir.sources import envelopes

#: Sink types and the parameters they need; a sink's frame is given to the caller, or written by weir.sources.sinks.
SINKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "sink.memory": ((), ()),
    "sink.table": (("path",), ("format", "mode")),
    "sink.nats": (("stream", "subject"), ("url", "encoding")),
}


#: Source types and the settings they need. The frame a pipeline runs over is given by the caller; the settings say how envelopes become records.
SOURCES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "memory": ((), ("tenant_prefix", "dlq_prefix", "codec")),
    "nats": (("stream", "consumer"), ("url", "tenant_prefix", "dlq_prefix", "codec")),
}
CODECS = ("json", "text")


class Registry:
    """Stage, sink and source types by name; a caller may add its own."""

    def __init__(self):
        self.stages: dict[str, Callable[[str, dict], Stage]] = dict(STAGES)
        self.sinks, self.sources = dict(SINKS), dict(SOURCES)

    def register_source(self, kind: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> None:
        self.sources[kind] = (required, optional)

    def register_stage(self, kind: str, make: Callable[[str, dict], Stage]) -> None:
        self.stages[kind] = make

    def register_sink(self, kind: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> None:
        self.sinks[kind] = (required, optional)


@dataclass
class Pipeline:
    """A loaded pipeline: every parameter checked, every pattern and condition compiled."""

    config: Config
    nodes: list[Node]
    stages: dict[str, Stage]

    def _source(self, key: str, default: str) -> str:
        return (self.config.source or {}).get(key, default)

    def intake(self, messages: DataFrame, header_prefix: str = "") -> envelopes.Intake:
        """Envelopes to records by the codec and tenant prefix of the source block."""
        return envelopes.intake(messages, self._source("codec", "json"), self._source("tenant_prefix", "logs"), header_prefix)

    def dead_letters(self, failed: DataFrame, reason: str, max_deliver: int = 5, header_prefix: str = "") -> DataFrame:
        """Failed envelopes of the last delivery, readdressed by the dead-letter prefix of the source block."""
        return envelopes.dead_letters(failed, reason, self._source("dlq_prefix", "dlq"), max_deliver, header_prefix)

    @property
    def stateful(self) -> bool:
        return any(s.stateful for s in self.stages.values())

    def dead_letters_of(self, run: Run, messages: DataFrame, max_deliver: int = 5, header_prefix: str = "") -> DataFrame | None:
        """The envelopes, of their last delivery, of records that a stage of the run gave up on; once each, whatever the number of branches."""
        failed = run.failed()
        if failed is None:
            return None
        ids = failed.select(F.col("meta.id").alias("_failed")).distinct()
        arrived = envelopes.arrivals(messages, self._source("tenant_prefix", "logs"), header_prefix)
        rows = arrived.join(ids, F.col("_id") == F.col("_failed"), "left_semi").select(*messages.columns, F.col("_tenant").alias("tenant"))
        return self.dead_letters(rows, "stage_error", max_deliver, header_prefix)

    def run(self, frame: Frame, share: bool = False) -> Run:
        """The pipeline's plans over a frame. share persists what several nodes read, so it is computed once for all sinks; close() the run when all is read."""
        run = Run({}, {}, {})
        made: dict[tuple[str, str], Frame] = {(SOURCE, ""): frame}
        readers = [r for n in self.nodes for r in n.reads]
        for node in self.nodes:
            taken = united(made[tuple(r.partition(".")[::2])] for r in node.reads)
            run.taken[node.id] = taken.df
            if node.is_sink:
                run.sinks[node.id] = taken
                continue
            result = self.stages[node.id].apply(taken)
            run.results[node.id] = result
            run.held += result.held
            for label, out in result.outputs.items():
                name = f"{node.id}.{label}" if label != PASS else node.id
                if share and readers.count(name) > 1:
                    out = Frame(out.df.persist())
                    run.held.append(out.df)
                made[node.id, label] = out
        return run


@dataclass
class Run:
    sinks: dict[str, Frame]
    results: dict[str, Result]
    taken: dict[str, DataFrame] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Gives back what was persisted for the run."""
        while self.held:
            self.held.pop().unpersist()

    def dropped(self) -> DataFrame:
        """(node, reason, record, meta) of every record that a stage dropped, records as JSON text."""
        parts = [Frame(df).df.select(F.lit(node).alias("node"), F.lit(reason).alias("reason"), (F.col("record") if Frame(df).free_form else F.to_json("record")).alias("record"), "meta") for node, r in self.results.items() for reason, df in r.dropped.items()]
        return _union(parts)

    def failed(self) -> DataFrame | None:
        """(node, kind, record, meta) of every record whose stage gave up on it, records as JSON text; None where no stage can."""
        parts = [to_free_form(Frame(df)).df.select(F.lit(node).alias("node"), F.lit(kind).alias("kind"), "record", "meta") for node, r in self.results.items() for (metric, kind), df in r.counted.items() if metric == "failed"]
        return _union(parts) if parts else None

    def traces(self, percent: float = 1.0) -> DataFrame:
        """(trace_id, tenant, node, outcome): where records ended, for the traced share of those that arrived or were dropped, and for all that failed."""
        ends = [(node, "out", f.df) for node, f in self.sinks.items()] + [(node, f"dropped: {reason}", df) for node, r in self.results.items() for reason, df in r.dropped.items()]
        ident, tenant = F.col("meta.id"), F.col("meta.tenant")
        parts = [df.filter(traces.traced(ident, tenant, percent)).select("meta", F.lit(node).alias("node"), F.lit(outcome).alias("outcome")) for node, outcome, df in ends]
        if (failed := self.failed()) is not None:
            parts.append(failed.select("meta", "node", F.concat(F.lit("failed: "), "kind").alias("outcome")))
        return _union(parts).select(traces.trace_id(ident, tenant).alias("trace_id"), tenant.alias("tenant"), "node", "outcome")

    def ledger(self) -> DataFrame:
        """(tenant, node, metric, label, value): records in, out and dropped by reason, and other counts, for each node and tenant."""
        parts: list[tuple[str, str, str, DataFrame]] = []
        for node, df in self.taken.items():
            parts.append((node, "records_in_total", "", df))
        for node, r in self.results.items():
            parts += [(node, "records_out_total", label, f.df) for label, f in r.outputs.items()]
            parts += [(node, "records_dropped_total", reason, df) for reason, df in r.dropped.items()]
            parts += [(node, "records_errored_total" if metric == "failed" else metric, label, df) for (metric, label), df in r.counted.items()]
        each = [df.groupBy(F.col("meta.tenant").alias("tenant")).agg(F.count("*").alias("value")).select("tenant", F.lit(node).alias("node"), F.lit(metric).alias("metric"), F.lit(label).alias("label"), "value") for node, metric, label, df in parts]
        return _union(each)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _check_source(config: Config, registry: Registry) -> None:
    if config.source is None:
        return
    given = dict(config.source)
    if (kind := given.pop("type", None)) not in registry.sources:
        raise ConfigError("unknown_type", f"there is no source of type `{kind}`; there are " + ", ".join(registry.sources))
    known_keys(given, *registry.sources[kind], where="source: ")
    for key, value in given.items():
        if not isinstance(value, str):
            raise ConfigError("wrong_type", f"source: `{key}` is a text, not {value!r}")
    if given.get("codec", "json") not in CODECS:
        raise ConfigError("unknown_choice", f"source: `{given['codec']}` is none of " + ", ".join(CODECS))


def compiled(text: str, registry: Registry | None = None) -> Pipeline:
    """Loads a pipeline from YAML, or says what is wrong with it."""
    registry = registry or Registry()
    config = load(text)
    _check_source(config, registry)
    stages: dict[str, Stage] = {}
    for node in config.nodes:
        if node.is_sink:
            if node.type not in registry.sinks:
                raise ConfigError("unknown_type", f"there is no sink of type `{node.type}`", node.id)
            known_keys(node.params, *registry.sinks[node.type], node.id)
            if node.params.get("encoding", "json") not in CODECS:
                raise ConfigError("unknown_choice", f"`{node.params['encoding']}` is none of " + ", ".join(CODECS), node.id)
        elif node.type not in registry.stages:
            raise ConfigError("unknown_type", f"there is no stage of type `{node.type}`", node.id)
        else:
            stages[node.id] = registry.stages[node.type](node.id, node.params)
    return Pipeline(config, ordered(config), stages)
