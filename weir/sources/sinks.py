"""Writing a run's sinks: tables through Spark's writers, queue sinks as tables of messages for a connector to publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weir.plans.runtime import Pipeline, Run
from weir.sources.envelopes import outgoing


def write_all(pipeline: Pipeline, run: Run, publish: Callable[[str, DataFrame], None] | None = None) -> None:
    """Writes every sink of a run. publish(node, messages) takes those of queue sinks."""
    for node in pipeline.nodes:
        if not node.is_sink:
            continue
        frame = run.sinks[node.id]
        if node.type == "sink.table":
            frame.df.write.format(node.params.get("format", "parquet")).mode(node.params.get("mode", "append")).save(node.params["path"])
        elif node.type == "sink.nats" and publish:
            publish(node.id, outgoing(frame, node.params["subject"], node.params.get("encoding", "json")))
