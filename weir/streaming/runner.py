"""A pipeline over a stream: one streaming query, whose micro-batches feed all sinks.

The part of the graph up to and with the stateful nodes runs as a streaming plan, so their state is
checkpointed with the offsets. Each micro-batch of what comes out is then split by what remains of the
graph and written by the caller. Replay after a failure repeats a batch as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weir.operators.base import PASS
from weir.operators.script import Script
from weir.plans.config import SOURCE
from weir.plans.frames import Frame
from weir.plans.runtime import Pipeline, Run
from weir.streaming.stateful import stateful_stage


class StreamError(ValueError):
    """A graph that one stream cannot run."""


def split(pipeline: Pipeline) -> tuple[list[str], Pipeline]:
    """The chain of nodes up to the last stateful one, and the rest. The chain must be a line without branches."""
    last = max((k for k, n in enumerate(pipeline.nodes) if n.id in pipeline.stages and pipeline.stages[n.id].stateful), default=-1)
    chain = [n.id for n in pipeline.nodes[: last + 1]]
    before = SOURCE
    for node in pipeline.nodes[: last + 1]:
        if isinstance(pipeline.stages.get(node.id), Script) and pipeline.stages[node.id].stateful:
            raise StreamError(f"node `{node.id}`: scripts with state run over tables only")
        if node.is_sink or node.type == "route" or node.reads != (before,):
            raise StreamError(f"node `{node.id}`: what comes before a stateful node must be one line of stages in a stream")
        before = node.id
    rest = []
    for node in pipeline.nodes[last + 1 :]:
        for read in node.reads:
            if read.partition(".")[0] in [SOURCE, *chain[:-1]] and chain:
                raise StreamError(f"node `{node.id}` reads from before a stateful node, which a stream has already passed")
        rest.append(replace(node, reads=tuple(SOURCE if r == before else r for r in node.reads)))
    return chain, Pipeline(pipeline.config, rest, {n.id: pipeline.stages[n.id] for n in rest if n.id in pipeline.stages})


def start(pipeline: Pipeline, source: Frame, write: Callable[[Run, DataFrame, int], None], checkpoint: str, state_ttl_ms: int | None = None, **trigger: object) -> StreamingQuery:
    """Runs a pipeline over a streaming frame. write(run, batch, number) is called for every micro-batch.

    State of a key ends when it was not written for state_ttl_ms of the clock; without it, see weir.streaming.stateful.
    """
    chain, rest = split(pipeline)
    frame = source
    for node in chain:
        stage = pipeline.stages[node]
        frame = stateful_stage(stage, frame, state_ttl_ms) if stage.stateful else stage.apply(frame).outputs[PASS]

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        run = rest.run(Frame(df))
        try:
            write(run, df, number)
        finally:
            run.close()
            df.unpersist()

    # state that ends by the clock would ask for one batch without data after another, and no query would ever be done
    conf, key = frame.df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return frame.df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(key, before)
