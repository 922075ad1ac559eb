import pytest
import json

from pyspark.sql import functions as F

from tests.helpers import free, ids
from weir.operators.dedupe import Dedupe
from weir.plans.frames import META, Frame
from weir.plans.runtime import compiled
from weir.sources.envelopes import ENVELOPE, dead_letters, intake, outgoing
from weir.sources.sinks import write_all
from weir.streaming.runner import StreamError, split, start

BIG = str(2**64 - 1)


def envelopes(spark, rows):
    return spark.createDataFrame([(s, h, p if isinstance(p, bytes) else json.dumps(p).encode(), t, n) for s, h, p, t, n in rows], ENVELOPE)


def test_intake(spark):
    rows = [
        ("logs.acme.app", {"Record-Id": ["1"], "Tenant": ["other"]}, {"a": 2.0}, 5, 1),
        ("logs.acme", {"Record-Id": [BIG], "Tenant": ["headed"], "Ingestion-Time": ["77"], "Ingestion-Time-Kind": ["clock"]}, 7, 5, 2),
        ("x", {"Record-Id": ["3"], "Tenant": ["a\nb"], "Ingestion-Time": ["77"]}, None, 5, 1),
        ("x", {"Record-Id": ["4", "5"]}, {}, 5, 1),
        ("x", {"Record-Id": ["+6"]}, {}, 5, 1),
        ("x", {"Record-Id": ["7"], "Record-Kind": ["metric"]}, b"{broken", 5, 1),
        ("logs.t.x", {"Record-Id": ["8"]}, b"{broken", 5, 5),
        ("x", {"Record-Id": ["9"]}, b"\xff", None, 1),
    ]
    took = intake(envelopes(spark, rows))
    got = {r.id: (r.tenant, r.ingestion_time, r.record) for r in took.frame.df.select("meta.*", "record").collect()}
    assert got == {1: ("acme", 5, '{"a": 2.0}'), -1: ("headed", 77, "7"), 3: ("unknown", 5, "null")}
    assert took.dropped["invalid_record"].count() == 1 and took.dropped["missing_id"].count() == 2 and took.failed["undecodable"].count() == 2
    assert took.invalid_headers.agg(F.sum("count")).first()[0] == 4
    dead = dead_letters(took.failed["undecodable"], "un\ndecodable").collect()
    assert len(dead) == 1 and dead[0].subject == "dlq.t" and dead[0].headers["Dlq-Reason"] == ["un decodable"] and dead[0].headers["Dlq-Subject"] == ["logs.t.x"]
    sent = {bytes(r.payload): r.headers["Record-Id"] for r in outgoing(took.frame, "out").collect()}
    assert sent[b"7"] == [BIG]


def test_text_codec_round_trip(spark):
    text = 'line "1"\n\té'
    took = intake(envelopes(spark, [("x", {"Record-Id": ["1"]}, text.encode(), 5, 1), ("x", {"Record-Id": ["2"]}, b"\xff\xfe", 5, 1)]), codec="text")
    assert json.loads(took.frame.df.first().record) == text and took.failed["undecodable"].count() == 1
    assert bytes(outgoing(took.frame, "out", "text").first().payload).decode() == text


def test_dead_letter_subjects_are_escaped(spark):
    failed = spark.createDataFrame([("s", {}, b"", 1, 9, "a.b é*")], ENVELOPE + ", tenant string")
    assert dead_letters(failed, "r").first().subject == "dlq.a%2Eb%20%C3%A9%2A"


def test_sinks(spark, tmp_path):
    pipeline = compiled(f"nodes:\n  - {{id: t, type: sink.table, path: '{tmp_path}/t', format: json}}\n  - {{id: q, type: sink.nats, stream: s, subject: out.x, from: source}}")
    sent = {}
    write_all(pipeline, pipeline.run(free(spark, [{"a": 1}])), lambda node, messages: sent.update({node: messages.collect()}))
    assert spark.read.json(f"{tmp_path}/t").count() == 1 and sent["q"][0].subject == "out.x"


STREAM = "nodes:\n  - {id: f, type: filter, action: keep, condition: k != 9}\n  - {id: d, type: dedupe, key: [k], window: 10s}\n  - {id: r, type: route, routes: {a: k == 1}, default: b}\n  - {id: a, type: sink.memory, from: r.a}\n  - {id: b, type: sink.memory, from: r.b}"
S = 10**9


def arrive(spark, folder, rows):
    frame = free(spark, [{"k": k} for k, *_ in rows], times=[t for _, t, _ in rows], ids=[i for *_, i in rows])
    frame.df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, checkpoint, pipeline, seen, **how):
    df = spark.readStream.schema(f"record string, meta {META}").parquet(folder)

    def write(run, batch, number):
        for sink in run.sinks:
            seen.setdefault(sink, []).extend(ids(run, sink))

    start(pipeline, Frame(df), write, checkpoint, **how).awaitTermination()


def test_stream_keeps_state_over_a_restart(spark, tmp_path):
    folder, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "state"), {}
    pipeline = compiled(STREAM)
    arrive(spark, folder, [(1, 0, 1), (1, 5 * S, 2), (2, 0, 3), (9, 0, 4)])
    stream(spark, folder, checkpoint, pipeline, seen)
    arrive(spark, folder, [(1, 9 * S, 5), (1, 10 * S, 6), (2, -S, 7), (1, 10 * S, 6)])
    stream(spark, folder, checkpoint, pipeline, seen)
    assert sorted(seen["a"]) == [1, 6, 6] and sorted(seen["b"]) == [3, 7]


def test_stream_counts_every_nth_over_a_restart(spark, tmp_path):
    folder, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "state"), {}
    pipeline = compiled("nodes:\n  - {id: n, type: sample, mode: every_nth, n: 3}\n  - {id: out, type: sink.memory}")
    for part in ([1, 2, 3, 4], [5, 6, 7, 8]):
        arrive(spark, folder, [(0, i * S, i) for i in part])
        stream(spark, folder, checkpoint, pipeline, seen)
    assert sorted(seen["out"]) == [1, 4, 7]


@pytest.mark.parametrize("ttl, kept", [(1, [1, 2]), (None, [1])])
def test_stream_state_ends(spark, tmp_path, ttl, kept):
    folder, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "state"), {}
    pipeline = compiled("nodes:\n  - {id: d, type: dedupe, key: [k], window: 10s}\n  - {id: out, type: sink.memory}")
    for ident in (1, 2):
        arrive(spark, folder, [(1, ident * S, ident)])
        stream(spark, folder, checkpoint, pipeline, seen, state_ttl_ms=ttl)
    assert sorted(seen["out"]) == kept


def test_stream_refuses_branches_before_state():
    with pytest.raises(StreamError):
        split(compiled("nodes:\n  - {id: f, type: filter, action: keep, condition: a == 1}\n  - {id: o, type: sink.memory}\n  - {id: d, type: dedupe, key: [a], window: 1s, from: f}\n  - {id: p, type: sink.memory}"))
    assert isinstance(compiled(STREAM).stages["d"], Dedupe)
