import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import free, ids, oracle, records, run, same, structured
from weir.functions import hashing
from weir.operators.dedupe import fold, judge, nanoseconds
from weir.plans.runtime import compiled
from weir.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    same(QUERIES[name](spark, sf_dir), oracle(ORACLE_SQL[name], sf_dir))


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["filter_keep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(value" in plan and "props" not in plan


def test_route_takes_the_first_label(spark):
    frame = free(spark, [{"a": 1, "b": 1}, {"b": 1}, {"c": 1}, "text"])
    r = compiled("nodes:\n  - {id: r, type: route, routes: {x: a == 1, y: b == 1}, default: drop}\n  - {id: x, type: sink.memory, from: r.x}\n  - {id: y, type: sink.memory, from: r.y}").run(frame)
    assert ids(r, "x") == [0] and ids(r, "y") == [1] and r.results["r"].dropped["route_default_drop"].count() == 2


def test_route_drops_what_it_cannot_search(spark):
    frame = free(spark, [{"s": "long text"}, {"s": "ok"}, {"k": 1, "s": "long text"}])
    r = compiled("nodes:\n  - {id: r, type: route, limits: {input_bytes: 4}, routes: {k: k == 1, t: s =~ 'ok'}, default: z}\n" + "\n".join(f"  - {{id: {x}, type: sink.memory, from: r.{x}}}" for x in "ktz")).run(frame)
    assert ids(r, "k") == [2] and ids(r, "t") == [1] and ids(r, "z") == [] and r.results["r"].dropped["regex_limit"].count() == 1


def test_fan_in_repeats_and_brings_schemas_together(spark):
    frame = structured(spark, [{"a": 1}, {"a": 2}], "a int")
    r = run(frame, "  - {id: x, type: edit, from: source, ops: [{set: {field: n.x, value: 1}}]}\n  - {id: y, type: edit, from: source, ops: [{set: {field: n.y, value: t}}]}\n  - {id: z, type: filter, action: keep, condition: a > 0, from: [x, y, x]}")
    rows = r.sinks["out"].df.select("record.a", "record.n.x", "record.n.y").collect()
    assert len(rows) == 6 and sum(r.x is None for r in rows) == 2


EDITS = "  - {id: e, type: edit, on_unapplied: %s, ops: [%s]}"


def edited(spark, record, ops, policy="skip", schema=None):
    frame = structured(spark, [record], schema) if schema else free(spark, [record])
    r = run(frame, EDITS % (policy, ops))
    return records(r).get(0), r.results["e"].counted["edit_unapplied_total", ""].count()


def test_edits_of_free_records(spark):
    assert edited(spark, {"a": 1}, "{set: {field: b.c, value: null}}") == ({"a": 1, "b": {"c": None}}, 0)
    assert edited(spark, {"a": 1}, "{rename: {from: a, to: a.b}}") == ({"a": {"b": 1}}, 0)
    assert edited(spark, {"a": None}, "{rename: {from: a, to: b}}") == ({"a": None}, 1)
    assert edited(spark, {"a": [1, 2]}, "{hash: {field: a}}, {hash: {field: b}}") == ({"a": [1, 2]}, 2)
    assert edited(spark, {"a": 2.0}, "{hash: {field: a}}")[0] == {"a": hashlib.sha256(b"2.0").hexdigest()}
    assert edited(spark, {"a": [1, 2, 3]}, "{delete: {fields: [a.0, z]}}") == ({"a": [2, 3]}, 1)
    assert edited(spark, {"a": 1}, "{copy: {from: gone, to: b}}", "drop") == (None, 1)
    assert edited(spark, {"a": 1}, "{copy: {from: meta.tenant, to: b}}, {copy: {from: ., to: c}}")[0] == {"a": 1, "b": "t", "c": {"a": 1, "b": "t"}}
    assert edited(spark, "text", "{set: {field: a, value: 1}}")[0] == {"a": 1}


def test_edits_of_structured_records(spark):
    schema = "a int, s string, n struct<x:int>, l array<int>, m map<string,int>"
    one = {"a": 1, "s": "t", "n": None, "l": [1, 2, 3], "m": {"k": 1}}
    got, n = edited(spark, one, "{set: {field: n.y, value: 2}}, {set: {field: m.z, value: 5}}, {delete: {fields: [l.1, m.k]}}, {copy: {from: n.x, to: q}}", schema=schema)
    assert got["n"] == {"x": None, "y": 2} and got["l"] == [1, 3] and got["m"] == {"z": 5} and got["q"] is None and n == 1
    got, n = edited(spark, one, "{rename: {from: s, to: s.inner}}, {hash: {field: a}}, {hash: {field: l}}, {copy: {from: gone, to: a}}", schema=schema)
    assert got["s"] == {"inner": "t"} and got["a"] == hashlib.sha256(b"1").hexdigest() and n == 2
    assert edited(spark, one, "{copy: {from: n.x, to: a}}", "drop", schema)[0] is None
    assert edited(spark, one, "{copy: {from: n.x, to: a}}", schema=schema)[0]["a"] == 1


TEXTS = ["user=ann id=7", "user= id=", "id=9", "", "user=é\r id=1\n"]


@pytest.mark.parametrize("pattern", [r"user=(?<user>\w*)(?: id=(?<id>\d+)?)?", r"^user=(?<user>.*)$", r"id=(?<id>\d)?$"])
def test_extract_is_the_same_in_both_shapes(spark, pattern):
    node = f"  - {{id: x, type: extract, field: s, pattern: '{pattern}'}}"
    loose = run(free(spark, [{"s": t} for t in TEXTS]), node)
    typed = run(structured(spark, [{"s": t} for t in TEXTS], "s string"), node)
    want = {k: v.get("attributes") or {} for k, v in records(loose).items()}
    got = {k: {n: x for n, x in (v.get("attributes") or {}).items() if x is not None} for k, v in records(typed).items()}
    assert got == want
    count = [r.results["x"].counted["regex_nonmatch_total", ""].count() for r in (loose, typed)]
    assert count[0] == count[1]


def test_redact_is_the_same_in_both_shapes(spark):
    node = r"  - {id: m, type: redact, fields: [s, gone], pattern: '\d+|x*', replace: '[$1\]', on_redos_risk: warn}"
    loose, typed = run(free(spark, [{"s": t} for t in TEXTS]), node), run(structured(spark, [{"s": t} for t in TEXTS], "s string"), node)
    assert {k: v["s"] for k, v in records(loose).items()} == {k: v["s"] for k, v in records(typed).items()}
    assert records(loose)[2]["s"].count("[$1\\]") >= 2


def test_extract_and_redact_pass_other_types_and_drop_long_texts(spark):
    frame = free(spark, [{"s": 5}, {"s": "aaaa"}, {"s": "b1"}, [1]])
    for node in ("  - {id: n, type: extract, field: s, pattern: '(?<d>\\d)', limits: {input_bytes: 3}}", "  - {id: n, type: redact, fields: [s], pattern: '\\d', replace: z, limits: {input_bytes: 3}}"):
        r = run(frame, node)
        assert ids(r) == [0, 2, 3] and r.results["n"].dropped["regex_limit"].count() == 1 and r.results["n"].counted["regex_nonmatch_total", ""].count() == 2


def test_windows():
    assert nanoseconds("10ms") == 10**7 and nanoseconds("2h") == 7200 * 10**9
    for bad in ("10", "0s", "s", "-1s", "1.5s", "3d"):
        with pytest.raises(ValueError):
            nanoseconds(bad)


def test_fold_is_judge_repeated():
    random.seed(1)
    for _ in range(300):
        n = random.randint(0, 30)
        times = [random.randint(0, 50) for _ in range(n)]
        if random.random() < 0.6:
            times.sort()
        idents = [random.randint(0, 9) for _ in range(n)]
        holder = start = random.choice([None, (random.randint(0, 60), 3)])
        want = []
        for t, i in zip(times, idents, strict=True):
            passed, holder = judge(holder, t, i, 10)
            want.append(passed)
        got, last = fold(np.array(times, np.int64), np.array(idents, np.int64), 10, start)
        assert got.tolist() == want and last == holder


def test_dedupe_rules(spark):
    s = 10**9
    # a repeat goes, exactly one window later it passes, a redelivery passes, tenants are apart, no key is a key
    frame = free(spark, [{"b": "x"}, {"b": "x"}, {"b": "x"}, {"b": "x"}, {"b": "x"}, {}, {}], tenants=["a", "a", "a", "b", "a", "a", "a"], times=[0, 9 * s, 10 * s, 5 * s, 10 * s, 0, s], ids=[1, 2, 3, 4, 3, 6, 7])
    assert ids(run(frame, "  - {id: d, type: dedupe, key: [b], window: 10s}")) == [1, 3, 3, 4, 6]


def test_dedupe_in_order_of_arrival_passes_older_records(spark):
    from weir.operators.dedupe import Dedupe

    frame = free(spark, [{"n": 0}, {"n": 1}, {"n": 2}], times=[10**10, 5 * 10**9, 11 * 10**9])
    frame = frame.with_record(F.lit('{"k":1}'))
    kept = Dedupe("d", {"key": ["k"], "window": "10s"}).apply(frame, F.col("meta.id")).outputs[""]
    assert sorted(r[0] for r in kept.df.select("meta.id").collect()) == [0, 1]


def test_random_sample_is_by_id_and_node(spark):
    frame = free(spark, [0] * 4000)
    some = set(ids(run(frame, "  - {id: s, type: sample, mode: random, percent: 10}")))
    salt = hashing.fnv1a64_py(b"s")
    assert some == {i for i in range(4000) if hashing.mix_py(i ^ salt) <= hashing.threshold(10)} and 320 < len(some) < 480
    assert ids(run(frame, "  - {id: s, type: sample, mode: random, percent: 100}")) == list(range(4000))


def test_consistent_sample_keeps_keys_together(spark):
    frame = free(spark, [{"k": i % 50} for i in range(500)])
    kept = ids(run(frame, "  - {id: s, type: sample, mode: consistent, percent: 40, key: [k, gone]}"))
    keys = {i % 50 for i in kept}
    assert len(kept) == 10 * len(keys) and keys == {k for k in range(50) if hashing.mix_py(hashing.fnv1a64_py(f"[{k},null]".encode())) <= hashing.threshold(40)}


def test_every_nth_counts_by_tenant(spark):
    frame = free(spark, [0] * 9, tenants=["a"] * 5 + ["b"] * 4, times=[k * 3_000_000_000_000 for k in range(9)])
    assert ids(run(frame, "  - {id: s, type: sample, mode: every_nth, n: 3}")) == [0, 3, 5, 8]


SCRIPT = """
  - id: p
    type: script
    on_error: %s
    limits: {instructions: 2000, output_kib: 1}
    source: |
      def process(record, meta):
          if record.get("drop"):
              return None
          if record.get("split"):
              return [{"n": k, "tenant": meta["tenant"]} for k in range(record["split"])]
          if record.get("loop"):
              while True:
                  pass
          if record.get("big"):
              return {"x": "y" * 5000}
          if record.get("bad"):
              return [1]
          record["seen"] = 1 / record.get("div", 1)
          return record
"""


def test_script_outcomes(spark):
    frame = free(spark, [{"drop": 1}, {"split": 3}, {"loop": 1}, {"big": 1}, {"bad": 1}, {"div": 0}, {"ok": 1}])
    r = run(frame, SCRIPT % "pass")
    assert ids(r) == [1, 1, 1, 2, 3, 4, 5, 6] and records(r)[6] == {"ok": 1, "seen": 1.0}
    counted = {k[1]: df.count() for k, df in r.results["p"].counted.items()}
    assert counted == {"instructions": 1, "runtime": 1, "output": 2} and r.results["p"].dropped["script_drop"].count() == 1
    assert run(frame, SCRIPT % "drop").results["p"].dropped["script_error"].count() == 4
    assert run(frame, SCRIPT % "nak").results["p"].counted["failed", "stage_error"].count() == 4


def test_script_state_is_per_tenant_and_expires(spark):
    source = """
  - id: p
    type: script
    source: |
      def process(record, meta):
          log.info("seen")
          first = state.set_nx("first:" + record["k"], record["n"], 10)
          if state.get("gone") is None and record["k"] == "d":
              state.delete("first:d")
          return {"first": first, "count": state.incr("n", 1, 5), "n": record["n"]}
"""
    rows = [{"k": "a", "n": 0}, {"k": "a", "n": 1}, {"k": "a", "n": 2}, {"k": "a", "n": 3}, {"k": "d", "n": 4}, {"k": "d", "n": 5}]
    ms = 10**6
    frame = free(spark, rows, tenants=["t", "t", "u", "t", "t", "t"], times=[0, 4 * ms, 4 * ms, 12 * ms, 13 * ms, 14 * ms])
    got = records(run(frame, source))
    assert [(got[k]["first"], got[k]["count"]) for k in range(6)] == [(None, 1), ("0", 2), (None, 1), (None, 1), (None, 2), (None, 3)]


def test_failures_are_told_traced_and_sent_to_dead_letters(spark):
    from weir.sources.envelopes import ENVELOPE

    pipeline = compiled("nodes:\n  - {id: p, type: script, on_error: nak, source: 'def process(r, m): return {\"x\": 1 / r[\"d\"]}'}\n  - {id: a, type: sink.memory, from: p}\n  - {id: b, type: sink.memory, from: p}")
    messages = spark.createDataFrame([("logs.t.x", {"Record-Id": [str(k)]}, json.dumps({"d": k % 3}).encode(), 5, 5 if k < 4 else 1) for k in range(1, 7)], ENVELOPE)
    taken = pipeline.intake(messages)
    done = pipeline.run(taken.frame)
    assert sorted((r.node, r.kind, r.meta.id) for r in done.failed().collect()) == [("p", "stage_error", 3), ("p", "stage_error", 6)]
    letters = pipeline.dead_letters_of(done, messages).collect()
    assert [(r.subject, r.headers["Dlq-Reason"]) for r in letters] == [("dlq.t", ["stage_error"])]
    ends = sorted((r.node, r.outcome) for r in done.traces(0.000001).collect())
    assert ends == [("p", "failed: stage_error")] * 2
    done.close()
    assert not done.held


def test_a_script_runs_once_for_all_its_outputs(spark):
    frame = free(spark, [{"k": k} for k in range(20)])
    pipeline = compiled("nodes:\n  - {id: p, type: script, source: 'def process(r, m): return {\"now\": now_ns()}'}\n  - {id: a, type: sink.memory, from: p}\n  - {id: b, type: sink.memory, from: p}")
    done = pipeline.run(frame)
    a, b = ({r.record for r in done.sinks[s].df.collect()} for s in "ab")
    done.close()
    assert a == b and len(a) > 1


def test_ledger_balances(spark):
    r = QUERIES["full_dag"](spark, "/root/testdata/sf0.001")
    assert r.count() > 0
    from weir.queries import FULL, documents

    ledger = compiled(FULL).run(documents(spark, "/root/testdata/sf0.001"), share=True).ledger().groupBy("node", "metric").agg(F.sum("value").alias("n")).collect()
    by = {(x.node, x.metric): x.n for x in ledger}
    for node in ("drop_short", "dedupe_text", "by_lang", "number", "tag", "mask", "some"):
        assert by[node, "records_in_total"] == by[node, "records_out_total"] + by.get((node, "records_dropped_total"), 0), node


def test_long_texts_are_split_whole(spark, tmp_path):
    """Lines of more than 1 MiB together, and more lines than the script stage's default of instructions, against the query's SQL."""
    texts = [(1, "\n".join(["x" * 600_000] * 3), "fr"), (2, "a\n" * 1_000_100, "de"), (3, "l1\n\nl2", "es"), (4, "no", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s1' source", "length(text) n_chars").coalesce(1).write.parquet(str(tmp_path / "documents"))
    next((tmp_path / "documents").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    counts = QUERIES["script_split_lines"](spark, str(tmp_path)).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    same(counts, oracle(f"SELECT doc_id, line, count(*) n FROM ({ORACLE_SQL['script_split_lines']}) GROUP BY ALL", str(tmp_path)))


def test_only_scripts_that_can_run_long_are_traced():
    from weir.operators import script

    def process(body, limit=1000):
        return script.compiled("def process(record, meta):\n" + body, limit)

    straight = process("    record['n'] += 1\n    return record\n")
    assert straight.__name__ == "process" and straight({"n": 1}, {}) == {"n": 2}
    for body in ("    while True:\n        pass\n", "    return process(record, meta)\n", "    return [x for x in record]\n", "    f = lambda: 1\n    return f()\n"):
        assert process(body).__name__ != "process"
    assert process("    return record\n", 2).__name__ != "process"
    for body, reads in (("return record", False), ("return {'t': meta['tenant']}", True), ("def f(): return meta\n    return f()", True)):
        assert script.reads_meta(script.ast.parse(f"def process(record, meta):\n    {body}\n")) == reads


def test_canonical_text_is_the_same_for_flat_and_nested_records():
    from weir.plans.frames import canonical

    for value in ({"b": 1, "a": "ü\n\"", "c": None, "d": True, "": -(10**20)}, {}):
        assert canonical([value]) == "[" + canonical(value) + "]" and canonical({"x": [1.0], **value}).endswith('"x":[1.0]}')
