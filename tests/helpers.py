"""Frames of small records, and a plain Python reading of the condition language to compare with."""

import json
import os
import re

import duckdb
import regex

from weir.functions import conditions as C
from weir.functions import paths
from weir.plans.frames import META, Frame
from weir.plans.runtime import compiled

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def free(spark, records, tenants=None, times=None, ids=None):
    rows = [(json.dumps(r), ((ids or range(len(records)))[k], (tenants or ["t"] * len(records))[k], (times or [0] * len(records))[k], 1)) for k, r in enumerate(records)]
    return Frame(spark.createDataFrame(rows, f"record string, meta {META}"))


def structured(spark, records, schema, tenants=None, times=None, ids=None):
    rows = [(r, ((ids or range(len(records)))[k], (tenants or ["t"] * len(records))[k], (times or [0] * len(records))[k], 1)) for k, r in enumerate(records)]
    return Frame(spark.createDataFrame(rows, f"record struct<{schema}>, meta {META}"))


def run(frame, nodes):
    return compiled("nodes:\n" + nodes + "\n  - {id: out, type: sink.memory}").run(frame)


def ids(run_, sink="out"):
    return sorted(r[0] for r in run_.sinks[sink].df.select("meta.id").collect())


def records(run_, sink="out"):
    frame = run_.sinks[sink]
    rows = frame.df.select("meta.id", "record").collect()
    return {r[0]: json.loads(r[1]) if frame.free_form else r[1].asDict(True) for r in rows}


def holds(c, record, meta):
    if isinstance(c, C.Both):
        return (holds(c.left, record, meta) and holds(c.right, record, meta)) if c.op == "and" else (holds(c.left, record, meta) or holds(c.right, record, meta))
    if isinstance(c, C.Not):
        return not holds(c.of, record, meta)
    value = meta[c.path.meta] if c.path.meta else paths.get(record, c.path)
    if isinstance(c, C.Match):
        found = isinstance(value, str) and regex.search(re.sub(r"\$$", r"\\Z", c.pattern), value) is not None
        return found != c.negated
    if c.op == "!=":
        return not holds(C.Compare(c.path, "==", c.literal), record, meta)
    a, b = value, c.literal
    if b is None:
        return c.op == "==" and a is None
    if isinstance(b, bool) or isinstance(a, bool):
        return c.op == "==" and isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(b, str) != isinstance(a, str) or not isinstance(a, (str, int, float)):
        return False
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    elif isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]


def oracle(sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql)


def same(got, want):
    """Whether a Spark and a DuckDB result hold the same columns and rows."""
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    b = sorted(repr(tuple(r)) for r in want.select(*columns).fetchall())
    assert a == b
