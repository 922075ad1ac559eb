"""Queries over the driver's tables, one for each operator, and DuckDB SQL for the same results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import traces
from weir.functions.hashing import FNV_OFFSET, FNV_PRIME, MIX, fnv1a64_py, threshold
from weir.plans.frames import Frame, nanoseconds, of_table
from weir.plans.runtime import Run, compiled
from weir.sources.envelopes import dead_letters, intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Frame:
    return of_table(read(spark, sf_dir, "events"), "event_id", F.col("event_type"), nanoseconds(F.col("ts")))


def documents(spark: SparkSession, sf_dir: str) -> Frame:
    return of_table(read(spark, sf_dir, "documents"), "doc_id", F.col("lang"), F.col("doc_id") * 1_000_000_000)


def piped(frame: Frame, nodes: str) -> Run:
    """Runs nodes, in YAML, whose last is followed by a sink named out."""
    return compiled(f"nodes:\n{nodes}\n  - {{id: out, type: sink.memory}}").run(frame)


def out(frame: Frame, nodes: str, *columns: str) -> DataFrame:
    return piped(frame, nodes).sinks["out"].df.selectExpr(*columns)


# filter


def _filter(frame: Frame, condition: str, action: str, *columns: str) -> DataFrame:
    return out(frame, f"  - {{id: f, type: filter, action: {action}, condition: {json.dumps(condition)}}}", *columns)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value >= 50")
def filter_keep(spark, d):
    return _filter(events(spark, d), 'event_type == "error" and value >= 50', "keep", "record.event_id", "record.user_id")


@query("SELECT event_id, user_id FROM events WHERE NOT (coalesce(event_type = 'view', false) OR coalesce(value < 20.5, false))")
def filter_drop(spark, d):
    return _filter(events(spark, d), 'event_type == "view" or value < 20.5', "drop", "record.event_id", "record.user_id")


def _labelled(spark, d) -> Frame:
    table = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    return of_table(table, "doc_id", F.col("lang"))


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS DISTINCT FROM 1 AND quality IS NULL")
def filter_ne_null(spark, d):
    return _filter(_labelled(spark, d), "toxic != 1 and quality == null", "keep", "record.doc_id")


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT (coalesce(toxic = 1, false) OR coalesce(quality > 0, false) AND lang = 'en')")
def filter_not(spark, d):
    return _filter(_labelled(spark, d), 'not (toxic == 1 or quality > 0 and lang == "en")', "keep", "record.doc_id")


@query("SELECT event_id FROM events WHERE value > 100")
def filter_type_mismatch(spark, d):
    return _filter(events(spark, d), 'user_id != "7" and not (event_type > 3) and (missing.field == null) and value > 100', "keep", "record.event_id")


@query(f"SELECT doc_id FROM documents WHERE strlen(text) <= 65536 AND regexp_matches(text, '{IPV4}')")
def filter_regex(spark, d):
    return _filter(documents(spark, d), f'text =~ "{IPV4}"'.replace("\\", "\\\\"), "keep", "record.doc_id")


@query(f"SELECT doc_id FROM documents WHERE strlen(text) <= 65536 AND NOT regexp_matches(text, '{EMAIL}') AND lang <> 'fr'")
def filter_not_regex(spark, d):
    return _filter(documents(spark, d), f'text !~ "{EMAIL}" and lang != "fr"'.replace("\\", "\\\\"), "keep", "record.doc_id")


@query("SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN 'regex_limit' ELSE 'filter' END reason FROM documents WHERE strlen(text) > 2000 OR NOT regexp_matches(text, 'the')")
def filter_regex_limit(spark, d):
    run = piped(documents(spark, d), '  - {id: f, type: filter, action: keep, condition: "text =~ \'the\'", limits: {input_bytes: 2000}}')
    parts = [df.select("meta.id", F.lit(reason).alias("reason")) for reason, df in run.results["f"].dropped.items()]
    return parts[0].unionAll(parts[1]).selectExpr("id AS doc_id", "reason")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_path_read(spark, d):
    frame = events(spark, d)
    free = Frame(frame.df.select("record.props", "meta").withColumnRenamed("props", "record"))
    return _filter(free, "k >= 90", "keep", "meta.id AS event_id", "CAST(get_json_object(record, '$.k') AS BIGINT) AS k")


# route, fan-out, fan-in

_ROUTE = """
  - id: r
    type: route
    routes: {returned: 'l_returnflag == "R"', bulk: l_quantity >= 45, dear: l_extendedprice > 50000.5}
    default: %s
"""


def _lineitem(spark, d) -> Frame:
    return of_table(read(spark, d, "lineitem"), "l_orderkey")


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity >= 45 THEN 'bulk' WHEN l_extendedprice > 50000.5 THEN 'dear' ELSE 'rest' END label, count(*) n FROM lineitem GROUP BY 1")
def route_label_counts(spark, d):
    run = compiled("nodes:" + _ROUTE % "rest" + "\n".join(f"  - {{id: {x}, type: sink.memory, from: r.{x}}}" for x in ("returned", "bulk", "dear", "rest"))).run(_lineitem(spark, d))
    parts = [f.df.groupBy(F.lit(name).alias("label")).agg(F.count("*").alias("n")) for name, f in run.sinks.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_returnflag <> 'R', true) AND l_quantity >= 45 OR coalesce(l_returnflag <> 'R', true) AND l_extendedprice > 50000.5")
def route_default_drop(spark, d):
    run = compiled("nodes:" + _ROUTE % "drop" + "  - {id: lost, type: sink.memory, from: r.returned}\n  - {id: out, type: sink.memory, from: [r.bulk, r.dear]}").run(_lineitem(spark, d))
    return run.sinks["out"].df.select("record.l_orderkey", "record.l_linenumber")


@query("SELECT event_id, count(*) copies FROM (SELECT event_id FROM events WHERE value > 50 UNION ALL SELECT event_id FROM events WHERE event_type = 'click') GROUP BY 1")
def fan_in_union(spark, d):
    nodes = """
  - {id: high, type: filter, action: keep, condition: value > 50, from: source}
  - {id: click, type: filter, action: keep, condition: 'event_type == "click"', from: source}
  - {id: both, type: edit, ops: [{set: {field: seen, value: true}}], from: [high, click]}"""
    return piped(events(spark, d), nodes).sinks["out"].df.groupBy("record.event_id").agg(F.count("*").alias("copies"))


@query("SELECT 'all' sink, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'")
def fan_out_two_sinks(spark, d):
    run = compiled("nodes:\n  - {id: all, type: sink.memory}\n  - {id: f, type: filter, action: keep, condition: 'event_type == \"error\"', from: source}\n  - {id: errors, type: sink.memory}").run(events(spark, d))
    return run.sinks["all"].df.select(F.lit("all").alias("sink"), "record.event_id").unionAll(run.sinks["errors"].df.select(F.lit("errors"), "record.event_id"))


# edit


def _edit(frame: Frame, ops: str, *columns: str, policy: str = "skip") -> DataFrame:
    return out(frame, f"  - {{id: e, type: edit, on_unapplied: {policy}, ops: [{ops}]}}", *columns)


def _customer(spark, d) -> Frame:
    return of_table(read(spark, d, "customer"), "c_custkey", F.col("c_mktsegment"))


@query("SELECT c_custkey, 'crm' origin, 7 level, 'x' c_name FROM customer")
def edit_set(spark, d):
    return _edit(_customer(spark, d), "{set: {field: tags.origin, value: crm}}, {set: {field: tags.level, value: 7}}, {set: {field: c_name, value: x}}", "record.c_custkey", "record.tags.origin", "record.tags.level", "record.c_name")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS tenant FROM customer")
def edit_copy(spark, d):
    return _edit(_customer(spark, d), "{copy: {from: c_name, to: a.name}}, {copy: {from: meta.tenant, to: a.tenant}}", "record.c_custkey", "record.a.name", "record.a.tenant")


@query("SELECT c_custkey, c_name AS label FROM customer")
def edit_rename(spark, d):
    return _edit(_customer(spark, d), "{rename: {from: c_name, to: about.label}}", "record.c_custkey", "record.about.label")


@query("SELECT c_custkey, sha256(c_name) c_name, sha256(CAST(c_nationkey AS VARCHAR)) c_nationkey FROM customer")
def edit_hash(spark, d):
    return _edit(_customer(spark, d), "{hash: {field: c_name}}, {hash: {field: c_nationkey}}", "record.c_custkey", "record.c_name", "record.c_nationkey")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def edit_delete(spark, d):
    return _edit(_customer(spark, d), "{delete: {fields: [c_acctbal, c_nationkey]}}", "record.*")


@query("SELECT c_custkey, c_mktsegment c_name, c_name old FROM customer")
def edit_order(spark, d):
    return _edit(_customer(spark, d), "{copy: {from: c_name, to: old}}, {copy: {from: c_mktsegment, to: c_name}}, {delete: {fields: [c_mktsegment, c_acctbal, c_nationkey]}}", "record.*")


@query("SELECT doc_id, toxic verdict FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NOT NULL")
def edit_unapplied_drop(spark, d):
    return _edit(_labelled(spark, d), "{rename: {from: toxic, to: verdict}}", "record.doc_id", "record.verdict", policy="drop")


# extract and redact

_URL = r"^(?<scheme>https?)://(?<host>[^/:?#]+)(?<path>/[^?#]*)?"


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/:?#]+)', 1) scheme, regexp_extract(url, '^(https?)://([^/:?#]+)', 2) host FROM pages")
def extract_groups(spark, d):
    return out(of_table(read(spark, d, "pages").select("page_id", "url"), "page_id"), f"  - {{id: x, type: extract, field: url, into: parts, pattern: '{_URL}'}}", "record.page_id", "record.parts.scheme", "record.parts.host")


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '\?page=\d+') THEN regexp_extract(url, '\?page=(\d+)(&ref=(\w*))?', 1) END page, CASE WHEN regexp_matches(url, '\?page=\d+&ref=') THEN regexp_extract(url, '\?page=(\d+)(&ref=(\w*))?', 3) END ref FROM pages")
def extract_optional_group(spark, d):
    return out(of_table(read(spark, d, "pages").select("page_id", "url"), "page_id"), r"  - {id: x, type: extract, field: url, pattern: '\?page=(?<page>\d+)(?:&ref=(?<ref>\w*))?'}", "record.page_id", "record.attributes.page", "record.attributes.ref")


@query(f"SELECT doc_id, regexp_replace(text, '{IPV4}', '[$ip]', 'g') AS text FROM documents WHERE strlen(text) <= 65536")
def redact_ips(spark, d):
    return out(documents(spark, d), f"  - {{id: m, type: redact, fields: [text, source, n_chars], pattern: '{IPV4}', replace: '[$ip]'}}", "record.doc_id", "record.text")


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<mail>', 'g') AS text FROM documents WHERE strlen(text) <= 65536")
def redact_emails(spark, d):
    return out(documents(spark, d), f"  - {{id: m, type: redact, fields: [text], pattern: '{EMAIL}', replace: '<mail>'}}", "record.doc_id", "record.text")


# sample

_TWO64 = "18446744073709551616::UHUGEINT"


def _mixed_sql(columns: str, x: str, rest: str, where: str) -> str:
    """The mix in steps, as each step's text holds the one before it twice."""
    ctes, prev = [f"m0 AS (SELECT {columns}, {x} AS x {rest})"], "m0"
    for k, (shift, factor) in enumerate(MIX, 1):
        step = f"xor(x, x // {1 << shift}::UHUGEINT)"
        step = f"({step} * {factor}::UHUGEINT) % {_TWO64}" if factor else step
        ctes.append(f"m{k} AS (SELECT * EXCLUDE (x), {step} AS x FROM {prev})")
        prev = f"m{k}"
    return f"WITH {', '.join(ctes)} SELECT * EXCLUDE (x) FROM {prev} WHERE {where}"


def _fnv_sql(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::UHUGEINT), lambda a, b: (xor(a, b) * {FNV_PRIME}::UHUGEINT) % {_TWO64}, {FNV_OFFSET}::UHUGEINT)"


@query(_mixed_sql("event_id", f"xor(event_id::UHUGEINT, {fnv1a64_py(b's')}::UHUGEINT)", "FROM events", f"x <= {threshold(12.5)}::UHUGEINT"))
def sample_random(spark, d):
    return out(events(spark, d), "  - {id: s, type: sample, mode: random, percent: 12.5}", "record.event_id")


@query(_mixed_sql("o_orderkey", _fnv_sql("""'[' || o_custkey || ',"' || o_orderpriority || '"]'"""), "FROM orders", f"x <= {threshold(30)}::UHUGEINT"))
def sample_consistent(spark, d):
    return out(of_table(read(spark, d, "orders"), "o_orderkey"), "  - {id: s, type: sample, mode: consistent, percent: 30, key: [o_custkey, o_orderpriority]}", "record.o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) n FROM events) WHERE (n - 1) % 7 = 0")
def sample_every_nth(spark, d):
    return out(events(spark, d), "  - {id: s, type: sample, mode: every_nth, n: 7}", "record.event_id")


# dedupe


def _dedupe_sql(table: str, ident: str, key: str, time: str, window: int, columns: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT *, {key} AS key_, {time} AS t_ FROM {table}),
o AS (SELECT *, row_number() OVER (PARTITION BY key_ ORDER BY t_, {ident}) n_ FROM e),
r AS (SELECT key_, n_, {ident} AS id_, t_ AS held_, true AS kept_ FROM o WHERE n_ = 1
  UNION ALL SELECT o.key_, o.n_, o.{ident}, CASE WHEN o.t_ - r.held_ >= {window} THEN o.t_ ELSE r.held_ END, o.t_ - r.held_ >= {window} FROM r JOIN o ON o.key_ = r.key_ AND o.n_ = r.n_ + 1)
SELECT {columns} FROM r JOIN {table} x ON x.{ident} = r.id_ WHERE kept_
"""


@query(_dedupe_sql("events", "event_id", "event_type || ':' || user_id", "epoch_us(ts) * 1000", 6 * 3600 * 10**9, "event_id, user_id"))
def dedupe_window(spark, d):
    return out(events(spark, d), "  - {id: d, type: dedupe, key: [user_id], window: 6h}", "record.event_id", "record.user_id")


@query(_dedupe_sql("events", "event_id", "event_type || ':' || props || ':' || (user_id % 3)", "epoch_us(ts) * 1000", 90 * 60 * 10**9, "event_id"))
def dedupe_multi_key(spark, d):
    frame = events(spark, d)
    frame = frame.with_record(F.col("record").withField("third", F.col("record.user_id") % 3))
    return out(frame, "  - {id: d, type: dedupe, key: [props, third], window: 90m}", "record.event_id")


@query(_dedupe_sql("(SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id))", "doc_id", "lang || ':' || coalesce(toxic::VARCHAR, 'null')", "doc_id * 1000000000", 40 * 10**9, "doc_id"))
def dedupe_null_key(spark, d):
    table = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return out(of_table(table, "doc_id", F.col("lang"), F.col("doc_id") * 1_000_000_000), "  - {id: d, type: dedupe, key: [toxic], window: 40s}", "record.doc_id")


# script, accounts, traces, intake


@query(r"SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents WHERE lang <> 'en') WHERE line <> ''")
def script_split_lines(spark, d):
    nodes = """
  - {id: f, type: filter, action: drop, condition: 'lang == "en"'}
  - id: s
    type: script
    limits: {instructions: 1000000000000, output_kib: 1000000000}
    source: |
      def process(record, meta):
          lines = [line for line in record["text"].split("\\n") if line]
          return [{"doc_id": record["doc_id"], "line": line} for line in lines] or None"""
    return out(documents(spark, d), nodes, "CAST(get_json_object(record, '$.doc_id') AS BIGINT) AS doc_id", "get_json_object(record, '$.line') AS line")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) stretch FROM g)
SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, stretch ORDER BY ts, event_id) seen FROM s""")
def script_state(spark, d):
    """How often a user was seen with an event type, begun anew after six hours without."""
    nodes = """
  - id: s
    type: script
    source: |
      def process(record, meta):
          return {"event_id": record["event_id"], "seen": state.incr("user:" + str(record["user_id"]), 1, 6 * 3600 * 1000)}"""
    return out(events(spark, d), nodes, "CAST(get_json_object(record, '$.event_id') AS BIGINT) AS event_id", "CAST(get_json_object(record, '$.seen') AS BIGINT) AS seen")


_LEDGER = """
  - {id: f, type: filter, action: keep, condition: value > 40}
  - {id: s, type: sample, mode: every_nth, n: 2}"""


@query("""
WITH f AS (SELECT * FROM events WHERE value > 40), n AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) n FROM f),
a AS (SELECT event_type tenant, count(*) n FROM events GROUP BY 1), b AS (SELECT event_type tenant, count(*) n FROM f GROUP BY 1),
c AS (SELECT event_type tenant, count(*) n FROM n WHERE n % 2 = 1 GROUP BY 1)
SELECT tenant, 'f' node, 'records_in_total' metric, '' AS label, n AS value FROM a UNION ALL SELECT tenant, 'f', 'records_out_total', '', n FROM b
UNION ALL SELECT tenant, 'f', 'records_dropped_total', 'filter', a.n - b.n FROM a JOIN b USING (tenant) WHERE a.n > b.n
UNION ALL SELECT tenant, 's', 'records_in_total', '', n FROM b UNION ALL SELECT tenant, 's', 'records_out_total', '', n FROM c
UNION ALL SELECT tenant, 's', 'records_dropped_total', 'sample', b.n - c.n FROM b JOIN c USING (tenant) WHERE b.n > c.n
UNION ALL SELECT tenant, 'out', 'records_in_total', '', n FROM c""")
def drop_ledger(spark, d):
    return piped(events(spark, d), _LEDGER).ledger()


@query(_mixed_sql("event_id", f"xor(xor(event_id::UHUGEINT, {_fnv_sql('event_type')}), {traces.SALT}::UHUGEINT)", "FROM events", f"x <= {threshold(5)}::UHUGEINT"))
def trace_sampled(spark, d):
    return events(spark, d).df.filter(traces.traced(F.col("meta.id"), F.col("meta.tenant"), 5.0)).select("record.event_id")


def _envelopes(spark, d) -> DataFrame:
    """Events as queue messages, some without id, of another kind, or not to be decoded."""
    e = read(spark, d, "events")
    none = F.lit(None).cast("array<string>")
    headers = F.map_filter(
        F.create_map(
            F.lit("Record-Id"), F.when(F.col("event_id") % 11 != 0, F.array(F.col("event_id").cast("string"))).otherwise(none),
            F.lit("Record-Kind"), F.when(F.col("event_id") % 13 == 0, F.array(F.lit("metric"))).otherwise(none),
            F.lit("Tenant"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("headed"))).otherwise(none),
        ), lambda _, v: v.isNotNull(),
    )
    subject = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("logs."), F.col("event_type"), F.lit(".app"))).otherwise(F.lit("other"))
    payload = F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return e.select(subject.alias("subject"), headers.alias("headers"), payload.cast("binary").alias("payload"), nanoseconds(F.col("ts")).alias("published"), F.when(F.col("event_id") % 5 == 0, 5).otherwise(1).cast("bigint").alias("delivered"))


_TENANT_SQL = "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'headed' ELSE 'unknown' END"


@query(f"""
SELECT CASE WHEN event_id % 13 = 0 THEN 'invalid_record' WHEN event_id % 11 = 0 THEN 'missing_id' WHEN event_id % 17 = 0 THEN 'undecodable' ELSE 'accepted' END outcome,
  {_TENANT_SQL} tenant, count(*) n FROM events GROUP BY ALL""")
def intake_outcomes(spark, d):
    took = intake(_envelopes(spark, d))
    parts = [took.frame.df.select(F.lit("accepted").alias("outcome"), "meta.tenant")]
    parts += [df.select(F.lit(k), "tenant") for k, df in [*took.dropped.items(), ("undecodable", took.failed["undecodable"])]]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionAll(p)
    return all_.groupBy("outcome", "tenant").agg(F.count("*").alias("n"))


@query(f"SELECT 'dlq.' || {_TENANT_SQL} subject, count(*) n FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 17 = 0 AND event_id % 5 = 0 GROUP BY ALL")
def dead_letter_subjects(spark, d):
    return dead_letters(intake(_envelopes(spark, d)).failed["undecodable"], "undecodable").groupBy("subject").agg(F.count("*").alias("n"))


# all together

FULL = rf"""
name: full
nodes:
  - {{id: drop_short, type: filter, action: drop, condition: n_chars < 80}}
  - {{id: dedupe_text, type: dedupe, key: [text], window: 10000h}}
  - id: by_lang
    type: route
    routes: {{english: 'lang == "en"', romance: 'lang == "fr" or lang == "es"'}}
    default: rest
  - {{id: number, type: extract, from: by_lang.english, field: source, pattern: '^src(?<number>\d+)$'}}
  - {{id: tag, type: edit, from: [number, by_lang.romance], on_unapplied: skip, ops: [{{copy: {{from: attributes.number, to: attributes.origin}}}}, {{set: {{field: attributes.pipeline, value: full}}}}]}}
  - {{id: mask, type: redact, from: [tag, by_lang.rest], fields: [text], pattern: '{IPV4}', replace: '[ip]'}}
  - {{id: some, type: sample, mode: consistent, percent: 90, key: [doc_id]}}
  - {{id: main, type: sink.memory}}
  - {{id: audit, type: sink.memory, from: by_lang.english}}
"""


@query(f"""
WITH RECURSIVE a AS (SELECT * FROM documents WHERE NOT (n_chars < 80)),
e AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) n FROM a),
k AS (SELECT * FROM e WHERE n = 1),
u AS (SELECT 'audit' sink, doc_id, CAST(NULL AS VARCHAR) origin, CAST(NULL AS VARCHAR) pipeline, text FROM k WHERE lang = 'en'),
m0 AS (SELECT k.*, {_fnv_sql("'[' || doc_id || ']'")} AS x FROM k WHERE strlen(text) <= 65536),
m1 AS (SELECT * EXCLUDE (x), (xor(x, x // {1 << MIX[0][0]}::UHUGEINT) * {MIX[0][1]}::UHUGEINT) % {_TWO64} AS x FROM m0),
m2 AS (SELECT * EXCLUDE (x), (xor(x, x // {1 << MIX[1][0]}::UHUGEINT) * {MIX[1][1]}::UHUGEINT) % {_TWO64} AS x FROM m1),
m3 AS (SELECT * EXCLUDE (x), xor(x, x // {1 << MIX[2][0]}::UHUGEINT) AS x FROM m2)
SELECT sink, doc_id, origin, pipeline, sha256(text) text_sha256 FROM (
SELECT * FROM u UNION ALL
SELECT 'main', doc_id, CASE WHEN lang = 'en' THEN regexp_extract(source, '^src(\\d+)$', 1) END, CASE WHEN lang IN ('en', 'fr', 'es') THEN 'full' END,
  regexp_replace(text, '{IPV4}', '[ip]', 'g') FROM m3 WHERE x <= {threshold(90)}::UHUGEINT)
""")
def full_dag(spark, d):
    """The flagship: filter, dedupe, route, extract, fan-in, edit, redact, sample and two sinks."""
    run = compiled(FULL).run(documents(spark, d), share=True)
    main = run.sinks["main"].df.select(F.lit("main").alias("sink"), "record.doc_id", "record.attributes.origin", "record.attributes.pipeline", "record.text")
    audit = run.sinks["audit"].df.select(F.lit("audit"), "record.doc_id", F.lit(None).cast("string"), F.lit(None).cast("string"), "record.text")
    return main.unionAll(audit).select("sink", "doc_id", "origin", "pipeline", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
