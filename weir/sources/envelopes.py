"""Queue messages as records: arrival facts from headers and subject, decoding, and what is refused.

An envelope row has subject, headers (map of text to a list of texts), payload (binary), published
(nanoseconds) and delivered (delivery count), as a queue's Spark source or a landed table gives them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.plans.frames import Frame

ENVELOPE = "subject string, headers map<string,array<string>>, payload binary, published bigint, delivered bigint"
#: Header names, after a prefix that the deployment chooses.
HEADERS = {"id": "Record-Id", "kind": "Record-Kind", "tenant": "Tenant", "time": "Ingestion-Time", "time_kind": "Ingestion-Time-Kind"}
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Intake:
    """accepted records; dropped rows by reason; failed rows by kind; how many headers were ignored as malformed."""

    frame: Frame
    dropped: dict[str, DataFrame]
    failed: dict[str, DataFrame]
    invalid_headers: DataFrame


def _header(name: str) -> Column:
    """A header's only value; null if it is absent or repeated."""
    values = F.try_element_at(F.col("headers"), F.lit(name))
    return F.when(F.size(values) == 1, F.get(values, 0))


def _repeated(name: str) -> Column:
    return F.coalesce(F.size(F.try_element_at(F.col("headers"), F.lit(name))) > 1, F.lit(False))


def _whole(text: Column) -> Column:
    """Unsigned 64-bit decimal digits as the BIGINT of the same bits; null for anything else."""
    number = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    number = F.when(number < F.lit("18446744073709551616").cast("decimal(20,0)"), number)
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(number >= half, (number - half - half).cast("bigint")).otherwise(number.cast("bigint"))


def _tenant(text: Column) -> Column:
    return F.when((F.length(text) > 0) & ~text.rlike(r"\p{Cntrl}"), text)


def arrivals(envelopes: DataFrame, tenant_prefix: str = "logs", header_prefix: str = "") -> DataFrame:
    """Adds what the transport says of each message: id, kind, tenant, time, and invalid, the number of headers that could not be read."""
    name = {k: header_prefix + v for k, v in HEADERS.items()}
    tokens = F.split("subject", r"\.", 3)
    from_subject = F.when((F.size(tokens) == 3) & (F.get(tokens, 0) == tenant_prefix), _tenant(F.get(tokens, 1)))
    ident, time = _whole(_header(name["id"])), _whole(_header(name["time"]))
    time_kind = _header(name["time_kind"])
    paired = time.isNotNull() & time_kind.isin("reported", "clock")
    has = {k: F.try_element_at(F.col("headers"), F.lit(n)).isNotNull() for k, n in name.items()}
    bad = [has["id"] & ident.isNull(), _repeated(name["kind"]), has["tenant"] & _tenant(_header(name["tenant"])).isNull(), (has["time"] | has["time_kind"]) & ~F.coalesce(paired, F.lit(False))]
    invalid = sum((F.coalesce(b, F.lit(False)).cast("int") for b in bad), F.lit(0))
    # an unreadable kind is no log; an absent one is
    kind = F.when(has["kind"], F.coalesce(F.lower(_header(name["kind"])), F.lit("?"))).otherwise(F.lit("log"))
    return envelopes.select(
        "*",
        ident.alias("_id"),
        kind.alias("_kind"),
        F.coalesce(from_subject, _tenant(_header(name["tenant"])), F.lit(UNKNOWN)).alias("_tenant"),
        F.coalesce(F.when(paired, time), F.col("published"), F.unix_micros(F.current_timestamp()) * 1000).alias("_time"),
        invalid.alias("_invalid"),
    )


def intake(envelopes: DataFrame, codec: str = "json", tenant_prefix: str = "logs", header_prefix: str = "") -> Intake:
    """Envelopes to records. Other kinds than logs are dropped unread; then those without id; then what the codec cannot read fails."""
    if codec not in ("json", "text"):
        raise ValueError(f"unknown variant `{codec}`, expected `json` or `text`")
    rows = arrivals(envelopes, tenant_prefix, header_prefix)
    own = envelopes.columns
    log = F.col("_kind") == "log"
    valid = F.is_valid_utf8(F.col("payload").cast("string"))
    text = F.when(valid, F.col("payload").cast("string"))
    record = F.to_json(F.array(text)) if codec == "text" else text
    # a text is a JSON text; json keeps its own spelling, so numbers keep their point
    record = F.when(text.isNotNull(), F.substring(record, F.lit(2), F.length(record) - 2)) if codec == "text" else F.when(F.try_parse_json(text).isNotNull(), text)
    logs = rows.filter(log)
    decoded = logs.filter("_id is not null").withColumn("record", record)
    meta = F.struct(F.col("_id").alias("id"), F.col("_tenant").alias("tenant"), F.col("_time").alias("ingestion_time"), F.coalesce("delivered", F.lit(1)).cast("bigint").alias("delivery_count"))
    facts = [*own, F.col("_tenant").alias("tenant")]
    return Intake(
        Frame(decoded.filter("record is not null").select("record", meta.alias("meta"))),
        {"invalid_record": rows.filter(~log).select(*facts), "missing_id": logs.filter("_id is null").select(*facts)},
        {"missing_id": logs.filter("_id is null").select(*facts), "undecodable": decoded.filter("record is null").select(*facts)},
        rows.filter("_invalid > 0").select(*facts, F.col("_invalid").alias("count")),
    )


def outgoing(frame: Frame, subject: str, encoding: str = "json", header_prefix: str = "") -> DataFrame:
    """Records as messages: (subject, headers, payload)."""
    text = F.col("record") if frame.free_form else F.to_json("record")
    if encoding == "text" and frame.free_form:
        value = F.try_parse_json(text)
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(text)
    headers = F.create_map(
        F.lit(header_prefix + HEADERS["id"]), F.array(F.when(F.col("meta.id") < 0, (F.col("meta.id").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("string")).otherwise(F.col("meta.id").cast("string"))),
        F.lit(header_prefix + HEADERS["tenant"]), F.array(F.col("meta.tenant")),
        F.lit(header_prefix + HEADERS["time"]), F.array(F.col("meta.ingestion_time").cast("string")),
        F.lit(header_prefix + HEADERS["time_kind"]), F.array(F.lit("reported")),
    )
    return frame.df.select(F.lit(subject).alias("subject"), headers.alias("headers"), text.cast("binary").alias("payload"))


def dead_letters(failed: DataFrame, reason: str, dlq_prefix: str = "dlq", max_deliver: int = 5, header_prefix: str = "") -> DataFrame:
    """The failed envelopes that were delivered for the last time, readdressed to their tenant's dead-letter subject with the reason."""
    escaped = F.array_join(
        F.transform(F.split("tenant", ""), lambda c: F.when(c.rlike(r"^[\x21-\x7E]$") & ~c.isin(".", "*", ">", "%"), c).otherwise(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1"))), ""
    )
    shown = F.substring(F.regexp_replace(F.lit(reason), r"\p{Cntrl}", " "), 1, 1024)
    extra = F.create_map(F.lit(header_prefix + "Dlq-Reason"), F.array(shown), F.lit(header_prefix + "Dlq-Subject"), F.array(F.col("subject")))
    headers = F.map_concat(F.map_filter("headers", lambda k, _: ~k.isin(header_prefix + "Dlq-Reason", header_prefix + "Dlq-Subject")), extra)
    return failed.filter(F.coalesce("delivered", F.lit(1)) >= max_deliver).select(F.concat(F.lit(dlq_prefix + "."), escaped).alias("subject"), headers.alias("headers"), "payload")
