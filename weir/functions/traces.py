"""Record traces: an id for each record that any process would derive, and the share of records that is traced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions import hashing

# fixed value: salt of trace keys
SALT = 0x74726163655F6964


def trace_key(ident: Column, tenant: Column) -> Column:
    return hashing.mix(ident.bitwiseXOR(hashing.fnv1a64(tenant)).bitwiseXOR(F.lit(SALT).cast("long")))


def trace_id(ident: Column, tenant: Column) -> Column:
    """32 hexadecimal digits: the trace key, then the record id."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (trace_key(ident, tenant), ident)])


def traced(ident: Column, tenant: Column, percent: float = 1.0) -> Column:
    return hashing.at_most(trace_key(ident, tenant), hashing.threshold(percent))
