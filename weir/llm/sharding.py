"""Sharding along a Hilbert curve (DataFrame operations only).

Four metadata dimensions (source, language, size, doc_id) are quantised to three bits each (doc_id by
approximate eighths of its values, so that outlying ids do not empty the dimension), the
documents are ordered by the index of their cell on a Hilbert curve through those dimensions,
and the order is cut into runs of equal row counts. Neighbours on the curve are neighbours in
every dimension, so each shard covers a small box and files can be skipped by a filter on any
of the four.

The order is global, yet nothing is sorted globally: rows are counted by cell and hash prefix,
running totals of those bounded counts give each small group its first rank, and only groups are
ordered inside. A hot cell is spread over 256 groups.

Texts may have any length, as only their sizes and checksums move.

Nulls and odd rows: null source or language come last in their dimension, a null doc_id counts as
the smallest; a null text has size 1. Rows alike in everything are interchangeable. Equal texts
need not meet in a shard, as the law is `rows`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import BROADCAST_ROWS, cut, lookup

SHARDS = 8
BITS = 3
DIMENSIONS = ("source", "lang", "size", "doc_id")


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Position on the Hilbert curve of a point with len(point) coordinates of `bits` bits.

    The usual recursion: at each level take one bit of every coordinate, undo the reflection and
    rotation of the enclosing cell, and read the orthant's place in Gray-code order.
    """
    n = len(point)
    entry, turn, index = 0, 0, 0
    full = (1 << n) - 1
    for level in range(bits - 1, -1, -1):
        orthant = sum(((point[d] >> level) & 1) << d for d in range(n)) ^ entry
        orthant = ((orthant >> (turn + 1)) | (orthant << (n - turn - 1))) & full
        place, g = 0, orthant
        while g:
            place ^= g
            g >>= 1
        index = index << n | place
        start = 0 if place == 0 else (((place - 1) & ~1) ^ (((place - 1) & ~1) >> 1))
        entry ^= ((start << (turn + 1)) | (start >> (n - turn - 1))) & full
        if place == 0:
            axis = 0
        else:
            odd = place if place & 1 else place - 1
            axis = (odd ^ (odd + 1)).bit_length() - 1
        turn = (turn + axis % n + 1) % n
    return index


def curve(bits: int = BITS, dimensions: int = len(DIMENSIONS)) -> list[int]:
    """The index of every cell, by its coordinates read as digits, first coordinate highest."""
    side = 1 << bits
    return [hilbert_index(tuple(cell // side ** (dimensions - 1 - d) % side for d in range(dimensions)), bits) for cell in range(side**dimensions)]


def _shares(rows: DataFrame, column: str, out: str) -> DataFrame:
    """(value, bin): values in order, null last, cut into bins of about equal row counts."""
    counts = cut(rows.groupBy(column).count(), f"hilbert-{column}")
    n = counts.agg(F.sum("count")).first()[0] or 1
    if counts.count() <= BROADCAST_ROWS:  # few enough to be ranked in one task
        before = F.sum("count").over(Window.orderBy(F.asc_nulls_last(column))) - F.col("count")
        return cut(counts.select(column, F.floor(before * (1 << BITS) / F.lit(n)).cast("int").alias(out)), f"hilbert-{column}")
    # ranges of values, their totals, and running totals inside each
    ranged = counts.repartitionByRange(F.asc_nulls_last(column)).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, f"hilbert-{column}")
    totals = ranged.groupBy("_range").agg(F.sum("count").alias("_all"))
    first = totals.select(F.col("_range").alias("_of"), (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_first"))
    inside = F.sum("count").over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(column))) - F.col("count")
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(first), F.col("_range") == F.col("_of"))
    return cut(placed.select(column, F.floor((F.col("_first") + F.col("_inside")) * (1 << BITS) / F.lit(n)).cast("int").alias(out)), f"hilbert-{column}")


def quantised(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, lang, size) with their cell's index on the curve."""
    edges = rows.select(F.percentile_approx("doc_id", [k / (1 << BITS) for k in range(1, 1 << BITS)], 10_000)).first()[0] or []
    top = (1 << BITS) - 1
    for column in ("source", "lang"):
        rows = lookup(rows, _shares(rows, column, f"_{column}"), column, F.col("doc_id"))
    by_size = F.least(F.greatest(F.length(F.bin("size")) - 7, F.lit(0)), F.lit(top))
    by_id = sum((F.coalesce(F.col("doc_id") > F.lit(edge), F.lit(False)).cast("int") for edge in edges), F.lit(0))
    cell = ((F.col("_source") * (top + 1) + F.col("_lang")) * (top + 1) + by_size) * (top + 1) + by_id
    return rows.withColumn("curve", F.element_at(F.lit(curve()), (cell + 1).cast("int")).cast("int")).drop("_source", "_lang")


def ranked(rows: DataFrame, order: str, ties: list[Column]) -> DataFrame:
    """Adds rank, the row's place from 0 by (order, ties); order has a bounded number of values, ties[0] is a hexadecimal hash."""
    rows = rows.withColumn("_part", F.substring(ties[0], 1, 2))
    counts = rows.groupBy(order, "_part").count()
    within = F.sum("count").over(Window.partitionBy(order).orderBy("_part")) - F.col("count")
    cells = rows.groupBy(order).agg(F.count("*").alias("_cell"))
    cells = cells.select(F.col(order).alias("_order"), (F.sum("_cell").over(Window.orderBy(order)) - F.col("_cell")).alias("_first"))
    starts = counts.withColumn("_within", within).join(cells, F.col(order) == F.col("_order")).select(F.col(order).alias("_o"), F.col("_part").alias("_p"), (F.col("_first") + F.col("_within")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(order, "_part").orderBy(*ties)) - 1
    return rows.withColumn("_inside", inside).join(starts, (F.col(order) == F.col("_o")) & (F.col("_part") == F.col("_p"))).withColumn("rank", F.col("_start") + F.col("_inside")).drop("_o", "_p", "_part", "_start", "_inside")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, curve, shard, slot) for every row of docs, counts by shard at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))).alias("h"))
    rows = cut(quantised(cut(rows, "hilbert-rows")), "hilbert-cells")
    n = max(1, rows.count())
    placed = ranked(rows, "curve", [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("source"), F.col("lang")])
    shard = F.floor(F.col("rank") * shards / F.lit(n)).cast("int") if n * shards < 2**52 else F.floor(F.col("rank").cast("decimal(38,0)") * shards / F.lit(n)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.ceil(F.col("shard") * F.lit(n) / F.lit(shards)).cast("long")
    return placed.select("doc_id", "source", "lang", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {"op3_hilbert_shards": op3_hilbert_shards}
ORACLE_SQL: dict[str, str] = {}
