"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Each source gets a word budget. Whole repeats of the source come first; the rest of the budget
is filled by the documents whose hash lies under a threshold. The threshold is found without
sorting the documents: words are summed by source and hash bucket, the bucket in which the
budget runs out is the only one that is looked into more closely, and documents are then
filtered. What one document too large leaves of a budget is filled in further, nested rounds
by documents that fit into it: first by ones that have no odd copy yet, in the last rounds by any
that may be repeated once more.

Nulls and odd rows: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; rows alike in doc_id and text share a hash and are taken together. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import cut, lookup, n_words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rounds of odd copies, and of these the last that may give a document another one.
ROUNDS, AGAIN = 5, 2
#: Hexadecimal digits of the hash that make a bucket: 4,096 buckets a source, and as many in the one that is refined.
DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds target to (source, source_size): shares of the whole by weight, none above max_repeats times its source.

    The sources that hit their limit are those whose limit for each unit of weight is least, so
    one pass in that order finds the level at which the others share what is left.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_limit = Window.orderBy("_limit_each", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(kinds, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_limit", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("_limit_each", F.col("_limit") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.first(F.when(F.col("_limit_each") >= F.col("_level"), F.col("_level")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("_limit", F.col("_level") * F.col("_weight")))
        .select("source", "source_size", "target")
    )


def odd_copies(rounds: Column, size: Column, h: Column, copies: Column, max_repeats: int) -> Column:
    """How many rounds take a document: it fits what was left then, its hash is under that round's stop, and it may be taken once more."""

    def one(n: Column, r: Column) -> Column:
        fits = (size > 0) & (size <= r["left"]) & (r["stop"].isNull() | (h < r["stop"]) | F.coalesce(h == r["edge"], F.lit(False)))
        return n + (fits & ((n == 0) | r["again"]) & (copies + n < max_repeats)).cast("int")

    return F.aggregate(rounds, F.lit(0), one)


def _boundary(rows: DataFrame, bucket: str) -> DataFrame:
    """(source, at, below): the bucket in which what is left runs out (null if it lasts), and the words taken before it; rows have below of their own."""
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy(bucket))
    return (
        rows.groupBy("source", "left", "below", bucket)
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", upto)
        .groupBy("source", F.col("below").alias("_from"))
        .agg(F.min(F.when(F.col("upto") > F.col("left"), F.col(bucket))).alias("at"), F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("below"))
        .select("source", "at", F.coalesce("below", "_from").alias("below"))
    )


def _threshold(docs: DataFrame, plan: DataFrame, max_repeats: int, again: bool, last: bool) -> DataFrame:
    """plan with one more round: the hash at which each source's remaining budget runs out."""
    left = lookup(docs.filter("size > 0"), plan, "source", F.col("h")).filter(F.col("size") <= F.col("left"))
    had = odd_copies(F.col("rounds"), F.col("size"), F.col("h"), F.col("copies"), max_repeats)
    left = left.filter(F.col("copies") + had < max_repeats if again else had == 0).select("source", "left", "size", "h", F.substring("h", 1, DIGITS).alias("bucket"))
    boundary = cut(_boundary(left.withColumn("below", F.lit(0)), "bucket"), "mix-boundary")
    # the bucket in which the budget runs out, cut into as many buckets again
    inside = lookup(left.select("*", F.substring("h", 1, 2 * DIGITS).alias("finer")), boundary, "source", F.col("h")).filter(F.col("bucket") == F.col("at")).drop("at", "bucket")
    inside = cut(inside, "mix-inside")
    finer = cut(_boundary(inside, "finer"), "mix-boundary")
    # refined: only the documents of the finer bucket in which the budget runs out
    over = F.col("upto") > F.col("left")
    refined = (
        lookup(inside.drop("below"), finer, "source", F.col("h"))
        .filter(F.col("finer") == F.col("at"))
        .groupBy("source", "left", "below", "h")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("h")))
        .groupBy("source")
        .agg(F.min(F.when(over, F.col("h"))).alias("stop"), F.min(F.when(over, F.col("upto"))).alias("after"), F.max(F.when(~over, F.col("upto"))).alias("reached"))
    )
    b, r = boundary.select(F.col("source").alias("_b"), "below").join(finer.select(F.col("source").alias("_f"), F.col("below").alias("_finer")), F.col("_b").eqNullSafe(F.col("_f")), "left").select("_b", F.coalesce("_finer", "below").alias("below")), refined.withColumnRenamed("source", "_r")
    steps = plan.join(b, plan["source"].eqNullSafe(b["_b"]), "left").join(r, plan["source"].eqNullSafe(r["_r"]), "left")
    reached = F.coalesce("reached", "below", F.lit(0))
    edge = F.when((F.col("after") - F.col("left")) < (F.col("left") - reached), F.col("stop")) if last else F.lit(None).cast("string")
    step = F.struct(F.col("left").alias("left"), F.col("stop").alias("stop"), edge.alias("edge"), F.lit(again).alias("again"))
    return steps.select("source", "source_size", "target", "copies", (F.col("left") - reached).alias("left"), F.concat("rounds", F.array(step)).alias("rounds"))


def _hash() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, h) and the plan (source, source_size, target, copies, rounds), both written."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash().alias("h")), "mix-sized")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    empty = F.array().cast("array<struct<left:double,stop:string,edge:string,again:boolean>>")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats).select("source", "source_size", "target", whole.alias("copies"))
    plan = cut(plan.select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("left"), empty.alias("rounds")), "mix-plan")
    for k in range(rounds):
        plan = cut(_threshold(sized, plan, max_repeats, k >= rounds - AGAIN, k == rounds - 1), "mix-plan")
    return sized, plan


def _copies(size: Column, h: Column, max_repeats: int) -> Column:
    return F.col("copies") + odd_copies(F.col("rounds"), size, h, F.col("copies"), max_repeats).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document of docs.

    docs needs doc_id, text and source. taken is copies times size; the copies of a document differ
    from its source's mean by less than one, but where large documents leave gaps, and never exceed max_repeats. Which documents get the
    odd copy depends on their doc_id and text alone, so reruns agree.
    """
    sized, plan = plan_mix(docs, weights, max_repeats, rounds)
    taken = lookup(sized, plan, "source", F.col("h")).withColumn("copies", _copies(F.col("size"), F.col("h"), max_repeats))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; texts are not shuffled."""
    plan = plan_mix(docs, weights, max_repeats, rounds)[1].select("source", "copies", "rounds")
    row = docs.select("source", F.struct("*").alias("row"), n_words(F.col("text")).alias("size"), _hash().alias("h"))
    taken = lookup(row, plan, "source", F.col("h")).withColumn("n", _copies(F.col("size"), F.col("h"), max_repeats).cast("int"))
    return taken.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")


def _oracle(rounds: int = ROUNDS) -> str:
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS) + "]"
    steps = ""
    for k in range(1, rounds + 1):
        closest = "CASE WHEN min(upto) FILTER (upto > l) - any_value(l) < any_value(l) - coalesce(max(upto) FILTER (upto <= l), 0) THEN min(h) FILTER (upto > l) END" if k == rounds else "NULL::VARCHAR"
        may = f"copies + took < {MAX_REPEATS}" + ("" if k > rounds - AGAIN else " AND took = 0")
        steps += f""",
c{k} AS (SELECT t.*, p.l, sum(size) OVER (PARTITION BY t.source ORDER BY h) upto FROM t{k - 1} t JOIN p{k - 1} p ON t.source IS NOT DISTINCT FROM p.source WHERE {may} AND size > 0 AND size <= p.l),
r{k} AS (SELECT source, min(h) FILTER (upto > l) stop, {closest} edge, max(upto) FILTER (upto <= l) reached FROM c{k} GROUP BY source),
p{k} AS (SELECT p.source, p.l - coalesce(r.reached, 0) l, copies FROM p{k - 1} p LEFT JOIN r{k} r ON p.source IS NOT DISTINCT FROM r.source),
t{k} AS (SELECT t.doc_id, t.source, t.size, t.h, took + (size > 0 AND {may} AND size <= p.l AND (r.stop IS NULL OR h < r.stop OR coalesce(h = r.edge, false)))::INT took FROM t{k - 1} t JOIN p{k - 1} p ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN r{k} r ON t.source IS NOT DISTINCT FROM r.source)"""
    return f"""
WITH t0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT size,
  md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) h, 0 took FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT source_size FROM t0 GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 rank FROM s0),
s2 AS (SELECT *, {weights}[(rank % {len(WEIGHTS)} + 1)::INT] weight, source_size * {float(MAX_REPEATS)}::DOUBLE lim FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) level,
  row_number() OVER (ORDER BY lim / weight, rank) place FROM s2 WINDOW b AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(level, place) FROM s3 WHERE lim / weight >= level) lv FROM s3),
s5 AS (SELECT source, source_size, least(lim, lv * weight) target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT copies FROM s5),
p0 AS (SELECT source, target - copies * source_size l, copies FROM s6){steps}
SELECT t.doc_id, t.size, s.source_size, s.target, ((s.copies + took) * t.size)::BIGINT taken FROM t{rounds} t JOIN s6 s ON t.source IS NOT DISTINCT FROM s.source
"""


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE_SQL = {"op1_mix_sources": _oracle()}
