"""Document fingerprints from closed syncmers (DataFrame operations only).

A text is a sequence of words, each replaced by its hash. A window of K words is a closed syncmer
if the smallest of its S-word pieces is the first or the last of them. Whether a window is chosen
depends on its own words only, so equal passages give equal anchors wherever they stand. syncmers() keeps all of
them with their places. similarity() of two texts is the Jaccard similarity of their whole syncmer
sets; passages() chains equal anchors by place into the passages that two texts share.

The fingerprint of a text is a digest, the FINGERPRINT smallest distinct syncmer hashes; the likeness
of two is the share of common ones among the smallest of their union, which only estimates the
similarity. The query shows fingerprints and compares whole sets.

Nulls and odd rows: a null text is an empty text; an empty text has an empty fingerprint; a text of
fewer than K words has one hash, that of all its words; two empty fingerprints have likeness 1.
In the order of doc_id a null is the smallest; rows with one doc_id follow by the hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import words

K, S = 3, 1
FINGERPRINT = 64
#: Rows of a range of doc_id in which neighbours are sought together.
ROWS_PER_RANGE = 4096
MAX_RANGES = 65_536
_GRID = 256


def _windows(array: Column, size: int) -> Column:
    """array<struct<w0, ..>>: the runs of `size` successive elements."""
    count = F.greatest(F.size(array) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(array, F.lit(j + 1), count).alias(f"w{j}") for j in range(size)])


def syncmers(docs: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """docs with out: array<struct<at int, hash long>>, the closed syncmers of a text column in order, at being the place of the first word."""
    rows = docs.withColumn("_w", words(F.col(text))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    if s > 1:
        rows = rows.withColumn("_s", F.transform(_windows(F.col("_h"), s), lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(s)])))
    else:
        rows = rows.withColumn("_s", F.col("_h"))
    pieces = k - s + 1
    count = F.greatest(F.size("_h") - (k - 1), F.lit(0))
    rows = rows.withColumn("_k", F.arrays_zip(*[F.slice("_h", F.lit(j + 1), count).alias(f"h{j}") for j in range(k)], *[F.slice("_s", F.lit(j + 1), count).alias(f"s{j}") for j in range(pieces)]))

    def closed(x: Column) -> Column:
        edges = F.least(x["s0"], x[f"s{pieces - 1}"]) if pieces > 1 else x["s0"]
        inner = [x[f"s{j}"] for j in range(1, pieces - 1)]
        return edges <= (F.least(*inner) if len(inner) > 1 else inner[0]) if inner else F.lit(True)

    hashed = F.transform("_k", lambda x, i: F.when(closed(x), F.struct(i.alias("at"), F.xxhash64(*[x[f"h{j}"] for j in range(k)]).alias("hash"))))
    short = F.when(F.size("_w") > 0, F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join("_w", " ")).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
    rows = rows.withColumn(out, F.when(F.size("_w") < k, short).otherwise(F.filter(hashed, lambda x: x.isNotNull())))
    return rows.drop("_w", "_h", "_s", "_k")


def fingerprint(anchors: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(anchors["hash"])), 1, FINGERPRINT)


def likeness(a: Column, b: Column) -> Column:
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, FINGERPRINT)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(smallest, F.array_intersect(a, b))) / F.size(smallest))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two anchor arrays, all of them; 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a["hash"], b["hash"])), F.size(F.array_union(a["hash"], b["hash"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def passages(pairs: DataFrame, key: str, a: str, b: str, k: int = K) -> DataFrame:
    """(key, a_start, b_start, n_words): the passages that the texts of anchor columns a and b share, from outer anchor to outer anchor.

    Equal anchors lie on a diagonal, the difference of their places; those of a diagonal whose windows
    of k words touch or overlap make one passage. Texts of fewer than k words have none. key names a pair
    of texts and is unique and not null. Work grows with the equal anchors, which a hash repeated in both texts multiplies.
    """
    left, right = (pairs.select(key, F.explode(c).alias("x")).select(key, F.col("x.hash").alias("hash"), F.col("x.at").alias(at)) for c, at in ((a, "_i"), (b, "_j")))
    met = left.join(right, [key, "hash"]).withColumn("_diagonal", F.col("_j") - F.col("_i"))
    order = Window.partitionBy(key, "_diagonal").orderBy("_i")
    met = met.withColumn("_run", F.sum(F.coalesce((F.col("_i") - F.lag("_i").over(order) > k).cast("int"), F.lit(1))).over(order))
    return met.groupBy(key, "_diagonal", "_run").agg(F.min("_i").alias("a_start"), F.min("_j").alias("b_start"), (F.max("_i") - F.min("_i") + k).alias("n_words")).drop("_diagonal", "_run")


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ..) with next_<column> of the row that follows by descending doc_id, the first following the last.

    Ranges of doc_id of about equal row counts are formed, the largest row of each is repeated at the
    end of the range before it, and neighbours are found inside ranges. No task sees more than one
    range, and rows move once.
    """
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    edges = docs.select(F.percentile_approx("doc_id", [j / ranges for j in range(1, ranges)], 10 * ranges + 1000)).first()[0] if ranges > 1 else []
    grid = [sorted(edges or [])[j : j + _GRID] for j in range(0, len(edges or []), _GRID)]

    def under(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))

    if grid:
        coarse = under(F.lit([g[-1] for g in grid]))
        fine = under(F.get(F.array(*[F.lit(g) for g in grid]), F.col("_coarse")))
        docs = docs.withColumn("_coarse", coarse).withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_coarse") * _GRID + F.greatest(fine, F.lit(0)))).drop("_coarse")
    else:
        docs = docs.withColumn("_range", F.lit(0))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    # at most MAX_RANGES + 1 rows; the largest range comes first
    heads = [tuple(r) for r in docs.groupBy("_range").agg(F.max(F.struct("doc_id", "_tie"))).orderBy(F.desc("_range")).selectExpr("_range", "`max(struct(doc_id, _tie))`.*").collect()]
    if not heads:
        return docs.drop("_range", "_tie").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    last = docs.sparkSession.createDataFrame([(before[0], at, doc_id, tie) for (at, doc_id, tie), before in zip(heads, [heads[-1], *heads[:-1]], strict=True)], "_before int, _at int, _id long, _tied long")
    repeated = docs.join(F.broadcast(last), (F.col("_range") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_tied")))
    rows = docs.withColumn("_ghost", F.lit(0)).unionByName(repeated.withColumn("_range", F.col("_before")).drop("_before", "_at", "_id", "_tied").withColumn("_ghost", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_ghost", F.desc_nulls_last("doc_id"), F.desc("_tie"))
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return rows.filter("_ghost = 0").drop("_ghost", "_range", "_tie")


def op2_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next_text", F.lit(1), F.col("half"))))
    rows = rows.select("doc_id", "n_chars", "text", "next_text", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    for text, anchors in (("text", "_a"), ("next_text", "_n"), ("edited", "_e")):
        rows = syncmers(rows, text, anchors).drop(text)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(fingerprint(F.col("_a"))).alias("fingerprint"),
        as_text(fingerprint(F.col("_e"))).alias("edited_fingerprint"),
        similarity(F.col("_a"), F.col("_e")).alias("near_edited"),
        similarity(F.col("_a"), F.col("_n")).alias("near_next"),
    )


QUERIES = {"op2_syncmer_fingerprints": op2_syncmer_fingerprints}
ORACLE_SQL: dict[str, str] = {}
