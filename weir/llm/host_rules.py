"""Host-level quality rules (DataFrame operations only).

Each document is measured; documents that fail any rule count as failures of their host (the
column `source`). A host's failure rate is shrunk toward the corpus by a beta prior fitted to
all hosts' rates by their first two moments, less the spread that chance alone gives to hosts of their
sizes, so a host with few documents needs strong evidence. Hosts whose shrunk rate is more than SPREADS
standard deviations of the prior above its mean are rejected with all their documents. Where hosts
differ no more than by chance, the prior has no spread and no host is rejected.

Nulls and odd rows: a null text has no words and fails; a null host is a host of its own; repeated
rows each count; texts may have any length, time grows as n log n. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import WORD, cut, lookup, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
MEAN_WORD_CHARS = (2.0, 15.0)
#: Standard deviations of the prior above its mean at which a host is rejected.
SPREADS = 2.0
#: A variance of the prior up to this is none.
NO_SPREAD = 1e-9
#: Window of words whose repeats count.
GRAM = 3


def _shifted(array: Column, k: int, count: Column) -> Column:
    return F.slice(array, F.lit(k + 1), count)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words); n_lines are those with a word.

    Repeated windows are found inside the row: window hashes are sorted with their positions, equal
    neighbours are repeats, and the positions covered are the sum of the gaps between repeats, at
    most GRAM each. Time grows as n log n with the length of a text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    bare = F.col("text")
    for space in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(space), F.lit(""))
    rows = rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    count = F.greatest(F.size("h") - (GRAM - 1), F.lit(0))
    rows = rows.withColumn("grams", F.arrays_zip(*[_shifted(F.col("h"), k, count).alias(f"w{k}") for k in range(GRAM)]))
    rows = rows.withColumn("grams", F.transform("grams", lambda g, i: F.struct(F.xxhash64(*[g[f"w{k}"] for k in range(GRAM)]).alias("g"), i.alias("at"))))
    # most short texts repeat nothing, which the count of distinct windows shows without a sort
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct(F.col("grams.g"))) == F.size("grams"), F.slice("grams", 1, 0)).otherwise(F.sort_array("grams")))
    n = F.size("sorted")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.col("sorted.g"), F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(F.col("sorted.g"), F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
    near = F.arrays_zip(F.col("sorted.g").alias("g"), F.col("sorted.at").alias("at"), before.alias("before"), after.alias("after"))
    repeats = F.filter(near, lambda x: x["at"].isNotNull() & ((x["g"] == x["before"]) | (x["g"] == x["after"])))
    rows = rows.withColumn("at", F.sort_array(F.transform(repeats, lambda x: x["at"])))
    gaps = F.zip_with(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(GRAM)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(GRAM).cast("long"), lambda total, gap: total + gap)).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def fails_a_rule() -> Column:
    """The document-level rules whose failures are counted by host."""
    mean_chars = F.try_divide("word_chars", "n_words")
    return (
        base_failed()
        | (F.col("n_symbols") > F.col("n_words") * MAX_SYMBOLS_PER_WORD)
        | (F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINE_SHARE)
        | F.coalesce((mean_chars < MEAN_WORD_CHARS[0]) | (mean_chars > MEAN_WORD_CHARS[1]), F.lit(True))
    )


def host_verdicts(rows: DataFrame, spreads: float = SPREADS) -> DataFrame:
    """(host, host_docs, host_rate, host_kept) from measured documents.

    The prior's mean m is that of the hosts' rates, its variance v theirs less m (1 - m) / n, on average, for hosts
    of n documents; its strength is m (1 - m) / v - 1, at least 1.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(fails_a_rule().cast("long")).alias("failures"))
    prior = hosts.select((F.col("failures") / F.col("host_docs")).alias("r"), (1 / F.col("host_docs")).alias("one")).agg(F.coalesce(F.avg("r"), F.lit(0.0)), F.coalesce(F.var_pop("r"), F.lit(0.0)), F.coalesce(F.avg("one"), F.lit(0.0)))
    mean, spread, one = prior.first()
    variance = spread - mean * (1 - mean) * one
    if variance <= NO_SPREAD:
        return hosts.select("host", "host_docs", F.lit(mean).alias("host_rate"), F.lit(True).alias("host_kept"))
    weight = max(mean * (1 - mean) / variance - 1, 1.0)
    rate = (F.col("failures") + mean * weight) / (F.col("host_docs") + weight)
    return hosts.select("host", "host_docs", rate.alias("host_rate"), (rate <= mean + spreads * variance**0.5).alias("host_kept"))


def host_rules(docs: DataFrame, host: str = "source", spreads: float = SPREADS) -> DataFrame:
    """Measures, base_failed, host_rate and kept for every document; the texts are read once."""
    rows = cut(measured(docs, host), "host-measured")
    joined = lookup(rows, cut(host_verdicts(rows, spreads), "host-verdicts"), "host", F.xxhash64("doc_id", "n_words", "word_chars"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def op7_host_rules(spark, sf_dir: str) -> DataFrame:
    rules = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL = f"""
WITH d AS (SELECT row_number() OVER () row, doc_id, source, coalesce(text, '') text FROM documents),
w AS (SELECT row, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') w FROM d),
g AS (SELECT row, unnest(range(1, len(w) - 1)) i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM g),
g3 AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) n FROM g2),
r AS (SELECT row, count(DISTINCT p)::BIGINT n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) p FROM g3 WHERE n > 1) GROUP BY row),
l AS (SELECT row, count(*) n_lines, count(*) - count(DISTINCT line) n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
m AS (SELECT w.doc_id, w.source, len(w)::BIGINT n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT word_chars,
  (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words
  FROM w LEFT JOIN r USING (row) LEFT JOIN l USING (row)),
f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} base_failed FROM m),
e AS (SELECT *, base_failed OR n_symbols > n_words * {MAX_SYMBOLS_PER_WORD}::DOUBLE OR n_dup_lines > n_lines * {MAX_DUP_LINE_SHARE}::DOUBLE
  OR coalesce(word_chars / n_words < {MEAN_WORD_CHARS[0]} OR word_chars / n_words > {MEAN_WORD_CHARS[1]}, true) failed FROM f),
h AS (SELECT source, count(*) n, sum(failed::INT) k FROM e GROUP BY source),
p AS (SELECT avg(k / n) m, var_pop(k / n) v, avg(1 / n) one FROM h),
q AS (SELECT m, v - m * (1 - m) * one v FROM p),
k AS (SELECT source, CASE WHEN v > {NO_SPREAD} THEN (k + m * greatest(m * (1 - m) / v - 1, 1.0)) / (n + greatest(m * (1 - m) / v - 1, 1.0)) <= m + {SPREADS} * sqrt(v) ELSE true END host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept kept FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source
"""

QUERIES = {"op7_host_rules": op7_host_rules}
ORACLE_SQL = {"op7_host_rules": _SQL}
