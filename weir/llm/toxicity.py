"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the spelling of words, one of toxic and one of ordinary
documents, share everything below the highest order: both back off to continuation counts taken
from the whole corpus, labelled or not. An N-gram holds N bytes of one word with its
white space (A-Z lowered), so inflected forms of a rare expression support each other. A document's
evidence is the difference of its log-likelihoods, normalised by its length, and a logistic curve
fitted on a fold that the models have not seen turns that into a score.

Where neither class has seen an N-gram the shared part cancels, and what is left would only tell
which class has fewer documents; it counts as no evidence, so that new words do not speak for the
rarer class. So a model is one table of seen N-grams, and its size is bounded by the labelled
sample (MAX_LABELLED rows, chosen by a hash of doc_id). A class counts each word once a document,
and equal texts once.

Labels are used of rows whose crc32(doc_id as text) mod 5 is not 0 only: remainder 1 fits the
curve, the others the models.

Nulls and odd rows: a null or blank text has no evidence either way and gets the curve's value at 0;
labels with a null doc_id or toxic, and those without a document, are ignored; repeated rows are
scored alike. Without labels of both classes every score is 0. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import at_sweep, cut, free, read

#: Bytes of an N-gram; at most 7, so that it fits a positive 64-bit number.
ORDER = 6
DISCOUNT = 0.75
MAX_LABELLED = 60_000
FOLDS = 5
PIECE = 1 << 20
#: Log-odds of a text without evidence, at most.
NOTHING = -0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def grams(words: A.Words, which: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The N-grams of some words as numbers, and the place in `which` of the word of each. A word gives one for each of its bytes and one for its end."""
    size = words.ends[which] - words.starts[which]
    place = np.cumsum(size + order) - size - 1  # each word after order - 1 spaces and before one
    buffer = np.full(int((size + order).sum()) + order, 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    buffer[np.repeat(place, size) + step] = words.data[np.repeat(words.starts[which], size) + step]
    n = size + 1
    at = np.repeat(place, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(at), np.int64)
    for k in range(order - 1, -1, -1):
        out = (out << 8) | buffer[at - k]
    return out, np.repeat(np.arange(len(which)), n)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[A.Words, np.ndarray]:
    words = A.Words(_LOWER[data], offsets)
    return words, words.hashes()


def _corpus_grams(order: int):
    def corpus_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, data, offsets in A.pieces(batch.column(0), PIECE):
                words, h = _words(data, offsets)
                found.append(np.unique(grams(words, np.unique(h, return_index=True)[1], order)[0]))
            yield pa.record_batch([np.unique(np.concatenate(found))], ["gram"])

    return corpus_grams


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, n): n counts the (document, word) pairs in which it occurs, with its repeats in the word."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, data, offsets in A.pieces(batch.column(0), PIECE):
            words, h = _words(data, offsets)
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            order = np.lexsort((h, doc))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]
            once = order[new]
            g, of = grams(words, once)
            label = toxic[row + doc[once]][of]
            for y in (0, 1):
                value, n = np.unique(g[label == y], return_counts=True)
                yield pa.record_batch([value, np.full(len(value), y, np.int32), n], ["gram", "toxic", "n"])


def shared_backoff(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(low, p): the Kneser-Ney probability of the last byte of each (order - 1)-gram given those before it, by continuation counts over all documents."""
    level = cut(docs.select("text").mapInArrow(A.releasing(_corpus_grams(order)), "gram long").distinct(), "toxicity-corpus").select(F.col("gram").alias("key"))
    levels = []
    for size in range(order - 1, 0, -1):
        level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("key")).agg(F.count("*").alias("n"))
        level = cut(level, "toxicity-level")
        levels.append(level)
        level = level.select("key")
    total = Window.partitionBy()
    p = levels[-1].select("key", (F.col("n") / F.sum("n").over(total) * 0.9 + 0.1 / 256).alias("p"))
    for size, counts in zip(range(2, order), reversed(levels[:-1]), strict=True):
        context = Window.partitionBy(F.shiftright("key", 8))
        n, kinds = F.sum("n").over(context), F.count("*").over(context)
        own = counts.select(F.col("key"), F.col("key").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)).alias("low"), (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / n).alias("own"), (kinds * DISCOUNT / n).alias("rest"))
        p = own.join(p.select(F.col("key").alias("low"), "p"), "low").select("key", (F.col("own") + F.col("rest") * F.col("p")).alias("p"))
    return p.select(F.col("key").alias("low"), "p")


def class_models(counts: DataFrame, shared: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log-likelihood differences, toxic less ordinary, of the N-grams that a class has seen."""
    both = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    both = both.withColumn("context", F.shiftright("gram", 8)).withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(shared, "low")
    context = Window.partitionBy("context")
    for y in (0, 1):
        both = both.withColumn(f"all{y}", F.sum(f"n{y}").over(context)).withColumn(f"kinds{y}", F.sum((F.col(f"n{y}") > 0).cast("int")).over(context))
        both = both.withColumn(f"rest{y}", F.when(F.col(f"all{y}") > 0, F.col(f"kinds{y}") * DISCOUNT / F.col(f"all{y}")).otherwise(F.lit(1.0)))
        both = both.withColumn(f"p{y}", F.greatest(F.col(f"n{y}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"all{y}"), F.lit(1)) + F.col(f"rest{y}") * F.col("p"))
    return both.select(F.col("gram").alias("key"), F.log(F.col("p1") / F.col("p0")).cast("float").alias("value"))


Model = tuple[np.ndarray, np.ndarray]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 for those that are missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(0))


def evidence(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Difference of log-likelihoods and number of words of each text."""
    sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in A.pieces(texts, PIECE):
        words, h = _words(data, offsets)
        _, which, of = np.unique(h, return_index=True, return_inverse=True)
        g, word = grams(words, which)
        distinct, back = np.unique(g, return_inverse=True)
        value = _looked_up(*model, distinct)
        each = np.bincount(word, value[back], minlength=len(which))
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        sums.append(np.bincount(doc, each[of], minlength=len(words.counts)))
        counts.append(words.counts)
    return np.concatenate(sums), np.concatenate(counts)


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Evidence a word, and evidence over the root of the length, for which chance alone would keep one spread at any length."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), total / n, total / np.sqrt(n)], axis=1)


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, free: slice) -> np.ndarray:
    """Weights of the logistic curve that start as w and of which `free` are fitted, slopes slightly held back."""
    w, part = w.copy(), x[:, free]
    held_back = np.array([1e-6, 0.1, 0.1])[free]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(held_back), part.T @ (y - p) - held_back * w[free])
        w[free] += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve whose value is 0.5 where precision and recall on the fitted rows are best together.

    A text that says nothing is not predicted toxic: where the curve would do so, that point is
    fixed at NOTHING and the slopes are fitted alone.
    """
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    x = x / scale
    w = _curve(x, y, np.zeros(x.shape[1]), slice(None))
    order = np.argsort(-(x @ w), kind="stable")
    z, hits = (x @ w)[order], np.cumsum(y[order])
    f = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f))
    if y.sum() >= 20 and best + 1 < len(z):
        w[0] -= (z[best] + z[best + 1]) / 2
    if w[0] > NOTHING:
        w = _curve(x, y, np.array([NOTHING, 0.0, 0.0]), slice(1, None))
    return w / scale


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); the result gives the scores of an Arrow column of texts."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    usable = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold(F.col("doc_id")) != 0)
    share = min(1.0, MAX_LABELLED / max(1, usable.count()))
    sample = cut(usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003), "toxicity-sample")
    # of equal texts one is learned from
    once = texts.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text"), F.length("text"), fold(F.col("doc_id")) == 1).agg(F.min(F.struct("doc_id", "toxic")).alias("one")).select("one.*")
    once = cut(once, "toxicity-once")
    learning = texts.join(F.broadcast(once.filter(fold(F.col("doc_id")) != 1)), "doc_id").select("text", "toxic")
    counts = cut(learning.mapInArrow(A.releasing(_class_grams), "gram long, toxic int, n long").groupBy("gram", "toxic").agg(F.sum("n").alias("n")), "toxicity-counts")
    rows = cut(class_models(counts, shared_backoff(texts)), "toxicity-model")
    free(spark)
    model = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in rows.orderBy("key").toArrow().columns))
    at_sweep(model.unpersist)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = evidence(model.value, batch.column(0))
            yield pa.record_batch([batch.column(1), total, n], ["toxic", "total", "n"])

    seen = texts.join(F.broadcast(once.filter(fold(F.col("doc_id")) == 1)), "doc_id").select("text", "toxic").mapInArrow(A.releasing(measured), "toxic int, total double, n long").toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    weights = fitted(features(seen.column("total").to_numpy(), seen.column("n").to_numpy()), y) if len(np.unique(y)) == 2 else None

    def scores(text: pa.Array) -> np.ndarray:
        if weights is None:
            return np.zeros(len(text))
        return 1 / (1 + np.exp(-np.clip(features(*evidence(model.value, text)) @ weights, -30, 30)))

    return scores


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    scores = scorer(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), scores(batch.column(1))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(A.releasing(scored), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score under 0.5."""
    scores = scorer(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(A.releasing(clean), docs.schema)


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_kneser_ney": op8_kneser_ney}
ORACLE_SQL: dict[str, str] = {}
