"""Runs of items that occur earlier in the corpus, shared by line and substring dedup.

Every run of `size` items starts a suffix. Most suffixes have no equal, so they are not dealt one by one: of
the pieces of `anchor` items in a run the one with the least hash is its anchor, equal runs have equal
anchors at equal places, and successive runs mostly share theirs. One leaf is dealt for each
anchor, with the hashes of the runs that chose it: the ways in which the anchor extends to
both sides. Leaves whose anchor stands alone are dropped where they meet, and the runs of the others are
sorted; equal ones are neighbours then, the earliest first.

Leaves are dealt by their anchor. One that a PLAN_SHARE-th of the documents shows to be frequent is dealt
by document besides; the earliest of each such run in each task are then compared across tasks.
Tasks read sorted rows as a stream, so the number of equal leaves never matters to memory.

Runs are equal if the 64-bit hash of the anchor and that of the run are: only runs that share an anchor
are ever compared by the second.

A row is known by its doc_id and a hash of its text. A run of it is a repeat if an equal one stands in a
row of smaller doc_id, or earlier in the same row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import cut, done, free, row_key

#: One row in so many, by a hash of its doc_id, is looked at for frequent anchors; results do not depend on it.
PLAN_SHARE = 16
#: An anchor is frequent if it has this many leaves among those looked at, and a fair task's share or more.
FREQUENT = 64
#: A fair task's share is this part of what one task gets.
FAIR = 4

LEAVES = "hash long, salt int, doc_id long, key int, start int, runs binary"
RUNS = "hash long, salt int, doc_id long, key int, start int, run long"

#: Of some texts: two hashes of each item, which may be the same where anchors have several items, and the numbers of items before each text.
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def anchored(h: np.ndarray, h2: np.ndarray, first: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first run, number of runs) of each leaf, and the hash of each run, all in order."""
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    starts = np.flatnonzero(room >= size)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(0, np.uint64)
    runs = A.Runs(h2)
    pieces = (runs if h is h2 else A.Runs(h)).of(anchor)
    at = A.least_run(pieces, size - anchor + 1)[starts]
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return pieces[at[head]], starts[head], np.diff(np.append(head, len(starts))), runs.of(size)[starts]


def _counted(items: Items, size: int, anchor: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in A.pieces(batch.column(0)):
                value, n = np.unique(anchored(*items(data, offsets), size, anchor)[0], return_counts=True)
                yield pa.record_batch([value.view(np.int64), n.astype(np.int64)], ["hash", "n"])

    return A.releasing(count)


def _leaves(items: Items, size: int, anchor: int, often: np.ndarray, salts: int):
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for row, _, data, offsets in A.pieces(batch.column(0)):
                h, h2, first = items(data, offsets)
                hash_, start, n, runs = anchored(h, h2, first, size, anchor)
                if not len(hash_):
                    continue
                text = np.searchsorted(first, start, "right") - 1
                key = keys[row + text].astype(np.int32)
                ident = ids[row + text].astype(np.int64)
                salt = np.where(np.isin(hash_, often), 1 + (A.mixed(ident.view(np.uint64)) % np.uint64(salts)).astype(np.int64), 0)
                ends = np.append(0, np.cumsum(n) * 8).astype(np.int32)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(runs.tobytes())])
                yield pa.record_batch([hash_.view(np.int64), salt.astype(np.int32), ident, key, (start - first[text]).astype(np.int32), bytes_], ["hash", "salt", "doc_id", "key", "start", "runs"])

    return A.releasing(leaves)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves sorted by (hash, salt) to their runs, less unsalted ones that stand alone."""

    def runs(batch: pa.RecordBatch, before: int | None, after: int | None) -> pa.RecordBatch:
        hash_, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = hash_[1:] == hash_[:-1]
        kept = np.flatnonzero((salt > 0) | np.append(before == hash_[0], same) | np.append(same, after == hash_[-1]))
        batch = batch.take(pa.array(kept))
        offsets = np.frombuffer(batch.column(5).buffers()[1], np.int32)[: len(kept) + 1].astype(np.int64) // 8
        n = np.diff(offsets)
        run = np.frombuffer(batch.column(5).buffers()[2] or b"", np.int64)[offsets[0] : offsets[-1]]
        rows = np.repeat(np.arange(len(kept)), n)
        start = batch.column(4).to_numpy()[rows] + (np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], n))
        return pa.record_batch([*(batch.column(k).to_numpy()[rows] for k in range(4)), start.astype(np.int32), run], ["hash", "salt", "doc_id", "key", "start", "run"])

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield runs(held, before, batch.column(0)[0].as_py())
            before = held.column(0)[-1].as_py()
        held = batch
    if held is not None:
        yield runs(held, before, None)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (hash, run, doc_id, key, start) to those that repeat an earlier one, hash and run null, and to the first of salted ones."""
    # of the row before: hash, run, then the first doc_id of these, then key and start of the first of its document
    before: tuple = (None,) * 5
    for batch in batches:
        if not batch.num_rows:
            continue
        hash_, salt, doc, key, start, run = (batch.column(k).to_numpy() for k in range(6))
        node = np.append((hash_[0], run[0]) != before[:2], (hash_[1:] != hash_[:-1]) | (run[1:] != run[:-1]))
        heads = np.flatnonzero(node)
        own = np.searchsorted(heads, np.arange(len(doc)), "right") - 1
        least = np.where(own >= 0, doc[heads[own]] if len(heads) else 0, before[2] or 0)
        new = node | np.append((doc[0], key[0]) != before[3:5] if not node[0] else True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
        heads = np.flatnonzero(new)
        own = np.searchsorted(heads, np.arange(len(doc)), "right") - 1
        first = np.where(own >= 0, start[heads[own]] if len(heads) else 0, before_start if before[0] is not None else 0)
        repeat = (doc != least) | (start != first)
        out = repeat | (salt > 0)
        yield pa.record_batch([doc[out], key[out], start[out], pa.array(hash_[out], mask=repeat[out]), pa.array(run[out], mask=repeat[out])], ["doc_id", "key", "start", "hash", "run"])
        before, before_start = (hash_[-1], run[-1], least[-1], doc[-1], key[-1]), first[-1]


def _spans(size: int):
    """Sorted (doc_id, key, start) to one row for each document, with the runs of items that are covered."""

    def rows(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        new_doc = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))
        new = new_doc.copy()
        new[1:] |= starts[1:] > starts[:-1] + size
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1
        docs = np.flatnonzero(new_doc)
        offsets = np.append(np.searchsorted(first, docs), len(first)).astype(np.int32)
        return pa.record_batch([pa.array(ids[docs]), pa.array(keys[docs]), pa.ListArray.from_arrays(offsets, starts[first]), pa.ListArray.from_arrays(offsets, (starts[last] + size).astype(np.int32))], ["doc_id", "key", "starts", "ends"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            other = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # where the last row's document begins in this batch
            if parts and (at or (parts[-1][0][-1], parts[-1][1][-1]) != (new[0][0], new[1][0])):
                yield rows(*(np.concatenate(x) for x in zip(*parts, [c[:at] for c in new], strict=True)))
                parts = []
            elif at:
                yield rows(*(c[:at] for c in new))
            parts.append([c[at:] for c in new])
        if parts:
            yield rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return A.releasing(spans)


def _frequent(texts: DataFrame, items: Items, size: int, anchor: int, tasks: int) -> np.ndarray:
    """Hashes of frequent anchors, sorted: at most FAIR for each task."""
    counts = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PLAN_SHARE)) == 0).select("text").mapInArrow(_counted(items, size, anchor), "hash long, n long")
    counts = cut(counts.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > 1), "repeats-counts")
    fair = max(FREQUENT, (counts.agg(F.sum("n")).first()[0] or 0) // (FAIR * tasks))
    found = np.sort(np.array([r.hash for r in counts.filter(F.col("n") >= fair).select("hash").toLocalIterator()], np.int64).view(np.uint64))
    done(counts)
    return found


def later_repeats(docs: DataFrame, items: Items, size: int, anchor: int) -> DataFrame:
    """(doc_id, key, starts, ends): for each row of docs (doc_id, text) with any, the runs [start, end) of its items that stand in a later repeat, in order; written."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.filter("doc_id is not null and text is not null").select("text", "doc_id", row_key().alias("key"))
    often = _frequent(texts, items, size, anchor, tasks)
    leaves = texts.mapInArrow(_leaves(items, size, anchor, often, tasks), LEAVES).repartition(tasks, "hash", "salt").sortWithinPartitions("hash")
    runs = leaves.mapInArrow(_opened, RUNS).sortWithinPartitions("hash", "run", "doc_id", "key", "start")
    repeats = cut(runs.mapInArrow(_repeats, "doc_id long, key int, start int, hash long, run long"), "repeats")
    free(spark)
    covered = repeats.filter("hash is null").select("doc_id", "key", "start")
    if len(often):
        # the first of a frequent run in each task: as many for each run as there are tasks, at most
        run = Window.partitionBy("hash", "run")
        firsts = repeats.filter("hash is not null").withColumn("_least", F.min("doc_id").over(run)).filter(F.col("doc_id") != F.col("_least"))
        covered = covered.unionAll(firsts.select("doc_id", "key", "start"))
    spans = cut(covered.repartition(tasks, "doc_id", "key").sortWithinPartitions("doc_id", "key", "start").mapInArrow(_spans(size), "doc_id long, key int, starts array<int>, ends array<int>"), "repeats-spans")
    done(repeats)
    return spans
