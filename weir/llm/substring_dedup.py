"""Substring dedup by prefix-partitioned suffix trees.

Every word starts a suffix; one that shares MIN_WORDS words or more with an earlier one is a repeat. Suffixes
are dealt to tasks by a piece of ANCHOR words near their start, which those of a common node all
have; where a piece is frequent its suffixes are dealt by document besides, so groups stay small
(see repeats.py). Each task sorts its suffixes by their first MIN_WORDS words: the internal nodes at that depth
are runs of equal leaves. A node's first leaf (least doc_id, then start) stays, all others are repeats;
as starts run on, overlapping ones merge to the maximal repeats. Nodes at other depths decide
nothing here and are not built, and leaves stand in the order of their hashes, not of their words.

Nulls and odd rows: a null text has no words; texts under MIN_WORDS words are kept whole; rows with one
doc_id do not remove each other's words, whether their texts are equal or not; rows with a null doc_id
are kept whole and remove nothing. Texts and words may have any length, as a task holds one text at a
time. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weir.llm import arrow_words as A
from weir.llm.common import row_key
from weir.llm.repeats import later_repeats

MIN_WORDS = 20
ANCHOR = 8


def _items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = A.Words(data, offsets)
    h = words.hashes()
    return h, h, words.first


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        for text, first, last in zip(batch.column("text").to_pylist(), starts, ends, strict=True):
            words = (text or "").encode().split()
            kept, done = [], 0
            for s, e in zip(first or (), last or (), strict=True):
                kept += words[done:s]
                done = e
            kept += words[done:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        counts, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.record_batch([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) or, with digest, kept_sha256 in place of kept: each document without its later repeats."""
    spans = later_repeats(docs.select("doc_id", "text"), _items, min_words, min(ANCHOR, min_words))
    rows = docs.select("doc_id", "text", row_key().alias("key")).join(spans.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "text", "starts", "ends")
    if digest:
        return rows.mapInArrow(A.releasing(_kept_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rows.mapInArrow(A.releasing(_kept), "doc_id long, n_words long, n_removed long, kept string")


def op5_suffix_trees(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op5_suffix_trees": op5_suffix_trees}
ORACLE_SQL = {
    "op5_suffix_trees": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) i FROM d WHERE len(w) >= {MIN_WORDS}),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) g FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {MIN_WORDS})) pos FROM r WHERE n > 1),
u AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) pos FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) kept, count(*) n FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos WHERE c.pos IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(k.n, 0))::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
}
