"""Line dedup by winnowing over line hashes.

A document is its sequence of lines that hold a word. Of every WINDOW successive lines the one with
the least hash is chosen as a fingerprint, so any run of WINDOW lines that two places share has a common
fingerprint there. Only chosen lines are dealt. The positions of equal fingerprints meet, and each is
extended to both sides by the lines around it, within the windows that chose it; where two extend alike,
the lines that they have in common are a shared run (see repeats.py). A line is deleted if it stands in
such a run that also starts earlier (smaller doc_id, or same document, earlier line); what is judged is the
input, not what is left of it. Longer repeats are deleted whole, as their runs overlap.

With long_words, a line of so many words or more is also a repeat by itself, whatever its neighbours. The
query op4_line_winnowing compares runs of WINDOW lines only, as its SQL does; the pipeline takes
lines of LONG_WORDS words too.

Lines are equal if their bytes are. Lines without a word are never compared and always kept.

Nulls and odd rows: a null text stays null; texts of fewer than WINDOW lines, none of them long, are kept; rows
with one doc_id do not delete each other's lines, whether their texts are equal or not; rows with a null doc_id
are kept whole and delete nothing. Texts and lines may have any length, as a task holds one text at a time. An
empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import cut, done, read, row_key
from weir.llm.repeats import later_repeats

WINDOW = 2
#: Words of a line that the pipeline takes for a repeat by itself.
LONG_WORDS = 50


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lines = A.Words(data, offsets, lines=True)
    return lines.hashes(), lines.hashes(A.SEED_B), lines.first


def _long_lines(long_words: int):
    def long_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines, words = A.Words(data, offsets, lines=True), A.Words(data, offsets)
        long = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts) >= long_words
        return lines.hashes()[long], lines.hashes(A.SEED_B)[long], np.append(0, np.cumsum(long))[lines.first]

    return long_lines


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """(doc_id, key, starts, ends, long_starts, long_ends), written: runs [start, end) of the worded lines of each row of docs that stand in a later repeat, and of its lines of long_words words or more, counted apart."""
    spans = later_repeats(docs.select("doc_id", "text"), _lines, window, 1)
    if long_words is None:
        return spans.withColumns({"long_starts": F.lit(None).cast("array<int>"), "long_ends": F.lit(None).cast("array<int>")})
    longs = later_repeats(docs.select("doc_id", "text"), _long_lines(long_words), 1, 1)
    both = spans.join(longs.withColumnsRenamed({"starts": "long_starts", "ends": "long_ends"}), ["doc_id", "key"], "full")
    out = cut(both, "line-spans")
    done(spans, longs)
    return out


class _Runs:
    """Tells for successive numbers whether they stand in runs."""

    def __init__(self, starts: list[int] | None, ends: list[int] | None):
        self.starts, self.ends, self.at, self.n = starts or [], ends or [], 0, 0

    def next(self) -> bool:
        n, self.n = self.n, self.n + 1
        while self.at < len(self.ends) and n >= self.ends[self.at]:
            self.at += 1
        return self.at < len(self.starts) and n >= self.starts[self.at]


def _without(text: str | None, starts: list[int] | None, ends: list[int] | None, long_starts: list[int] | None = None, long_ends: list[int] | None = None, long_words: int | None = None) -> tuple[int, int, str | None]:
    """Worded lines, those deleted, and the text that is left."""
    if text is None:
        return 0, 0, None
    runs, long_runs = _Runs(starts, ends), _Runs(long_starts, long_ends)
    kept, removed = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            gone = runs.next()
            if long_starts and len(line) >= 2 * long_words - 1 and len(line.encode().split()) >= long_words and long_runs.next():
                gone = True
            if gone:
                removed += 1
                continue
        kept.append(line)
    return runs.n, removed, "\n".join(kept) if removed else text


_SPANS = ("starts", "ends", "long_starts", "long_ends")


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """The rows of docs, all columns, with later repeated lines deleted from text; n_chars, where docs has it, is counted anew."""
    spans = repeated_lines(docs, window, long_words)
    spans = spans.select(F.col("doc_id").alias("_weir_id"), F.col("key").alias("_weir_text"), *[F.col(c).alias(f"_weir_{c}") for c in _SPANS])
    rows = docs.withColumn("_weir_key", row_key())
    rows = rows.join(spans.hint("merge"), (rows["doc_id"] == spans["_weir_id"]) & (rows["_weir_key"] == spans["_weir_text"]), "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = zip(*(batch.column(f"_weir_{c}").to_pylist() for c in _SPANS), strict=True)
            left = [t.as_py() if not s[0] and not s[2] else _without(t.as_py(), *s, long_words)[2] for t, s in zip(batch.column(at), spans, strict=True)]
            batch = batch.set_column(at, "text", pa.array(left, pa.string()))
            yield batch.select([n for n in batch.schema.names if not n.startswith("_weir_")])

    cleaned = rows.mapInArrow(A.releasing(clean), docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_without(t or "", s, e) for t, s, e in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in found], pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def op4_line_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.withColumn("key", row_key()).join(repeated_lines(docs).hint("merge"), ["doc_id", "key"], "left")
    return rows.select("doc_id", "text", "starts", "ends").mapInArrow(A.releasing(_digests), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


QUERIES = {"op4_line_winnowing": op4_line_winnowing}
ORACLE_SQL = {
    "op4_line_winnowing": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) lines FROM documents),
l AS (SELECT doc_id, unnest(lines) line, generate_subscripts(lines, 1) pos FROM d),
w AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT doc_id, n, list(line) OVER r g, count(*) OVER r size FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, n, row_number() OVER (PARTITION BY g ORDER BY doc_id, n) k FROM g WHERE size = {WINDOW}),
c AS (SELECT DISTINCT doc_id, unnest(range(n, n + {WINDOW})) n FROM f WHERE k > 1),
k AS (SELECT l.doc_id, count(w.n) n_lines, count(c.n) n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.n IS NULL) kept
  FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.pos = w.pos LEFT JOIN c ON w.doc_id = c.doc_id AND w.n = c.n GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT n_lines, n_removed::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM k
"""
}
