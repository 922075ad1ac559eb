"""Token ids as files of patched frame-of-reference blocks.

Documents are dealt into ranges of doc_id, encoded, and written in ascending order as pages of
whole documents. A page cuts its ids into blocks of BLOCK; a block stores its least id, the
differences to it packed at a width that fits the share FITS of them, and the others as a list of
exceptions; an index gives the place of every block in the page, so one block can be read alone.
Pages are rows of a Parquet table in the shared folder: Spark's writer commits whole tasks
only, so a lost executor leaves no torn file.

Words between ASCII white space are encoded by the library one by one and remembered, up to REMEMBER
words a process; the tokenizer's own splitting never crosses white space, so ids are the same.

Nulls and odd rows: a null text is an empty text and has the end id alone; a null doc_id comes first;
rows with one doc_id follow by their text. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import BROADCAST_ROWS, read, scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
BLOCK = 128
#: Share of a block's ids that its width must hold.
FITS = 0.9
#: Ids after which a page ends, at the next document's end.
PAGE = 1 << 16
REMEMBER = 1_000_000
#: ASCII signs that the splitting never joins to letters; the apostrophe may be.
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class Encoder(dict):
    """UTF-8 word to the bytes of its ids, which are little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if self.kept < REMEMBER:
            self.kept += 1
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


class PlainEncoder(Encoder):
    """For tokenizers that lower case, split letters, single digits and other signs, and map bytes to characters.

    Words of Latin letters, with signs after them (a run of signs is a match of its own), skip normalising and splitting, which
    would leave them whole, and go to the library's model directly.
    """

    def __init__(self, path: str):
        super().__init__(path)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.table = {b: 256 + k for k, b in enumerate(hidden)}
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        head = word.rstrip(SIGNS)
        if head and len(head) < len(word) and (head.isalpha() or head.decode().isalpha()):
            out = self[head] + self[word[len(head) :]]
        else:
            if word.isalpha():  # ASCII: the bytes are shown as they are
                seen = word.lower().decode()
            else:
                text = word.decode()
                if not text.isalpha() or max(text) > "\xff":
                    return super().__missing__(word)
                seen = text.lower().encode().decode("latin-1").translate(self.table)
            tokens = self.model.tokenize(seen)
            out = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if self.kept < REMEMBER:
            self.kept += 1
            self[word] = out
        return out


def encoder(path: str) -> Encoder:
    """One for each process and vocabulary; the plain one where it agrees with the library on a probe of its rules."""

    def made() -> Encoder:
        plain = PlainEncoder(path)
        probe = ["It", "éÀß", "word.", "naïve,", "To!!", "éa%,*", "ªµº", "x|", "A", "ÿþÐ", "ﬁ", "don't", "a1b22", "Ǆ", "é"]
        agrees = all(plain.ids(w) == np.array(plain.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in probe)
        return plain if agrees else Encoder(path)

    return A.loaded(f"words {path}", made)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """A page's blocks and the index of their starts."""
    if not len(ids):
        return b"", b""
    count = -(-len(ids) // BLOCK)
    table = np.full(count * BLOCK, ids[-1], np.uint32)
    table[: len(ids)] = ids
    table = table.reshape(count, BLOCK)
    least = table.min(1)
    table = table - least[:, None]
    chosen = np.partition(table, int(np.ceil(FITS * BLOCK)) - 1, axis=1)[:, int(np.ceil(FITS * BLOCK)) - 1]
    width = np.frexp(chosen.astype(np.float64))[1].astype(np.uint8)  # bits of the chosen value
    over = (table >> width[:, None].astype(np.uint32)) > 0
    over[width >= 32] = False
    exceptions = over.sum(1)
    size = 4 + 1 + 1 + width.astype(np.int64) * (BLOCK // 8) + exceptions * 5
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    # a block: least id (4 bytes), width, number of exceptions, packed differences, places, values
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = width, exceptions
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = ((table[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        out[(starts[rows] + 6)[:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    row, place = np.nonzero(over)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = starts[row] + 6 + width[row].astype(np.int64) * (BLOCK // 8)
    out[base + rank] = place
    out[(base + exceptions[row] + 4 * rank)[:, None] + np.arange(4)] = table[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype("<u4").tobytes()


def unpack(page: bytes, index: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The n ids of a page; with first and last, those of the blocks first to last only."""
    data, starts = np.frombuffer(page, np.uint8), np.frombuffer(index, "<u4").astype(np.int64)
    count = len(starts)
    starts = starts[first:last]
    if not len(starts):
        return np.zeros(0, np.uint32)
    least = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").ravel()
    width, exceptions = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    table = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = data[(starts[rows] + 6)[:, None] + np.arange(int(w) * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
        value = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(int(w)):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        table[rows] = value
    row = np.repeat(np.arange(len(starts)), exceptions)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = starts[row] + 6 + width[row] * (BLOCK // 8)
    table[row, data[base + rank]] = np.ascontiguousarray(data[(base + exceptions[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
    table += least[:, None]
    whole = table.ravel()
    return whole[: n - first * BLOCK] if last is None or last >= count else whole


PAGES = "part string, page int, n_ids long, docs array<long>, sizes array<long>, blocks binary, index binary"


def _pages(path: str, end_id: int):
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = encoder(path), str(TaskContext.get().partitionId())
        ended = np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        streams: list[bytes] = []
        held, page = 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(streams), "<u4")
            blocks, index = pack(ids)
            return pa.record_batch(
                [pa.array([part]), pa.array([page], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(s) // 4 for s in streams]], pa.list_(pa.int64())), pa.array([blocks], pa.binary()), pa.array([index], pa.binary())],
                ["part", "page", "n_ids", "docs", "sizes", "blocks", "index"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = words.ids(text.as_py() or "") + ended
                docs.append(doc_id)
                streams.append(stream)
                held += len(stream) // 4
                if held >= PAGE:
                    yield closed()
                    docs, streams, held, page = [], [], 0, page + 1
        if docs:
            yield closed()

    return pages


def write_pages(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END) -> None:
    """Writes the ids of every document of docs (doc_id, text), each followed by end_id, as pages in ascending order of doc_id."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered.mapInArrow(A.releasing(_pages(tokenizer, end_id), f"words {tokenizer}"), PAGES).write.option("compression", "uncompressed").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["blocks"], row["index"], row["n_ids"])
            ends = np.cumsum(row["sizes"])
            crc = [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(row["sizes"], ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.record_batch(
                [pa.array([row["part"]] * n), pa.array([row["page"]] * n, pa.int32()), pa.array(row["docs"], pa.int64()), pa.array(ends - row["sizes"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                ["part", "page", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_pages(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the pages alone; start counts the ids of all documents before."""
    pages = spark.read.schema(PAGES).parquet(path)
    sizes = pages.select("part", "page", "n_ids", F.get("docs", F.lit(0)).alias("first"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.min_by("first", "page").alias("first"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy(F.asc_nulls_first("first"), "part")) - F.col("ids")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("page")) - F.col("n_ids")
    starts = sizes.select("part", "page", inside.alias("page_start")).join(parts, "part").select("part", "page", (F.col("part_start") + F.col("page_start")).alias("start"))
    if sizes.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    docs = pages.mapInArrow(A.releasing(_documents), "part string, page int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "page"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_patched_blocks(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-pages")
    write_pages(read(spark, sf_dir, "documents"), path)
    return read_pages(spark, path)


QUERIES = {"op9_patched_blocks": op9_patched_blocks}
ORACLE_SQL: dict[str, str] = {}
