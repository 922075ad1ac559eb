"""Byte-level BPE by longest matches and backtracking.

A piece of text (one match of the splitting pattern) is UTF-8 bytes, read as Latin-1 characters, in
which an Aho-Corasick automaton finds all vocabulary entries. Tokens are laid from the left, the
longest first. Two tokens may stand side by side only if BPE would leave the boundary between them,
which is seen by undoing their merges, latest first, and is remembered for each pair. Where the longest does not fit, its
longest part from the left that is a token is next; where no token fits, the last one is shortened; a place from which no way leads on is never tried again, so the
work is linear in the piece. The result is the one exact merging gives.

Segments of text (a word and its leading space, as a rule) recur, so their ids are remembered: those of up to
SHORT characters, in two generations of up to REMEMBER each, of which the older one goes when the
younger is full. What recurs moves on to the younger one, so the memory holds frequent segments however
much text a process sees. A segment starts at a space before other than white space, where
the pattern always starts a match, so segments can be encoded one by one.

Nulls and odd rows: a null text is an empty text and has no ids. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from weir.llm import arrow_words as A
from weir.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
REMEMBER, SHORT = 100_000, 48
#: Pairs of tokens judged and remembered.
PAIRS = 250_000


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class BytePairs(dict):
    """Segment of text to the bytes of its ids, little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.vocabulary = [self.token.get(k, b"") for k in range(max(self.token) + 1)]
        self.split = regex.compile(pattern).findall
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}
        for rank in sorted(self.token):
            self._learn(rank)
        self.fits.clear()  # pairs judged while merges were missing
        self.size = list(map(len, self.vocabulary))
        self.shorter = [next((r for k in range(n - 1, 0, -1) if (r := self.rank.get(token[:k])) is not None), -1) for n, token in zip(self.size, self.vocabulary, strict=True)]
        self.shown = list(map(str, range(len(self.vocabulary))))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()

    def _learn(self, rank: int) -> None:
        """Finds the two tokens whose merge makes this one: the only cut that earlier merges leave open."""
        token = self.token[rank]
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.rank.get(token[:cut], rank), self.rank.get(token[cut:], rank)
            if left < rank and right < rank and self._fit(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the boundary between two tokens alone."""
        parts, merged = self.parts, self.merged
        before = len(self.vocabulary) + 1  # merges of lower rank than this came first
        while True:
            if merged.get((left, right), before) < before:
                return False
            if left > right and left in parts:
                before, left = left, parts[left][1]
            elif right in parts:
                # of equal merges the left one comes first
                before, right = right + 1, parts[right][0]
            elif left in parts:
                before, left = left, parts[left][1]
            else:
                return True

    def piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        raw = piece.encode()
        if (whole := self.rank.get(raw)) is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n  # the longest token from each place
        for end, (before, rank) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - before] = rank
        fits, size, shorter = self.fits, self.size, self.shorter
        ids: list[int] = []
        place, last, rank, dead = 0, -1, longest[0], bytearray(n + 1)
        while True:
            while rank >= 0:
                end = place + size[rank]
                if not dead[end]:
                    if last < 0:
                        break
                    pair = last << 32 | rank
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        fit = fits[pair] = self._fit(last, rank)
                    if fit:
                        break
                rank = shorter[rank]
            else:  # no token leads on from here: the last one is shortened
                dead[place] = 1
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes")
                last = ids.pop()
                place, rank = place - size[last], shorter[last]
                last = ids[-1] if ids else -1
                continue
            ids.append(rank)
            if end == n:
                return ids
            place, last, rank = end, rank, longest[end]

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = self.encoded(segment)
        if len(segment) <= SHORT:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encoded(self, segment: str) -> bytes:
        if segment[-1:] in (".", ",") and segment[1:-1].isalpha() and (segment[0] == " " or segment[0].isalpha()):
            return self[segment[:-1]] + self[segment[-1:]]  # letters, then a sign: two matches
        if segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()):
            return packed(self.piece(segment))  # letters: one match
        pieces = self.split(segment)
        if len(pieces) > 1:
            return b"".join(map(self.__getitem__, pieces))
        return b"".join(packed(self.piece(piece)) for piece in pieces)

    def encode(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        segments = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                segments.append(" " + part)
            else:
                segments[-1] += " " + part
        return np.frombuffer(b"".join(map(self.__getitem__, segments)), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def encoder(path: str = RANKS, pattern: str = PATTERN) -> BytePairs:
    """One for each process and vocabulary."""
    return A.loaded(f"bpe {path} {pattern}", lambda: BytePairs(path, pattern))


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            ids = [bpe.encode(text.as_py() or "").astype(np.int32) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(A.releasing(encode, f"bpe {path} {pattern}"), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text binary) of rows (doc_id, ids)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(A.releasing(decode, f"bpe {path} {PATTERN}"), "doc_id long, text binary")


def round_trips(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass."""

    def trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            counts, listed, back = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "").tolist()
                counts.append(len(ids))
                listed.append(hashlib.sha256(" ".join(map(bpe.shown.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(A.releasing(trips, f"bpe {path} {pattern}"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trips(read(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
