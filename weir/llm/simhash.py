"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint holds the majority of each bit over the hashes of its shingles. Equal
fingerprints form one class. Two classes link if at most BUDGET bits differ. Links are found in
tries: pairs of nodes are walked down together from a root, adding up differing bits, and a pair
is dropped as soon as its sum exceeds the budget.

To deal the work out, the 64 bits are cut into blocks, BUDGET + 1 of them or more where there are
more classes. Of any linked pair, all but BUDGET blocks agree, so each choice of so many blocks
makes a set of tries, rooted at the values of these blocks, and every link lies in one of them.
Each task walks the tries it is dealt, all at once level by level, and gives a spanning star for
each group it finds rather than all pairs, so a group of copies costs its size in output.
Components of the stars are then found across tasks.

Nulls and odd rows: a null or blank text has fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; rows with a null doc_id belong to components but never name
them (null where all are). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import cut, done, read, row_key
from weir.llm.components import components

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Node pairs walked at once, and leaves of a node pair under which they are compared directly.
FRONTIER = 1 << 18
LEAVES = 16
#: Expected classes in a trie above which the bits are cut into more blocks.
TRIE = 4096
#: Classes above which a trie is dealt again.
SPLIT = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    words = A.Words(_LOWER[data], offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(words):
        return out
    sizes = words.ends - words.starts
    places = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(places[-1] + sizes[-1]), 0x20, np.uint8)
    source = np.repeat(words.starts - places, sizes) + (at := np.repeat(places - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())))
    joined[at] = words.data[source]
    # shingles: SHINGLE words, or all the words of a shorter text
    length = np.minimum(words.counts, SHINGLE)
    n = np.where(words.counts, words.counts - length + 1, 0)
    full = np.flatnonzero(n)
    first = np.cumsum(n) - n
    start = np.repeat(words.first[:-1] - first, n) + np.arange(int(n.sum()))
    last = start + np.repeat(length, n) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(places[start].tolist(), (places[last] + sizes[last]).tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel()
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprints(data, offsets) for _, _, data, offsets in A.pieces(batch.column(2))]
        yield pa.record_batch([batch.column(0), batch.column(1), np.concatenate(found).view(np.int64) if found else pa.array([], pa.int64())], ["doc_id", "key", "fingerprint"])


class Groups:
    """Which of n items are known to be linked: label is the least member of an item's group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
                while (self.label != (up := self.label[self.label])).any():
                    self.label = up

    def whole(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether all of the items lo to hi and lo2 to hi2 are linked already."""
        changes = np.zeros(len(self.label) + 1, np.int64)
        np.cumsum(self.label[1:] != self.label[:-1], out=changes[1:-1])
        return (changes[hi - 1] == changes[lo]) & (changes[hi2 - 1] == changes[lo2]) & (self.label[lo] == self.label[lo2])


def _compare(f: np.ndarray, pairs: np.ndarray, groups: Groups, budget: int) -> None:
    """All leaves under node pairs, few for each."""
    alo, ahi, blo, bhi = pairs[:4]
    n = (ahi - alo) * (bhi - blo)
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    width = (bhi - blo)[which]
    i, j = alo[which] + at // width, blo[which] + at % width
    near = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= budget)
    groups.link(i[near], j[near])


def trie_links(f: np.ndarray, roots: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of the fingerprints f the index of the least one of its group. roots are the starts of tries; each trie's values are sorted and distinct."""
    groups = Groups(len(f))
    ends = np.append(roots[1:], len(f))
    keep = ends - roots > 1
    lo, hi = roots[keep], ends[keep]
    # a node is a run of f; a node pair is lo, hi, lo, hi, differing bits so far, bits walked
    stack = [np.array([lo, hi, lo, hi, 0 * lo, 0 * lo])]
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [pairs[:, FRONTIER:], pairs[:, :FRONTIER]]
            continue
        pairs = pairs[:, ~groups.whole(*pairs[:4])]
        few = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAVES) | (pairs[5] == 64)
        if few.any():
            _compare(f, pairs[:, few], groups, budget)
            pairs = pairs[:, ~few]
        if not pairs.shape[1]:
            continue
        alo, ahi, blo, bhi, bits, depth = pairs
        a, b = (_split(f, lo, hi, depth) for lo, hi in ((alo, ahi), (blo, bhi)))
        same = alo == blo
        children = [[alo, a, blo, b, bits, depth + 1], [a, ahi, b, bhi, bits, depth + 1], [alo, a, b, bhi, bits + 1, depth + 1]]
        children.append([x[~same] for x in (a, ahi, blo, b, bits + 1, depth + 1)])
        below = np.concatenate([np.array(c) for c in children], axis=1)
        alone = (below[0] == below[2]) & (below[1] - below[0] == 1)
        stack.append(below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget) & ~alone])
    return groups.label


def _split(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the bit at depth turns to one in sorted f[lo:hi], by bisection of all nodes at once."""
    shift = (63 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        one = ((f[np.minimum(middle, len(f) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, middle, hi)
        lo = np.where(open_ & ~one, middle + 1, lo)
    return lo


def _stars(budget: int):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (choice, root, fingerprint); whole tries of the rows at hand are walked together."""

        def walked(choice: np.ndarray, root: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            roots = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (root[1:] != root[:-1])))
            sizes = np.diff(np.append(roots, len(f)))
            kept = np.repeat(sizes > 1, sizes)
            f, sizes = f[kept], sizes[sizes > 1]
            if not len(f):
                return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
            order = np.lexsort((f, np.repeat(np.arange(len(sizes)), sizes)))  # by value as unsigned numbers
            f = f[order]
            label = trie_links(f, np.cumsum(sizes) - sizes, budget)
            linked = label != np.arange(len(f))
            return pa.record_batch([f[linked].view(np.int64), f[label[linked]].view(np.int64)], ["a", "b"])

        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            other = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # where the last row's trie begins in this batch
            if parts and (at or (parts[-1][0][-1], parts[-1][1][-1]) != (new[0][0], new[1][0])):
                yield walked(*(np.concatenate(x) for x in zip(*parts, [x[:at] for x in new], strict=True)))
                parts = []
            elif at:
                yield walked(*(x[:at] for x in new))
            parts.append([x[at:] for x in new])
        if parts:
            yield walked(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return stars


def choices(n: int, budget: int = BUDGET) -> list[int]:
    """Masks of the bits that agree: for n random fingerprints each mask leaves about TRIE to a trie, or less."""
    blocks = budget + 1
    while blocks < 64 and n / 2 ** (64 * (blocks - budget) // blocks) > TRIE and blocks < budget + 4:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    return [sum(c) for c in combinations(each, blocks - budget)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(mask: int, n: int) -> list[int]:
    """The bits of a mask cut into n masks of successive ones."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def dealt(classes: DataFrame, budget: int) -> DataFrame:
    """(choice, root, fingerprint): the tries, each class in one for each choice.

    A trie of more than SPLIT classes is dealt again: its other bits are cut into BUDGET + 1 blocks, of which linked
    pairs agree in one at least. What is left of it has so few free bits that classes within the budget of each other are few.
    """
    masks = choices(classes.count(), budget)

    def under(masks: list[int], first: int):
        return F.explode(F.array(*[F.struct(F.lit(first + k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("root")) for k, m in enumerate(masks)])).alias("r")

    tries = classes.select(under(masks, 0), "fingerprint").select("r.choice", "r.root", "fingerprint")
    large = cut(tries.groupBy("choice", "root").count().filter(F.col("count") > SPLIT).select("choice", "root"), "simhash-large")
    if not large.count():
        done(large)
        return tries
    again = tries.join(large, ["choice", "root"])
    wholes = [m | p for m in masks for p in _parts(~m & ((1 << 64) - 1), budget + 1)]
    each = F.array(*[F.lit(_signed(m)) for m in wholes])
    finer = again.withColumn("k", F.explode(F.sequence(F.col("choice") * (budget + 1), F.col("choice") * (budget + 1) + budget)))
    finer = finer.select((F.lit(len(masks)) + F.col("k")).alias("choice"), F.col("fingerprint").bitwiseAND(F.element_at(each, F.col("k") + 1)).alias("root"), "fingerprint")
    return tries.join(large, ["choice", "root"], "left_anti").unionAll(finer)


def trie_stars(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): stars of linked fingerprints, spanning each group that a task finds. classes (fingerprint) should be a written table."""
    tries = dealt(classes, budget).repartition("choice", "root").sortWithinPartitions("choice", "root")
    return tries.mapInArrow(A.releasing(_stars(budget)), "a long, b long")


def _near(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, key, fingerprint, first) for every row of docs: first is the doc_id and key of the first row of its component."""
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    prints = cut(rows.mapInArrow(A.releasing(_fingerprinted), "doc_id long, key int, fingerprint long"), "simhash")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    classes = cut(prints.groupBy("fingerprint").agg(F.min(row).alias("least_row")), "simhash-classes")
    stars = components(trie_stars(classes.select("fingerprint"), budget))
    named = classes.join(stars, classes["fingerprint"] == stars["node"], "left").select("fingerprint", "least_row", F.coalesce("least", "fingerprint").alias("group"))
    names = named.groupBy("group").agg(F.min("least_row").alias("first"))
    return prints.join(named.join(names, "group").select("fingerprint", "first"), "fingerprint").select("doc_id", "key", "fingerprint", "first")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of docs (doc_id, text)."""
    return _near(docs, budget).select("doc_id", "fingerprint", F.col("first.doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that found (doc_id, key, first) names as the first of their component, once each, and those with a null doc_id."""
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    stay = cut(found.filter(first).groupBy(F.col("doc_id").alias("_weir_id"), F.col("key").alias("_weir_text")).agg(F.count("*").alias("_weir_n")), "near-dedup-stay")

    def kept(stay: DataFrame) -> DataFrame:
        rows = docs.withColumn("_weir_key", row_key())
        return rows.join(stay, (rows["doc_id"] == stay["_weir_id"]) & (rows["_weir_key"] == stay["_weir_text"]), "left_semi")

    out = kept(stay.filter("_weir_n = 1")).drop("_weir_key")
    repeated = stay.filter("_weir_n > 1")
    if repeated.limit(1).count():  # rows alike in doc_id and text
        place = F.row_number().over(Window.partitionBy("doc_id", "_weir_key").orderBy(F.lit(0)))
        out = out.unionByName(kept(repeated).withColumn("_weir_row", place).filter("_weir_row = 1").drop("_weir_row", "_weir_key"))
    return out.unionByName(docs.filter("doc_id is null"))


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of docs, all columns, less near-duplicates: of each component the row of least doc_id stays, once (of rows with one doc_id, one of them).

    Rows with a null doc_id all stay, as nothing tells them apart.
    """
    return first_of_each(docs, _near(docs, budget))


def op6_simhash_tries(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_tries": op6_simhash_tries}
ORACLE_SQL: dict[str, str] = {}
