"""Near-duplicates by an exact self-join of shingle sets.

A document is the set of its SHINGLE-word shingles, in lower case (ASCII). Two documents link if the
Jaccard similarity of their sets is 0.8 or more (NUM / DEN); components of the links are found.
No link is missed: the similarity is computed on the whole sets, and candidates come from a filter
that every linked pair passes.

The filter: sets similar enough differ in at most a ninth of their sizes' sum. Sizes are cut into levels so that
linked sets are of one level or of successive ones, and a set takes part in its own level and the next. A level cuts the
hashes into some more classes than its sets may differ in, so linked sets agree on some classes: one signature for each
class a set has shingles in, and linked sets share a signature unless the classes they agree on are all empty. For that
a set must have as many empty classes as the level has to spare; those that have so many also send
single shingles, the first n - ceil(0.8 n) + 1 in one order for all (those frequent in a sample last), of which linked sets have one in common. A signature stands for some three
shingles, so sets that are not alike hardly ever share one, however long or many they are.

Equal sets form one class before that, and only classes are compared. Each set is compared with the first under its
signature, so a group of copies is linked at a cost of its size. Then all pairs under a signature that are not in one component
yet are looked at where they meet: sizes and a sketch of each set, the numbers of its shingles in each of
SKETCH classes by their hash, bound how many can be common. Pairs that this leaves are looked at by a sketch as wide as
their sets, and whole sets are sent for what remains.

With a budget, op6's tries come first: documents whose fingerprints differ in at most so many bits are linked as well, and
what the tries have linked is not compared again.

Shingles are compared by 64-bit hashes.

Nulls and odd rows: a null or blank text has the empty set, equal to any other such; fewer words than a
shingle make one shingle; rows with a null doc_id are not compared; rows with one doc_id are told apart by their texts. Texts may have any length. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import arrow_words as A
from weir.llm.common import cut, done, free, row_key
from weir.llm.components import components
from weir.llm.simhash import _LOWER, BUDGET, fingerprints, first_of_each, trie_stars

SHINGLE = 5
#: Least similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: About so many documents are looked at for frequent shingles, those in SEEN of them or more; results do not depend on it.
SAMPLE, SEEN = 16_384, 3
#: Counters of a sketch, and the count from which they stand for any.
SKETCH, ANY = 64, 255
#: Pairs whose sketches are compared at once.
AT_ONCE = 1 << 16


def _levels() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least size of each level, in how many shingles its sets may differ, and its number of classes. Smaller sets link to equal ones only."""
    edges = [DEN - 1, DEN]
    while edges[-1] < 1 << 31:
        edges.append((edges[-1] - 1) * DEN // NUM + 1)
    differ = [2 * (top - 1) * (DEN - NUM) // (NUM + DEN) for top in edges[1:]]
    return np.array(edges[:-1]), np.array(differ), np.array([d + 2 + d // 6 for d in differ])


LEAST, DIFFER, CLASSES = _levels()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and how many each text has."""
    words = A.Words(_LOWER[data], offsets)
    length = np.minimum(words.counts, size)
    n = np.where(words.counts, words.counts - length + 1, 0)
    if not len(words):
        return np.zeros(0, np.uint64), n
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    runs, each = A.Runs(words.hashes()), length[text]
    h = np.zeros(len(start), np.uint64)
    for k in np.unique(each).tolist():
        h[each == k] = runs.of(k)[start[each == k]]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
    return h[new], np.bincount(text[new], minlength=len(n))


def sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The sketch of each of some sets."""
    text = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(text * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), minlength=len(n) * SKETCH)
    raw = np.minimum(counts, ANY).astype(np.uint8).tobytes()
    return [raw[k * SKETCH : (k + 1) * SKETCH] for k in range(len(n))]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in A.pieces(batch.column(2)):
            h, n = shingle_sets(data, offsets)
            own = batch.slice(row, end - row)
            yield pa.record_batch([own.column(0), own.column(1), A.set_hashes(h, n).view(np.int64), n.astype(np.int32), pa.array(sketches(h, n), pa.binary())], ["doc_id", "key", "node", "n", "sketch"])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _keyed, with the fingerprint of each text."""
    for batch in batches:
        for row, end, data, offsets in A.pieces(batch.column(2)):
            for keyed in _keyed(iter([batch.slice(row, end - row)])):
                yield pa.record_batch([*keyed.columns, fingerprints(data, offsets).view(np.int64)], [*keyed.schema.names, "fingerprint"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in A.pieces(batch.column(0)):
            yield pa.record_batch([shingle_sets(data, offsets)[0].view(np.int64)], ["hash"])


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in SEEN or more of about SAMPLE documents, sorted, and in how many; at most the sample's shingles over SEEN."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    rows = sample.mapInArrow(_shingles, "hash long").groupBy("hash").count().filter(F.col("count") >= SEEN).toArrow()
    hashes, times = rows.column("hash").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def singles(h: np.ndarray, n: np.ndarray, level: np.ndarray, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that sets of these levels send one by one, and the set of each."""
    text = np.repeat(np.arange(len(n)), n)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        h = h[np.lexsort((h, np.where(often[at] == h, times[at], 0), text))]
    kept = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < (n - (NUM * n + DEN - 1) // DEN + 1)[text]
    h, text = h[kept], text[kept]
    return A.mixed(A.mixed(h ^ np.uint64(A.SEED_A)) ^ A.mixed(level[text].astype(np.uint64) + np.uint64(A.SEED_B))), text


def signatures(h: np.ndarray, n: np.ndarray, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some sets, whose hashes are sorted within each, and the set of each signature."""
    text = np.repeat(np.arange(len(n)), n)
    item = A.mixed(h ^ np.uint64(A.SEED_A))
    own = np.searchsorted(LEAST, n, "right") - 1
    found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        level = np.maximum(own + up, 0)
        sent = (own >= 0) & (DEN * n >= NUM * LEAST[level])
        some = np.flatnonzero(sent[text])
        if not len(some):
            continue
        t = text[some]
        c = ((h[some] >> np.uint64(32)) * CLASSES[level].astype(np.uint64)[t]) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])))
        owner = t[starts]
        found.append(A.mixed(np.add.reduceat(item[some], starts) + A.mixed(c[starts] + np.uint64(1) + (level[owner].astype(np.uint64) << np.uint64(40)))))
        of.append(owner)
        bare = np.flatnonzero(sent & (CLASSES[level] - np.bincount(owner, minlength=len(n)) >= CLASSES[level] - DIFFER[level]))
        if len(bare):
            one, owner = singles(h[np.isin(text, bare)], n[bare], level[bare], often, times)
            found.append(one)
            of.append(bare[owner])
    return np.concatenate(found), np.concatenate(of)


def _signed(often: np.ndarray, times: np.ndarray):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set's signatures, once in a task: copies do not pile up under theirs."""
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in A.pieces(batch.column(0)):
                h, n = shingle_sets(data, offsets)
                node = A.set_hashes(h, n)
                new = np.zeros(len(n), bool)
                for k, x in enumerate(node.tolist()):
                    if x not in done:
                        done.add(x)
                        new[k] = True
                h, node, n = h[np.repeat(new, n)], node[new], n[new]
                found, of = signatures(h, n, often, times)
                yield pa.record_batch([found.view(np.int64), node[of].view(np.int64), n[of].astype(np.int32)], ["hash", "node", "n"])

    return signed


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first, cut where it changes."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        done = int(np.searchsorted(new[0], new[0][-1]))
        if done or (parts and parts[-1][0][-1] != new[0][0]):
            head = [*parts, [x[:done] for x in new]]
            yield [np.concatenate(x) for x in zip(*head, strict=True)]
            parts = []
        parts.append([x[done:] for x in new])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def may_link(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar enough."""
    return NUM * np.maximum(n, m).astype(np.int64) <= DEN * np.minimum(n, m).astype(np.int64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, node) whose hash has two nodes or more, each with the first of them, or the one before it, where they may link."""
    for h, node, n in whole_runs(batches):
        copy = np.append(False, (h[1:] == h[:-1]) & (node[1:] == node[:-1]))
        h, node, n = (x[~copy] for x in (h, node, n))
        follows = np.append(False, h[1:] == h[:-1])
        kept = follows | np.append(follows[1:], False)
        first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(h))))
        to = np.where(may_link(n, n[first]), first, np.maximum(np.arange(len(h)) - 1, 0))
        near = follows & may_link(n, n[to])
        yield pa.record_batch([h[kept], node[kept], n[kept], pa.array(node[to][kept], mask=~near[kept])], ["hash", "node", "n", "before"])


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash whose hash has two components or more."""
    for h, node, n, group in whole_runs(batches):
        runs = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        own = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(h))))
        kept = (np.bincount(own, group != group[runs][own]) > 0)[own]
        yield pa.record_batch([h[kept], node[kept], n[kept], group[kept]], ["hash", "node", "n", "group"])


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with sketches x and y can be similar enough."""
    least = np.minimum(x, y)
    return ((NUM + DEN) * least.sum(1, dtype=np.int64) >= NUM * (n.astype(np.int64) + m)) | (least == ANY).any(1)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (hash, n): pairs under one hash that are in two components and may link."""
    for h, n, node, group, sketch in whole_runs(batches):
        bits = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH)
        at, step = np.arange(len(h)), 1
        while len(at := at[at + step < len(h)]):
            to = at + step
            at = at[(h[to] == h[at]) & (NUM * n[to] <= DEN * n[at])]
            to = at + step
            found = at[group[at] != group[to]]
            for k in range(0, len(found), AT_ONCE):
                i = found[k : k + AT_ONCE]
                i = i[possible(bits[i], bits[i + step], n[i], n[i + step])]
                if len(i):
                    a, b = node[i], node[i + step]
                    yield pa.record_batch([np.minimum(a, b), np.maximum(a, b)], ["a", "b"])
            step += 1


def wide_sketch(h: np.ndarray) -> bytes:
    """A sketch of one set with a counter for some two shingles; their number is a power of two, so neighbouring sizes can be folded."""
    size = 1 << max(len(h) // 2, 1).bit_length()
    return np.minimum(np.bincount((h % np.uint64(size)).astype(np.int64), minlength=size), ANY).astype(np.uint8).tobytes()


def wide_possible(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these wide sketches can be similar enough."""
    if (x == ANY).any() or (y == ANY).any():
        return True
    size = min(len(x), len(y))
    x, y = (z.reshape(-1, size).sum(0, dtype=np.int64) for z in (x, y))
    return (NUM + DEN) * int(np.minimum(x, y).sum()) >= NUM * (n + m)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in A.pieces(batch.column(0)):
            h, n = shingle_sets(data, offsets)
            ends = np.append(0, np.cumsum(n)) * 8
            raw = h.tobytes()
            items = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            wide = [wide_sketch(h[a // 8 : b // 8]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([A.set_hashes(h, n).view(np.int64), n.astype(np.int32), pa.array(wide, pa.binary()), pa.array(items, pa.binary())], ["node", "n", "wide", "items"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, m, sketch, sketch) whose sketches allow the similarity."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (4, 5))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(possible(x, y, n, m)))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, m, wide sketch, wide sketch) whose wide sketches allow the similarity."""
    for batch in batches:
        n, m = (batch.column(k).to_pylist() for k in (2, 3))
        x, y = ([np.frombuffer(z.as_buffer(), np.uint8) for z in batch.column(k)] for k in (4, 5))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(list(map(wide_possible, x, y, n, m)), pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _near(docs: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, key, first) for every row of docs (doc_id, text) with a doc_id: key of the row, doc_id and key of the first row of its component; written.

    With a budget, documents whose fingerprints differ in at most so many bits are linked too.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    spark = docs.sparkSession
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    columns = "doc_id long, key int, node long, n int, sketch binary"
    keyed = cut(rows.mapInArrow(A.releasing(_keyed), columns) if budget is None else rows.mapInArrow(A.releasing(_printed), columns + ", fingerprint long"), "shingle-nodes")
    classes = cut(keyed.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("least_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "shingle-classes")
    shared = cut(docs.select("text").mapInArrow(A.releasing(_signed(*_frequent(docs))), "hash long, node long, n int").repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(A.releasing(_shared), "hash long, node long, n int, before long"), "shingle-shared")
    free(spark)

    def printed() -> DataFrame:
        """Links of the tries, between a node of each fingerprint, and of such a node with the others of its fingerprint."""
        prints = cut(keyed.groupBy("fingerprint").agg(F.min("node").alias("least")), "shingle-prints")
        stars = trie_stars(prints.select("fingerprint"), budget)
        stars = stars.join(prints.selectExpr("fingerprint a", "least x"), "a").join(prints.selectExpr("fingerprint b", "least y"), "b").selectExpr("x a", "y b")
        own = keyed.join(prints, "fingerprint").filter("node != least").selectExpr("node a", "least b")
        links = cut(stars.unionAll(own).distinct(), "shingle-tries")
        done(prints)
        return links

    def sketched(pairs: DataFrame) -> DataFrame:
        a, b = classes.selectExpr("node a", "n", "sketch s"), classes.selectExpr("node b", "n m", "sketch t")
        return pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(A.releasing(_possible), "a long, b long")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "shingle-pairs")
        free(spark)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # other texts that have the doc_id of one needed do no harm
        needed = docs.join(classes.join(nodes, "node").select(F.col("least_row.doc_id").alias("doc_id")), "doc_id", "left_semi")
        sets = cut(needed.select("text").mapInArrow(A.releasing(_sets), "node long, n int, wide binary, items binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
        free(spark)
        a, b = sets.selectExpr("node a", "n", "wide x"), sets.selectExpr("node b", "n m", "wide y")
        close = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(A.releasing(_wide), "a long, b long")
        a, b = sets.selectExpr("node a", "items x"), sets.selectExpr("node b", "items y")
        links = cut(close.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(A.releasing(_linked), "a long, b long"), "shingle-links")
        done(pairs, sets)
        return links

    links = linked(sketched(shared.filter("before is not null").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))))
    tables = [links] if budget is None else [links, printed()]
    found = reduce(DataFrame.unionAll, tables)
    groups = components(found)
    rows = shared.join(groups, "node", "left").select("hash", "node", "n", F.coalesce("least", "node").alias("group")).repartition("hash").sortWithinPartitions("hash")
    divided = cut(rows.mapInArrow(A.releasing(_divided), "hash long, node long, n int, group long"), "shingle-divided")
    done(shared, groups)
    rows = divided.join(classes.select("node", "sketch"), "node").select("hash", "n", "node", "group", "sketch")
    rest = linked(rows.repartition("hash").sortWithinPartitions("hash", "n").mapInArrow(A.releasing(_apart), "a long, b long").distinct())
    done(divided)
    groups = components(found.unionAll(rest))
    named = classes.join(groups, "node", "left").select("node", "least_row", F.coalesce("least", "node").alias("group"))
    names = named.groupBy("group").agg(F.min("least_row").alias("first"))
    found = cut(keyed.select("doc_id", "key", "node").join(named.join(names, "group").select("node", "first"), "node").select("doc_id", "key", "first"), "shingle-found")
    done(keyed, classes, *tables, rest, groups)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text) with a doc_id."""
    return _near(docs).select("doc_id", F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of docs, all columns, less near-duplicates: of each component the row of least doc_id stays, once (of rows with one doc_id, one of them).

    Near-duplicates are what op6's tries link and what the exact join links. Rows with a null doc_id all stay, as nothing tells them apart.
    """
    return first_of_each(docs, _near(docs, budget))
