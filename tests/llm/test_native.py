"""Mixing, fingerprints, sharding and host rules."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import SMALL, oracle, same
from tests.llm.corpus import clashing, frame, made, words
from weir.llm import common, host_rules, mixing, sharding, syncmers


@pytest.mark.parametrize("module", [mixing, host_rules])
def test_query_equals_its_sql(spark, module):
    for name, query in module.QUERIES.items():
        same(query(spark, SMALL), oracle(module.ORACLE_SQL[name]))


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_native_operators_run_no_python(spark):
    docs = frame(spark)
    for df in (mixing.mix(docs), mixing.mixed(docs), sharding.hilbert_shards(docs), syncmers.with_next(docs, ["text"])):
        assert no_python(df)


def test_mixing(spark):
    rows = made()
    got = mixing.mix(clashing(frame(spark))).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * total[s]
            left -= want[s]
            open_.remove(s)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 15), s
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    copies = Counter(r.doc_id for r in mixing.mixed(clashing(frame(spark))).select("doc_id").collect())
    assert copies == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_of_nothing_and_of_equal_rows(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    same_rows = [(1, "a b c", "en", "s", 5)] * 4 + [(2, None, "en", "t", 0)]
    got = mixing.mix(frame(spark, same_rows)).collect()
    assert len({(r.doc_id, r.taken) for r in got}) == 2


def test_a_lookup_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    few = sorted(map(tuple, mixing.mix(frame(spark)).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(frame(spark)).collect()), key=repr) == few


def test_the_curve_visits_neighbours():
    order = sorted(range(4096), key=sharding.curve().__getitem__)
    assert sorted(sharding.curve()) == list(range(4096))
    for a, b in zip(order, order[1:], strict=False):
        assert sum(abs(a // 8**d % 8 - b // 8**d % 8) for d in range(4)) == 1


def test_sharding(spark):
    rows = made()
    got = sharding.hilbert_shards(clashing(frame(spark))).collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    shards = defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        shards[r.shard].append((r.slot, r.curve))
    counts = [len(shards[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    run = []
    for k in range(8):
        assert sorted(s for s, _ in shards[k]) == list(range(counts[k]))
        run += [c for _, c in sorted(shards[k])]
    assert run == sorted(run)
    assert sharding.hilbert_shards(frame(spark, [])).collect() == []
    equal = sharding.hilbert_shards(frame(spark, [(None, None, None, None, None)] * 9)).collect()
    assert Counter(r.shard for r in equal) == Counter({0: 2, **dict.fromkeys(range(1, 8), 1)})
    assert len(sharding.hilbert_shards(frame(spark, made()[:5])).collect()) == 5


@pytest.mark.parametrize("ids", [[-(2**62), 2**62], [0, 2**61, 5], [-(2**63), 2**63 - 1, None, None, 1], [None] * 6])
def test_sharding_of_wide_and_null_ids(spark, ids):
    table = [(i, f"t {k}", "en", None, 1) for k, i in enumerate(ids)] * 3
    got = sharding.hilbert_shards(frame(spark, table)).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(table) and max(counts.values()) - min(counts[k] for k in range(8)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(counts[k])) for k in range(8))


def test_sharding_of_more_values_than_are_broadcast(spark, monkeypatch):
    few = {r.doc_id: (r.shard, r.slot) for r in sharding.hilbert_shards(frame(spark)).collect()}
    for module in (sharding, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.hilbert_shards(frame(spark)).collect()} == few


def test_one_bad_host_among_many_is_rejected(spark):
    good, bad = "\n".join(" ".join(f"w{j}x{k}" for j in range(20)) for k in range(4)), "a b"
    rows = [(100 * h + k, f"{good} {h} {k}" if k >= (9 if h == 3 else 1) else bad, "en", f"h{h}", 0) for h in range(12) for k in range(12)]
    got = host_rules.host_rules(frame(spark, rows)).collect()
    assert {r.host for r in got if not r.host_kept} == {"h3"}
    assert all(r.kept == (not r.base_failed and r.host != "h3") for r in got)
    even = [(100 * h + k, bad if k < 3 else f"{good} {h} {k}", "en", f"h{h}", 0) for h in range(12) for k in range(12)]
    assert all(r.host_kept for r in host_rules.host_rules(frame(spark, even)).collect())


def test_duplicate_lines_are_counted_by_line(spark):
    line = " ".join(f"w{k}" for k in range(30))
    row = host_rules.measured(frame(spark, [(1, "\n".join([line, line, "", line]), "en", "h", 0)])).withColumn("fails", host_rules.fails_a_rule()).first()
    assert (row.n_lines, row.n_dup_lines, row.fails) == (3, 2, True)


def test_sharding_in_sql_order(spark):
    """The cell of every document, by a plain reading of the quantisation."""
    rows = made()
    got = {r.doc_id: r.curve for r in sharding.hilbert_shards(frame(spark)).collect()}
    n = len(rows)

    def bins(values):
        count, before, out = Counter(values), 0, {}
        for v in sorted(count, key=lambda v: (v is None, (v or "").encode())):
            out[v] = before * 8 // n
            before += count[v]
        return out

    by_source, by_lang = bins([r[3] for r in rows]), bins([r[2] for r in rows])
    ids = sorted(r[0] for r in rows)
    edges = [ids[math.ceil(k / 8 * n) - 1] for k in range(1, 8)]
    for r in rows:
        size = len((r[1] or "").encode()) + 1
        point = (by_source[r[3]], by_lang[r[2]], min(max(size.bit_length() - 7, 0), 7), sum(r[0] > e for e in edges))
        assert got[r[0]] == sharding.hilbert_index(point)


@pytest.mark.parametrize("k, s", [(3, 1), (5, 2), (4, 4)])
def test_syncmers_are_the_windows_with_the_least_piece_at_an_edge(spark, k, s):
    texts = [(r[0], r[1]) for r in made(12)]
    df = syncmers.syncmers(spark.createDataFrame(texts, "doc_id long, text string"), "text", "anchors", k, s)
    assert no_python(df)
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for _, t in texts for w in words(t)}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {tuple(r.p): r.h for r in spark.createDataFrame([([hashes[a] for a in p],) for p in {tuple(words(t)[i : i + s]) for _, t in texts for i in range(len(words(t)) - s + 1)}], "p array<long>").select("p", F.xxhash64(*[F.col("p")[j] for j in range(s)]).alias("h")).collect()}
    for r in df.collect():
        w = words(dict(texts)[r.doc_id])
        if len(w) < k:
            assert len(r.anchors) == (1 if w else 0)
            continue
        piece = [pairs[tuple(hashes[x] for x in w[i : i + s])] if s > 1 else hashes[w[i]] for i in range(len(w) - s + 1)]
        want = [i for i in range(len(w) - k + 1) if min(piece[i], piece[i + k - s]) <= min(piece[i : i + k - s + 1])]
        assert [a["at"] for a in r.anchors] == want


def test_fingerprints(spark, tmp_path):
    rows = made()
    clashing(frame(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    syncmers.ROWS_PER_RANGE, before = 16, syncmers.ROWS_PER_RANGE
    try:
        df = syncmers.op2_syncmer_fingerprints(spark, str(tmp_path))
        got = {r.doc_id: r for r in df.collect()}
    finally:
        syncmers.ROWS_PER_RANGE = before
    assert no_python(df) and len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    order = sorted(text, reverse=True)
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].edited_fingerprint == got[i].fingerprint and got[i].near_edited == 1
    assert got[1000].fingerprint == got[9].fingerprint and got[1003].near_edited == 1.0
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_likeness_estimates_the_share_of_common_syncmers(spark):
    base = " ".join(f"w{k}" for k in range(4000))
    for share in (0.2, 0.5, 0.8):
        n = int(4000 * share)
        other = " ".join([f"w{k}" for k in range(n)] + [f"v{k}" for k in range(4000 - n)])
        df = spark.createDataFrame([(base, other)], "a string, b string")
        df = syncmers.syncmers(syncmers.syncmers(df, "a", "x"), "b", "y")
        near = df.select(syncmers.likeness(syncmers.fingerprint(F.col("x")), syncmers.fingerprint(F.col("y")))).first()[0]
        assert abs(near - share / (2 - share)) < 0.2


def test_short_shared_passages_of_long_texts_count(spark, tmp_path):
    """Likeness of whole anchor sets, and a passage of 30 words found by place, in texts of 6000 words."""
    shared = [f"s{k}" for k in range(30)]
    a = [f"a{k}" for k in range(6000)]
    b = [f"b{k}" for k in range(3000)] + shared + [f"b{k}" for k in range(3000, 6000)]
    a[1000:1000] = shared
    frame(spark, [(1, " ".join(a), "en", "s", 0), (2, " ".join(b), "en", "s", 0), (3, "", "en", "s", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.createDataFrame([(7, " ".join(a), " ".join(b))], "pair long, a string, b string")
    df = syncmers.syncmers(syncmers.syncmers(df, "a", "x"), "b", "y")
    row = df.first()
    x, y = {r["hash"] for r in row.x}, {r["hash"] for r in row.y}
    got = {r.doc_id: r for r in syncmers.op2_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    assert len(x & y) > 10 and got[2].near_next == pytest.approx(len(x & y) / len(x | y)) and got[1].near_next == 0.0
    found = syncmers.passages(df, "pair", "x", "y")
    assert no_python(found)
    (one,) = found.collect()
    assert one.pair == 7 and one.b_start - one.a_start == 2000 and 1000 <= one.a_start <= 1002 and 1028 <= one.a_start + one.n_words <= 1030
    same = syncmers.passages(df.select("pair", "x"), "pair", "x", "x").collect()
    assert [(r.a_start, r.b_start) for r in same] == [(same[0].a_start,) * 2] and same[0].n_words >= 6026


def test_next_rows_with_ties_and_nulls(spark):
    rows = [(None, "n1", "", "", 0), (None, "n2", "", "", 0), (5, "a", "", "", 0), (5, "a", "", "", 0), (9, "z", "", "", 0)]
    got = syncmers.with_next(frame(spark, rows).select("doc_id", "text"), ["text"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    assert sorted(r.next_text for r in got) == sorted(r[1] for r in rows)
    assert syncmers.with_next(frame(spark, []).select("doc_id", "text"), ["text"]).collect() == []
    assert syncmers.with_next(frame(spark, rows[4:]).select("doc_id", "text"), ["text"]).first().next_text == "z"


def test_host_rules(spark):
    rows = made()
    df = host_rules.host_rules(clashing(frame(spark)))
    assert no_python(df)
    got = {r.doc_id: r for r in df.collect()}
    for i, t, *_ in rows:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        repeats = len({k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(3)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), repeats, len(lines) - len(set(lines))), i
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.base_failed == (len(w) < 50 or 100 * repeats > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert host_rules.host_rules(frame(spark, [])).collect() == []


def test_a_bad_host_goes_and_a_small_one_is_given_the_benefit(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, "bad", "en", "bad", 0) for k in range(90)] + [(100 + k, good, "en", "bad", 0) for k in range(10)]
    rows += [(1000 * h + k, good if k % 10 else "short", "en", f"h{h}", 0) for h in range(1, 30) for k in range(40)] + [(99_000, "short", "en", "tiny", 0), (99_001, good, "en", "tiny", 0)]
    got = {r.doc_id: r.kept for r in host_rules.host_rules(frame(spark, rows)).collect()}
    assert not any(got[100 + k] for k in range(10)) and got[99_001] and all(got[1000 * h + 1] for h in range(1, 30))


