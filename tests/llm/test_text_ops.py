"""Line and substring dedup, SimHash, toxicity, token files, byte-level BPE and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.helpers import SMALL, oracle, same
from tests.llm.corpus import clashing, frame, made, words
from weir.llm import arrow_words, byte_bpe, line_dedup, repeats, shingle_join, simhash, substring_dedup, token_files, toxicity
from weir.llm.components import components


@pytest.mark.parametrize("module", [line_dedup, substring_dedup])
def test_query_equals_its_sql(spark, module):
    for name, query in module.QUERIES.items():
        same(query(spark, SMALL), oracle(module.ORACLE_SQL[name]))


def test_words_of_buffers():
    rng = random.Random(1)
    texts = [None, "", " \t", "a", " a\tb\n\nc ", "é à b", "x" * 90] + ["".join(rng.choice("ab \n\x0b\x1cé") for _ in range(30)) for _ in range(200)]
    seen = {}
    for a, b, data, offsets in arrow_words.pieces(pa.array(texts, pa.string()).slice(0), 40):
        w = arrow_words.Words(data, offsets)
        h = w.hashes()
        for k in range(a, b):
            mine = range(w.first[k - a], w.first[k - a + 1])
            assert [bytes(data[w.starts[i] : w.ends[i]]).decode() for i in mine] == words(texts[k])
            for i in mine:
                assert seen.setdefault(bytes(data[w.starts[i] : w.ends[i]]), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def covered(sequences, size):
    """The places of each sequence in a run of `size` that starts earlier too; sequences are (id, items) in order of id."""
    first, out = {}, {}
    for i, items in sequences:
        mine = out.setdefault(i, set())
        for k in range(len(items) - size + 1):
            run = tuple(items[k : k + size])
            if run in first and first[run] != (i, k):
                mine.update(range(k, k + size))
            first.setdefault(run, (i, k))
    return out


def salted(monkeypatch):
    """Every anchor met twice is dealt by document."""
    for name, value in (("FREQUENT", 2), ("PLAN_SHARE", 1), ("FAIR", 1_000_000)):
        monkeypatch.setattr(repeats, name, value)


@pytest.mark.parametrize("size, hot", [(20, False), (12, True), (5, True)])
def test_substring_dedup(spark, monkeypatch, size, hot):
    if hot:
        salted(monkeypatch)
    rows = made()
    gone = covered(sorted((r[0], words(r[1])) for r in rows), size)
    got = substring_dedup.remove_repeats(clashing(frame(spark)), size).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words({x[0]: x[1] for x in rows}[r.doc_id])
        kept = [x for k, x in enumerate(w) if k not in gone[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(w) - len(kept), " ".join(kept)), r.doc_id
    assert sum(r.n_removed for r in got) > 300


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []
    twice = substring_dedup.remove_repeats(frame(spark, [(1, text, "", "", 0)] * 2 + [(None, text, "", "", 0), (2, text + " " + text, "", "", 0)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in twice) == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]
    hot = substring_dedup.remove_repeats(frame(spark, [(k, "a " * 200, "", "", 0) for k in range(5)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in hot) == [(0, 199)] + [(k, 200) for k in range(1, 5)]


def test_line_dedup(spark, monkeypatch):
    salted(monkeypatch)
    rows = made()
    lines = {r[0]: (r[1] or "").split("\n") for r in rows}
    worded = {i: [k for k, x in enumerate(v) if words(x)] for i, v in lines.items()}
    gone = covered(sorted((i, [lines[i][k] for k in v]) for i, v in worded.items()), line_dedup.WINDOW)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(frame(spark))).collect()}
    assert set(got) == set(lines) and got[3].asDict()["starts"] == "clash"
    for i, v in lines.items():
        dropped = {worded[i][k] for k in gone[i]}
        want = "\n".join(x for k, x in enumerate(v) if k not in dropped)
        assert (got[i].text or "") == want and (got[i].n_chars or 0) == len(want)
    assert got[1002].text is None and sum(map(len, gone.values())) > 50


def test_line_dedup_of_odd_rows(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
    got = line_dedup.dedup_lines(frame(spark, [(1, "a\nb", "", "", 3)] * 2 + [(None, "a\nb", "", "", 3), (2, "x\n\na\n \nb\na", "", "", 0)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a\nb"), ("1", "a\nb"), ("2", "x\n\n \na"), ("None", "a\nb")]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_only_chosen_minima_are_dealt(window):
    rng = np.random.default_rng(3)
    h, first = rng.integers(0, 2**63, 400).astype(np.uint64) % np.uint64(97), np.array([0, 150, 150, 151, 400])
    fingerprint, start, n, runs = repeats.anchored(h, h + np.uint64(1), first, window, 1)
    want = {}
    for a, b in zip(first, first[1:], strict=False):
        for k in range(a, b - window + 1):
            least = k + int(np.argmin(h[k : k + window]))
            want.setdefault(least, []).append(k)
    assert [list(range(s, s + m)) for s, m in zip(start, n, strict=True)] == list(want.values())
    assert fingerprint.tolist() == h[list(want)].tolist() and len(runs) == sum(map(len, want.values()))


def twins():
    """Two different words that every hash linear in its bytes, modulo a power of two, takes for one."""
    morse = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[x] for x in morse), "".join("ba"[x] for x in morse)


def test_patterns_do_not_collide(spark):
    one, other = twins()
    text = pa.array([f"{one} {other}"])
    (_, _, data, offsets), *_ = arrow_words.pieces(text)
    for w in (arrow_words.Words(data, offsets), arrow_words.Words(np.frombuffer(f"{one}\n{other}".encode(), np.uint8), np.array([0, 2049]), lines=True)):
        assert len(set(w.hashes().tolist())) == len(set(w.hashes(arrow_words.SEED_B).tolist())) == 2
    start = " ".join(f"w{k}" for k in range(19))
    docs = frame(spark, [(1, f"{start} {one}", "", "", 0), (2, f"{start} {other}", "", "", 0), (3, f"u\n{one}", "", "", 0), (4, f"u\n{other}", "", "", 0)])
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0] * 4
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}
    runs = arrow_words.Runs(np.array([[3, 5][bin(k).count("1") % 2] for k in range(2048)], np.uint64)).of(1024)
    assert runs[0] != runs[1024]


def test_texts_under_one_doc_id(spark, monkeypatch):
    alone = " ".join(f"v{k}" for k in range(25))
    shared = " ".join(f"w{k}" for k in range(25))
    rows = [(0, shared, "", "", 0), (1, shared + " z", "", "", 0), (1, alone, "", "", 0), (1, alone + " y", "", "", 0), (2, alone, "", "", 0)]
    lines = [(0, "p\nq", "", "", 0), (1, "p\nq\nz", "", "", 0), (1, "m\nn\nz", "", "", 0)]
    for hot in (False, True):
        if hot:
            salted(monkeypatch)
        got = sorted((r.doc_id, r.kept) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
        assert got == sorted([(0, shared), (1, "z"), (1, alone), (1, alone + " y"), (2, "")])
        got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, lines)).collect())
        assert got == [(0, "p\nq"), (1, "m\nn\nz"), (1, "z")]
    near = [(1, alone, "", "", 0), (2, shared, "", "", 0), (2, alone + " y", "", "", 0), (3, shared, "", "", 0), (3, shared, "", "", 0)]
    for one_of_each in (lambda d: simhash.one_of_each(d, 16), shingle_join.one_of_each):
        assert sorted((r.doc_id, r.text) for r in one_of_each(frame(spark, near)).collect()) == [(1, alone), (2, shared)]


def test_texts_of_megabytes(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    huge = "\n".join(f"a{k} b{k} c{k}" for k in range(80_000))
    rows = [(0, passage + "\nx", "", "", 0), (1, huge + "\n" + passage + "\nx", "", "", 0), (2, "q" * 3_000_000, "", "", 0), (3, huge, "", "", 0)]
    assert len(huge) > arrow_words.PIECE
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 31, 2: 0, 3: 240_000}
    got = {r.doc_id: len(r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: len(passage) + 2, 1: len(huge), 2: 3_000_000, 3: 0}


def test_long_lines_are_repeats_by_themselves(spark, monkeypatch):
    salted(monkeypatch)
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49))
    extra = [(3000 + k, f"x{k}\n{long}\ny{k}\n{short}\nz{k}", "", "", 0) for k in range(9)] + [(3100, long, "", "", 0), (3101, f"q\n{long}\n{long}", "", "", 0), (None, long, "", "", 0)]
    rows = made() + extra
    lines = {r[0]: (r[1] or "").split("\n") for r in rows if r[0] is not None}
    worded = {i: [k for k, x in enumerate(v) if words(x)] for i, v in lines.items()}
    gone = covered(sorted((i, [lines[i][k] for k in v]) for i, v in worded.items()), line_dedup.WINDOW)
    seen = set()
    for i in sorted(worded):
        for n, k in enumerate(worded[i]):
            if len(words(lines[i][k])) >= 50:
                gone[i] |= {n} if lines[i][k] in seen else set()
                seen.add(lines[i][k])
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, clashing(frame(spark, rows)), "").collect()}
    for i, v in lines.items():
        dropped = {worded[i][k] for k in gone[i]}
        assert (got[i].text or "") == "\n".join(x for k, x in enumerate(v) if k not in dropped), i
    assert got[3001].text == f"x1\ny1\n{short}\nz1" and got[3100].text == "" and got[3101].text == "q" and got[None].text == long
    assert corpus_pipeline.line_dedup(spark, frame(spark, []), "").collect() == []


def plain_fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(f, budget=4):
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= budget
    label = np.arange(len(f))
    while True:
        least = np.where(near, label[None, :], len(f)).min(1)
        if (least == label).all():
            return label
        label = least


def test_near_duplicates(spark):
    rows = made() + [(2000 + k, made()[6][1] + f" tail{k}", "en", "hot", 0) for k in range(40)]
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(frame(spark, rows))).collect()}
    ids = sorted(got)
    text = {r[0]: r[1] for r in rows}
    f = np.array([plain_fingerprint(text[i]) for i in ids], np.uint64)
    groups = plain_groups(f)
    for k, i in enumerate(ids):
        assert got[i].fingerprint % 2**64 == int(f[k]) and got[i].component_id == ids[groups[k]], i
    stay = simhash.one_of_each(clashing(frame(spark, [*rows, rows[0], (None, "x", "", "", 0)])))
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted([str(ids[k]) for k in set(groups)] + ["None"])
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert [r.component_id for r in simhash.near_duplicates(frame(spark, [(None, "a", "", "", 0)] * 2)).collect()] == [None, None]


def test_tries_of_many_classes_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 2)
    rng = random.Random(4)
    f = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        f |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(8)}
    f = sorted(f)
    classes = spark.createDataFrame([(simhash._signed(x),) for x in f], "fingerprint long")
    tries = simhash.dealt(classes, 4)
    assert tries.filter("choice >= 5").count() > 0
    links = tries.repartition("choice", "root").sortWithinPartitions("choice", "root").mapInArrow(simhash._stars(4), "a long, b long")
    label = {x % 2**64: least % 2**64 for x, least in components(links).collect()}
    groups = plain_groups(np.array(f, np.uint64))
    found = {}
    for x, g in zip(f, groups.tolist(), strict=True):
        found.setdefault(label.get(x, x), set()).add(g)
    assert all(len(g) == 1 for g in found.values()) and len(found) == len(set(groups.tolist()))


def test_tries_find_every_group():
    rng = np.random.default_rng(2)
    for _ in range(60):
        f = []
        for b in rng.integers(0, 2**63, 6, dtype=np.uint64):
            for _ in range(rng.integers(1, 60)):
                x = int(b)
                for bit in rng.integers(0, 64, rng.integers(0, 9)):
                    x ^= 1 << int(bit)
                f.append(x)
        f = np.unique(np.array(f, np.uint64))
        assert (simhash.trie_links(f, np.array([0])) == plain_groups(f)).all()


def test_every_linked_pair_meets_in_a_trie():
    for n in (10, 10**8, 10**11):
        masks = simhash.choices(n)
        rng = random.Random(n)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)
    assert len(simhash.choices(10)) == 5 and len(simhash.choices(10**10)) > 5


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 300), (200, 201), (201, 200), (202, 202)]
    got = {r.node: r.least for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(1, 21), 300], 0), **dict.fromkeys(range(101, 130), 100), 201: 200}


def labelled(n=900, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    docs, labels = [], []
    for k in range(n):
        toxic = int(k % 6 == 0)
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["Grumble", "grumblo", "zzork", "zzorks"]) + rng.choice(["", "a", "er", "!"])
        docs.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, toxic))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled()
    odd = [(5000, None, "", "", 0), (5001, "", "", "", 0), (None, "zzork zzork", "", "", 0)]
    frame_ = clashing(frame(spark, docs + odd))
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame_, table).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {k: y for k, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    swapped = spark.createDataFrame([(k, q, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in labels], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(frame_, swapped).collect()} == {(r.doc_id, r.score) for r in got}
    clean = toxicity.reject_toxic(frame_, table)
    assert clean.columns == frame_.columns and {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_labels_or_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark), empty).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), empty).collect() == []


def test_shared_backoff_is_kneser_ney(spark):
    """The shared part against a plain reading of it, and its sum over all next bytes."""
    docs, _ = labelled(60)
    shared = {r.low: r.p for r in toxicity.shared_backoff(frame(spark, docs), 3).collect()}
    trigrams = {p[k - 2 : k + 1] for d in docs for w in words(d[1]) for p in [b"  " + w.lower().encode() + b" "] for k in range(2, len(p))}
    bigrams = Counter(g[1:] for g in trigrams)
    single = Counter(g[1:] for g in bigrams)
    one = [0.9 * single[bytes([c])] / sum(single.values()) + 0.1 / 256 for c in range(256)]
    for context in {g[:1] for g in bigrams}:
        n = sum(v for g, v in bigrams.items() if g[:1] == context)
        rest = 0.75 * sum(g[:1] == context for g in bigrams) / n
        p = [max(bigrams[context + bytes([c])] - 0.75, 0) / n + rest * one[c] for c in range(256)]
        assert sum(p) == pytest.approx(1)
        for c in range(256):
            assert ((context[0] << 8 | c) in shared) == (context + bytes([c]) in bigrams)
            assert shared.get(context[0] << 8 | c, p[c]) == pytest.approx(p[c])


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000, 5000):
        for high in (1, 2, 300, 49408, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[::17] = rng.integers(0, 2**32 - 1)
            blocks, index = token_files.pack(ids)
            assert (token_files.unpack(blocks, index, n) == ids).all()
            if n >= 1000:
                assert (token_files.unpack(blocks, index, n, 1, 3) == ids[128:384]).all() and (token_files.unpack(blocks, index, n, 7) == ids[896:]).all()
    small = rng.integers(1000, 1064, 12_800, dtype=np.uint32)
    assert len(token_files.pack(small)[0]) < 12_800


def test_token_pages(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PAGE", 500)
    tokenizer = token_files.Encoder(token_files.TOKENIZER).tokenizer
    rows = [*made(), (-50, "Ünïcode é İ ﬁ ǅ it's don't \U0001f600 日本語 a​b \x1c x́ A" + "B" * 300, "", "", 0), (None, "first", "", "", 0)]
    path = token_files.scratch(spark, "pages")
    token_files.write_pages(clashing(frame(spark, rows)), path)
    got = {r.doc_id: r for r in token_files.read_pages(spark, path).collect()}
    start = 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    empty = token_files.scratch(spark, "pages")
    token_files.write_pages(frame(spark, []), empty)
    assert token_files.read_pages(spark, empty).collect() == []


def test_words_are_encoded_as_the_library_does():
    words_ = token_files.encoder(token_files.TOKENIZER)
    assert isinstance(words_, token_files.PlainEncoder)
    rng = random.Random(8)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    for _ in range(6000):
        word = "".join(rng.choice(letters if rng.random() < 0.9 else letters[:52]) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", ".", ",", "!", ";", "|", "..", "-x", "7"])
        want = words_.tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(words_.ids(word), "<u4").tolist() == want, word


def test_byte_bpe_is_exact():
    import tiktoken

    bpe = byte_bpe.encoder()
    reference = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.rank, special_tokens={})
    assert all(r in bpe.parts for r, t in bpe.token.items() if len(t) > 1)
    rng = random.Random(3)
    alphabet = list("aabbe  \n\t.,!'s019éß日本 \x1c\x85 \U0001f600́") + [" the", " ing", "tion", "'ll", ". ", "<|endoftext|>"]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = bpe.encode(text).tolist()
        assert ids == reference.encode_ordinary(text) and bpe.decode(ids) == text.encode(), text
    for text in ("a" * 20_000, "=-" * 5000, " " * 3000, "\n" * 900 + " x", "xyzzyqq" * 3000):
        assert bpe.encode(text).tolist() == reference.encode_ordinary(text)


def test_byte_bpe_of_tables(spark):
    bpe = byte_bpe.encoder()
    got = {r.doc_id: r for r in byte_bpe.round_trips(clashing(frame(spark))).collect()}
    for i, text, *_ in made():
        ids = bpe.encode(text or "").tolist()
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decoded(byte_bpe.encoded(frame(spark))).collect()
    assert {r.doc_id: bytes(r.text).decode() for r in back} == {r[0]: r[1] or "" for r in made()}
    assert byte_bpe.round_trips(frame(spark, [])).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, blanks, repeated rows and columns with clashing names pass through all stages; so does an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(k, 1, 0) for k in range(0, 90, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, None, None, None, None), (None, "lone words here", None, None, 1), (7000, None, None, None, None), (7001, " \n ", "en", "s1", 3), (7002, "a b c", "en", "s1", 5), (7002, "a b c", "en", "s1", 5), (7002, "d e f", "en", "s1", 5)]
    for rows in (made(30) + odd, []):
        now = clashing(frame(spark, rows)).withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made_ = stage(spark, now, str(tmp_path))
            assert k + 1 == len(corpus_pipeline.STAGES) or made_.columns == now.columns
            now = corpus_pipeline.cut(made_, name, keep=True)
            if name == "near_dedup" and rows:
                kept = [(r.doc_id, r.text) for r in now.collect()]
                assert kept.count((7002, "a b c")) == kept.count((7002, "d e f")) == 1 and (None, "lone words here") in kept and (None, None) in kept
        assert (now.count() > 10) == bool(rows)


def test_pipeline(spark, tmp_path):
    """Each stage against a plain reading of it on what the stage before kept."""
    import corpus_pipeline
    from weir.llm import mixing

    docs, labels = labelled(300)
    docs += [(1000 + k, docs[1][1] + f" t{k}", "en", "s2", 0) for k in range(3)] + [(2000, "l1 a\nl2 b\nx", "en", None, 0), (2001, "l1 a\nl2 b\ny", "en", "s2", 0)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    tables, now = [], frame(spark, docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = corpus_pipeline.cut(stage(spark, now, str(tmp_path)), name)
        tables.append(now.collect())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, lined, single, mixed, encoded = tables
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {r.doc_id for r in clean} == {i for i, p in predicted.items() if not p}
    assert {r.doc_id: r.text for r in lined}[2001] == "y" and len(lined) == len(clean)
    texts = {r.doc_id: r.text for r in lined}
    ids = sorted(texts)
    groups = plain_groups(np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64))
    assert sorted(r.doc_id for r in single) == sorted(ids[k] for k in set(groups))
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(single)).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    bpe = byte_bpe.encoder()
    assert sorted((r.doc_id, r.n_tokens) for r in encoded) == sorted((r.doc_id, len(bpe.encode(r.text))) for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in encoded)


def test_letters_and_runs_of_signs_are_encoded_apart():
    """As the library does, which is asked for the run of signs alone."""
    words_ = token_files.encoder(token_files.TOKENIZER)
    asked = []
    for word in ["TO!!", "éèan,", "the,***", "a%%%", "naïve\"", "it's", "x—,", "日本!!", "a'", "e\u0301!", "a1!!", "***", "ß<>", "[a]"]:
        want = words_.tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(words_.ids(word), "<u4").tolist() == want, word
        asked.append(word.encode() in words_)
    assert all(asked) and b"%%%" in words_ and "éèan".encode() in words_


def test_shorter_tokens_are_tried_as_exact_merging_leaves_them():
    bpe = byte_bpe.encoder()
    for rank in range(0, len(bpe.vocabulary), 97):
        token, part = bpe.vocabulary[rank], bpe.shorter[rank]
        starts = [bpe.rank[token[:k]] for k in range(1, len(token)) if token[:k] in bpe.rank]
        assert part == (starts[-1] if starts else -1)
