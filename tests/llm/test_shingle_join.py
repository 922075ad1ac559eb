"""Near-duplicates by exact similarity of shingle sets."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.corpus import clashing, frame, made, words
from weir.llm import shingle_join, simhash


def shingles(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def plain_components(texts):
    """Least id of each id's component, from all pairs."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label, links


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def planted():
    rng = random.Random(9)
    boilerplate = " ".join(f"b{rng.randrange(300)}" for _ in range(60))
    rows = []
    for k in range(30):
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 200)))
        rows.append(base)
        rows += [edited(rng, base, n) for n in range(6)] + [base + " more words at the end of it", boilerplate + " " + base[: rng.randint(0, 300)]]
    rows += [edited(rng, rows[0], 1) for _ in range(60)]  # a large group
    rng.shuffle(rows)
    return [(5000 + k, t, "en", "s1", len(t)) for k, t in enumerate(rows)]


def test_exact_components(spark, monkeypatch):
    rows = made() + planted()
    want, links = plain_components({r[0]: r[1] for r in rows})
    for sample, seen in ((16_384, 3), (50, 2)):
        monkeypatch.setattr(shingle_join, "SAMPLE", sample)
        monkeypatch.setattr(shingle_join, "SEEN", seen)
        monkeypatch.setattr(shingle_join, "ANY", 255 if seen != 2 else 2)
        got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(clashing(frame(spark, [*rows, (None, "x", "", "", 0)]))).collect()}
        assert got == want
    assert len(links) > 300


def test_edited_copies_go_from_the_pipeline(spark):
    """Two changed words of 120 are more than four fingerprint bits, and less than a fifth of the shingles."""
    rng = random.Random(4)
    rows = []
    for k in range(20):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
        rows += [(2 * k, base, "en", "s1", 0), (2 * k + 1, edited(rng, base, 2), "en", "s1", 0)]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, [*rows, rows[0], (None, "x", "", "", 0)]), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([str(2 * k) for k in range(20)] + ["None"])
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").collect() == []


def test_runs_over_batches_stay_whole():
    rng = np.random.default_rng(1)
    for _ in range(200):
        h = np.sort(rng.integers(0, 6, rng.integers(0, 30)))
        cuts = np.sort(rng.integers(0, len(h) + 1, 4))
        batches = [pa.record_batch([x, x * 2], ["h", "v"]) for x in np.split(h, cuts)]
        out = list(shingle_join.whole_runs(iter(batches)))
        assert (np.concatenate([o[0] for o in out] or [h]) == h).all() and all((o[1] == 2 * o[0]).all() for o in out)
        assert all(a[0][-1] != b[0][0] for a, b in zip(out, out[1:], strict=False))


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def test_what_the_tries_link_goes_from_the_pipeline(spark):
    """Fingerprints count repeats and sets do not: these two are three bits apart, with a third of their shingles in common."""
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    texts = [" ".join([base] * 30 + [f"{c}{k}" for k in range(40)]) for c in "ab"]
    f = simhash.fingerprints(*arrays(texts))
    a, b = map(shingles, texts)
    assert int(f[0] ^ f[1]).bit_count() <= 4 and 3 * len(a & b) == len(a | b)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, [(k, t, "en", "s1", 0) for k, t in enumerate([*texts, "quite another text of seven words"])]), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_linked_sets_share_a_signature_and_others_hardly_ever():
    none, rng = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.random.default_rng(3)
    for trial in range(600):
        n = int(rng.integers(4, 60 if trial % 2 else 1500))
        m = int(rng.integers(n, n * 5 // 4 + 1))
        both = -(-4 * (n + m) // 9)
        if both > n or both == m:
            continue
        new = [rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (both, n - both, m - both)]
        x, y = np.sort(np.append(new[0], new[1])), np.sort(np.append(new[0], new[2]))
        found, of = shingle_join.signatures(np.append(x, y), np.array([n, m]), *none)
        assert set(found[of == 0].tolist()) & set(found[of == 1].tolist())
        sketches = [np.frombuffer(shingle_join.wide_sketch(z), np.uint8) for z in (x, y)]
        assert shingle_join.wide_possible(*sketches, n, m)
    # texts of few frequent words: by chance any two of them share single shingles
    pool = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    sets = [np.unique(pool[rng.integers(0, len(pool), 900)]) for _ in range(40)]
    found, of = shingle_join.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), *none)
    met = len(found) - len(np.unique(found))
    assert met < 0.02 * len(found)
