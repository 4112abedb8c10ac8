import random
import re

import numpy as np
import xxhash

from zonarium.llm import simhash as S


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """Brute force over (doc_id, fingerprint)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_fingerprint():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 300, 2000):
        t = " \t\n".join(rng.choice(["A", "b", "Éa", "the x", "c" * 40]) for _ in range(n))
        assert S.fingerprint(t) == slow(t)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


def test_trie_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ sum((np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(k)) for k in range(5)]))
    bounds = np.array([0, 70, 71, len(fp)])
    i, j = S.trie_pairs(fp, bounds, 4, leaf=3)
    want = {(a, b) for lo, hi in zip(bounds[:-1], bounds[1:]) for a in range(lo, hi) for b in range(a + 1, hi) if int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_linking_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            rows.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    rows = [(i * 3 + 5, x) for i, x in enumerate(rows + rows[:9] + [0, 0, 1])]
    fps = spark.createDataFrame([(S.signed(x),) for _, x in rows], "fp long").distinct()
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in S.near_pairs(fps, hot_bucket=12).collect()}
    values = sorted({x for _, x in rows})
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4}


def test_classes(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    texts = [None, "", "one", "ONE", "a b c d"] + base + [b.upper() for b in base[:3]] + [base[5] + " tail"]
    rows = [(i + 10, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_classes(df).collect()}
    fps = [(d, slow(t)) for d, t, _ in rows]
    want = classes(fps)
    assert got == {d: (f"{x:016x}", want[d]) for d, x in fps}
    kept = [r.doc_id for r in S.one_of_each(df).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_classes(df).count() == 0 and S.one_of_each(df).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in S.simhash_classes(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2)]
    assert sorted(r.doc_id for r in S.one_of_each(df).collect()) == [1, 2]
    far = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    df = spark.createDataFrame([(None, far[0], "x"), (None, far[1], "x"), (None, far[1], "x"), (7, far[2], "y"), (7, far[0], "z")], "doc_id long, text string, _row string")
    kept = S.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, far[1]), (7, far[2]), (7, far[0])])


def test_long_text(monkeypatch):
    text = " ".join("w%d" % (i * 7919 % 9973) for i in range(5000))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 700)
    assert S.fingerprint(text) == want == slow(text)
