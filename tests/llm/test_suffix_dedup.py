import hashlib
import random
from collections import Counter

from zonarium.llm.suffix_dedup import repeated_bytes


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [rand(120) for _ in range(4)]
    texts = [None, "", "x" * 500, "ab" * 300, rand(39), rand(40)]
    for _ in range(40):
        p = rng.choice(shared)
        a, b = sorted((rng.randrange(120), rng.randrange(120)))
        texts.append(rand(rng.randrange(60)) + p[a:b] + rand(rng.randrange(60)) + rng.choice(shared)[: rng.randrange(120)])
    return texts + texts[6:9] + ["x" * 700]


def check(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "noise") for i, t in enumerate(texts)], "doc_id long, text string, rid string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(df, length=40, seed=20, **kw).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_hot_keys_equal_brute_force(spark):
    check(spark, corpus(2), hot_runs=2)


def test_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_bytes(empty).count() == 0
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_removed) for r in repeated_bytes(df, with_text=True).collect())
    assert got == [(-1, len(t)), (5, len(t)), (5, len(t)), (6, 0)]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    """However a long text is cut, each string is in one run, and equal strings get equal keys and places in them."""
    import numpy as np

    from zonarium.llm import suffix_dedup as S

    rng = np.random.default_rng(4)
    part = rng.integers(0, 3, 300).astype(np.uint8)
    data = np.concatenate([part, rng.integers(0, 3, 500).astype(np.uint8), part, np.zeros(200, np.uint8), part])

    def strings():
        out = {}
        for key, _, first, n, lead in zip(*S.runs_of(data, 40, 20), strict=True):
            for k in range(n):
                assert first + k not in out
                out[int(first + k)] = (int(key), int(lead) - k)
        return out

    whole = strings()
    assert sorted(whole) == list(range(len(data) - 39))
    monkeypatch.setattr(S, "_PIECE", 97)
    assert strings() == whole
    by = {}
    for i, k in whole.items():
        by.setdefault(data[i : i + 40].tobytes(), set()).add(k)
    assert all(len(v) == 1 for v in by.values())


def test_multikey_sort_equals_sets():
    """Strings of runs around one chosen position, by sorting and by a dictionary of their bytes."""
    import numpy as np

    from zonarium.llm import suffix_dedup as S

    rng = np.random.default_rng(8)
    for length, seed in ((40, 20), (37, 9), (12, 5), (5, 2)):
        core = bytes(rng.integers(97, 100, seed).astype(np.uint8))
        lefts = [bytes(rng.integers(97, 99, length).astype(np.uint8)) for _ in range(3)]
        rights = [bytes(rng.integers(97, 99, length).astype(np.uint8)) for _ in range(3)]
        pieces, leads = [], []
        for _ in range(30):
            # Strings begin at most at the chosen position and hold the whole of its seed.
            before, after = int(rng.integers(1, length - seed + 1)), int(rng.integers(1, length - seed + 1))
            left, right = bytearray(lefts[rng.integers(3)]), bytearray(rights[rng.integers(3)])
            if rng.random() < 0.5:
                left[rng.integers(length)] ^= 1
                right[rng.integers(length)] ^= 1
            piece = bytes(left)[len(left) - before :] + core + bytes(right)[:after]
            if len(piece) >= length:
                pieces.append(piece)
                leads.append(before)
        got = S.repeated_strings(pieces, leads, length, seed)
        seen = Counter((lead - i, p[i : i + length]) for p, lead in zip(pieces, leads) for i in range(len(p) - length + 1))
        for p, lead, flags in zip(pieces, leads, got, strict=True):
            assert flags.tolist() == [seen[(lead - i, p[i : i + length])] > 1 for i in range(len(p) - length + 1)]
        assert any(f.any() for f in got)
