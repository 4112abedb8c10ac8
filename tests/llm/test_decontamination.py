import itertools
import math
import random
import re

import numpy as np
import pytest

from zonarium.llm import decontamination as D


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, overlap=13, similarity=0.8):
    out = set()
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            need = min(overlap, len(b))
            if need and any(
                sum(x == y for x, y in zip(a[p : p + need], b[q : q + need])) >= math.ceil(similarity * need - 1e-9)
                for p in range(len(a) - need + 1)
                for q in range(len(b) - need + 1)
            ):
                out.add((d, i))
    return out


@pytest.mark.parametrize("n", range(1, 21))
def test_masks_lose_no_window(n):
    need = min(n, 13)
    bad = need - math.ceil(0.8 * need - 1e-9)
    masks = D.masks_for(n, 13)
    for gone in itertools.combinations(range(need), bad):
        assert any(all(s + o not in gone for o in m) for m in masks for s in range(need - m[-1])), (n, gone)


def corpus():
    rng = random.Random(2)
    pool = ["w%d" % i for i in range(30)] + ["É", "the"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 13, 14, 30])))) for i in range(30)] + [(90, None), (91, " .")]
    docs = [(0, None), (1, ""), (2, "w1"), (3, "?")]
    for d in range(4, 120):
        t = [rng.choice(pool).upper() for _ in range(rng.randrange(40))]
        if rng.random() < 0.7:
            x = words(items[rng.randrange(30)][1])
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = "zz"
            a = rng.randrange(len(t) + 1)
            t[a:a] = x[rng.randrange(3) :]
        docs.append((d, rng.choice([" ", ", ", "\n-"]).join(t)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for block_words in (2_000_000, 300):
        got = [(r.doc_id, r.item_id) for r in D.contaminations(df, bench, block_words=block_words).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    clean = D.without_benchmarks(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_overlap_is_reported():
    item = " ".join("abcdefghijklmnopqrst")
    text = ("x y " + item.replace("c", "q").replace("f", "q") + " z").encode()
    m = D.Matcher([(7, item)])
    assert m.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == [(0, 0, 2, 20, 18)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminations(docs, one).count() == 0 and D.without_benchmarks(docs, one).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b d")], "doc_id long, text string")
    assert D.contaminations(rows, bench).count() == 0 and D.without_benchmarks(rows, bench).count() == 4
    assert D.contaminations(rows, one).count() == 3 and D.without_benchmarks(rows, one).count() == 1
