import random

import numpy as np

from zonarium.llm import passage_dedup as P


def test_compact_windows_equal_definition():
    rng = np.random.default_rng(0)
    for n in (1, 5, 6, 30, 80):
        v = rng.integers(0, 12, n).astype(np.uint64) << np.uint64(30)
        want = set()
        for c in range(n):
            l = c
            while l and v[l - 1] > v[c]:
                l -= 1
            r = c
            while r + 1 < n and v[r + 1] >= v[c]:
                r += 1
            if r - l + 1 >= 6:
                want.add((l, c, r))
        assert set(P.compact_windows(v, 6)) == want
        # Each stretch of the width lies in exactly one window whose c it holds.
        for i in range(n - 5):
            assert sum(l <= i <= c <= i + 5 <= r for l, c, r in want) == 1


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def corpus():
    rng = random.Random(6)
    fresh = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    texts, planted = [], {}
    for k in range(25):
        passage = fresh(rng.randrange(55, 160))
        for m in range(rng.randrange(2, 5)):
            p = list(passage)
            if m and len(p) > 100:
                p[len(p) // 2] = "changed%d" % m
            planted[len(texts)] = (k, len(p))
            texts.append(fresh(rng.randrange(80)) + p + fresh(rng.randrange(80)))
    clean = [fresh(rng.randrange(1, 300)) for _ in range(40)]
    short = fresh(40)
    clean += [fresh(60) + short + fresh(60), fresh(30) + short + fresh(90)]
    first_clean = len(texts)
    return [" ".join(t) for t in texts + clean], planted, first_clean


def test_planted_passages(spark):
    texts, planted, first_clean = corpus()
    rows = [(i + 100, t, "x") for i, t in enumerate(texts)] + [(900, texts[0].upper() + " .", "x"), (901, texts[first_clean + 3] + " z", "x"), (902, None, "x"), (903, "", "x")]
    n = len(rows)
    rows += [(904, texts[1], "x"), (905, texts[1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)
    got = {r.doc_id: r for r in P.passage_classes(df).collect()}
    assert len(got) == len(rows) and n
    groups = {}
    for i, (k, size) in planted.items():
        groups.setdefault(k, []).append(i)
        assert got[i + 100].n_dup_words >= size - 12, (i, size, got[i + 100])
    for members in groups.values():
        assert {got[i + 100].class_id for i in members} == {min(members) + 100}
    assert got[900].class_id == got[100].class_id and got[904].class_id == got[905].class_id == got[101].class_id
    assert got[904].n_dup_words == got[904].n_words
    for i in range(first_clean, len(texts)):
        if i != first_clean + 3:
            assert (got[i + 100].class_id, got[i + 100].n_dup_words) == (i + 100, 0)
    assert (got[902].class_id, got[902].n_words, got[903].n_dup_words) == (902, 0, 0)


def test_verified_pairs_are_similar(spark):
    texts, _, _ = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index, _, passages = P.near_passages(df)
    doc = {r.rid: r.doc_id for r in index.collect()}
    found = passages.collect()
    assert found
    for r in found:
        a, b = texts[doc[r.a]].split()[r.a_first : r.a_end], texts[doc[r.b]].split()[r.b_first : r.b_end]
        assert len(a) >= 50 and len(b) >= 50 and jaccard(a, b) >= 0.8


def test_empty_and_repeated(spark):
    assert P.passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join("w%d" % i for i in range(60))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, "short"), (6, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_dup_words) for r in P.passage_classes(df).collect())
    assert got == [(0, 5, 60), (5, 5, 60), (5, 5, 60), (6, 6, 0), (6, 6, 0)]


def test_one_substitution_anywhere():
    """Whichever shared token leads to a passage with one word changed, the passage is found where the rule holds."""
    rng = random.Random(9)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    for size in (50, 51, 55, 60, 70, 80):
        for at in range(size):
            p = fresh(size)
            q = [*p[:at], "changed", *p[at + 1 :]]
            if jaccard(p, q) < 0.8:
                continue
            before, after = (rng.randrange(30) for _ in range(2)), (rng.randrange(30) for _ in range(2))
            texts = [fresh(m) + t + fresh(n) for m, t, n in zip(before, (p, q), after)]
            a, b = (P.tokens_of(" ".join(t).encode()) for t in texts)
            common = np.intersect1d(a, b)
            for token in common[:: max(1, len(common) // 12)]:
                c, d = int(np.flatnonzero(a == token)[0]), int(np.flatnonzero(b == token)[0])
                s, e, t, f, found, _ = P.near_passage(a, b, (c, c, len(a) - 1 - c), (d, d, len(b) - 1 - d), 46)
                assert found, (size, at, c)
                x, y = texts[0][s : e + 4], texts[1][t : f + 4]
                assert len(x) >= 50 and len(y) >= 50 and jaccard(x, y) >= 0.8 and e - s >= size - 9


def test_exact_run_goes_on_past_a_gap(spark):
    rng = random.Random(10)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    p = fresh(90)
    rows = [(1, " ".join(fresh(9) + p + fresh(9))), (2, " ".join(fresh(9) + p[:60] + ["changed"] + p[61:] + fresh(9)))]
    got = {r.doc_id: r for r in P.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].class_id == got[2].class_id == 1 and min(got[1].n_dup_words, got[2].n_dup_words) >= 90


def test_windows_regroup_past_a_first_text(spark):
    """Two later texts share passages of which an earlier one has only phrases, or an edited version."""
    rng = random.Random(11)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    rows = []
    for k in range(40):
        p = fresh(60)
        edited = [w if i % 9 else "x%d" % i for i, w in enumerate(p)]
        rows += [(3 * k, edited), (3 * k + 1, fresh(20) + p + fresh(20)), (3 * k + 2, fresh(5) + p + fresh(30))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in P.passage_classes(df).collect()}
    for k in range(40):
        assert (got[3 * k].class_id, got[3 * k].n_dup_words) == (3 * k, 0)
        assert got[3 * k + 1].class_id == got[3 * k + 2].class_id == 3 * k + 1
        assert min(got[3 * k + 1].n_dup_words, got[3 * k + 2].n_dup_words) >= 60


def test_first_text_repeats_a_passage(spark):
    rng = random.Random(12)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    p = fresh(70)
    rows = [(1, fresh(30) + p + fresh(40) + p + fresh(30)), (2, fresh(20) + p + fresh(20))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in P.passage_classes(df).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_dup_words >= 140 and 70 <= got[2].n_dup_words < 80


def test_similar_passages_share_a_stretch_of_25_words():
    """Random edits of passages: wherever the similarity is 0.8 or more, 25 words stand together in both."""
    rng = random.Random(13)
    seen = 0
    for _ in range(2500):
        p = ["w%d" % rng.randrange(10**9) for _ in range(rng.randrange(50, 200))]
        q = list(p)
        for _ in range(rng.randrange(1, 6)):
            i, kind = rng.randrange(len(q)), rng.randrange(4)
            if kind == 0:
                q[i] = "x%d" % rng.randrange(10**9)
            elif kind == 1:
                q.insert(i, "x%d" % rng.randrange(10**9))
            elif kind == 2:
                del q[i : i + rng.randrange(1, 4)]
            else:
                q = q[i:] + q[:i]
        if len(q) >= 50 and jaccard(p, q) >= 0.8:
            seen += 1
            runs = lambda t: {tuple(t[i : i + 25]) for i in range(len(t) - 24)}
            assert runs(p) & runs(q)
    assert seen > 400


def phrases_corpus(seed, docs=30):
    """Texts made of shared lines, passages that several have with a few edits, and words of their own."""
    rng = random.Random(seed)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    lines = [fresh(rng.randrange(20, 36)) for _ in range(3)]
    passages = [fresh(rng.randrange(50, 90)) for _ in range(8)]
    out = []
    for _ in range(docs):
        text = fresh(rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5:
                text += rng.choice(lines)
            else:
                p = list(rng.choice(passages))
                for _ in range(rng.choice((0, 0, 1, 2))):
                    p[rng.randrange(len(p))] = "x%d" % rng.randrange(10**9)
                text += p
            text += fresh(rng.randrange(25))
        out.append(text)
    return out


def brute_links(texts):
    """Pairs of texts that have passages of 50 to 100 words with a similarity of 0.8 or more, by all alignments of 50-word stretches."""
    found = set()
    tokens = [P.tokens_of(" ".join(t).encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b = tokens[i], tokens[j]
            if len(a) < 46 or len(b) < 46:
                continue
            for size in (46, 52, 60, 75, 90):
                hit = False
                for s in range(0, len(a) - size + 1):
                    x = a[s : s + size]
                    at = np.flatnonzero(np.isin(b, x))
                    if len(at) < 0.8 * size:
                        continue
                    for t in range(max(0, int(at[0]) - 6), min(len(b) - size, int(at[-1])) + 1):
                        if P.similar(x, b[t : t + size], 0.8):
                            hit = True
                            break
                    if hit:
                        break
                if hit:
                    found.add((i, j))
                    break
    return found


def classes(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_links_equal_brute_force(spark):
    """Every link of all pairs is there in the classes, shared lines or not; also where groups are too large for a task."""
    for seed in (1,):
        texts = phrases_corpus(seed)
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        want = brute_links(texts)
        assert len(want) > 12
        for gathered in (P._GATHERED, 4):
            index, _, passages = P.near_passages(df, gathered=gathered)
            doc = {r.rid: r.doc_id for r in index.collect()}
            got = {tuple(sorted((doc[r.a], doc[r.b]))) for r in passages.collect()}
            root = classes(len(texts), got)
            lost = [(a, b) for a, b in want if root[a] != root[b]]
            print("links", len(want), "lost", len(lost), "gathered", gathered)
            assert not lost
        assert len(set(classes(len(texts), want))) > 3


def test_links_past_an_earlier_text_with_most_of_the_passage(spark):
    rng = random.Random(14)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    rows = []
    for k in range(200):
        p = fresh(60)
        rows += [(3 * k, fresh(10) + p[:45] + fresh(20)), (3 * k + 1, fresh(20) + p + fresh(20)), (3 * k + 2, fresh(5) + p + fresh(30))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in P.passage_classes(df).collect()}
    found = sum(got[3 * k + 1] == got[3 * k + 2] for k in range(200))
    print("links found", found, "of 200")
    assert found == 200


def test_one_word_over_and_over(spark):
    """Runs of one word in many texts: classes by what stands around them, without comparing every place."""
    rows = [(i, "a%d b%d " % (i, i) + "same " * (40 + i) + "c%d" % i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.passage_classes(df).collect()}
    assert len(got) == 20
    assert len({got[i].class_id for i in range(10, 20)}) == 1


def test_very_long_text(spark):
    words = " ".join("w%d" % (i * 7919 % 100003) for i in range(300_000))
    part = " ".join(words.split()[200_000:200_100])
    df = spark.createDataFrame([(1, words), (2, "head " + part + " tail")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.passage_classes(df).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[2].n_dup_words >= 100


def test_windows_of_many_texts_are_the_trees_nodes(monkeypatch):
    """Windows found for texts together, also in pieces, are the nodes of each text's own tree, with reaches cut."""
    rng = np.random.default_rng(15)
    sizes = [0, 10, 49, 50, 51, 300, 24, 1000, 60]
    words = [rng.integers(0, 40 if n == 300 else 1 << 63, n).astype(np.uint64) for n in sizes]
    first = np.concatenate(([0], np.cumsum(sizes)))
    for piece in (1 << 22, 128):
        monkeypatch.setattr(P, "_PIECE", piece)
        keys, places, ends = P.windows_of(np.concatenate(words), first)
        begin = 0
        for w, end in zip(words, ends, strict=True):
            seeds = P.shingles_of(w, P.SEED) if len(w) >= P.WORDS else np.zeros(0, np.uint64)
            want = {(int(seeds[c].view(np.int64)), c): (min(c - l, 10), min(r - c, 10)) for l, c, r in P.compact_windows(seeds, P.WIDTH)}
            got = {}
            for k, p in zip(keys[begin:end].tolist(), places[begin:end].tolist(), strict=True):
                far = got.get((k, p >> 8), (0, 0))
                got[(k, p >> 8)] = max(far[0], p >> 4 & 15), max(far[1], p & 15)
            assert set(got) == set(want)
            if piece > 1000:
                assert got == want
            begin = end
        assert begin == len(keys)


def chains_corpus(seed, docs=60):
    """Texts around one shared line whose passages drift: each is similar to the next, none to those farther off."""
    rng = random.Random(seed)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    line, right, out = fresh(26), fresh(24 + docs), []
    for i in range(docs):
        # Every third text has the line among words of its own; the others, words beside it that move on.
        beside = fresh(24) if i % 3 == 2 else right[i // 3 : i // 3 + 24]
        out.append(fresh(30) + line + beside + fresh(30))
    return out


def test_results_do_not_depend_on_what_a_task_gathers(spark):
    """Classes, words and passages that count are the same, whatever the size at which groups are split."""
    for texts in (chains_corpus(21), phrases_corpus(22, 40)):
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
        want = {r.doc_id: r for r in P.passage_classes(df).collect()}
        assert len({r.class_id for r in want.values()}) < len(texts)
        for gathered in (2, 5):
            assert {r.doc_id: r for r in P.passage_classes(df, gathered=gathered).collect()} == want, gathered


def test_groups_lose_no_similar_window():
    """A group links what all pairs of its windows link, and each window meets the first similar one, split or not."""
    for seed in range(4):
        texts = chains_corpus(seed, 36) + phrases_corpus(seed, 30)
        windows = {}
        for rid, t in enumerate(texts):
            words = P.words_of(" ".join(t).encode())
            keys, places, _ = P.windows_of(words, np.array([0, len(words)]))
            tokens = P.shingles_of(words, P.SHINGLE)
            for key, place in zip(keys.tolist(), places.tolist()):
                begin, near = P._context(tokens, place >> 2 * P._BITS)
                windows.setdefault(key, []).append((rid, place, begin, near.astype(np.uint32).view(np.int32), rid, 0))
        seen = 0
        for rows in windows.values():
            group = P._Group(46, 0.8)
            for r in rows:
                group.add(*r)
            want, first = set(), {}
            for i, (ra, pa_, a0, x, *_) in enumerate(rows):
                for rb, pb, b0, y, *_ in rows[i + 1 :]:
                    if ra != rb and P._passage(x, y, (pa_ >> 8) - a0, (pb >> 8) - b0, 46, 0.8, {})[0]:
                        want.add((ra, rb))
                        first.setdefault((ra, pa_), (rb, pb))
                        first.setdefault((rb, pb), (ra, pa_))
            for rb, pb, *_ in rows:
                before = [(ra, pa_) for ra, pa_, *_ in rows if first.get((rb, pb)) == (ra, pa_)]
                assert len(before) == ((rb, pb) in first)
            found = group.compare()
            assert classes(len(texts), {r[:2] for r in found}) == classes(len(texts), want)
            got = {(r[0], r[7]): (r[1], r[8]) for r in found if r[9]} | {(r[1], r[8]): (r[0], r[7]) for r in found if r[10]}
            assert got == first
            seen += len(want)
        assert seen > 100


def test_a_seed_is_looked_at_once(monkeypatch):
    """However far lines repeat with small changes around a seed, what belongs to it is found without widening looks."""
    rng = random.Random(31)
    fresh = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    line = fresh(36)
    a = P.tokens_of(" ".join(line * 9).encode())
    b = P.tokens_of(" ".join(w for _ in range(60) for w in line[:-1] + fresh(1)).encode())
    calls, near = [], P.near_passage
    monkeypatch.setattr(P, "near_passage", lambda *x, **y: calls.append(1) or near(*x, **y))
    known, seeds = {}, [d for d in range(len(b)) if b[d] == a[0] and len(b) - d > 50]
    for d in seeds:
        P._passage(a, b, 36, d, 46, 0.8, known)
    assert len(seeds) > 50 and len(calls) <= len(seeds)


def test_balance_never_tells_similar_windows_apart():
    """Windows that repeat tokens: where stretches around the seeds are similar, both sides together may be."""
    rng = np.random.default_rng(32)
    seen = 0
    for _ in range(400):
        base = rng.integers(0, 9, 24).astype(np.uint64)
        x, y = (np.where(rng.random(24) < 0.15, rng.integers(0, 14, 24).astype(np.uint64), base) for _ in range(2))
        c, width = 12, 8
        x[c] = y[c] = base[c]
        stretches = [(s, e) for s in range(c + 1) for e in range(max(c + 1, s + width), 25)]
        if any(P.similar(x[s:e], y[t:f], 0.8) for s, e in stretches[::7] for t, f in stretches[::5]):
            seen += 1
            assert P._balance(x, P._among(x, y), c, width, 4.0) + P._balance(y, P._among(y, x), c, width, 4.0) >= -1e-6
    assert seen > 50
