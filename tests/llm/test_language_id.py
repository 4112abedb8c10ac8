import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from zonarium.llm import language_id as L


def slow_model(texts, vocabulary):
    """Interpolated Kneser-Ney by dictionaries."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        t = L.PAD + t
        counts[4].update(t[i : i + 4] for i in range(len(t) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, kinds = [Counter() for _ in range(5)], [Counter() for _ in range(5)]
    for k in range(1, 5):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (vocabulary + 1)
        lower = p(gram[1:])
        if not total[k][gram[:-1]]:
            return lower
        return max(counts[k][gram] - 0.75, 0) / total[k][gram[:-1]] + 0.75 * kinds[k][gram[:-1]] / total[k][gram[:-1]] * lower

    return lambda t: -sum(math.log2(p((L.PAD + t)[i : i + 4])) for i in range(len(t))) / len(t)


def test_models_equal_dictionaries():
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30)))
    train = {"x": [text("abc") for _ in range(9)], "y": [text("bcdé") for _ in range(9)], "z": ["q"]}
    points = Counter(ord(c) for ts in train.values() for t in ts for c in t) + Counter({32: 1})
    alphabet = L.Alphabet(points)
    counts = {}
    for lang, ts in train.items():
        keys = np.concatenate([alphabet.keys(L.PAD + t) for t in ts])
        counts[lang] = L._sum_by(keys, np.ones(len(keys)))
    models = L.Models(alphabet, counts)
    texts = [text("abcd") for _ in range(20)] + ["a", "zzz é", "q", "qq"]
    slow = {lang: slow_model(ts, len(points)) for lang, ts in train.items()}
    want = np.array([[slow[lang](t.replace("z", "\x00")) for lang in "xyz"] for t in texts])
    for portion in (20, 10**6):
        assert np.allclose(models.entropies(texts, portion), want, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.identify(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert sum(r.rejected for r in got) <= 2
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, held_out string"
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, f"hello world number {i}", "en", None) for i in range(9)] + [(None, "bonjour", "fr", "x"), (20, None, "en", "x"), (21, "12 !", "en", "x"), (22, "", None, "x"), (3, "hello world", "en", "x"), (3, "hello world", "en", "x")]
    df = spark.createDataFrame(rows, schema)
    got = defaultdict(list)
    for r in L.identify(df).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 and got[i][0].rejected for i in (20, 21, 22))
    assert got[None][0].held_out is False and got[None][0].lang_pred == "en" and len(got[3]) == 3
    none = spark.createDataFrame([(1, "abc", None, None)], schema)
    assert [(r.lang_pred, r.score) for r in L.identify(none).collect()] == [("und", 0.0)]


def test_few_rows_still_reject(spark):
    """A language of few rows has a limit: foreign scripts are rejected, its own held-out texts are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    own = docs.where("lang = 'de'").orderBy("doc_id").limit(60)
    foreign = ["Η γλώσσα είναι ένα σύστημα επικοινωνίας των ανθρώπων", "Язык является средством общения между людьми во всём мире", "언어는 사람들이 서로 생각을 나누는 수단이다"]
    extra = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(own.unionByName(extra)).collect()}
    assert all(got[10**6 + i].rejected for i in range(len(foreign)))
    assert sum(r.rejected for r in got.values()) <= len(foreign) + 3
    models = L.fit(docs.where("lang <> 'de'").unionByName(own))
    assert np.isfinite(models.centres).all()
    one = L.fit(spark.createDataFrame([(1, "ein einziger kurzer satz", "de")], "doc_id long, text string, lang string"))
    assert np.isfinite(one.centres).all()


def test_long_texts_do_not_shut_out_others(spark):
    rows = [(i, "guten morgen liebe welt " * (1 + 99 * (i % 2)), "de") for i in range(60)] + [(100 + i, "hello again my good friend " * 200, "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = L.fit(docs, max_chars=1000)
    assert models.languages == ["de", "en"]
    got = {r.doc_id: r for r in L.identify(docs, models).collect()}
    assert all(got[i].lang_pred == ("de" if i < 100 else "en") for i in got)


UNSEEN = [
    "Lugha ni mfumo wa mawasiliano kati ya watu ambao hutumia sauti na maneno kueleza mawazo yao kwa wengine kila siku nyumbani na kazini",
    "Kieli on ihmisten v\u00e4linen viestint\u00e4j\u00e4rjestelm\u00e4 jota k\u00e4ytet\u00e4\u00e4n ajatusten ja tunteiden ilmaisemiseen joka p\u00e4iv\u00e4 kotona ja ty\u00f6ss\u00e4",
    "J\u0119zyk jest systemem znak\u00f3w s\u0142u\u017c\u0105cym ludziom do porozumiewania si\u0119 mi\u0119dzy sob\u0105 w domu i w pracy ka\u017cdego dnia tygodnia",
    "A nyelv az emberek k\u00f6z\u00f6tti kommunik\u00e1ci\u00f3 eszk\u00f6ze amelyet mindennap haszn\u00e1lunk otthon \u00e9s a munkahely\u00fcnk\u00f6n is egyar\u00e1nt",
    "\u042f\u0437\u044b\u043a \u044f\u0432\u043b\u044f\u0435\u0442\u0441\u044f \u0441\u0440\u0435\u0434\u0441\u0442\u0432\u043e\u043c \u043e\u0431\u0449\u0435\u043d\u0438\u044f \u043c\u0435\u0436\u0434\u0443 \u043b\u044e\u0434\u044c\u043c\u0438 \u0432\u043e \u0432\u0441\u0451\u043c \u043c\u0438\u0440\u0435",
]


def test_unseen_languages_are_rejected_and_few_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(UNSEEN)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs.unionByName(extra)).collect()}
    out = [r for r in got.values() if r.held_out and r.doc_id < 10**6]
    print("held-out rejected", sum(r.rejected for r in out), "of", len(out), "unseen", [got[10**6 + i].rejected for i in range(len(UNSEEN))])
    assert sum(got[10**6 + i].rejected for i in range(len(UNSEEN))) == len(UNSEEN)
    assert sum(r.rejected for r in out) <= 0.01 * len(out) + 1


def test_calibration_holds_its_rate():
    """Of new texts like those kept out, the stated share is rejected, at any length."""
    rng = np.random.default_rng(2)
    models = L.Models(L.Alphabet({97: 1, 98: 1}), {"x": (np.zeros(0, np.uint64), np.zeros(0))})
    draw = lambda n: (lambda chars: (3 + rng.normal(0, 1, n) * np.sqrt(0.01 + 4 / chars), chars))(rng.integers(5, 2000, n).astype(float))
    models.calibrate([draw(5000)], 0.01)
    bits, chars = draw(50000)
    for own in (chars < 100, chars >= 100, chars > 0):
        share = (bits > models.limit(np.zeros(len(chars), int), chars))[own].mean()
        assert 0.004 < share < 0.02
