import hashlib
import tarfile
import zlib
from pathlib import Path

from zonarium.llm import media as M


def test_png_round_trip():
    for t in (None, "", "a", "x" * 576, "é" * 400, "z" * 100_000):
        samples, n = M.payload_of(t)
        raw = (t or "").encode()
        assert n == len(raw) and samples.startswith(raw) and len(samples) % 576 == 0 and len(samples) >= 576
        assert set(samples[n:]) <= {255} and len(samples) - n < 577
        stored = M.encode_png(samples)
        assert M.decode_png(stored) == samples
        assert M.png_header(stored[:33]) == (24, len(samples) // 24, 8)


def test_columns(spark, tmp_path):
    texts = [None, "", "abc", "abc", "é" * 5000, "w" * 576, "Abc"]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "abc", 1), (2, "abc", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(2)
    index = M.store_media(df, str(tmp_path))
    got = M.media_features(index).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = dict(zip(range(len(texts)), texts)).get(r.doc_id, "abc") or ""
        samples, n = M.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]))
        assert by.setdefault(text, r[2:]) == r[2:]
        assert r.feature == f"24x{len(samples) // 24}x8;" + M.feature_of(samples)
    for p in Path(tmp_path).glob("*.tar"):
        with tarfile.open(p) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            for m in tar:
                assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name[3:-4]


def test_empty(spark):
    assert M.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
