import corpus_pipeline as P
from zonarium.llm import common as C
from zonarium.llm import decontamination as D
from zonarium.llm import language_id as L
from zonarium.llm import mixing as M
from zonarium.llm import sharding as S
from zonarium.llm import simhash as H

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage keeps exactly what its operator's plain result says of that stage's input."""
    docs = C.read_table(spark, SF, "documents")
    bench = C.read_table(spark, SF, "benchmark")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    want = {
        "language_id": lambda d: {r.doc_id for r in L.identify(d).collect() if not r.rejected},
        "simhash_dedup": lambda d: {r.component_id for r in H.simhash_classes(d).collect()},
        "decontamination": lambda d: ids(d) - {r.doc_id for r in D.contaminations(d, bench).collect()},
        "mixing": lambda d: {r.doc_id for r in M.mixture(d).collect()},
        "sharding": ids,
    }
    for name, stage in P.STAGES:
        out = C.materialize(stage(spark, docs, SF), "test")
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert sorted(got) == sorted(want[name](docs)), name
        assert name == "sharding" or out.columns == docs.columns
        docs = out
    shards = {}
    for r in docs.collect():
        shards.setdefault((r.shard_depth, r.shard_prefix), []).append(r)
    assert all(sum(r.n_bytes for r in rows) == rows[0].shard_bytes <= P.SHARD_BYTES for rows in shards.values())
    assert S.BITS == 60
