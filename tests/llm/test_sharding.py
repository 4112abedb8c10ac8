import hashlib
import random

import duckdb

from zonarium.llm import queries
from zonarium.llm import sharding as S


def brute(rows, limit):
    h = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    out = []

    def split(part, depth, prefix):
        size = sum(n for _, n in part)
        if size <= limit or len({d for d, _ in part}) < 2:
            out.extend((-1 if d is None else d, n, depth, prefix, size, size > limit) for d, n in part)
            return
        for bit in (0, 1):
            mine = [(d, n) for d, n in part if h(d) >> (59 - depth) & 1 == bit]
            if mine:
                split(mine, depth + 1, 2 * prefix + bit)

    if rows:
        split(rows, 0, 0)
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "é" * rng.choice([0, 1, 5, 30]), 1) for i in range(400)] + [(None, None, 1), (None, "abc", 1)] + [(7, "x" * 900, 1)] * 3 + [(1000, "y" * 2000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, depth int")
    sizes = [(d, len((t or "").encode())) for d, t, _ in docs]
    for limit in (100, 1500, 10**6):
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in S.assign_shards(df, limit).collect())
        assert got == brute(sizes, limit)


def test_steps_deeper(spark):
    df = spark.createDataFrame([(i, "x" * 9) for i in range(200)], "doc_id long, text string")
    sizes = df.select(S.hash_of(df.doc_id).alias("h"), S.F.lit(9).alias("n_bytes"))
    shards = S.directory(sizes, 30, step=1).collect()
    assert sum(r.docs for r in shards) == 200 and all(r.bytes <= 30 for r in shards)


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.QUERIES["op10_sharding"](spark, sf).collect())
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(duckdb.sql(queries.ORACLE["op10_sharding"]).fetchall())


def test_empty(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
