import random

import numpy as np

from daybook.llm import hamming_topk as ht
from daybook.llm import permutation_ann as pa


def code_rows(n, seed):
    rnd = random.Random(seed)
    codes = [rnd.getrandbits(64) for _ in range(n)]
    near = [codes[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(n // 3)]
    every = codes + near + [codes[1]] * 40
    ids = rnd.sample(range(10 * len(every)), len(every))
    return [(i, c - 2**64 if c >= 2**63 else c) for i, c in zip(ids, every, strict=True)]


def plain_hamming(rows, q, k):
    code = dict(rows)[q]
    return sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**7 + i for i, c in rows if i != q)[:k]


def test_hamming(spark):
    for n, k in ((400, 10), (30, 3), (4, 10)):
        rows = code_rows(n, n)
        df = spark.createDataFrame([*rows, *rows[:2], (None, 5), (10**6, None)], "id long, code long")
        asked = [i for i, _ in rows[:: max(1, len(rows) // 12)]] + [rows[-1][0], rows[-2][0]]
        got = {}
        for r in ht.nearest(df, df.filter(df.id.isin(asked)).withColumnRenamed("id", "query_id"), k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.distance * 10**7 + r.id))
        assert set(got) == set(asked)
        for q, v in got.items():
            assert [x for _, x in sorted(v)] == plain_hamming(rows, q, k) and [x for x, _ in sorted(v)] == list(range(1, len(v) + 1))
    assert ht.nearest(df.limit(0), df.limit(0).withColumnRenamed("id", "query_id")).count() == 0
    assert ht.nearest(df.limit(1), df.limit(1).withColumnRenamed("id", "query_id")).count() == 0


def test_sign_code(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, -1.0, 0.0, 2.0],), ([],), (None,), ([1.0, None],), ([nan],), ([inf],), ([1.0] * 64,), ([1.0] * 65,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").coalesce(1).select(ht.sign_code(pa.F.col("v"))).collect()]
    assert got == [9, None, None, None, None, None, -1, None]


def vectors(n, d, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)).astype(np.float32)
    x[: n // 3] = x[0] + 0.01 * rnd.normal(size=(n // 3, d))
    x[n // 3 : n // 2] = x[n // 2]
    return x


def run_ann(spark, x, odd, **options):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "id long, vector array<float>, rank int").repartition(5)
    got = {}
    for r in pa.nearest(df, df.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.id))
    x, hits, total = x.astype(float), 0, 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        v = sorted(got[q])
        assert [r for r, *_ in v] == list(range(1, len(v) + 1)) and [(s, i) for _, s, i in v] == sorted((s, i) for _, s, i in v)
        assert all(abs(s - d[i]) < 1e-9 for _, s, i in v)
        hits, total = hits + len({i for *_, i in v} & set(best)), total + min(10, len(x) - 1)
    assert set(got) == set(range(0, len(x), 20))
    return hits / total


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(10**6, None, 1), (10**6 + 20, [0.0] * 24, 1), (10**6 + 40, [nan] + [1.0] * 23, 1), (10**6 + 60, [None] + [1.0] * 23, 1), (10**6 + 80, [inf] * 24, 1), (None, [1.0] * 24, 1), (10**6 + 100, [1.0] * 5, 1), (10**6 + 120, [], 1)]
    x = vectors(3000, 24, 1)
    assert run_ann(spark, x, odd) >= 0.95
    assert run_ann(spark, x, odd, block=400, query_block=50) >= 0.95
    assert run_ann(spark, x[:700], [(0, x[0].tolist(), 1)], least=10**6) == 1.0  # all exact
    assert run_ann(spark, vectors(5, 3, 2), []) == 1.0
    df = spark.createDataFrame([], "id long, vector array<float>")
    assert pa.nearest(df, df.withColumnRenamed("id", "query_id")).count() == 0
