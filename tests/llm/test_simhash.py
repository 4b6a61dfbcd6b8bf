import random

import numpy as np
import xxhash

from daybook.llm import simhash
from daybook.llm.components import components
from daybook.llm.simhash import blocks, near_duplicates, near_pairs


def plain_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, budget):
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rnd = random.Random(1)
    words = ["alpha", "Beta", "ÉTÉ", "x", "über", "日本", "to day"]
    base = [" ".join(rnd.choices(words, k=n)) + "\t\n" for n in (60, 300, 300, 5, 4, 3, 1)]
    texts = list(base)
    for t in base[:3] * 12:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, " \n", base[0], base[0], "z" * 3000]
    rows = [(i if i != 20 else None, t, 1) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    fps = [plain_fingerprint(t, 4) for t in texts]
    assert sorted((r.doc_id is None, r.doc_id, r.fp & (2**64 - 1)) for r in got) == sorted((i is None, i, f) for (i, _, _), f in zip(rows, fps, strict=True))
    comp = plain_components(fps, 4)
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None) for i in range(len(rows))}
    assert {r.doc_id: r.component_id for r in got} == want
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dense(n, volatile, seed):
    rnd = np.random.default_rng(seed)
    fps = rnd.integers(0, 2**64, n // 2, dtype=np.uint64)
    near = np.full(n - len(fps), fps[0])
    for b in rnd.choice(64, volatile, replace=False):
        near ^= (rnd.random(len(near)) < 0.35).astype(np.uint64) << np.uint64(b)
    return np.unique(np.concatenate([fps, near]))


def check_pairs(spark, fps):
    df = spark.createDataFrame([(0, int(x), int(x)) for x in fps.view(np.int64)], "seed int, fp long, node long")
    roots = {r.node: r.root for r in components(near_pairs(df)).collect()}
    s = fps.view(np.int64).tolist()
    comp = plain_components([int(x) for x in fps], 4)
    groups, ours = {}, {}
    for i, x in enumerate(s):
        groups.setdefault(comp[i], set()).add(x)
        ours.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))
    assert all(k == min(v) for k, v in ours.items())


def test_pairs_against_brute_force(spark, monkeypatch):
    check_pairs(spark, dense(1500, 24, 3))
    monkeypatch.setattr(simhash, "GROUP", 100)  # groups in several parts
    check_pairs(spark, dense(1200, 14, 4))
    monkeypatch.setattr(simhash, "START_LOAD", 0)  # the most blocks
    assert len(blocks(1000)[0]) == 8
    check_pairs(spark, dense(600, 14, 5))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, **{1001 + i: 1000 for i in range(300)}}
