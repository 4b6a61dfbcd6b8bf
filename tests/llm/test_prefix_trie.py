import hashlib
import random
import zlib

from pyspark.sql import functions as F

from daybook.llm import prefix_trie as pt
from daybook.llm import q_trie


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain(convs):
    """``convs``: id -> list of turns. Walks a nested trie."""
    if not convs:
        return set()
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    saved, leaves = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        here = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = here + sum(saved[k] for k in kids.get(path, []))
        leaves[path] = sum(leaves[k] for k in kids.get(path, [])) or 1
    return {
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(c for c in m if len(convs[c]) == len(p)))
        for p, m in nodes.items()
    }


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def fixture(seed):
    rnd = random.Random(seed)
    texts = ["hi", "hé", "", None, "ok then", "漢", "x" * 500]
    rows = []
    for c in rnd.sample(range(0, 400), 160):
        start = rnd.choice([[("system", "be kind")], [("user", "hi"), ("assistant", "hello")], []])
        turns = start + [(rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts)) for _ in range(rnd.randrange(0 if start else 1, 9))]
        rows += [(c, n, r, t) for n, (r, t) in enumerate(turns)]
    same = [(n, "user", f"turn {n % 3}") for n in range(6)]
    rows += [(1000 + c, *t) for c in range(60) for t in same]  # copies
    rows += [(2000, n, "user", "a") for n in range(1500)] + [(2005, n, "user", "a") for n in range(1498)]  # long
    rows += [(2001, None, "user", "first"), (2001, 0, "b", "x"), (2001, 0, "a", "y"), (2001, 0, "a", "y"), (2001, -3, None, None)]
    rows += [(None, 0, "user", "lost"), (2002, 7, None, None), (-12, 0, "user", "hi")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, bytes string").repartition(5)


def nodes_of(df):
    rows = df.collect()
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = {tuple(r[c] for c in cols) for r in rows}
    assert len(got) == len(rows)
    return got


def own(df):
    t = pt.ordered_turns(df)
    convs = t.groupBy("conv_id").agg(F.count("*").alias("length"))
    return t.withColumn("depth", F.col("pos") + 1), convs


def test_trie_of_whole_conversations(spark, monkeypatch):
    rows = fixture(1)
    turns, convs = own(frame(spark, rows))
    want = plain(ordered(rows))
    assert nodes_of(pt.prefix_trie(turns, convs)) == want
    monkeypatch.setattr(pt, "BLOCK", 4)  # conversations of several blocks
    got = pt.prefix_trie(turns, convs)
    assert nodes_of(got) == want and got.select("digest").distinct().count() == len(want)


def test_crowded_sketch_changes_nothing(spark):
    rows = fixture(2)
    turns, convs = own(frame(spark, rows))
    assert nodes_of(pt.prefix_trie(turns, convs, cell_bits=3)) == plain(ordered(rows))


def test_estimates_prove_singles(spark):
    rows = fixture(3)
    turns, _ = own(frame(spark, rows))
    p = turns.select("conv_id", F.col("t1").alias("d1"), F.col("t2").alias("d2"))
    got = pt.proven_single(p, 26).join(p.groupBy("d1", "d2").agg(F.count("*").alias("n")), ["d1", "d2"]).select("single", "n").collect()
    assert all(r.n == 1 for r in got if r.single)
    assert sum(r.single for r in got) >= 0.95 * sum(r.n == 1 for r in got) > 0


def test_rebuilt(spark):
    rows = fixture(4)
    have = ordered(rows)
    want = {}
    for c, turns in have.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c - 5 * int(c / 5))
        want[c] = have.get(base, [])[:h] + turns[h:]
    assert [] in want.values()
    assert nodes_of(pt.prefix_trie(*q_trie.rebuilt(frame(spark, rows)))) == plain(want)


def test_empty(spark):
    for rows in ([], [(None, 0, "user", "x")]):
        assert nodes_of(pt.prefix_trie(*q_trie.rebuilt(frame(spark, rows)))) == set()
