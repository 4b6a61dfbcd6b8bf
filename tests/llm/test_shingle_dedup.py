import random

import corpus_pipeline

from daybook.llm import shingle_dedup


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rnd, text, n):
    w = text.split()
    for k, i in enumerate(rnd.sample(range(0, len(w), 5), n)):
        w[i] = f"edit{rnd.randrange(10**9)}x{k}"
    return " ".join(w)


def brute_force(texts):
    at, sets = list(range(len(texts))), [shingles(t) for t in texts]

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return sorted({root(i) for i in range(len(texts))})


def stage(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())


def test_stage_keeps_the_rule_of_similarity(spark):
    """Pairs on both sides of 0.8: 7 to 11 edits of 400 words are about 0.84 to 0.76."""
    rnd = random.Random(3)
    texts, pairs = [], []
    for k in range(80):
        t = " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))
        texts += [t, edited(rnd, t, 5 + k % 12)]
        pairs.append(similarity(*map(shingles, texts[-2:])))
    assert sum(0.8 <= s < 0.86 for s in pairs) > 15 and sum(0.7 < s < 0.8 for s in pairs) > 15
    assert stage(spark, texts) == brute_force(texts)


def test_dense_group_with_leaders(spark, monkeypatch):
    """Copies of one text that are partly below 0.8 of one another, compared with leaders first."""
    monkeypatch.setattr(shingle_dedup, "FEW", 0)
    rnd = random.Random(4)
    base = " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
    texts = [edited(rnd, base, rnd.choice([1, 3, 6, 9])) for _ in range(60)] + [base, base]
    assert stage(spark, texts) == brute_force(texts)


def compared(monkeypatch):
    """Counts of the pairs that the sets decide."""
    counts, real = [], shingle_dedup.alike

    def count(pairs, sets, similarity):
        counts.append(pairs.count())
        return real(pairs, sets, similarity)

    monkeypatch.setattr(shingle_dedup, "alike", count)
    return counts


def test_dense_group_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    """Copies of one text, each with its own few edits, pairwise from 0.6 to 0.8: many share keys, few are links."""
    rnd, done = random.Random(5), {}
    base = " ".join(f"w{rnd.randrange(5000)}" for _ in range(120))
    counts = compared(monkeypatch)
    for n in (150, 300, 600):
        texts = [edited(rnd, base, rnd.choice([3, 3, 3, 4, 5])) for _ in range(n)]
        counts.clear()
        assert stage(spark, texts) == brute_force(texts)
        done[n] = sum(counts)
    # all pairs would be 4 times as many at each step
    assert done[600] < 2.6 * done[300] and done[600] < 20 * 600, done


def test_refined_keys_lose_no_pair(spark):
    """Every similar pair of a key is joined by the links or shares a refined key."""
    rnd = random.Random(6)
    base = [" ".join(f"w{rnd.randrange(900)}" for _ in range(n)) for n in (60, 90)]
    texts = list({edited(rnd, b, rnd.choice([0, 1, 2, 3])) for b in base for _ in range(60)}) + [base[0] + " " + " ".join(f"x{i}" for i in range(k)) for k in range(3, 30, 3)]
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame([(i, [hash(x) for x in s]) for i, s in enumerate(sets)], "node long, set array<long>")
    member = spark.createDataFrame([(k, i, len(s), i) for i, s in enumerate(sets) for k in (0, 1 + i % 2)], "key long, node long, n int, root long")
    got, links = shingle_dedup.refined(member, df, 0.8)
    keys, joined = {}, {frozenset((r.a, r.b)) for r in links.collect()}
    for r in got.collect():
        keys.setdefault(r.node, set()).add((r.key, r.side))
    both = shingle_dedup.BOTH

    def meet(i, j):
        return any((k, both) in keys.get(j, ()) if s == both else (k, 1 - s) in keys.get(j, ()) for k, s in keys.get(i, ()))

    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in joined:
        assert similarity(sets[a], sets[b]) >= 0.8
        root[find(a)] = find(b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 100
    assert all(find(i) == find(j) or meet(i, j) for i, j in pairs)


def test_odd_rows(spark):
    rnd = random.Random(7)
    long = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(20_000))
    t = " ".join(f"v{rnd.randrange(5000)}" for _ in range(100))
    rows = [
        (5, t, "x"), (3, t, "y"), (3, t, "y"), (None, t, "z"), (9, t.upper(), "u"), (10, edited(rnd, t, 1), "e"),  # one group
        (20, long, "l"), (21, long + " more", "m"),  # one group
        (30, None, "n"), (31, "", "o"), (32, " \n", "p"),  # no words: one group
        (40, "two words", "q"), (41, "Two  words", "r"),  # one shingle
        (None, "alone in its words here today", "s"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, hash string, node int, n int").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.hash) for r in got.collect()) == [(-1, "s"), (3, "y"), (20, "l"), (30, "n"), (40, "q")]
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, df.filter("hash = 's'"), "").count() == 1
