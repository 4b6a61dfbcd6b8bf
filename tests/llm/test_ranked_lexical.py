import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from daybook.llm import ranked_lexical as rl

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    full = [(i, c, sum(c.values())) for i, c in bags if c]
    total, terms = len(full), sum(n for *_, n in full)
    df = Counter(w for _, c, _ in full for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = set()
    for item, ts in asked.items():
        found = []
        for i, c, n in full:
            m = 50 + 50 * n * total // terms
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ts if w in c)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out |= {(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])}
    return out


def fixture(seed):
    rnd = random.Random(seed)
    vocab = ["the", "Été", "x1", "9", "naïve", "漢字", "𝕏𝕐", "foo", "Bar", "b_c", "ÀB", "q", "zz", "İx"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(1, 30)))) for i in rnd.sample(range(1000), 120)]
    docs += [(2000 + i, docs[i % 3][1]) for i in range(60)]  # copies
    docs += [(3000 + i, " ".join(sorted(words(docs[0][1])))) for i in range(5)]  # the same bag in another order
    docs += [(4000, None), (4001, ""), (4002, " -- "), (None, docs[1][1]), (None, "foo foo"), docs[5], docs[5], (4003, "the " * 20_000 + "q")]
    items = [(i, " ".join(rnd.choices(vocab, k=6))) for i in range(6)] + [(6, None), (7, "unseen words"), (None, "foo"), (0, "q zz"), (8, "FOO été e")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, w double")
    rows = rl.search(d, q, **options).collect()
    assert len(rows) == len({(r.item_id, r["rank"]) for r in rows})
    return {tuple(r) for r in rows}


def test_against_every_document(spark):
    docs, items = fixture(1)
    assert run(spark, docs, items, k=10) == plain(docs, items, 10)
    assert run(spark, docs, items) == plain(docs, items, 50)


def test_vocabulary_beyond_a_task(spark):
    docs, items = fixture(2)
    assert run(spark, docs, items, k=7, in_task=3) == plain(docs, items, 7)


def test_equal_hashes_of_different_bags(spark):
    docs, items = fixture(3)
    few = lambda m, ids, tfs: [F.pmod(F.xxhash64(m, ids, tfs), F.lit(3)), F.lit(0).cast("long")]
    assert run(spark, docs, items, k=12, digest=few) == plain(docs, items, 12)


def test_empty(spark):
    docs, items = fixture(4)
    assert run(spark, [], items) == set() == run(spark, docs, []) == run(spark, [(1, None)], items)
