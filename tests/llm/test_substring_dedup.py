import random

import numpy as np

from daybook.llm import substring_dedup as sd


def plain(docs, window):
    """Per row: kept words and removed spans, from every window of every row."""
    words = [(t or "").encode().split() for _, t in docs]
    place = lambda i: (i is None, i or 0)
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            first[key] = min(first.get(key, (place(i), at)), (place(i), at))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < (place(i), at):
                gone |= set(range(at, at + window))
        spans, kept = [], []
        for n, x in enumerate(w):
            if n not in gone:
                kept.append(x.decode())
            elif spans and spans[-1][1] == n:
                spans[-1] = (spans[-1][0], n + 1)
            else:
                spans.append((n, n + 1))
        out.append((i, len(w), len(w) - len(kept), " ".join(kept), tuple(spans)))
    return sorted(out, key=str)


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, kept string").repartition(6)
    rows = sd.drop_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, tuple(tuple(s) for s in r.spans)) for r in rows), key=str)


def fixture(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É,", "a b", "漢字", " "]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "\t ", "  "]) for _ in range(n))
    passages = [text(rnd.randrange(15, 60)) for _ in range(12)]
    docs = []
    for i in rnd.sample(range(-500, 5000), 150):
        parts = [text(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), text(rnd.randrange(0, 25))]
        docs.append((i, "".join(parts)))
    docs += [(6000 + i, docs[i % 4][1]) for i in range(40)]  # copies
    docs += [(7000 + i, docs[0][1].replace("w1", "v1", 1)) for i in range(30)]
    docs += [(8000, None), (8001, ""), (8002, " \n"), (8003, "one two"), (8004, "same " * 3000), (8005, "same " * 50), (8006, "a b c " * 400)]
    docs += [(None, docs[3][1]), (None, passages[0]), docs[5], docs[5], (docs[7][0], text(50) + passages[1])]
    return docs


def test_against_every_window(spark):
    docs = fixture(1)
    assert run(spark, docs) == plain(docs, 20)


def test_other_windows_and_parts(spark, monkeypatch):
    docs = fixture(2)
    for window, size in ((2, 500), (7, 2000), (21, 900), (40, 3000)):
        monkeypatch.setattr(sd, "PART_BYTES", size)
        assert run(spark, docs, window=window) == plain(docs, window)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, "", ()), (2, 0, 0, "", ())]


def test_rolling_hash_depends_on_order_and_window_only():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**64, 200, dtype=np.uint64)
    for width in (1, 2, 3, 7, 10, 13, 20):
        got = sd.rolling(np.concatenate([h, h[50:]]), width, sd._B1)
        assert len(got) == 350 - width + 1 and len(np.unique(got[: 200 - width + 1])) == 200 - width + 1
        assert (got[50 : 200 - width + 1] == got[200:]).all()
    assert len(sd.rolling(h[:5], 10, sd._B1)) == 0


def test_packed_numbers():
    x = np.sort(np.random.default_rng(2).integers(0, 2**63, 99, dtype=np.uint64))
    flags = np.random.default_rng(3).random(99) < 0.5
    assert (sd.from_bits(sd.bits(flags), 99) == flags).all()
    assert (sd.from_deltas(sd.deltas(x), np.uint64) == x).all() and (sd.from_planes(sd.planes(x), np.uint64) == x).all()
    assert len(sd.from_deltas(sd.deltas(x[:0]), np.uint64)) == 0
