import random
import re

from pyspark.sql import functions as F

from daybook.llm import license_scan as ls
from daybook.llm import mix_sources as ms

NOTICE = dict((label, t) for label, t, kind in ls.TEMPLATES if kind == "notice")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text):
    w = words(text)
    starts, base, labels, score = [], set(), set(), 0.0
    for label, t, kind in ls.TEMPLATES:
        p = t.split()
        if kind == "phrase":
            hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += hit
            if hit:
                base.add(label)
                labels.add(label)
                score = 1.0
        width = ls.STRIDE + max(len(x.split()) for _, x, _ in ls.TEMPLATES) - 1
        for b in range(0, len(w), ls.STRIDE):
            n = len(set(w[b : b + width]) & set(p))
            if kind == "notice" and n >= ls.need(p, ls.THRESHOLD):
                labels.add(label)
                score = max(score, n / len(set(p)))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def texts():
    rnd = random.Random(4)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "of", "and", "ÉTÉ", "Kelvin\u212a", "_x"]
    out = ["", None, "...", "Under the MIT License", "under the mitlicense; CC-BY-NC, cc by nc", "x" * 30_000, "under the m\u0130t license"]
    out += [" ".join(rnd.choices(pool, k=n)) for n in (5, 60, 63, 64, 65, 66, 67, 128, 900, 5000)]
    out += ["pad " * n + "Apache License,\nVersion 2.0" for n in (0, 59, 61, 62, 63, 64, 127)]
    for t in NOTICE.values():
        w = t.split()
        out += [" ".join(["pad"] * 50 + w), " ".join(["pad"] * 100 + w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2])]
    return out


def test_license_labels(spark):
    rows = [(i if i % 9 else None, t, 3) for i, t in enumerate(texts())]
    rows += rows[3:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = sorted(tuple(r) for r in ls.document_labels(df).select("_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect() if r._id is not None)
    assert got == sorted((i, *plain(t)) for i, t, _ in rows if i is not None)
    assert ls.document_labels(df).count() == len(rows)
    assert ls.document_labels(df.limit(0)).count() == 0


def plain_targets(sizes):
    """Weights shared again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    w = {k: ms.WEIGHTS[i % 3] for i, k in enumerate(names)}
    cap, total = {k: 3 * sizes[k] for k in names}, sum(sizes.values())
    full = set()
    while True:
        open_ = [k for k in names if k not in full]
        rest, rest_w = total - sum(cap[k] for k in full), sum(w[k] for k in open_)
        over = {k for k in open_ if w[k] * rest / rest_w > cap[k]}
        if not over:
            return {k: float(cap[k]) if k in full else w[k] * rest / rest_w for k in names}
        full |= over


def mix_rows():
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        s = rnd.choice(["a", "a", "a", "b", "", None, "é", "z", "tiny"] if i % 50 else ["one"])
        n = rnd.choice([0, 1, 5, 300, 2000]) if s != "tiny" else rnd.choice([0, 1])
        rows.append((i, None if n == 0 and i % 2 else " w\t" * n, s, 1))
    return rows + rows[:3] + [(None, "no id", "a", 1)]


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    pieces, docs = ms.mix(df, block_words=64)
    got = docs.collect()
    assert sorted((str(r._id), r._size) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _, _ in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = plain_targets(sizes), {}
    for r in got:
        s = None if r._key == "1" else r._key[1:]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r._size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    p = pieces.collect()
    assert sum(r.words for r in p) == sum(r.taken for r in got) and all(0 < r.words <= 64 for r in p)
    # every stretch of the schedule holds the sources close to their shares
    slots = {}
    for r in p:
        slots.setdefault(r.slot, set()).add(r._key)
    order = [next(iter(slots[k])) for k in sorted(slots)]
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    for key in set(order):
        share = order.count(key) / len(order)
        assert all(abs(order[:n].count(key) - n * share) < 8 for n in range(0, len(order), 7))
    again = ms.mix(df.repartition(2), block_words=64)[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert ms.mix(df.limit(0))[1].count() == 0
    assert ms.mix(df.filter("text is null"))[1].agg(F.sum("taken")).first()[0] == 0


def test_mixed_documents(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int")
    taken = {}
    for r in ms.mix(df)[1].collect():
        taken.setdefault(str(r._id), []).append(r.taken)
    out = ms.mixed_documents(df)
    assert out.columns == df.columns
    have = {}
    for r in out.collect():
        have[str(r.doc_id)] = have.get(str(r.doc_id), 0) + len(r.text.split())
    assert have == {k: sum(v) for k, v in taken.items() if sum(v)}
