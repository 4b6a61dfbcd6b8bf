"""SimHash near-duplicates: a binary trie self-join over fingerprints.

The join walks pairs of trie nodes together, adds up the bits in which their paths differ, and drops a pair whose
sum exceeds the budget. Walking from one root would meet nearly all pairs of upper nodes, so fingerprints are first
cut into blocks of bits: of ``budget + c`` blocks two linked fingerprints agree in c at least. There is one trie
forest per choice of c blocks; its paths start with the bits of those blocks, which must be equal, and the walk
starts below them. c grows with the number of fingerprints, so that few share a start.

Only components are asked for, so a node pair whose fingerprints are all known to be in one component is dropped
too; a dense group of near copies costs about its size, not its square.

More than one fingerprint per text (``seeds``) links texts that are near in any of them, for callers who want most pairs of
a given similarity rather than one fixed rule.

Defined cases: a NULL or empty text has fingerprint 0, linked like any other; fewer words than a shingle make one
shingle; equal fingerprints are one node; a NULL id is never a component's id unless all ids of it are NULL; rows that
repeat are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.session import materialize

BUDGET = 4
SHINGLE = 4
GROUP = 8192  # fingerprints of one start in one task; larger groups are dealt out as pairs of parts
START_LOAD = 512  # wanted fingerprints per start, at most


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles in order, in parts; none of a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return
    digest, flat = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    ends = start[min(shingle, len(words)) :][:n] - 1
    for at in range(0, n, 65_536):
        a, b = start[at : min(at + 65_536, n)].tolist(), ends[at : at + 65_536].tolist()
        yield np.fromiter((digest(flat[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprint(text: str | None, shingle: int, seeds: int = 1) -> np.ndarray:
    """64-bit SimHashes; a bit is set if it is in over half of the shingles' hashes. The first has the hashes as they are,
    each further one mixes them anew."""
    n, count = 0, np.zeros((seeds, 64), np.int64)
    for h in shingle_hashes(text, shingle):
        n += len(h)
        for k in range(seeds):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            count[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * count > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seeds: int = 1) -> DataFrame:
    """(doc_id, hash, fps): a hash of the text, and its fingerprints as signed longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["_id"], "hash": b["_hash"], "fps": [fingerprint(t, shingle, seeds).view(np.int64) for t in b["_text"]]})

    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return src.mapInPandas(run, "doc_id string, hash long, fps array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))


def blocks(count: int, budget: int = BUDGET) -> tuple[list[tuple[int, int]], int]:
    """(first bit, bits) of each block, and how many must agree."""
    for c in range(1, 5):
        m = budget + c
        if count <= START_LOAD << (64 // m * c):
            break
    edge = [64 * i // m for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(m)], c


def starts(fp: Column, cut: list[tuple[int, int]], c: int) -> Column:
    """Array of (forest, start, path): which blocks are chosen, the bits of the chosen blocks, and all bits with those first."""

    def put(order: list[int], end: int) -> Column:
        out, at = F.lit(0).cast("long"), end
        for i in order:
            low, width = cut[i]
            at -= width
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), at))
        return out

    made = []
    for t, chosen in enumerate(combinations(range(len(cut)), c)):
        rest = [i for i in range(len(cut)) if i not in chosen]
        width = sum(cut[i][1] for i in chosen)
        made.append(F.struct(F.lit(t).alias("forest"), put(list(chosen), width).alias("start"), put([*chosen, *rest], 64).alias("path")))
    return F.array(*made)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i[k] and j[k]: each row's label is the least row of its component."""
    while True:
        a, b = label[i], label[j]
        odd = a != b
        if not odd.any():
            return label
        i, j, a, b = i[odd], j[odd], a[odd], b[odd]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def walk(path: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, budget: int, label: np.ndarray) -> np.ndarray:
    """Join the rows of each [lo, hi) with one another; rows of a range are sorted by path and agree in ``depth`` bits."""
    changed = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    ones: dict[int, np.ndarray] = {}
    stack = [(int(d), lo[depth == d], hi[depth == d], lo[depth == d], hi[depth == d], np.zeros((depth == d).sum(), np.int64)) for d in np.unique(depth)]
    found = []
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        same = al == bl
        # a node with itself needs two rows, and rows of more than one component
        need = np.where(same, ah - al > 1, True) & ~((changed[ah - 1] == changed[al]) & (changed[bh - 1] == changed[bl]) & (label[al] == label[bl]))
        al, ah, bl, bh, err, same = (x[need] for x in (al, ah, bl, bh, err, same))
        if not len(al):
            continue
        # small pairs are compared row by row
        size = (ah - al) * (bh - bl)
        few = size <= 16 if d < 60 else size > 0
        if few.any():
            x, y, w, n = al[few], bl[few], (bh - bl)[few], size[few]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(w, n)
            i, j = np.repeat(x, n) + at // w, np.repeat(y, n) + at % w
            ok = (i != j) & (np.bitwise_count(path[i] ^ path[j]) <= budget)
            found.append((i[ok], j[ok]))
            al, ah, bl, bh, err, same = (x[~few] for x in (al, ah, bl, bh, err, same))
        if not len(al):
            continue
        if len(al) > 500_000:
            h = len(al) // 2
            stack += [(d, al[:h], ah[:h], bl[:h], bh[:h], err[:h]), (d, al[h:], ah[h:], bl[h:], bh[h:], err[h:])]
            continue
        if d not in ones:
            bit = (path >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        am, bm = ah - (ones[d][ah] - ones[d][al]), bh - (ones[d][bh] - ones[d][bl])
        far = err + 1
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, far), tuple(x[~same] for x in (am, ah, bl, bm, far))]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = (ah > al) & (bh > bl) & (err <= budget)
        stack.append((d + 1, al[ok], ah[ok], bl[ok], bh[ok], err[ok]))
    if not found:
        return label
    return merged(label, np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))


def trie_links(path: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, budget: int) -> np.ndarray:
    """Labels of the components within each range. Large ranges are walked with budgets 1, 2, ... so that what a small
    budget has joined need not be walked again."""
    label = np.arange(len(path))
    large = hi - lo > 256
    for b in range(1, budget) if large.any() else ():
        label = walk(path, lo[large], hi[large], depth[large], b, label)
    return walk(path, lo, hi, depth, budget, label)


def linked(batches: Iterator[pd.DataFrame], depths: list[int], budget: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by grp, then path; gives (a, b): nodes joined to the first of their component in their start."""

    def starts_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grp = rows["grp"].to_numpy()
        depth = np.array(depths)[(grp >> 40) & 0xFFF]
        return grp, rows["path"].to_numpy().view(np.uint64) >> (64 - depth).astype(np.uint64), depth

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        grp, start, depth = starts_of(rows)
        cut = np.concatenate(([0], np.nonzero((grp[1:] != grp[:-1]) | (start[1:] != start[:-1]))[0] + 1, [len(grp)]))
        lo, hi = cut[:-1], cut[1:]
        keep = hi - lo > 1
        node, path = rows["node"].to_numpy(), rows["path"].to_numpy().view(np.uint64)
        if not keep.any():
            return pd.DataFrame({"a": node[:0], "b": node[:0]})
        label = trie_links(path, lo[keep], hi[keep], depth[lo[keep]], budget)
        i = np.nonzero(label != np.arange(len(label)))[0]
        return pd.DataFrame({"a": node[i], "b": node[label[i]]})

    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        if len(held) >= 4 * GROUP:
            grp, start, _ = starts_of(held)
            last = np.nonzero((grp != grp[-1]) | (start != start[-1]))[0]
            if len(last):
                yield done(held.iloc[: last[-1] + 1])
                held = held.iloc[last[-1] + 1 :].reset_index(drop=True)
    if held is not None and len(held):
        yield done(held)


def near_pairs(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``fps``: seed, fp, node, distinct in (seed, fp). Gives (a, b), links of nodes that have the same components as all pairs
    of one seed within the budget."""
    most = fps.groupBy("seed").count().agg(F.max("count")).first()[0] or 0
    cut, c = blocks(most, budget)
    depths = [sum(cut[i][1] for i in chosen) for chosen in combinations(range(len(cut)), c)]
    rows = fps.select("seed", "node", F.inline(starts(F.col("fp"), cut, c)))
    hot = rows.groupBy("seed", "forest", "start").count().filter(F.col("count") > GROUP).withColumn("parts", F.ceil(F.col("count") / GROUP).cast("int")).drop("count")
    rows = rows.join(hot, ["seed", "forest", "start"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    # a start in one part meets itself; of more parts, each pair of two meets
    rows = rows.withColumn("_o", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, parts - 1), x -> x <> _p)"))))
    # one number for seed, forest and the pair of parts; the start is the head of the path
    pair = [F.shiftleft(x.cast("long"), n) for x, n in ((F.col("seed"), 52), (F.col("forest"), 40), (F.least("_p", "_o"), 20), (F.greatest("_p", "_o"), 0))]
    rows = rows.select((pair[0] + pair[1] + pair[2] + pair[3]).alias("grp"), "path", "node", "start")
    dealt = rows.repartition("grp", "start").drop("start").sortWithinPartitions("grp", "path")
    return dealt.mapInPandas(lambda b: linked(b, depths, budget), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, seeds: int = 1) -> DataFrame:
    """(doc_id, hash, fp, group, component_id): component_id is the least id reachable over fingerprints that differ in at most
    ``budget`` bits, group tells components apart even where ids don't."""
    rows = fingerprints(docs, id_col=id_col, text=text, shingle=shingle, seeds=seeds)
    rows = materialize(rows.withColumn("node", F.element_at("fps", 1) if seeds == 1 else F.xxhash64("fps")), "simhash")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("fps").alias("fps")), "simhash-nodes")
    each = nodes.select("node", F.posexplode("fps").alias("seed", "fp"))
    if seeds == 1:
        links = near_pairs(each, budget)
    else:  # texts that agree in one fingerprint but not in all
        same = materialize(each.groupBy("seed", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "simhash-same")
        equal = each.withColumnRenamed("node", "a").join(same.filter("n > 1").withColumnRenamed("node", "b"), ["seed", "fp"]).select("a", "b")
        links = near_pairs(same.drop("n"), budget).union(equal)
    roots = components(links).withColumnRenamed("node", "_node")
    nodes = nodes.join(roots, nodes["node"] == roots["_node"], "left").select("node", F.coalesce("root", "node").alias("group"), "least")
    least = nodes.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(least, "group").select("node", "group", "component_id"), "node").select(
        "doc_id", "hash", F.element_at("fps", 1).alias("fp"), "group", "component_id"
    )
