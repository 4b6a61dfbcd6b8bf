"""Substring dedup by fixed-block anchors: words inside a passage that also starts earlier go.

A window is ``window`` consecutive words of one document. Any of them contains a whole block that starts at a multiple of
``window // 2`` words, so it is enough to index these non-overlapping blocks and to probe them with every rolling window of a
block's length:

1. Texts are cut into parts of some megabytes, kept compressed. A part sends the hash of each distinct rolling block once, with
   marks for "also an indexed block here" and "more than once here"; equal hashes of all parts meet, and those that are an
   indexed block and occur twice are hits. A part gets one bit back for each hash that it sent.
2. A part extends its hits: each window whose anchor would lie on a hit gets a 96-bit key. Per part the earliest of equal
   windows is sent to meet those of the other parts, and again one bit comes back: not the earliest of all.
3. These windows, and those that come later in their own part, are the repeats. Runs of adjacent repeats are the maximal
   passages to remove.

So a passage that occurs a million times costs one row a part, whichever it is, and no pairs of occurrences are made. Parts that
meet are sized by the text there is. False hits of step 1 only cost a key in step 2. What a part sends depends on its texts
alone, so later steps work it out again instead of keeping it.

Defined cases: words are runs without ASCII white space, unchanged; a NULL or empty text has no words; "earlier" is a smaller
(id, first word), ids being integers with NULL after all others; windows at the same place of rows with the same id are
equally early, so rows that repeat as a whole do not remove one another; texts shorter than a window are kept whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.session import materialize

WINDOW = 20
PART_BYTES = 4 << 20  # text of a part; a longer document is a part of its own
TASK_PARTS = 8  # parts of a task, so that a batch of rows stays small
BUCKET_BYTES = 16 << 20  # text whose hashes meet in one group
REST = 28  # bits of a block's hash beside those of its bucket
LAST = 2**63 - 1  # place of a NULL id
CHUNK = 1 << 17  # bytes hashed at once, unless a word is longer
_B0, _B1, _B2 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(size, b, np.uint64)))) for b in (_B0, np.uint64(pow(int(_B0), -1, 2**64))))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words raw[start:end]: polynomials of their bytes, read off running sums."""
    out, at = np.empty(len(start), np.uint64), 0
    power, inverse = powers(CHUNK)
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        size = int(end[to - 1] - base)
        if size >= len(power):
            power, inverse = powers(size)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw[base : base + size].astype(np.uint64) + np.uint64(1)) * power[:size])))
        a, b = start[at:to] - base, end[at:to] - base
        out[at:to] = (run[b] - run[a]) * inverse[a] + (b - a).astype(np.uint64) * _B2
        at = to
    return mixed(out)


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all windows, by doubling; mixed, so that the top bits are even."""
    n, power, out, done, step = 1, int(base), None, 0, h
    while True:
        if width & 1:
            rest = step[done:]  # comes after the words that are in already
            out, done = (step if out is None else out[: len(rest)] * np.uint64(power) + rest), done + n
        width >>= 1
        if not width:
            break
        step = step[: len(step) - n] * np.uint64(power) + step[n:] if len(step) > n else step[:0]
        n, power = 2 * n, power * power % 2**64
    return mixed(out)


def planes(values: np.ndarray) -> bytes:
    """The bytes of the values, lowest bytes of all first, compressed: small numbers leave whole planes empty."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def deltas(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def from_deltas(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(from_planes(raw, kind), dtype=kind)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class Part:
    """Texts of some documents in the order of their ids: where their words are, and the words' hashes."""

    def __init__(self, blob: bytes) -> None:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(plain[:8], "little")
        head = np.frombuffer(plain, np.int64, 2 * n, 8)
        self.ids, sizes = head[:n], head[n:]
        self.text = plain[8 + 16 * n :]
        raw = np.frombuffer(self.text, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        begin = np.cumsum(sizes) - sizes
        self.first = np.searchsorted(self.start, begin)  # of each document's words among those of the part
        self.length = np.diff(self.first, append=len(self.start))
        self.hash = word_hashes(raw, self.start, self.end)

    @staticmethod
    def blob(ids: list[int], texts: list[bytes]) -> bytes:
        import zstandard

        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        head = np.array([ids[i] for i in order] + [len(texts[i]) + 1 for i in order], np.int64).tobytes()
        return zstandard.ZstdCompressor(3).compress(len(ids).to_bytes(8, "little") + head + b"".join(texts[i] + b" " for i in order))

    def words(self, doc: int) -> list[bytes]:
        a, b = self.first[doc], self.first[doc] + self.length[doc]
        return [] if a == b else self.text[self.start[a] : self.end[b - 1]].split()

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per word: whether a window of that width fits its document from there, and the word's number in it."""
        place = np.arange(len(self.hash)) - np.repeat(self.first, self.length)
        return place + width <= np.repeat(self.length, self.length), place

    def codes(self, block: int, bucket_bits: int) -> np.ndarray:
        return rolling(self.hash, block, _B1) >> np.uint64(64 - bucket_bits - REST)

    def distinct(self, block: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct codes of rolling blocks; which are an indexed block here, and which occur more than once."""
        code = self.codes(block, bucket_bits)
        fits, place = (x[: len(code)] for x in self.starts(block))
        both = np.sort((code[fits] << np.uint64(1)) | (place[fits] % block == 0).astype(np.uint64))
        code = both >> np.uint64(1)
        last = np.flatnonzero(np.concatenate((code[1:] != code[:-1], [True]))[: len(code)])
        return code[last], (both[last] & np.uint64(1)).astype(bool), np.diff(last, prepend=-1) > 1


def ranges(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of an ascending array."""
    if not len(bucket):
        return []
    edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def told(masks: list, slots: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The bits that came back, by (bucket, from, to) of what was sent."""
    out, by = np.zeros(n, bool), {m["bucket"]: m["mask"] for m in masks}
    for bucket, a, b in slots:
        if bucket in by:
            out[a:b] = from_bits(by[bucket], b - a)
    return out


def cut(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(part, data): the texts of some documents, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b["_id"].tolist(), b["_text"], strict=True):
                raw = (t or "").encode("utf-8", "replace")
                if held and held + len(raw) > PART_BYTES:
                    yield pd.DataFrame({"part": [part], "data": [Part.blob(ids, texts)]})
                    part, ids, texts, held = part + 1, [], [], 0
                ids.append(i)
                texts.append(raw)
                held += len(raw) + 16
        if ids:
            yield pd.DataFrame({"part": [part], "data": [Part.blob(ids, texts)]})

    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.col(text).alias("_text"))
    return src.mapInPandas(run, "part long, data binary")


def by_part(masks: DataFrame) -> DataFrame:
    """(part, masks): of one part as many bits as it has words, at most."""
    return masks.groupBy("part").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))


def hits(parts: DataFrame, block: int, bucket_bits: int) -> DataFrame:
    """(part, bucket, mask): which of the part's distinct rolling blocks are indexed somewhere and occur twice at least."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, blob in zip(b["part"], b["data"], strict=True):
                code, indexed, many = Part(blob).distinct(block, bucket_bits)
                rest = (code & np.uint64((1 << REST) - 1)).astype(np.uint32)
                rows = [(bucket, int(part), deltas(rest[x:y]), bits(indexed[x:y]), bits(many[x:y]), y - x) for bucket, x, y in ranges(code >> np.uint64(REST))]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "part", "data", "indexed", "many", "n"], dtype=object)

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        rest = np.concatenate([from_deltas(x, np.uint32) for x in b["data"]])
        indexed, many = (np.concatenate([from_bits(x, n) for x, n in zip(b[c], b["n"], strict=True)]) for c in ("indexed", "many"))
        order = np.argsort(rest, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(rest[order]) != 0)))
        size = np.diff(at, append=len(rest))
        hit = ((size > 1) | np.logical_or.reduceat(many[order], at)) & np.logical_or.reduceat(indexed[order], at)
        keep = np.zeros(len(rest), bool)
        keep[order] = np.repeat(hit, size)
        return answers(b, keep)

    sent = parts.mapInPandas(send, "bucket int, part long, data binary, indexed binary, many binary, n int")
    return sent.groupBy("bucket").applyInPandas(meet, "part long, bucket int, mask binary")


def answers(b: pd.DataFrame, flag: np.ndarray) -> pd.DataFrame:
    """The flags of each packet, of those that have any."""
    edge = np.concatenate(([0], np.cumsum(b["n"].to_numpy().astype(np.int64))))
    rows = [(int(p), int(k), bits(flag[x:y])) for p, k, x, y in zip(b["part"], b["bucket"], edge[:-1], edge[1:], strict=True) if flag[x:y].any()]
    return pd.DataFrame(rows, columns=["part", "bucket", "mask"], dtype=object)


class Windows:
    """The windows of a part that lie on hits, by key; ``first`` are the earliest of equal ones in the part."""

    def __init__(self, p: Part, masks: list, window: int, block: int, bucket_bits: int) -> None:
        code, _, _ = p.distinct(block, bucket_bits)
        code = code[told(masks, ranges(code >> np.uint64(REST)), len(code))]
        mine = p.codes(block, bucket_bits)
        hit = code[np.minimum(np.searchsorted(code, mine), len(code) - 1)] == mine if len(code) else np.zeros(len(mine), bool)
        fits, place = p.starts(window)
        # the anchor of a window starts at one of its first ``block`` words
        before = np.concatenate(([0], np.cumsum(hit)))
        loc = np.flatnonzero(fits)
        loc = loc[before[np.minimum(loc + block, len(hit))] > before[loc]]
        k1 = rolling(p.hash, window, _B1)[loc]
        k2 = (rolling(mixed(p.hash * _B2), window, _B2)[loc] >> np.uint64(32)).astype(np.uint32)
        ids, start = p.ids[np.repeat(np.arange(len(p.ids)), p.length)[loc]], place[loc].astype(np.uint32)
        order = np.lexsort((start, ids, k2, k1))
        self.loc, self.k1, self.k2, self.ids, self.start = (x[order] for x in (loc, k1, k2, ids, start))
        new = np.concatenate(([True], (self.k1[1:] != self.k1[:-1]) | (self.k2[1:] != self.k2[:-1])))[: len(loc)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(loc)), 0)) if len(loc) else np.zeros(0, np.int64)
        self.first = (self.ids == self.ids[head]) & (self.start == self.start[head])

    def slots(self, bucket_bits: int) -> list[tuple[int, int, int]]:
        return ranges(self.k1[self.first] >> np.uint64(64 - bucket_bits))


def later(parts: DataFrame, window: int, block: int, bucket_bits: int) -> DataFrame:
    """(part, bucket, mask): which of the part's first windows are not the earliest of all equal ones. ``parts`` with masks."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, blob, masks in zip(b["part"], b["data"], b["masks"], strict=True):
                w = Windows(Part(blob), masks, window, block, bucket_bits)
                k1, k2, ids, start = (x[w.first] for x in (w.k1, w.k2, w.ids, w.start))
                rows = [(bucket, int(part), deltas(k1[x:y]), planes(k2[x:y]), planes(ids[x:y]), planes(start[x:y]), y - x) for bucket, x, y in w.slots(bucket_bits)]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "part", "k1", "k2", "ids", "start", "n"], dtype=object)

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        k1 = np.concatenate([from_deltas(x, np.uint64) for x in b["k1"]])
        k2, start = (np.concatenate([from_planes(x, np.uint32) for x in b[c]]) for c in ("k2", "start"))
        ids = np.concatenate([from_planes(x, np.int64) for x in b["ids"]])
        order = np.lexsort((start, ids, k2, k1))
        s1, s2 = k1[order], k2[order]
        new = np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late = np.zeros(len(order), bool)
        late[order] = (ids[order] != ids[head]) | (start[order] != start[head])
        return answers(b, late)

    sent = parts.mapInPandas(send, "bucket int, part long, k1 binary, k2 binary, ids binary, start binary, n int")
    return sent.groupBy("bucket").applyInPandas(meet, "part long, bucket int, mask binary")


def remove(parts: DataFrame, window: int, block: int, bucket_bits: int) -> DataFrame:
    """``parts`` with masks (of hits) and late (of first windows), each NULL where a part has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob, masks, late in zip(b["data"], b["masks"], b["late"], strict=True):
                p = Part(blob)
                gone = np.zeros(len(p.hash) + 1, np.int32)
                if masks is not None:
                    w = Windows(p, masks, window, block, bucket_bits)
                    first = w.loc[w.first]
                    known = told(late, w.slots(bucket_bits), len(first)) if late is not None else np.zeros(len(first), bool)
                    loc = np.concatenate((w.loc[~w.first], first[known]))
                    np.add.at(gone, loc, 1)
                    np.add.at(gone, loc + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for at in range(0, len(p.ids), 256):
                    out = []
                    for d in range(at, min(at + 256, len(p.ids))):
                        words, off = p.words(d), gone[p.first[d] : p.first[d] + p.length[d]]
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], off.view(np.int8), [0]))))
                        spans = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                        kept = words if not spans else [w for w, g in zip(words, off.tolist(), strict=True) if not g]
                        out.append((None if p.ids[d] == LAST else int(p.ids[d]), len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
                    yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "spans"], dtype=object)

    return parts.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the kept words joined by one blank, and the maximal passages that went, as
    word numbers [start, end)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bucket_bits = max(5, (size // BUCKET_BYTES).bit_length())
    written = materialize(cut(docs, id_col, text), "substring-parts")
    tasks = max(1, -(-written.count() // TASK_PARTS))
    hit = materialize(by_part(hits(written, block, bucket_bits)), "substring-hits")
    parts = written.repartition(tasks, "part")
    late = later(parts.join(hit, "part"), window, block, bucket_bits)
    late = materialize(by_part(late).withColumnRenamed("masks", "late"), "substring-late")
    return remove(parts.join(hit, "part", "left").join(late, "part", "left"), window, block, bucket_bits)
