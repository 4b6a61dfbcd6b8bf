"""Pack tokenized documents into sequences: Martello-Toth dominance reduction, then best fit.

How many pieces have each length is all that packing needs, and that is at most ``capacity`` numbers. The
reduction and best fit therefore work on lengths with multiplicities, whatever the number of documents; their
result is a plan of at most some thousand rows that says where the r-th piece of a length goes. Spark counts the
lengths, ranks the pieces within their length, and joins them with the plan.

Defined cases: a NULL text is empty and gives one piece that holds the end token alone; longer documents are cut
into pieces of ``capacity`` and a shorter last one; rows that repeat are separate documents; an empty table gives
an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import running_start
from daybook.session import materialize

CAPACITY = 2048
END_ID = 0
MEMO_ENTRIES = 200_000  # of words a Python worker remembers; bounds its memory only
MEMO_CHARS = 48


# The steps of a tokenizer whose units can be found beforehand. Each is as its file states it.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# letters that lower-casing and composing leave single letters
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


class WordMemo(dict):
    """Token ids (4 bytes each) of a stretch of text without white space, remembered.

    A tokenizer of the above steps drops white space and starts a new unit there, so the ids of a text are those of its
    stretches in turn. Stretches of Latin letters and ASCII without an apostrophe are cut into units here and given to the
    tokenizer's model, which skips the steps before it; all others go to the tokenizer whole, and so do all texts of other
    tokenizers. What is remembered is a matter of speed alone.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.units = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = (spec[k] or {} for k in ("normalizer", "pre_tokenizer"))
        norm, pre = norm.get("normalizers", []), pre.get("pretokenizers", [])
        steps = ([x["type"] for x in norm], [x["type"] for x in pre])
        self.known = steps == STEPS and pre[0]["pattern"].get("Regex") == UNITS and not pre[1]["add_prefix_space"]
        self.simple = re.compile(f"[{LATIN}!-&(-~]+").fullmatch
        self.cut = re.compile(f"[{LATIN}]+|[0-9]|[^{LATIN}0-9]+").findall
        # the letters that stand for bytes: printable ones for themselves, the others from 256 on
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letter = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in own)}

    def encode(self, s: str) -> bytes:
        import array

        return array.array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def unit(self, s: str) -> bytes:
        import array

        s = s.lower()
        got = self.units.get(s)
        if got is None:
            raw = s if s.isascii() else s.encode().decode("latin-1").translate(self.letter)
            got = array.array("I", [x.id for x in self.model.tokenize(raw)]).tobytes()
            if len(self.units) < MEMO_ENTRIES:
                self.units[s] = got
        return got

    def __missing__(self, s: str) -> bytes:
        if len(s) > MEMO_CHARS:
            return self.encode(s)
        got = b"".join([self.unit(x) for x in self.cut(s)]) if self.simple(s) else self.encode(s)
        if len(self) < MEMO_ENTRIES:
            self[s] = got
        return got

    def text(self, s: str) -> bytes:
        # special tokens, and characters that split() takes for white space but the tokenizer doesn't
        if not self.known or any(x in s for x in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
            return self.encode(s)
        return b"".join([self[x] for x in s.split()])


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tokenizers

        # kept by the worker process from task to task
        memos = tokenizers.__dict__.setdefault("_word_memos", {})
        if tokenizer_path not in memos:
            memos[tokenizer_path] = WordMemo(tokenizer_path)
        memo, end = memos[tokenizer_path], int(end_id).to_bytes(4, "little")
        step = 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            out = []
            for key, s in zip(batch["_id"], batch["_text"], strict=True):
                ids = memo.text(s or "") + end
                out += [(key, i // step, i // 4, min(step, len(ids) - i) // 4, ids[i : i + step]) for i in range(0, len(ids), step)]
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    # the id passes Python as a string: pandas would turn integers beside NULLs into floats
    src = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    got = src.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids binary")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


@dataclass
class Bins:
    """``count`` bins that are filled alike: ``items`` are (length, how many, offset of the first)."""

    count: int
    used: int
    items: list[tuple[int, int, int]]


def dominant_set(j: int, order: list[int], left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates every other set a bin could hold with ``j``; None if none is proven.

    ``left`` has how many pieces of each length there are, ``order`` its lengths, sorted. A set dominates another if
    the other's pieces can be dealt to different pieces of the set so that each deal is no longer than the piece it
    stands for: then swapping them never needs another bin. Proven cases, with the room r that ``j`` leaves:
    1. nothing fits in r: j alone;
    2. the longest that fits fills r, or no two pieces fit in r together: j with the longest that fits;
    3. at most two fit in r together, and the best pair is no longer than the longest single: j with that single;
    4. at most two fit, the best pair (a, b) holds the longest single as a, and no pair fits whose shorter piece is
       longer than b: every pair (x, y) has x <= a and y <= b, so j with (a, b).
    Taking pieces away breaks none of these while the set itself is left, so it may be fixed as often as it is there.
    """
    import bisect

    room = capacity - j
    rest = lambda n: left[n] - (n == j)
    end = bisect.bisect_right(order, room)
    if end and not rest(order[end - 1]):
        end -= 1
    if not end:
        return (j,)
    longest = order[end - 1]
    small: list[int] = []
    for n in order[: min(end, 4)]:
        small += [n] * min(3, rest(n))
    if longest == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, longest)
    if len(small) > 2 and sum(small[:3]) <= room:
        return None
    sizes = [n for n in order[:end] if rest(n)]
    best, lo = None, 0
    for hi in range(len(sizes) - 1, -1, -1):  # two pointers over the lengths
        while lo <= hi and sizes[lo] + sizes[hi] <= room:
            lo += 1
        k = min(lo - 1, hi)
        if k == hi and rest(sizes[hi]) < 2:
            k -= 1
        if k >= 0 and (best is None or sizes[hi] + sizes[k] > sum(best)):
            best = (sizes[hi], sizes[k])
        if best and sizes[hi] * 2 < sum(best):
            break
    if best is None or longest >= sum(best):
        return (j, longest)
    longer = [n for n in sizes if n > best[1]]
    pairs = [n for n in longer[:2] for _ in range(min(2, rest(n)))][:2]
    return (j, *best) if best[0] == longest and (len(pairs) < 2 or sum(pairs) > room) else None


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``counts`` (pieces by length, 1 to ``capacity``): dominance reduction until nothing is proven, then
    best fit of what is left, longest first."""
    left = {n: c for n, c in counts.items() if c > 0}
    order, done, changed = sorted(left), [], True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (got := dominant_set(j, order, left, capacity)):
                need = {n: got.count(n) for n in got}
                times = min(left[n] // k for n, k in need.items())
                done.append(filled(times, need))
                for n, k in need.items():
                    left[n] -= k * times
                    if not left[n]:
                        del left[n]
                        order.remove(n)
                changed = True
    return done + best_fit(left, capacity)


def filled(times: int, need: dict[int, int]) -> Bins:
    at, items = 0, []
    for n in sorted(need, reverse=True):
        items.append((n, need[n], at))
        at += n * need[n]
    return Bins(times, at, items)


def best_fit(left: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing with multiplicities: each length goes to the fullest bins that take it, as often as it fits."""
    import bisect

    groups: list[Bins] = []
    room: list[tuple[int, int]] = []  # (free, index in groups), sorted
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(room, (n, -1))
            if at == len(room):
                per = capacity // n
                whole, part = divmod(todo, per)
                for count, k in ((whole, per), (1 if part else 0, part)):
                    if count:
                        groups.append(Bins(count, k * n, [(n, k, 0)]))
                        bisect.insort(room, (capacity - k * n, len(groups) - 1))
                break
            free, g = room.pop(at)
            b, per = groups[g], free // n
            whole, part = divmod(todo, per)
            takes = [(min(whole, b.count), per)]
            if whole < b.count and part:
                takes.append((1, part))
            spare = b.count - sum(c for c, _ in takes)
            base, used = b.items, b.used
            todo -= sum(c * k for c, k in takes)
            b.count = 0
            for count, k in takes:
                if count:
                    groups.append(Bins(count, used + k * n, [*base, (n, k, used)]))
                    bisect.insort(room, (capacity - used - k * n, len(groups) - 1))
            if spare:
                groups.append(Bins(spare, used, base))
                bisect.insort(room, (free, len(groups) - 1))
    return [b for b in groups if b.count]


def plan_rows(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence, offset of the first)."""
    rows, taken, sequence = [], {}, 0
    for b in bins:
        for n, k, at in b.items:
            first = taken.get(n, 0)
            taken[n] = first + k * b.count
            rows.append((n, first, taken[n], sequence, k, at))
        sequence += b.count
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with doc_id, piece, start, length, ids and, new, sequence_id and offset.

    The plan is broadcast: its rows are bounded by ``capacity`` alone (a length opens at most four groups of bins,
    and a bin holds fewer than 2 * sqrt(capacity) different lengths), not by the documents.
    """
    spark = cut.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan_rows(plan_lengths(counts, capacity))
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _seq long, _per long, _at long")
    order = ["_shuffle", "doc_id", "piece"]
    keyed = cut.withColumn("_shuffle", F.xxhash64("doc_id", "piece")).withColumn("_bucket", F.pmod("_shuffle", F.lit(1024))).withColumn("_one", F.lit(1))
    ranked = running_start(keyed, ["length"], "_bucket", order, "_one", "_rank")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["_rank"] >= plan["_from"]) & (ranked["_rank"] < plan["_to"]))
        .drop(plan["length"])
        .withColumn("sequence_id", F.expr("_seq + (_rank - _from) div _per"))
        .withColumn("offset", F.expr("_at + (_rank - _from) % _per * length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    instead_of_ids: dict[str, Column] | None = None,
) -> DataFrame:
    """Tokenize once (kept as a table in the shared folder), then pack. ``instead_of_ids``: columns made from ``ids`` that
    take its place, for callers who need no ids in the result; then no ids are kept or shuffled."""
    cut = pieces(docs, tokenizer_path, id_col=id_col, text=text, capacity=capacity, end_id=end_id)
    if instead_of_ids is not None:
        cut = cut.withColumns(instead_of_ids).drop("ids")
    return pack(materialize(cut, "packing-pieces"), capacity)
