"""Trie of conversation prefixes with count-min screening.

Every prefix of a conversation is a node, named by a digest. The digest is the running XOR of hashes of (place, turn), so a
conversation need not be read in order by one task. A count-min sketch counts the digests: a prefix's cell counts are never
too small, so a count of one proves that no other conversation has it, nor any longer one. From the first such prefix on, a
conversation's nodes are its own and are made on the spot; only prefixes before it, which others may share, are shuffled and
grouped exactly by digest.

Sums over subtrees need no walk: a node's conversation with the least id stands for it, and as that conversation passes
through all nodes above, a running sum from its end and one grouping by prefix add up every subtree.

The sketch has about 8 cells a prefix, at most 2^``CELL_BITS`` in each of its two rows; only one bit a cell (more than one
prefix met it) goes to the tasks, 16 MB at most. Where a table outgrows it, fewer prefixes are proven single and more are
grouped; the result is the same.

Defined cases: NULL conversation ids take no part; a NULL role or text is empty; turns of equal number are ordered by role,
then text, and rows that repeat are turns of their own; a conversation may have no turns and is then a member of the root
only; an empty table gives an empty result, without a root; other columns are ignored. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import running_start
from daybook.session import materialize

CELL_BITS = 26
BLOCK = 1024  # turns of one conversation in one window
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "d1", "d2"]


def ordered_turns(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, bytes): place from 0, a digest of role and text, and the UTF-8 length of the text."""
    own = rows.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).alias("one")
    )
    # a long conversation is numbered in blocks of turn numbers
    own = own.withColumn("block", F.coalesce(F.floor(F.col("turn") / 64), F.lit(-(2**62))))
    placed = running_start(own, ["conv_id"], "block", ["turn", "role", "text"], "one", "pos")
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = [F.conv(F.substring(sha, at, 16), 16, -10).cast("long") for at in (1, 17)]
    return placed.select("conv_id", "pos", half[0].alias("t1"), half[1].alias("t2"), F.octet_length("text").cast("long").alias("bytes"))


def running(df: DataFrame, key: str, place: Column, sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Add running sums and XORs up to and with each row, in the order of ``place`` (long, distinct in a key). A key's rows are
    cut into blocks, so that a long one is spread over tasks."""
    df = df.withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / BLOCK))
    names = [*sums, *xors]
    each = {n: (F.sum(c) if n in sums else F.bit_xor(c)) for n, c in {**sums, **xors}.items()}
    blocks = df.groupBy(key, "_block").agg(*[c.alias(n) for n, c in each.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over = {n: (F.sum(n) if n in sums else F.bit_xor(n)) for n in names}
    base = blocks.select(key, "_block", *[F.coalesce(c.over(before), F.lit(0)).alias(f"_{n}") for n, c in over.items()])
    inner = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    got = df.join(base, [key, "_block"])
    for n in names:
        here = each[n].over(inner)
        got = got.withColumn(n, F.col(f"_{n}") + here if n in sums else F.col(f"_{n}").bitwiseXOR(here))
    return got.drop("_place", "_block", *[f"_{n}" for n in names])


def crowded_cells(prefixes: DataFrame, bits: int) -> list[np.ndarray]:
    """Two rows of 2^bits cells as packed bits: set if more than one prefix was counted there."""
    rows = prefixes.select(F.inline(F.array(*[F.struct(F.lit(r).alias("r"), cell(r, bits).alias("cell")) for r in (0, 1)])))
    counts = rows.groupBy("r", "cell").count().filter("count > 1")
    part = F.shiftright("cell", 15).alias("part")
    maps = counts.groupBy("r", part).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    packed = [np.zeros(max(1, 1 << bits >> 15) * 4096, np.uint8) for _ in (0, 1)]
    for m in maps.collect():  # 2^bits / 8 bytes in all for each row
        packed[m.r][m.part * 4096 : (m.part + 1) * 4096] = np.frombuffer(m.bits, np.uint8)
    return packed


def cell(r: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(r), "d1", "d2"), 64 - bits)


def proven_single(prefixes: DataFrame, cell_bits: int) -> DataFrame:
    """``prefixes`` with ``single``: true only if the count-min estimate is one."""
    count = prefixes.count()
    bits = min(cell_bits, max(16, (8 * count).bit_length()))
    crowded = prefixes.sparkSession.sparkContext.broadcast(crowded_cells(prefixes, bits))

    @F.pandas_udf("boolean")
    def alone(a: pd.Series, b: pd.Series) -> pd.Series:
        met = [(m[c >> 3] >> (c & 7).astype(np.uint8)) & 1 for m, c in zip(crowded.value, (a.to_numpy(), b.to_numpy()), strict=True)]
        return pd.Series((met[0] & met[1]) == 0)

    return prefixes.withColumn("single", alone(cell(0, bits), cell(1, bits)))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node's ``ends``, streamed in that order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for b in batches:
            key = b[NODE].to_numpy(np.int64)
            cut = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(b)]
            out, ids = [], b["conv_id"].tolist()
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                joined = ",".join(map(str, ids[lo:hi])).encode()
                if node == tuple(key[lo]):
                    digest.update(b"," + joined)
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = tuple(key[lo]), hashlib.sha256(joined)
            if out:
                yield pd.DataFrame(out, columns=[*NODE, "ends"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends"])

    sorted_ends = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return sorted_ends.mapInPandas(run, "depth long, d1 long, d2 long, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, cell_bits: int = CELL_BITS) -> DataFrame:
    """Nodes of the trie.

    ``turns``: conv_id, depth (1, 2, ... in each conversation), t1, t2, bytes. ``conversations``: conv_id, length (long), one row
    each, those without turns too. Gives conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and digest (hexadecimal, the same for equal prefixes).
    """
    long = lambda v: F.lit(v).cast("long")
    own = [F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "depth", "t1")]
    turns = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", own[0].alias("o1"), own[1].alias("o2"))
    prefixes = running(turns, "conv_id", F.col("depth"), {}, {"d1": F.col("o1"), "d2": F.col("o2")})
    prefixes = prefixes.select("conv_id", "depth", "bytes", "d1", "d2", F.col("d1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("o2")).alias("p2"))
    prefixes = materialize(prefixes, "trie-prefixes")
    flagged = materialize(proven_single(prefixes, cell_bits), "trie-screened")
    conversations = conversations.select("conv_id", F.col("length").cast("long").alias("length"))
    first = flagged.filter("single").groupBy("conv_id").agg(F.min("depth").alias("alone"))
    lines = materialize(conversations.join(first, "conv_id", "left"), "trie-conversations")
    rows = flagged.drop("single").join(lines, "conv_id")

    digest = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    one_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    single = [long(1).alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), one_end.alias("ends_sha256")]
    # below the first single prefix everything is known where the row lies
    tails = rows.filter("depth > alone").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single, digest("d1", "d2").alias("digest"))

    front = materialize(rows.filter("alone is null or depth <= alone"), "trie-front")
    heads = front.filter("depth = alone")
    root = lines.select("conv_id", long(0).alias("depth"), long(0).alias("bytes"), long(0).alias("d1"), long(0).alias("d2"), long(None).alias("p1"), long(None).alias("p2"), "length", "alone")
    shared = root.unionByName(front.filter("alone is null or depth < alone"))
    grouped = shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    grouped = materialize(grouped, "trie-grouped")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    children = grouped.filter("depth > 0").select(*up).unionAll(heads.select(*up)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = materialize(grouped.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", long(0))), "trie-nodes")

    # a node's values sit at its least member, (conv_id, depth) names it there
    worth = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("worth"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = shared.select("conv_id", *NODE).join(worth, ["conv_id", "depth"], "left")
    ends_alone = heads.select("conv_id", *NODE, long(0).alias("worth"), long(1).alias("leaf"))
    path = path.withColumn("head", F.lit(False)).unionByName(ends_alone.withColumn("head", F.lit(True)))
    path = running(path, "conv_id", -F.col("depth"), {"saved": F.coalesce("worth", long(0)), "leaves": F.coalesce("leaf", long(0))}, {})
    sums = path.filter("not head").groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = digests_of_ends(shared.filter("depth = length"))

    above = nodes.select(F.col("depth").alias("ad"), F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    on = (F.col("depth") - 1 == F.col("ad")) & (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2"))
    inner = nodes.join(sums, NODE).join(ends, NODE, "left").join(above, on, "left")
    inner = inner.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), digest("d1", "d2").alias("digest"))
    outer = heads.join(above, on).select("conv_id", "depth", "parent_conv_id", *single, digest("d1", "d2").alias("digest"))
    return inner.unionByName(outer).unionByName(tails)
