"""Near-duplicates by exact similarity: texts whose sets of shingles have a Jaccard similarity of at least a threshold.

Links are decided by the sets themselves, so no pair below the threshold is linked. What is compared comes from two sides. The
trie self-join over SimHash fingerprints (``simhash``) finds the very similar texts, which joins groups of copies early. MinHash
finds the rest: a text's set of hashed shingles gives BANDS keys of ROWS minima each, and texts that share a key are compared. A
pair of similarity s shares none with probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8, fewer above.

Only components are asked for, so a pair that is joined already need not be compared. Each text is compared with the leader of
its largest key, as long as that joins many. What is left may be a dense group whose members are all a little less similar
than the threshold; comparing all its pairs would cost the square of its size. There each set A is written as its difference
D(A) from one member of the group: with t = (1 - s) / (1 + s), two sets are similar enough exactly if their differences share
at least (f(A) + f(B)) / 2 elements, f(A) = |D(A)| - t |A|. What the group has in common is not in the differences, so ordering
their elements by rarity and comparing only texts that share one of the rarest |D| - (f(A) + f(B)) / 2 + 1 (a prefix filter,
for each pair of values of f) leaves few pairs besides true links, and loses none.

Defined cases: words and shingles as in ``simhash``; a NULL or empty text has the empty set, and these are one node that is
like no other; fewer words than a shingle make one shingle; rows that repeat and texts of equal sets are one group; of a group
the row with the least id stays, NULL ids last, then the least text hash; all columns are kept as they are, whatever their
names; an empty table gives an empty result. Sets are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.simhash import near_pairs, shingle_hashes
from daybook.session import materialize

SIMILARITY = 0.8
BANDS, ROWS = 32, 5
FEW = 4  # pairs for each (key, node) row, up to which all are compared at once
SLICE = 500  # texts
BOTH = 2  # side of a key whose nodes are all to be compared with one another
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, none for an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[at : at + 256, None] * _TIMES + _PLUS).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for minima in least.reshape(BANDS, ROWS).T:
        key = (key ^ minima) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int) -> DataFrame:
    """(doc_id, hash, s1, s2, n, fp, keys): a hash of the text; two of its set, the set's size, fingerprint and band keys."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                b = whole.iloc[at : at + SLICE]
                sets = [shingle_set(t, shingle) for t in b["_text"]]
                raw = [x.tobytes() for x in sets]
                s1, s2 = (np.array([xxhash.xxh64_intdigest(x, seed) for x in raw], np.uint64).view(np.int64) for seed in (0, 1))
                yield pd.DataFrame({
                    "doc_id": b["_id"].to_numpy(), "hash": b["_hash"].to_numpy(), "s1": s1, "s2": s2, "n": [len(x) for x in sets],
                    "fp": [set_fingerprint(x) for x in sets], "keys": [band_keys(x).view(np.int64) for x in sets],
                })

    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    got = src.mapInPandas(run, "doc_id string, hash long, s1 long, s2 long, n int, fp long, keys array<long>")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def sets_of(docs: DataFrame, want: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(node, set) for the nodes of ``want`` (node, doc_id, hash: one row that has the set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                b = whole.iloc[at : at + SLICE]
                yield pd.DataFrame({"node": b["node"].to_numpy(), "set": [shingle_set(t, shingle).view(np.int64) for t in b["_text"]]})

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    met = rows.join(want, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("hash")))
    # rows that repeat as a whole would bring a set twice
    once = met.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.lit(0)))).filter("_n = 1")
    return once.select("node", "_text").mapInPandas(run, "node long, set array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(common / (F.size("_a") + F.size("_b") - common) >= similarity).select("a", "b")


def refined(member: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Sharper keys for the nodes of ``member`` (key, node, n, root), and links found on the way.

    Every two similar nodes of one key are in one component by the links, or share a new key (key, node, n, side): one of
    two sides for nodes of different f, of which only those of different sides are meant, or ``BOTH``.
    """
    # groups of nodes that share keys, cut by size: similar sets differ by a factor of 1 / similarity at most
    lead = member.groupBy("key").agg(F.min("node").alias("b"))
    group = components(member.join(lead, "key").select(F.col("node").alias("a"), "b").distinct())
    nodes = member.select("node", "n", "root").distinct().join(group.select("node", F.col("root").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    # a little wider than the factor, for rounding
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(similarity) * (1 + 1e-9))).cast("int")
    nodes = nodes.select("node", "n", "root", F.explode(F.array(*[F.xxhash64("group", band + i) for i in (0, 1)])).alias("part"))
    leads = nodes.groupBy("part").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("lead"), F.col("n").alias("ln"), F.col("root").alias("lr"))).alias("l"), F.count("*").alias("size"))
    leads = leads.filter("size > 1").select("part", "l.lead", "l.ln", "l.lr")
    t = (1 - similarity) / (1 + similarity)
    with_sets = nodes.join(leads, "part").join(sets.withColumnRenamed("set", "_a"), "node")
    with_sets = with_sets.join(sets.select(F.col("node").alias("lead"), F.col("set").alias("_b")), "lead")
    apart = F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a"))
    far = with_sets.select("part", "node", "n", "root", "lead", "ln", "lr", apart.alias("apart"))
    # f in steps of a millionth, rounded down: a level too low only keeps more
    far = far.withColumn("level", F.floor((F.size("apart") - t * F.col("n")) * 1e6).cast("long"))
    far = far.withColumn("alike", F.size("apart") - t * F.col("n") <= t * F.col("ln") + 1e-9)
    # nodes that are joined with the leader need not meet one another
    far = materialize(far.withColumn("near", F.col("alike") | (F.col("root") == F.col("lr"))), "shingle-differences")
    links = far.filter("alike and root <> lr").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()

    each = far.select("part", "node", F.explode("apart").alias("element"))
    common = each.groupBy("part", "element").count().filter("count > 1")
    # elements of one node alone come first in the order by rarity and meet nobody
    ordered = each.join(common, ["part", "element"]).groupBy("part", "node").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("shared"))
    others = far.groupBy("part", F.col("level").alias("other")).agg(F.bool_and("near").alias("all_near"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("level") + F.col("other")) / 2e6 - 1e-5))
    take = (F.size("shared") - needed + 1).cast("int")  # the others of the |D| - needed + 1 rarest are the node's alone
    own = far.select("part", "node", "n", "ln", "level", "near").join(ordered, ["part", "node"])
    others = others.withColumnRenamed("part", "_part")
    rows = own.join(others, (F.col("part") == F.col("_part")) & ~(F.col("near") & F.col("all_near")) & (take > 0)).withColumn("take", take)
    levels = [F.least("level", "other"), F.greatest("level", "other")]
    got = rows.select("part", "node", "n", "level", *[c.alias(f"l{i}") for i, c in enumerate(levels)], F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("s"))
    side = F.when(F.col("l0") == F.col("l1"), BOTH).when(F.col("level") == F.col("l0"), 0).otherwise(1)
    found = got.select(F.xxhash64("part", "l0", "l1", "s.element").alias("key"), "node", "n", side.alias("side")).distinct()
    met = found.groupBy("key").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.count("*").alias("c")).filter(f"c > 1 and (a <> b or a = {BOTH})")
    return found.join(met.select("key"), "key", "left_semi"), links


def similar_sets(member: DataFrame, sets: DataFrame, similarity: float, links: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of the nodes that are not the root of their component; None without links.

    ``member``: key, node, n, of keys with two nodes at least. ``links``: pairs (a, b) that are known to be similar.
    """
    member = member.withColumn("side", F.lit(BOTH))
    rows, before, sharp = member.count(), None, False
    roots = components(links) if links is not None else None
    turn = 0
    while True:
        at = member.withColumn("root", F.col("node")) if roots is None else member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        at = materialize(at.select("key", "node", "n", "side", "root"), "shingle-members")
        # pairs of a key that are not in one component
        each = at.groupBy("key", "root").agg(*[F.count_if(F.col("side") == i).alias(f"c{i}") for i in range(3)])
        total = each.groupBy("key").agg(*[F.sum(f"c{i}").alias(f"n{i}") for i in range(3)], F.sum(F.col("c0") * F.col("c1")).alias("s"), F.sum(F.col("c2") * F.col("c2")).alias("s2"))
        open_keys = total.select("key", ((F.col("n2") * F.col("n2") - F.col("s2")) / 2 + F.col("n0") * F.col("n1") - F.col("s")).alias("pairs")).filter("pairs > 0")
        pending = open_keys.agg(F.sum("pairs")).first()[0]
        if not pending:
            return roots
        # leaders no longer help once they join little
        few, stuck = pending <= FEW * rows, before is not None and pending > 0.8 * before
        at = at.join(open_keys.select("key"), "key", "left_semi")
        if stuck and not few and not sharp:
            member, new = refined(at, sets, similarity)
            member = materialize(member, "shingle-sharp")
            links = materialize(new if links is None else links.union(new), "shingle-links")
            roots, before, sharp = components(links), None, True
            rows = max(rows, member.count())
            continue
        last = few or stuck
        similar_size = F.least("n", "bn") / F.greatest("n", "bn") >= similarity
        if last:
            other = at.select(F.col("key").alias("_key"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"), F.col("side").alias("bs"))
            across = (F.col("side") == BOTH) | (F.col("side") != F.col("bs"))
            met = at.join(other, (F.col("key") == F.col("_key")) & (F.col("root") < F.col("br")) & across & similar_size)
        else:
            first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br")))
            lead = at.groupBy("key").agg(first.alias("lead"), F.count("*").alias("size"))
            met = at.join(lead.select("key", "size", "lead.b", "lead.bn", "lead.br"), "key").filter((F.col("root") != F.col("br")) & similar_size)
            # one comparison a node: each carries two sets
            met = met.groupBy("node").agg(F.max(F.struct("size", "key", "b")).alias("m")).select("node", "m.b")
        pairs = met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        new = materialize(alike(pairs, sets, similarity), "shingle-links")
        links = new if links is None else links.union(new)
        roots = components(links)
        if last:
            return roots
        before, turn = pending, turn + 1


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that with the least id (NULL last), then the least text hash."""
    rows = materialize(sketches(docs, id_col=id_col, text=text, shingle=shingle), "shingle-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), F.col("doc_id").alias("_first"), F.col("hash").alias("_hash"))).alias("k")
    nodes = rows.groupBy("s1", "s2").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), first)
    # the number is written with the row, so it is the same wherever it is read
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")

    # SimHash: nodes of one fingerprint, and fingerprints that the trie join finds close
    fps = materialize(nodes.filter("n > 0").groupBy(F.lit(0).alias("seed"), "fp").agg(F.min("node").alias("node"), F.count("*").alias("same")), "shingle-fingerprints")
    equal = nodes.filter("n > 0").select("node", "fp").join(fps.filter("same > 1").select("fp", F.col("node").alias("b")), "fp").filter("node <> b")
    close = near_pairs(fps.drop("same")).union(equal.select("node", "b"))
    close = materialize(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "shingle-close")

    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").count().filter("count > 1").select("key")
    member = materialize(each.join(shared, "key").select("key", "node", "n"), "shingle-keys")
    wanted = member.select("node").union(close.select("a")).union(close.select("b")).distinct()
    want = nodes.select("node", F.col("k._first").alias("doc_id"), F.col("k._hash").alias("hash")).join(wanted, "node", "left_semi")
    sets = materialize(sets_of(docs, want, id_col, text, shingle), "shingle-sets")
    links = materialize(alike(close, sets, similarity), "shingle-links")
    roots = similar_sets(member, sets, similarity, links)

    kept = nodes.select("node", "k")
    if roots is not None:
        kept = kept.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("k").alias("k"))
    return first_rows(docs, kept, id_col, text)


def first_rows(docs: DataFrame, first: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row of ``docs`` for each k._first, k._hash: an id and the hash of a text."""
    kept = first.select("k._first", "k._hash").distinct()
    rows = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"))
    hit = rows.join(kept, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_h") == F.col("_hash")), "left_semi")
    once = hit.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.lit(0)))).filter("_n = 1")
    return once.select("_row.*")
