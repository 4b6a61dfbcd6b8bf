"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its pivots in order of nearness; the inverted file
of a pivot holds the place it has in each vector's order. A query adds up, over its pivots' files, how far each vector's
places are from its own (Spearman's footrule), keeps the ``share`` of the vectors with the least sum, and ranks those by
their exact distance.

Vectors are dealt by hash into blocks, each with inverted files of its own, and each block of queries goes to every block
of vectors: a task holds one of each, whatever the table. Every vector is indexed.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, nor do NULL ids, nor
vectors of another length than the most common one; equal vectors are one entry with their k + 1 least ids, which is all
that can be among the k nearest; rows with a query's id are never among its results; ties go to the smaller id; fewer
candidates than k give all; rows that repeat count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.hamming_topk import best
from daybook.session import materialize

K = 10
PIVOTS = 128
SAMPLE = 1024  # vectors that pivots are chosen from
SHARE = 0.2
LEAST = 512  # of a block's vectors that are ranked exactly, at least
BLOCK = 8192
QUERY_BLOCK = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Per row and pivot, the pivot's place in the row's order of nearness (ties: first pivot)."""
    far = (pivots**2).sum(1) - 2 * x @ pivots.T
    order = np.argsort(far, axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], 1)
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the sample, in its order, that keep a quarter of the median distance from one another; a large group of
    near copies so takes one place. If too few do, the first of the others fill up."""
    if len(sample) <= count:
        return sample
    sq = (sample**2).sum(1)
    far = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * sample @ sample.T, 0))
    least, chosen = np.median(far) / 4, []
    for i in range(len(sample)):
        if len(chosen) < count and (far[i, chosen] >= least).all():
            chosen.append(i)
    rest = [i for i in range(len(sample)) if i not in set(chosen)]
    return sample[chosen + rest[: count - len(chosen)]]


def search_block(x: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of its k nearest found in the block, and their distances."""
    files = np.ascontiguousarray(places(x, pivots).T)  # one row per pivot: its inverted file
    keep = min(len(x), max(k, least, int(np.ceil(share * len(x)))))
    for mine, own in zip(q, places(q, pivots), strict=True):
        if keep < len(x):
            footrule = np.zeros(len(x), np.int32)
            for p, place in enumerate(own):
                footrule += np.abs(files[p] - place)
            near = np.argpartition(footrule, keep - 1)[:keep]
        else:
            near = np.arange(len(x))
        exact = np.sqrt(((x[near] - mine) ** 2).sum(1))
        top = np.lexsort((near, exact))[: 4 * k]
        # all that tie with the k-th stay: ids decide between them later
        top = top[exact[top] <= exact[top[min(k, len(top)) - 1]]]
        yield near[top], exact[top]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, *, pivots: int = PIVOTS, share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``vectors``: id, vector (array of numbers). ``queries``: query_id, vector. Gives query_id, rank (from 1), id, score."""

    def cleaned(df: DataFrame, key: str) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        return df.select(F.col(key), v.alias("vector")).filter(F.col(key).isNotNull() & usable(F.col("vector")))

    given = cleaned(vectors, "id")
    size = given.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = size[0].n if size else 0
    given = given.filter(F.size("vector") == size).withColumn("_key", F.xxhash64("vector"))
    # the least ids of each distinct vector; the hash spreads them, the vector itself decides
    few = given.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("_key", "vector").orderBy("id"))).filter(F.col("_r") <= k + 1)
    entries = materialize(few.groupBy("_key", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    asked = cleaned(queries, "query_id").filter(F.size("vector") == size).distinct()
    asked = materialize(asked.withColumn("rep", F.min("query_id").over(Window.partitionBy("vector"))), "ann-asked")
    reps = asked.filter("rep = query_id").select("rep", "vector")
    sample = entries.orderBy("_key").limit(SAMPLE).select("vector").collect()  # SAMPLE vectors
    sample = choose_pivots(np.array([r.vector for r in sample]).reshape(-1, max(size, 1)), pivots)
    n, m = max(1, -(-entries.count() // block)), max(1, -(-reps.count() // query_block))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    side_v = entries.select(F.pmod("_key", F.lit(n)).cast("int").alias("vb"), every(m).alias("qb"), F.lit(None).cast("long").alias("rep"), "ids", "vector")
    side_q = reps.select(every(n).alias("vb"), F.pmod(F.xxhash64("rep"), F.lit(m)).cast("int").alias("qb"), "rep", F.lit(None).cast("array<long>").alias("ids"), "vector")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["rep"].notna()
        mine, theirs = rows[asks], rows[~asks]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"rep": [], "id": [], "score": []})
        # in order of the least id, so that equal distances are kept in order of ids
        theirs = theirs.iloc[np.argsort([i[0] for i in theirs["ids"]], kind="stable")]
        x, q = np.stack(theirs["vector"].to_numpy()), np.stack(mine["vector"].to_numpy())
        ids, out = theirs["ids"].to_numpy(), []
        for rep, (near, score) in zip(mine["rep"].astype("int64"), search_block(x, q, sample, k + 1, share, least), strict=True):
            got = [(i, s) for r, s in zip(near, score, strict=True) for i in ids[r]]
            out += [(rep, i, s) for i, s in sorted(got, key=lambda g: (g[1], g[0]))[: k + 1]]
        return pd.DataFrame(out, columns=["rep", "id", "score"])

    found = side_v.unionByName(side_q).groupBy("vb", "qb").applyInPandas(search, "rep long, id long, score double")
    # one more than k, as one may be the query itself
    top = best(found, "rep", ["score", "id"], k + 1)
    mine = asked.select("query_id", F.col("rep").alias("_rep")).join(top, F.col("_rep") == F.col("rep")).filter("id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
