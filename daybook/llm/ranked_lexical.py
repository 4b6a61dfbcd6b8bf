"""Ranked lexical search of a set of items by bag deduplication.

A document is reduced to its bag: how often it holds each term of the items' vocabulary, and a length factor m. Documents of
equal bags and equal m have equal scores for every item, so a class of them is hashed, verified by comparing the bags
themselves, and scored once; the best classes of an item are then expanded into their members by ascending id. The 50 best
documents lie in the 50 classes that come first by (score, least id), as each of these has a member that comes before any
member of a later class.

Weights follow BM25 in integers: N documents hold a term at all, L terms with repeats are in them, n in one document, df
documents hold a term, tf times. w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and a document's score is
the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 20 m)).

Tasks look terms up in the vocabulary if it has at most ``in_task`` terms and ``in_task_bytes`` bytes; beyond that, terms and
vocabulary meet in a shuffle. Both give the same bags.

Defined cases: a NULL or empty text has no terms; such a document does not count in N and is never a result; rows that repeat
are documents of their own; NULL document ids come last; items with a NULL id take no part, and several rows of an item id are
one item; terms of weight 0 add nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.session import materialize

K = 50
IN_TASK, IN_TASK_BYTES = 1 << 20, 64 << 20
TASK_ROWS = 1_000_000  # scored (class, item, term) rows a task
_BLANK = bytes(b"abcdefghijklmnopqrstuvwxyz"[b - 65] if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_BLANK).split()


def bag_digest(m: Column, ids: Column, tfs: Column) -> list[Column]:
    return [F.xxhash64(m, ids, tfs), F.xxhash64(F.lit(1), tfs, ids, m)]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term), distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b["_id"], b["_text"], strict=True):
                each = sorted(set(terms(t)))
                yield pd.DataFrame({"_id": [i] * len(each), "term": [x.decode() for x in each]}, dtype=object)

    src = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    found = src.mapInPandas(run, "_id string, term string").distinct()
    return found.select(F.col("_id").cast(items.schema[item_id].dataType).alias("item_id"), "term")


def bags_in_task(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, n, ids, tfs) with the vocabulary in every task; its size has been checked."""
    known = docs.sparkSession.sparkContext.broadcast({r.term.encode(): r.id for r in vocabulary.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                n, ids, tfs = [], [], []
                for t in b["_text"]:
                    words = terms(t)
                    pairs = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    n.append(len(words))
                    ids.append(np.array([i for i, _ in pairs], np.int64))
                    tfs.append(np.array([c for _, c in pairs], np.int64))
                yield pd.DataFrame({"doc": b["doc"].to_numpy(), "n": n, "ids": ids, "tfs": tfs})

    return docs.mapInPandas(run, "doc string, n long, ids array<long>, tfs array<long>")


def bags_by_shuffle(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same with a vocabulary of any size: terms of the documents meet it in a join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 100):
                b = whole.iloc[at : at + 100]
                each = [Counter(terms(t)) for t in b["_text"]]
                yield pd.DataFrame({"doc": b["doc"].to_numpy(), "n": [sum(c.values()) for c in each], "words": [[w.decode() for w in c] for c in each], "counts": [list(c.values()) for c in each]})

    counted = docs.mapInPandas(run, "doc string, n long, words array<string>, counts array<long>")
    # the row's number is written, so it is the same wherever it is read
    counted = materialize(counted.withColumn("row", F.monotonically_increasing_id()), "lexical-words")
    met = counted.select("row", F.inline(F.arrays_zip("words", "counts"))).join(vocabulary, F.col("words") == F.col("term"))
    bag = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("id", "counts"))).alias("bag"))
    none = F.array().cast("array<long>")
    got = counted.select("row", "doc", "n").join(bag, "row", "left")
    return got.select("doc", "n", F.coalesce("bag.id", none).alias("ids"), F.coalesce("bag.counts", none).alias("tfs"))


def best(rows: DataFrame, by: list[str], order: list[Column], k: int, out: str = "_r") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K,
    in_task: int = IN_TASK, in_task_bytes: int = IN_TASK_BYTES, digest: Callable[[Column, Column, Column], list[Column]] = bag_digest,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    asked = materialize(item_terms(items, item_id, item_text), "lexical-items")
    vocabulary = materialize(asked.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "lexical-vocabulary")
    size = vocabulary.agg(F.count("*").alias("terms"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    src = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text).alias("_text"))
    small = size.terms <= in_task and size.bytes <= in_task_bytes
    bags = (bags_in_task if small else bags_by_shuffle)(src, vocabulary)
    bags = materialize(bags.select(F.col("doc").cast(docs.schema[id_col].dataType).alias("doc_id"), "n", "ids", "tfs"), "lexical-bags")
    whole = bags.filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    spark = docs.sparkSession
    if not whole.docs:
        kinds = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
        return spark.createDataFrame([], kinds)

    # classes: grouped by hash and bag, so equal hashes of different bags stay apart
    m = F.expr(f"50 + (50L * n * {whole.docs}L) div {whole.terms}L")
    held = bags.filter(F.size("ids") > 0).withColumn("m", m)
    h = digest(F.col("m"), F.col("ids"), F.col("tfs"))
    held = held.select("doc_id", "m", "ids", "tfs", h[0].alias("h1"), h[1].alias("h2"))
    bag = ["h1", "h2", "m", "ids", "tfs"]
    classes = materialize(held.groupBy(*bag).agg(F.count("*").alias("size"), F.min("doc_id").alias("least")), "lexical-classes")
    shared = classes.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    odd = classes.join(shared, ["h1", "h2"], "left_semi").select(*bag)
    odd = materialize(odd.withColumn("no", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("m", "ids", "tfs"))), "lexical-odd")
    some_odd = not odd.isEmpty()

    def numbered(rows: DataFrame) -> DataFrame:
        if not some_odd:
            return rows.withColumn("no", F.lit(0))
        return rows.join(odd, bag, "left").withColumn("no", F.coalesce("no", F.lit(0)))

    counts = classes.select("size", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("size").alias("df"), F.count("*").alias("classes"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * whole.docs + 2) / (2.0 * F.col("df") + 1)))
    weights = asked.join(vocabulary, "term").join(counts, "id").select("id", "item_id", w.alias("w"), "classes")
    weights = materialize(weights.filter("w > 0"), "lexical-weights")
    rows = weights.agg(F.coalesce(F.sum("classes"), F.lit(0))).first()[0]

    # a class is scored in one place: the shuffle moves bags, never (class, item) sums
    key = ["h1", "h2", "no"]
    postings = numbered(classes).repartition(max(1, -(-rows // TASK_ROWS)), *key)
    postings = postings.select(*key, "least", "m", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"))))
    part = F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")
    scored = postings.join(weights.drop("classes"), "id").groupBy(*key, "least", "item_id").agg(F.sum(part).alias("score"))
    top = best(scored.filter("score > 0"), ["item_id"], [F.desc("score"), F.asc_nulls_last("least")], k)
    top = materialize(top.select("item_id", *key, "score"), "lexical-top")

    member = numbered(held).join(top.select(*key).distinct(), key, "left_semi").select(*key, "doc_id")
    member = best(member, key, [F.asc_nulls_last("doc_id")], k).drop("_r")
    ranked = best(top.join(member, key), ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    return ranked.select("item_id", "rank", "doc_id", "score")
