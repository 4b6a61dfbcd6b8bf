"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. Each n-gram is scaled by the log of how much more often texts labelled 1
hold it than texts labelled 0; a logistic regression (MLlib) on the scaled set gives the score.

The fit reads at most ``max_rows`` labelled texts, those whose ids hash lowest; the score reads every whole text. Of the n-grams
of those texts the ``features`` with the largest |log-count ratio| * sqrt(texts) get a weight and the others none. This
selection is a part of the method, not a saving: with all of them the fit finds fewer toxic texts it has not seen (README).

Defined cases: a NULL text is empty, and an empty text gets the score of a text without any known n-gram; a label that
is NULL or neither 0 nor 1 is no label; of several labels of one id the largest counts; rows that repeat are scored one
by one; columns named held_out, score or predicted are replaced; without labels of both classes the score is the share of 1 among the labels, (ones + 1) / (labels + 2); an empty
table gives an empty result. Labels and other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.session import materialize

SIZES = (4, 5, 6, 7)
BITS = 21
MAX_ROWS = 20_000
FEATURES = 16_384
SMOOTH = 1.0
THRESHOLD = 0.7


def grams(text: str | None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """Hashes of the character n-grams of the whole text, in lower case with a blank at either end; with repeats."""
    s = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, h = [], s
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint64(1_000_003) + s[n - 1 :] if len(h) > 1 else h[:0]
        if n in sizes:
            out.append((((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    """``weight[i]`` belongs to n-gram hash ``feature[i]``."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may read the label of."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(y, text): at most ``max_rows`` labelled ids, so that their list may be broadcast."""
    y = F.col(label).cast("int")
    known = labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(y).alias("y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    one = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    return one.join(F.broadcast(some), "_id").select("y", "text")


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, ones, zeros): in how many texts of a task each n-gram is, by label."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        for y, t in zip(b["y"], b["text"], strict=True):
            n[y, np.unique(grams(t))] += 1
    f = np.nonzero(n.any(0))[0]
    for at in range(0, len(f), 100_000):
        part = f[at : at + 100_000]
        yield pd.DataFrame({"feature": part, "ones": n[1, part], "zeros": n[0, part]})


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS,
    features: int = FEATURES, smooth: float = SMOOTH, ridge: float = 1e-4, rounds: int = 60,
) -> Model:
    rows = materialize(training_rows(docs, labels, id_col, text, label, max_rows), "toxicity-rows")
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    prior = float(np.log((n.ones + 1) / (n.n - n.ones + 1)))
    counts = materialize(rows.mapInPandas(counted, "feature int, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "toxicity-counts")
    size = counts.agg(F.sum(F.col("ones") + smooth).alias("p"), F.sum(F.col("zeros") + smooth).alias("q")).first()
    if not 0 < n.ones < n.n or not size.p:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    ratio = F.log((F.col("ones") + smooth) / F.lit(size.p)) - F.log((F.col("zeros") + smooth) / F.lit(size.q))
    best = counts.withColumn("ratio", ratio).orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("ones") + F.col("zeros"))), "feature").limit(features)
    got = sorted((r.feature, r.ratio) for r in best.select("feature", "ratio").collect())  # `features` rows at most
    chosen = np.array([f for f, _ in got])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = np.zeros(1 << BITS, bool)
        keep[chosen] = True
        for b in batches:
            for at in range(0, len(b), 128):  # lists of strings take much room
                part = b.iloc[at : at + 128]
                hit = (grams(t) for t in part["text"])
                yield pd.DataFrame({"label": part["y"].astype(float), "words": [np.unique(h[keep[h]]).astype(str).tolist() for h in hit]})

    sets = rows.mapInPandas(words, "label double, words array<string>")
    vectors = CountVectorizerModel.from_vocabulary([str(f) for f in chosen], inputCol="words", outputCol="set", minTF=None).setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r for _, r in got]), inputCol="set", outputCol="features")
    train = materialize(scaled.transform(vectors.transform(sets)).select("label", "features"), "toxicity-vectors")
    # standardization would take the log-count scaling out again
    model = LogisticRegression(regParam=ridge, maxIter=rounds, standardization=False).fit(train)
    return Model(chosen, model.coefficients.toArray() * np.array([r for _, r in got]), float(model.intercept))


def score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1.

    A plain UDF: its batches hold 100 rows, where one Arrow batch would hold 10,000 whole texts in the executor and in its worker.
    """
    feature, weight, intercept = model.feature, model.weight, model.intercept
    tables: list[np.ndarray] = []  # filled once per task

    def one(t: str | None) -> float:
        if not tables:
            keep, w = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
            keep[feature], w[feature] = True, weight
            tables.extend((keep, w))
        keep, w = tables
        h = grams(t)
        z = intercept + w[np.unique(h[keep[h]])].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return F.udf(one, "double", useArrow=False)(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = fit(docs, labels, id_col=id_col, text=text, **options)
    scored = docs.withColumn("held_out", held_out(id_col)).withColumn("score", score(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
