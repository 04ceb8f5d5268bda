"""Quality classifier by Bradley-Terry ranking.

Features of a document are column expressions. Labelled documents become
preference pairs (a good one over a bad one); the weights minimise the
logistic loss on feature differences, and the cut is a quantile of the scores
of the labelled sample. Only the bounded sample of features reaches the
driver; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions.rings import settle
from parcelcheck.llm.common import count_of, hash_share, held_out, text_of, words_of

#: Labelled rows the model is fitted on, at most.
MAX_LABELS = 20_000
#: Preference pairs drawn from them.
MAX_PAIRS = 60_000

FEATURES = (
    "symbols",
    "capitals",
    "punctuation",
    "digits",
    "line_repeats",
    "distinct_words",
    "few_distinct",
    "word_length",
    "shortness",
    "breaks",
)


@dataclass(frozen=True)
class Model:
    """Standardised linear score; ``cut`` is the score quantile that separates."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and an array ``x`` of features for every row.

    A null or empty text has no words; every feature is defined for it.
    """
    split = docs.select(*keep, text_of(text).alias("__body")).select(
        *keep, "__body", words_of(F.col("__body")).alias("__w"), F.split("__body", "\n").alias("__lines")
    )
    counted = split.select(
        *keep,
        F.size("__w").alias("__n"),
        F.size(F.array_distinct("__w")).alias("__distinct"),
        F.size("__lines").alias("__nl"),
        F.size(F.array_distinct("__lines")).alias("__nld"),
        F.length(F.array_join("__w", "")).alias("__chars"),
        count_of(F.col("__body"), "#*$%&|<>").alias("__sym"),
        count_of(F.col("__body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__cap"),
        count_of(F.col("__body"), "!?.,;:").alias("__punct"),
        count_of(F.col("__body"), "0123456789").alias("__digit"),
    )
    n, chars = F.greatest(F.col("__n"), F.lit(1)), F.greatest(F.col("__chars"), F.lit(1))
    share = F.col("__distinct") / n
    return counted.select(
        *keep,
        F.array(
            F.least(F.col("__sym") / n, F.lit(1.0)),
            F.least(F.col("__cap") / chars, F.lit(0.6)),
            F.least(F.col("__punct") / n, F.lit(1.5)),
            F.least(F.col("__digit") / chars, F.lit(0.5)),
            1 - F.col("__nld") / F.col("__nl"),
            share,
            # room for repeats grows with the length; a share this low doesn't come from length alone
            F.greatest(F.lit(0.25) - share, F.lit(0.0)) * F.lit(4.0),
            F.least(chars / n, F.lit(20.0)),
            F.greatest(F.lit(1.0) - F.col("__n") / 30, F.lit(0.0)),
            F.least(F.col("__nl") / n, F.lit(1.0)),
        ).alias("x"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS) -> DataFrame:
    """``(y, x)`` of at most ``limit`` labelled documents outside the held-out third.

    Several labels of one document count as their majority (ties: good); a
    null label or id is left out. Documents are chosen by a hash of the id, so
    reruns choose the same; of rows that repeat an id the least feature row
    stands for all, so ``limit`` bounds the rows whatever repeats.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    voted = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = voted.orderBy(hash_share(F.col("doc_id")), "doc_id").limit(limit)
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
    # at most ``limit`` ids and labels are broadcast
    rows = features(own.join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"])
    # combines on the map side: at most ``limit`` rows from any task
    return rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x")


def fit(sample: DataFrame, pairs: int = MAX_PAIRS, ridge: float = 1e-3, rounds: int = 60) -> Model:
    """Weights by Newton steps on the Bradley-Terry loss, then the cut.

    Without both labels there is nothing to prefer: weights are zero and the
    cut is 0, so every score is 0.5.
    """
    rows = sample.collect()
    y = np.array([r.y for r in rows], dtype=int)
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        zero = (0.0,) * len(FEATURES)
        return Model(zero, (1.0,) * len(FEATURES), zero, 0.0)
    order = np.lexsort(x.T)  # rows arrive in any order
    x, y = x[order], y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(len(FEATURES))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ p / n - ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 4.0 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    scores = np.sort(z @ w)
    # the share of bad labels is the quantile; the cut lies halfway to the next score
    k = len(bad)
    cut = float((scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2)
    return Model(tuple(mean), tuple(scale), tuple(w), cut)


def score_column(model: Model, x: str = "x") -> Column:
    """Score from 0 to 1; 0.5 is the cut."""
    raw = F.lit(-model.cut)
    for k, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights, strict=True)):
        raw = raw + (F.col(x)[k] - F.lit(float(m))) * F.lit(float(w / s))
    return 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(40.0)), F.lit(-40.0))))


def pairwise_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = fit(labelled_sample(docs, labels))
    scored = features(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = fit(labelled_sample(docs, labels))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text"))
    # settled, or the filter would copy every feature's words and lines into itself
    scored = settle(features(packed, ["__row"]), __score=score_column(model))
    return scored.where(F.col("__score") >= 0.5).select("__row.*")
