"""Language identification by nearest centroids.

A text is a vector of hashed character 1- to 3-grams, weighted by TF-IDF and
normalised. Every language gets several centroids by spherical k-means, so a
language may have different kinds of text. A text takes the language of the
centroid with the largest cosine; a text further from its centroid than almost
all training texts of that language are from theirs is marked as rejected.

Document frequencies cover all rows that may be learned from. Only the bounded
sample, the frequencies and the centroids (fixed size each) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.llm.common import hash_share, held_out

#: Buckets of the hashed n-grams.
DIM = 4096
#: Texts of one language that the centroids are fitted on, about.
PER_LANGUAGE = 400
#: Centroids of one language, at most.
CENTROIDS = 4
#: Share of the training texts of a language that its rejection bound leaves out.
REJECT = 0.005

_PRIMES = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # centroids x DIM, rows of length 1
    bounds: np.ndarray  # least cosine of each centroid's language
    idf: np.ndarray


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters and blanks.

    Any run of other characters is one blank, and a blank stands at both ends,
    so that word starts and ends are grams too. A text without letters has
    none.
    """
    lowered = text.lower()
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(DIM)
    ascii_letter = (codes >= 97) & (codes <= 122)
    letter = ascii_letter | ((codes >= 0xAA) & _wide_letters(lowered, codes))
    codes = np.where(letter, codes, np.uint64(32))
    gap = ~letter
    kept = codes[~(gap & np.concatenate(([True], gap[:-1])))]
    if not len(kept):
        return np.zeros(DIM)
    kept = np.concatenate(([np.uint64(32)], kept, [np.uint64(32)] if kept[-1] != 32 else []))
    kept = kept.astype(np.uint64)
    one, two, three = _PRIMES
    grams = [kept * one]
    if len(kept) > 1:
        grams.append(kept[:-1] * two + kept[1:] * one)
    if len(kept) > 2:
        grams.append(kept[:-2] * three + kept[1:-1] * two + kept[2:] * one)
    mixed = np.concatenate(grams)
    return np.bincount(((mixed ^ (mixed >> np.uint64(15))) * three >> np.uint64(13)) % np.uint64(DIM), minlength=DIM)


def _wide_letters(text: str, codes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(codes), dtype=bool)
    wide = np.flatnonzero(codes >= 0xAA)
    if len(wide):
        values, back = np.unique(codes[wide], return_inverse=True)
        found[wide] = np.array([chr(int(v)).isalpha() for v in values])[back]
    return found


def unit_vector(text: str, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, of length 1 (or zero without letters)."""
    vector = np.log1p(gram_counts(text)) * idf
    length = np.sqrt(vector @ vector)
    return vector / length if length else vector


def learnable(docs: DataFrame) -> DataFrame:
    """``(text, lang)`` of the rows a model may learn from."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return usable.select("doc_id", "text", "lang")


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are and how many hold each gram; over all of them.

    Every task returns one row of DIM counts, which Spark adds up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += gram_counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"i": np.arange(-1, DIM), "n": np.concatenate(([n], total))})

    rows = train.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = {r.i: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(DIM)], dtype=float)


def sample(train: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` texts of every language, chosen by a hash of the text.

    Languages are counted over all rows; the counts, one for each language as in
    the model itself, are broadcast, so that no text is shuffled before it is
    drawn. A few times the wanted number pass by the
    share of their hash, equal texts are one, and of those the least hashes
    stay: rows that repeat a text or an id, also a null one, count once.
    """
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    drawn = train.withColumn("__share", hash_share(F.col("text"))).join(F.broadcast(sizes), "lang")
    few = drawn.where(F.col("__share") * F.col("__n") < 3 * per_language).dropDuplicates(["lang", "__share"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("__share"))
    return few.withColumn("__k", first).where(F.col("__k") <= per_language).select("doc_id", "text", "lang")


def cluster(vectors: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from the vectors furthest from those chosen."""
    centers = [vectors.mean(axis=0)]
    centers[0] /= max(np.linalg.norm(centers[0]), 1e-12)
    while len(centers) < min(k, len(vectors)):
        near = np.max(vectors @ np.array(centers).T, axis=1)
        centers.append(vectors[np.argmin(near)])
    found = np.array(centers)
    for _ in range(rounds):
        home = np.argmax(vectors @ found.T, axis=1)
        sums = np.array([vectors[home == c].sum(axis=0) for c in range(len(found))])
        length = np.linalg.norm(sums, axis=1)
        found = sums[length > 1e-9] / length[length > 1e-9][:, None]
    return found


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """None if there is no text with a language to learn from."""
    train = learnable(docs)
    n, df = document_frequencies(train)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 0.1
    picked = sorted(sample(train, per_language).collect(), key=lambda r: (r.lang, str(r.doc_id), r.text))
    languages: list[str] = []
    rows, bounds = [], []
    for lang in dict.fromkeys(r.lang for r in picked):
        vectors = np.array([unit_vector(r.text, idf) for r in picked if r.lang == lang])
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        if not len(vectors):
            continue
        own = cluster(vectors, centroids)
        bound = float(np.quantile(np.max(vectors @ own.T, axis=1), REJECT))
        languages += [lang] * len(own)
        rows.append(own)
        bounds += [bound] * len(own)
    if not languages:
        return None
    return Model(tuple(languages), np.vstack(rows), np.array(bounds), idf)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row.

    Null texts and texts without a letter are ``und`` with score 0. Texts
    beyond the bound keep their nearest language and have ``rejected`` set.
    Without a model every text is ``und``.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x CENTROIDS x DIM numbers

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            names, scores, far = [], [], []
            for text in batch["text"]:
                vector = unit_vector(text, known.idf) if known is not None and isinstance(text, str) else None
                # grams are counted from letters only, so a zero vector has no letter
                if vector is None or not vector.any():
                    names.append("und"), scores.append(0.0), far.append(True)
                    continue
                near = known.centroids @ vector
                best = int(np.argmax(near))
                names.append(known.languages[best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
                far.append(bool(near[best] < known.bounds[best]))
            out = batch[["doc_id", "held_out"]].assign(lang_pred=names, score=scores, rejected=far)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(label, schema)


def nearest_centroid(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
