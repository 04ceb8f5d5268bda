"""Ranked lexical search over impact vectors in buckets of their length.

A document is a vector of impacts, one coordinate for each term of the query
set, measured by the terms' weights: its length is the root of the sum of
weight * impact^2, a query's length the root of the sum of its weights, and the
score their inner product. Vectors are put into buckets whose bounds grow
geometrically, and buckets are read from the longest down, many at a time:

* Cauchy-Schwarz: query length times the bucket's greatest length bounds every
  score in it. Once that is below the tenth best score of every query, neither
  this bucket nor any shorter one is read; inside, the same bound holds for
  each document and query;
* coordinates: of a query's FOCUS heaviest terms each bounds the angle between
  both vectors, and all of them together with the rest of both lengths bound
  the score;
* survivors are scored in integers, so bounds decide what is looked at, never
  the result. Bounds in floating point get a margin.

A query set goes in blocks of about BLOCK_TERMS terms against all documents.
Only weights, queries and thresholds of one block reach driver and tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.llm.common import text_of
from parcelcheck.session import remove_staged, staging_path

#: What separates terms (fixed values): ASCII but for digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)

#: Results of a query.
TOP = 10
#: Pairs of query and term in a block, about.
BLOCK_TERMS = 200_000
#: Buckets for each doubling of the length.
STEPS = 8
#: Documents of the first round, and how many times more each further one takes.
FIRST, GROWTH = 20_000, 8
#: Heaviest terms of a query whose coordinates are tested.
FOCUS = 3
#: Cells of a table of documents and queries that a task holds.
CELLS = 1 << 20
_SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max


@dataclass
class Queries:
    """A block of queries: ids, and for each the places of its terms in the vocabulary."""

    ids: list[int | None]
    terms: list[np.ndarray]
    vocabulary: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def prepare(self) -> None:
        """Lengths, heaviest terms and the list of queries for every term."""
        w = self.weights
        self.square = np.array([float(w[t].sum()) for t in self.terms])
        self.length = np.sqrt(self.square)
        heavy = [t[np.argsort(-w[t], kind="stable")[:FOCUS]] for t in self.terms]
        self.focus = np.full((len(self.terms), FOCUS), -1, dtype=np.int64)
        for row, t in zip(self.focus, heavy):
            row[: len(t)] = t
        owner = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        flat = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.holders = owner[order]
        self.first = np.searchsorted(flat[order], np.arange(len(w) + 1))


def terms_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``term`` exploded: every occurrence of a term is a row."""
    lowered = F.translate(text_of(text), UPPER, LOWER)
    return docs.withColumn("term", F.explode(F.array_remove(F.split(lowered, GAP), "")))


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Queries]:
    """The query set, block by block; rows that share an id are one query."""
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    pairs = terms_of(named).select("item_id", "term").distinct()
    blocks = max(1, math.ceil(pairs.count() / BLOCK_TERMS))
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        own: dict[int | None, list[int]] = {}
        vocabulary: dict[str, int] = {}
        for row in part.collect():  # one block
            own.setdefault(row.item_id, []).append(vocabulary.setdefault(row.term, len(vocabulary)))
        yield Queries(list(own), [np.array(sorted(t), dtype=np.int64) for t in own.values()], vocabulary)


def count_terms(docs: DataFrame, vocabulary: dict[str, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, ids, tfs)`` for every row with a term: all its terms with repeats, and the vocabulary's among them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = known.keys()
        for batch in batches:
            doc, total, ids, tfs, starts = [], [], [], [], [0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(_TERM.findall(text.translate(_LOWERED)))
                if not found:
                    continue
                own = sorted((known[t], found[t]) for t in found.keys() & names)
                doc.append(i)
                total.append(found.total())
                ids += [k for k, _ in own]
                tfs += [n for _, n in own]
                starts.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int64())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(total, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body")).where(F.length("body") > 0)
    return rows.mapInArrow(run, "doc_id long, n long, ids array<long>, tfs array<long>")


def weigh(queries: Queries, counted: DataFrame) -> tuple[int, int]:
    """Sets the weights; returns the number of documents and of all their terms."""
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(queries.vocabulary), dtype=np.int64)
    found = counted.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    for row in found.collect():  # the block's vocabulary
        weights[row.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    queries.weights = weights
    queries.prepare()
    return n_docs, n_terms


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def impact_vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``(doc_id, ids, impacts, norm, bucket)`` of the documents that hold a term of the block."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in batches:
            (n,) = _columns(batch, "n")
            (ids, sizes), (tfs, _) = _flat(batch, "ids"), _flat(batch, "tfs")
            m = np.repeat(10 + (90 * n.astype(np.int64) * n_docs) // max(n_terms, 1), sizes)
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, w[ids] * impacts.astype(float) ** 2, minlength=len(sizes)))
            bucket = np.floor(np.log2(np.maximum(norm, 1e-300)) * STEPS).astype(np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            out = [batch.column(0)] + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, impacts)]
            made = pa.RecordBatch.from_arrays([*out, pa.array(norm), pa.array(bucket)], names=["doc_id", "ids", "impacts", "norm", "bucket"])
            yield made.filter(pa.array(norm > 0))

    return counted.mapInArrow(run, "doc_id long, ids array<long>, impacts array<long>, norm double, bucket int")


class Best:
    """The best rows of every query that a task has seen."""

    def __init__(self, threshold: np.ndarray):
        self.threshold = threshold.astype(float)
        self.rows: dict[int, list[tuple[int, int]]] = {}

    def add(self, query: int, docs: np.ndarray, scores: np.ndarray) -> None:
        held = self.rows.get(query, []) + list(zip((-scores).tolist(), docs.tolist()))
        held.sort()
        self.rows[query] = held[:TOP]
        if len(held) >= TOP:
            self.threshold[query] = max(self.threshold[query], -held[TOP - 1][0])


def candidates(queries: Queries, threshold: np.ndarray, norm: np.ndarray, starts: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Document by query: can the score reach the threshold?

    First by lengths, then by the coordinates of the query's heaviest terms.
    """
    limit = threshold[None, :]
    alive = (norm[:, None] * queries.length[None, :] * _SLACK + 1e-6 >= limit) & (queries.length[None, :] > 0)
    # coordinates of all heaviest terms, as documents by terms
    wanted = np.unique(queries.focus[queries.focus >= 0])
    place = np.full(len(queries.weights) + 1, -1, dtype=np.int64)
    place[wanted] = np.arange(len(wanted))
    table = np.zeros((len(norm), len(wanted) + 1))
    row = np.repeat(np.arange(len(norm)), np.diff(starts))
    inside = place[ids] >= 0
    table[row[inside], place[ids[inside]]] = impacts[inside]
    square = norm[:, None] ** 2
    product = np.zeros(alive.shape)
    used_doc, used_query = np.zeros(alive.shape), np.zeros(len(queries.ids))
    for f in range(FOCUS):
        term = queries.focus[:, f]
        w = np.where(term >= 0, queries.weights[term], 0).astype(float)
        x = table[:, np.where(term >= 0, place[term], len(wanted))]
        own, part = w[None, :] * x, w[None, :] * x**2
        rest = np.sqrt(np.maximum(queries.square - w, 0))[None, :] * np.sqrt(np.maximum(square - part, 0))
        alive &= (own + rest) * _SLACK + 1e-6 >= limit
        product += own
        used_doc += part
        used_query += w
    rest = np.sqrt(np.maximum(queries.square - used_query, 0))[None, :] * np.sqrt(np.maximum(square - used_doc, 0))
    return alive & ((product + rest) * _SLACK + 1e-6 >= limit)


def exact_scores(queries: Queries, alive: np.ndarray, starts: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (document * queries + query) among ``alive`` with a score above 0, and the scores."""
    width = len(queries.ids)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    use = alive.any(axis=1)[row]
    row, ids, impacts = row[use], ids[use], impacts[use]
    many = queries.first[ids + 1] - queries.first[ids]
    ends = np.cumsum(many)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(queries.first[ids], many)
    cell = np.repeat(row, many) * width + queries.holders[at]
    keep = alive.ravel()[cell]
    cell, value = cell[keep], np.repeat(queries.weights[ids] * impacts, many)[keep]
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    scores = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)
    return cell[first][scores > 0], scores[scores > 0]


def search_round(vectors: DataFrame, queries: Queries, threshold: np.ndarray) -> DataFrame:
    """``(item_id, doc_id, score)``: at most TOP rows of every query and task, all that can matter among ``vectors``."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = shared.value
        best = Best(start)
        width = len(own.ids)
        for batch in batches:
            doc = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)  # null ids come last
            (norm,) = _columns(batch, "norm")
            (ids, sizes), (impacts, _) = _flat(batch, "ids"), _flat(batch, "impacts")
            starts = np.concatenate(([0], np.cumsum(sizes)))
            step = max(1, CELLS // max(width * (FOCUS + 1), 1))
            for low in range(0, len(doc), step):
                high = min(low + step, len(doc))
                cut = slice(starts[low], starts[high])
                local = starts[low : high + 1] - starts[low]
                alive = candidates(own, best.threshold, norm[low:high], local, ids[cut], impacts[cut])
                if not alive.any():
                    continue
                cell, score = exact_scores(own, alive, local, ids[cut], impacts[cut])
                query = cell % width
                good = score >= best.threshold[query]
                query, row, score = query[good], cell[good] // width, score[good]
                order = np.argsort(query, kind="stable")
                bounds = np.searchsorted(query[order], np.arange(width + 1))
                for q in np.unique(query).tolist():
                    mine = order[bounds[q] : bounds[q + 1]]
                    best.add(q, doc[low:high][row[mine]], score[mine])
        rows = [(own.ids[q], None if d == _LAST else d, -s) for q, held in best.rows.items() for s, d in held]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "item_id long, doc_id long, score long")


def top_rows(found: DataFrame) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the TOP best of every query, ties by ascending doc_id, null ids last."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def search_block(docs: DataFrame, queries: Queries, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The best documents of one block's queries, written to the shared folder."""
    spark = docs.sparkSession

    def staged(rows: DataFrame, label: str) -> tuple[str, DataFrame]:
        path = staging_path(spark, label)
        rows.write.parquet(path)
        return path, spark.read.schema(rows.schema).parquet(path)

    counted_path, counted = staged(count_terms(docs, queries.vocabulary, doc_id, text), "term-counts")
    n_docs, n_terms = weigh(queries, counted)
    made = impact_vectors(counted, queries.weights, n_docs, n_terms)
    # long vectors first: a round reads row groups by their range of buckets
    vectors_path, vectors = staged(made.sortWithinPartitions(F.desc("bucket")), "impact-vectors")
    remove_staged(spark, counted_path)
    sizes = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"))
    buckets = sorted(sizes.collect(), reverse=True)  # STEPS for each doubling
    threshold = np.zeros(len(queries.ids))
    place = {i: k for k, i in enumerate(queries.ids)}
    best_path, best = staged(spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"), "best")
    at, wanted = 0, FIRST
    while at < len(buckets):
        if not (buckets[at].norm * queries.length * _SLACK + 1e-6 >= threshold).any():
            break  # no shorter vector reaches any query's threshold either
        held, end = 0, at
        while end < len(buckets) and held < wanted:
            held += buckets[end].n
            end += 1
        part = vectors.where(F.col("bucket").between(buckets[end - 1].bucket, buckets[at].bucket))
        found = search_round(part, queries, threshold)
        next_path, best = staged(top_rows(best.drop("rank").unionByName(found)), "best")
        remove_staged(spark, best_path)
        best_path = next_path
        for row in best.where(F.col("rank") == TOP).select("item_id", "score").collect():  # one row a query
            threshold[place[row.item_id]] = row.score
        at, wanted = end, wanted * GROWTH
    remove_staged(spark, vectors_path)
    return best


def norm_buckets(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of every item's best documents.

    Null and empty texts, on either side, have no terms and no results; items
    without a shared term have no rows. Each row of ``docs`` is a document of
    its own, repeated ids and texts included; equal scores go by doc_id, null
    ids last. Rows of ``items`` that share an id (null is one) are one item.
    Empty tables give no rows. Very long texts are counted whole, in one task.
    """
    out = [search_block(docs, queries) for queries in query_blocks(items) if queries.ids]
    whole = out[0] if out else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


SQL = f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS place,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT place, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
counts AS (SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY place, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, stats GROUP BY term),
items AS (SELECT DISTINCT item_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark)),
lengths AS (SELECT place, doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) AS m FROM docs, stats),
scores AS (SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (place) GROUP BY item_id, place, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
