"""N-gram Jaccard join by prefix trees.

A document is its set of hashed five-word shingles in one global order (that
of the hash). Documents with equal sets are folded into one first. Then

1. documents that agree in a pair of least hashes meet their bucket's first
   document; verified links of this kind give provisional groups;
2. shingles of a fixed share of the hash range are grouped. Where a shingle is
   held by few documents, pairs of different provisional groups are counted; a
   pair stays if the count, what frequent shingles could add and what the rest
   of the range could add reach the bound. A document with more than a fifth
   of its set among such shingles must share one with any partner;
3. all other documents meet as in step 1, now led by those with most frequent
   shingles, and then on the first shingles of their whole sets, rarest first,
   so long that no partner of another group can be missed;
4. candidates are verified in blocks: the sets of a block form a prefix tree
   which the block's leader walks, sharing partial overlaps of common prefixes
   and leaving subtrees that can't reach the bound any more.

Steps 2 and 3 leave out pairs whose provisional group is the same, as they
can't change a component. No step caps or samples anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelcheck.functions.rings import settle
from parcelcheck.llm.common import text_of, words_of
from parcelcheck.llm.components import components
from parcelcheck.session import remove_staged, staging_path

N = 5
#: Step 2 reads hashes whose lowest 10 bits are below this: 30 % of them.
SHARE_OF_1024 = 307
#: A shingle of more documents than this is frequent in step 2.
FREQUENT = 32
#: Members of a block that one leader walks, about.
BLOCK = 64
_BINS = 16
_MAP_BITS = 1 << 22
_NONE, _SEEN = -(2**63), -(2**63) + 1


def lower_words(text: Column) -> Column:
    """The words of a text with A to Z in lower case."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return words_of(lowered)


def with_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, s)``: sorted distinct hashes of all N-word shingles, of the whole
    sequence if it is shorter; empty for a text without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # both are settled: a filter above must not copy them into every step of a lambda
    words = settle(rows, w=lower_words(F.col("text"))).select("doc_id", "w")
    grams = ", ".join(f"w[i + {k}]" for k in range(N))
    made = F.expr(
        "array_distinct(sort_array(case when size(w) = 0 then cast(array() as array<bigint>)"
        f" when size(w) < {N} then array(xxhash64(array_join(w, ' ')))"
        f" else transform(sequence(0, size(w) - {N}), i -> xxhash64({grams})) end))"
    )
    return settle(words, s=made).select("doc_id", "s")


def _low(h: str) -> str:
    return f"({h} & 1023) < {SHARE_OF_1024}"


def bucket_keys(sets: DataFrame) -> DataFrame:
    """``(key, d1, id)``: eight keys of two least hashes each, from the low share of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            cell = row * _BINS + ((values >> 10) & (_BINS - 1))
            order = np.argsort(cell, kind="stable")  # values of a row ascend
            at, first = np.unique(cell[order], return_index=True)
            least = np.zeros(len(counts) * _BINS, dtype=np.int64)
            found = np.zeros(len(counts) * _BINS, dtype=bool)
            least[at], found[at] = values[order][first], True
            pairs = least.reshape(-1, _BINS // 2, 2).astype(np.uint64)
            both = found.reshape(-1, _BINS // 2, 2).all(axis=2)
            place = np.arange(_BINS // 2, dtype=np.uint64)
            with np.errstate(over="ignore"):
                key = (pairs[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (pairs[:, :, 1] + place * np.uint64(0xC2B2AE3D27D4EB4F))
                key ^= key >> np.uint64(29)
            id, d1 = (np.repeat(batch.column(k).to_numpy(), _BINS // 2).reshape(both.shape)[both] for k in range(2))
            yield pa.RecordBatch.from_pydict({"key": key[both].astype(np.int64), "d1": d1, "id": id})

    return sets.select("doc_id", "d1", "low").mapInArrow(run, "key long, d1 long, id long")


def star_edges(keys: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: in every bucket, one set's id a with the least id b of every other set.

    The one is the set with the largest weight in ``(id, weight)``, or the one
    of the least id. Copies have all keys in common, so the least id of a set
    within a bucket is the one that stands for the set everywhere.
    """
    sets = keys.groupBy("key", "d1").agg(F.min("id").alias("id"))  # folds copies on the map side
    weighed = sets.withColumn("weight", F.lit(0.0)) if weights is None else sets.join(weights, "id")
    first = (
        weighed.groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("least"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", (-F.col("first.least")).alias("a"))
    )
    return weighed.join(first, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def group_pairs(tokens: DataFrame) -> DataFrame:
    """``(a, b, n)`` from ``(h, id, grp)``: how many shingles of few documents two documents
    of different groups share; rows with b = _NONE count a document's frequent shingles.

    Rows arrive sorted by shingle and are read as a stream; more than FREQUENT
    rows of one shingle are never held. A shingle of one group only is no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)]
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy() for k in range(3)]).astype(np.int64)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows])
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            done, held = rows[:last], [rows[last:]]
            if len(held[0]) > 50_000:  # a shingle of very many documents
                yield from _pairs_of(held[0], open_end=True)
                held = [_marked(held[0][-FREQUENT - 1 :])]
            yield from _pairs_of(done)
        yield from _pairs_of(held[0])

    return (
        tokens.mapInArrow(run, "a long, b long, n long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"))
    )


def _marked(rows: np.ndarray) -> np.ndarray:
    """Rows that were counted already; they only show that the shingle is frequent."""
    rows = rows.copy()
    rows[:, 1:] = _SEEN
    return rows


def _pairs_of(rows: np.ndarray, open_end: bool = False) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
    sizes = np.diff(np.concatenate((starts, [len(rows)])))
    low = np.minimum.reduceat(rows[:, 2], starts)
    high = np.maximum.reduceat(rows[:, 2], starts)
    mixed = (low != high) | open_end
    a, b, n = [], [], []
    often = np.repeat(mixed & ((sizes > FREQUENT) | open_end), sizes)
    ids = rows[often, 1]
    ids = ids[ids != _SEEN]
    if len(ids):
        one, count = np.unique(ids, return_counts=True)
        a.append(one), b.append(np.full(len(one), _NONE, dtype=np.int64)), n.append(count)
    few = mixed & (sizes <= FREQUENT) & (not open_end)
    for size in np.unique(sizes[few]):
        at = starts[few & (sizes == size)]
        left, right = np.triu_indices(size, 1)
        x, y = rows[at[:, None] + left, 1].ravel(), rows[at[:, None] + right, 1].ravel()
        differ = (rows[at[:, None] + left, 2] != rows[at[:, None] + right, 2]).ravel()
        x, y = x[differ], y[differ]  # marked rows are in longer groups only
        if len(x):
            pair, count = np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y))), axis=0, return_counts=True)
            a.append(pair[:, 0]), b.append(pair[:, 1]), n.append(count)
    if a:
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})


def rare_first(sets: DataFrame) -> DataFrame:
    """``(a, b)`` candidates among ``(id, grp, n, s)`` that miss no pair over the bound.

    Shingles are ordered by the number of documents, then by hash. Of two
    linked documents, the first 1/9 of the smaller set and the first 1/5 of
    the larger one (and one more shingle each) have a shingle in common.
    """
    rows = sets.select("id", "grp", "n", F.explode("s").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    ranked = rows.join(counts, "h").withColumn(
        "at", F.row_number().over(Window.partitionBy("id").orderBy("c", "h"))
    )
    shared = ranked.where((F.col("c") > 1) & (F.col("at") <= F.col("n") - F.ceil(0.8 * F.col("n")) + 1))
    probe = shared.select("h", F.col("id").alias("a"), F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("at").alias("ia"))
    index = shared.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 8 / 9) + 1).select(
        "h", F.col("id").alias("b"), F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("at").alias("ib")
    )
    met = probe.join(index, "h").where(
        (F.col("ga") != F.col("gb"))
        # the pair's first common shingle leaves so much of both sets, the others leave less
        & (9 * (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))) >= 4 * (F.col("na") + F.col("nb")))
        & (5 * F.col("nb") >= 4 * F.col("na"))
        & ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    )
    return met.select("a", "b").distinct()


def walk(leader: np.ndarray, members: list[np.ndarray]) -> list[bool]:
    """Which members have a Jaccard similarity of 0.8 or more with the leader.

    Members in lexicographic order are the leaves of a prefix tree in the order
    of a depth-first walk: what two neighbours have in common is their shared
    path. The overlap at each depth of the current path is kept, so that a
    shared path is never compared twice, and a path that fell below the bound
    at some depth is left with all leaves beneath it.
    """
    nx = len(leader)
    found = [False] * len(members)
    order = sorted(range(len(members)), key=lambda k: members[k].byteswap().tobytes())
    path = np.zeros(0, dtype=np.int64)
    over = np.zeros(1, dtype=np.int64)  # overlap of the first d shingles of the path
    dead = None  # depth at which the path fell below any bound, with the largest set it holds for
    for k in order:
        own = members[k]
        ny = len(own)
        short = min(len(path), ny)
        differ = np.flatnonzero(path[:short] != own[:short])
        shared = int(differ[0]) if len(differ) else short
        known = min(shared, len(over) - 1)
        if dead is not None and dead[0] <= shared and ny >= dead[1] and 4 * nx + 4 * ny > 9 * min(dead[2] + ny - dead[0], dead[2] + dead[3]):
            continue
        dead = None
        over = over[: known + 1]
        depth, step = known, 32
        fits = True
        while depth < ny:
            part = own[depth : depth + step]
            at = np.searchsorted(leader, part)
            hit = leader[np.minimum(at, nx - 1)] == part
            over = np.concatenate((over, over[-1] + np.cumsum(hit)))
            depth += len(part)
            left = nx - int(at[-1]) - int(hit[-1])
            if 9 * (int(over[-1]) + min(ny - depth, left)) < 4 * (nx + ny):
                fits, dead = False, (depth, ny, int(over[-1]), left)
                break
            step *= 2
        path = own
        found[k] = fits and 9 * int(over[min(ny, len(over) - 1)]) >= 4 * (nx + ny)
    return found


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, s)`` of the documents whose id is in ``ids``.

    A bitmap of fixed size keeps most other texts out of the shuffle; the join
    is exact.
    """
    spark = docs.sparkSession
    spot = F.pmod(F.xxhash64("id"), F.lit(_MAP_BITS)).cast("int")
    bits = np.zeros(_MAP_BITS, dtype=bool)
    bits[ids.select(spot.alias("k")).distinct().toPandas()["k"].to_numpy(dtype=np.int64)] = True  # at most _MAP_BITS rows
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        at = k.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    likely = own.where(maybe(F.pmod(F.xxhash64("doc_id"), F.lit(_MAP_BITS)).cast("int")))
    texts = likely.join(ids, F.col("doc_id") == F.col("id")).select("doc_id", "text")
    return with_sets(texts).select(F.col("doc_id").alias("id"), "s")


def verify(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Those ``(a, b)`` of the candidates whose similarity is 0.8 or more.

    Every a leads blocks of about BLOCK of its b; a leader with many members
    has many blocks. Sets are made anew from the texts of the documents that
    occur.
    """
    spark = docs.sparkSession
    edges_path = staging_path(spark, "candidates")
    edges.write.parquet(edges_path)
    edges = spark.read.schema(edges.schema).parquet(edges_path)
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("__d"))
    blocks = edges.join(degree, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("__d") / BLOCK)).cast("int").alias("block")
    )
    path = staging_path(spark, "blocks")
    blocks.write.parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    ids = blocks.select(F.col("a").alias("id")).union(blocks.select("b")).distinct()
    sets = sets_of(docs, ids)
    members = blocks.join(sets, F.col("b") == F.col("id")).select("a", "block", F.lit(1).alias("kind"), "b", "s")
    leaders = (
        blocks.select("a", "block").distinct().join(sets, F.col("a") == F.col("id"))
        .select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("b"), "s")
    )
    rows = leaders.union(members).repartition("a", "block").sortWithinPartitions("a", "block", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, names, members = None, None, [], []
        linked_a, linked_b = [], []

        def close() -> None:
            if members:
                hits = walk(leader, members)
                linked_a.extend(key[0] for h in hits if h)
                linked_b.extend(n for n, h in zip(names, hits, strict=True) if h)

        for batch in batches:
            a, block, kind, b = (batch.column(k).to_numpy() for k in range(4))
            lists = batch.column(4)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for k in range(len(a)):
                own = values[cuts[k] : cuts[k + 1]]
                if kind[k] == 0:
                    close()
                    key, leader, names, members = (a[k], block[k]), own.copy(), [], []
                else:
                    names.append(b[k]), members.append(own.copy())
            if len(linked_a) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": np.array(linked_a, np.int64), "b": np.array(linked_b, np.int64)})
                linked_a, linked_b = [], []
        close()
        yield pa.RecordBatch.from_pydict({"a": np.array(linked_a, np.int64), "b": np.array(linked_b, np.int64)})

    links = rows.mapInArrow(run, "a long, b long")
    out = staging_path(spark, "links")
    links.write.parquet(out)
    remove_staged(spark, path)
    remove_staged(spark, edges_path)
    return spark.read.schema("a long, b long").parquet(out)


def trie_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    A null or empty text has an empty set and is linked with nothing. Rows
    that repeat an id get a row each, by their own text; where texts of one id
    differ, any of them may link it. Null ids have a null component.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "shingles")
    made = with_sets(docs).select(
        "doc_id",
        F.size("s").cast("long").alias("n"),
        F.xxhash64("s").alias("d1"),
        F.xxhash64(F.lit(7), "s").alias("d2"),
        F.expr(f"filter(s, h -> {_low('h')})").alias("low"),
    )
    made.write.parquet(path)
    own = spark.read.schema(made.schema).parquet(path)
    filled = own.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # documents with equal sets are one; the least id stands for them
    classes = filled.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"))
    classes_path = staging_path(spark, "classes")
    classes.write.parquet(classes_path)
    classes = spark.read.schema(classes.schema).parquet(classes_path)
    keys_path = staging_path(spark, "bucket-keys")
    bucket_keys(filled).write.parquet(keys_path)
    keys = spark.read.schema("key long, d1 long, id long").parquet(keys_path)
    first_links = verify(star_edges(keys), docs)
    grouped = components(first_links)
    groups = classes.join(grouped, "id", "left").select("id", F.coalesce("component", "id").alias("grp"))
    labelled = filled.join(groups.dropDuplicates(["id"]), F.col("doc_id") == F.col("id")).select("id", "n", "low", "grp")
    tokens = labelled.select("id", "grp", F.explode("low").alias("h")).select("h", "id", "grp")
    counted = group_pairs(tokens.repartition("h").sortWithinPartitions("h"))
    counted_path = staging_path(spark, "counted")
    counted.write.parquet(counted_path)
    counted = spark.read.schema(counted.schema).parquet(counted_path)

    often = counted.where(F.col("b") == _NONE).select(F.col("a").alias("id"), F.col("n").alias("often"))
    facts = (
        labelled.select("id", "n", "grp", F.size("low").alias("low"))
        .join(often, "id", "left")
        .select("id", "n", "grp", "low", F.coalesce("often", F.lit(0)).alias("often"))
    )
    facts_path = staging_path(spark, "facts")
    facts.write.parquet(facts_path)
    facts = spark.read.schema(facts.schema).parquet(facts_path)

    def side(c: str) -> DataFrame:
        return facts.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "low", "often")])

    pairs = counted.where(F.col("b") != _NONE).select("a", "b", F.col("n").alias("c"))
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(
            "9 * (c + least(often_a, often_b) + least(n_a - low_a, n_b - low_b)) >= 4 * (n_a + n_b)"
            " and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"
        )
        .select("a", "b")
    )
    unsafe = facts.where("5 * (low - often) <= n")
    # what other documents were edited from has most frequent shingles: it leads the second stars
    centres = unsafe.select("id", (F.col("often") / (F.col("low") + 1)).alias("weight"))
    more_links = verify(star_edges(keys, centres), docs)
    links = first_links.union(more_links)
    regrouped = components(links).withColumnRenamed("component", "__c")
    open_sets = unsafe.join(regrouped, "id", "left").select("id", "n", F.coalesce("__c", "id").alias("grp"))
    whole = sets_of(docs, open_sets.select("id")).join(open_sets, "id").select("id", "grp", "n", "s")
    candidates = near.union(rare_first(whole)).distinct()
    links = links.union(verify(candidates, docs))
    joined = components(links)
    names = classes.join(joined, "id", "left").select(
        "d1", "d2", F.col("n").alias("n_set"), F.coalesce("component", "id").alias("component_id")
    )
    rows = own.select("doc_id", "n", "d1", "d2").join(
        names, (own["d1"] == names["d1"]) & (own["d2"] == names["d2"]) & (own["n"] == names["n_set"]), "left"
    )
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component."""
    found = trie_join(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id")))
    return docs.join(found.select(F.col("doc_id").alias("__out")).distinct(), F.col("doc_id") == F.col("__out"), "left_anti")
