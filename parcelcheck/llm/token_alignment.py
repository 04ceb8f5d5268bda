"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are grouped by their full text (copies combine on the map side). Every
distinct one is encoded by both tokenizers and aligned by byte offsets: where
tokens of both end there is a group border, and every stretch between two
neighbouring token ends of either side is one link, because exactly one token
of each covers it. Links of an id pair are counted over the corpus with the
text's multiplicity as weight. The measures then go back to the documents by
the SHA-256 of the text.

Pair counts meet texts in two ways: the most frequent pairs (at most FREQUENT
rows) are broadcast, all rarer ones are joined by a shuffle; texts of more than
1 / HOT of all rows are broadcast (fewer than HOT rows), the rest is joined by
a shuffle. Rows that need no partner there get a key of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcheck.llm.backtrack_bpe import byte_letters, ranges, share_file
from parcelcheck.session import remove_staged, staging_path

#: Pairs whose counts are broadcast, at most.
FREQUENT = 500_000
#: A text of more than this share of the rows, as 1 of so many, is hot.
HOT = 50_000
#: Characters that are encoded at once.
CHUNK_CHARS = 500_000

#: How text is cut before the merges of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class is the same in all versions of Unicode, and the longest run of them that the faster encoder takes.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u052f]*")
RUN = 400

_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pair:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=piece_file)
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        values = [t.encode() if t in special else bytes(letters[c] for c in t) for t in tokens]
        self.bytes_a = _table(values)
        # the same vocabulary, whose ids are the ranks of its merges, for the encoder without offsets
        ranks = {v: i for i, (v, t) in enumerate(zip(values, tokens)) if t not in special}
        self.fast = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _table(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
        )
        ids = range(max(size, len(pieces)))
        self.marked = [np.array([f"{i}{mark}" for i in ids], dtype=object) for mark in ",|;"]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for every text, a bounded number of characters at a time."""
        chunk: list[str] = []
        held = 0
        for k, text in enumerate(texts):
            chunk.append(text)
            held += len(text)
            if held >= CHUNK_CHARS or k == len(texts) - 1:
                for x, y in zip(map(self.encode_a, chunk), self.b.encode(chunk, num_threads=1)):
                    yield np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
                chunk, held = [], 0

    def encode_a(self, text: str) -> list[int]:
        """A's ids. Plain text goes through the rank table; any other character,
        or a very long run, through the tokenizer of the file itself."""
        if _PLAIN.fullmatch(text) and len(max(text.split(" "), key=len)) < RUN:
            return self.fast.encode_ordinary(" " + text)
        return self.a.encode(" " + text, add_special_tokens=False).ids

    def align(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple | None:
        """``(n_a, n_b, n_groups, n_links, digest, pairs, times)``; None if the bytes of either side differ from the text's."""
        data = (" " + text).encode()
        (pool_a, at_a, size_a), (pool_b, at_b, size_b) = self.bytes_a, self.bytes_b
        if ranges(pool_a, at_a[a], size_a[a]).tobytes() != data or ranges(pool_b, at_b[b], size_b[b]).tobytes() != data:
            return None
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        ends = np.sort(np.concatenate((ends_a, ends_b)))
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))]
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[in_a] == ends) & (ends_b[in_b] == ends)
        code = np.sort((a[in_a] << 32) | b[in_b])
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        times = np.diff(np.concatenate((first, [len(code)])))
        # every id with the mark that follows it, A's ids of a group before B's
        end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        end_a[in_a[both]], end_b[in_b[both]] = True, True
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        comma, bar, semicolon = self.marked
        names = np.concatenate((np.where(end_a, bar[a], comma[a]), np.where(end_b, semicolon[b], comma[b])))
        digest = hashlib.sha256("".join(names[order].tolist())[:-1].encode()).hexdigest()
        return len(a), len(b), int(both.sum()), len(ends), digest, code[first], times


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizers_of(byte_name: str, piece_name: str) -> Pair:
    """One pair for each two files and Python worker."""
    names = byte_name, piece_name
    if names not in _PAIRS:
        _PAIRS[names] = Pair(*[SparkFiles.get(n) for n in names])
    return _PAIRS[names]


def _staged(rows: DataFrame, label: str) -> tuple[str, DataFrame]:
    path = staging_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return path, rows.sparkSession.read.schema(rows.schema).parquet(path)


_ALIGNED = (
    "key string, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<long>, times array<long>"
)


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """One row for each distinct text that has tokens: its key, how many rows hold it, its
    measures, and its distinct id pairs (A's id in the upper, B's in the lower half) with their links."""
    names = tuple(share_file(docs.sparkSession, path) for path in (byte_path, piece_path))
    body = F.col(text)
    texts = docs.select(body.alias("t")).where(F.length("t") > 0).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers_of(*names)
        schema = pa.schema(
            [("key", pa.string()), ("n", pa.int64())]
            + [(c, pa.int64()) for c in _MEASURES[:4]]
            + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
        )
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows: list[list] = [[] for _ in schema]
            for k, (a, b) in enumerate(own.encode(texts)):
                made = own.align(texts[k], a, b)
                if made is not None:
                    for column, x in zip(rows, (batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), *made)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return texts.select("t", F.sha2(F.col("t").cast("binary"), 256).alias("key"), "n").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count)``: links of every id pair in the corpus."""
    links = aligned.select("n", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("n") * F.col("x.times")).alias("count"))


def ranked(counts: DataFrame) -> DataFrame:
    """``(pair, count, best)``: best, if no pair of the same B id has a higher count."""
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    # one row for each id of B's vocabulary at most
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def frequent_from(counts: DataFrame, frequent: int = FREQUENT) -> int:
    """The least count of which at most ``frequent`` pairs have that or more; a power of two."""
    level = F.floor(F.log2("count")).cast("int")
    held, least = 0, 1 << 62
    for row in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("l")).collect():  # 63 rows at most
        held += row.n
        if held > frequent:
            break
        least = 1 << row.l
    return least


def text_measures(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with n_best and count_sum."""
    least = frequent_from(counts, frequent)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    links = links.select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = F.broadcast(counts.where(F.col("count") >= least))
    rare = counts.where(F.col("count") < least)

    def sums(rows: DataFrame) -> DataFrame:
        # a text's links lie together, so that the map side leaves about one row for each text
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return rows.groupBy("key").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    parts = sums(links.join(often, "pair"))
    if not rare.isEmpty():
        others = links.join(often.select("pair"), "pair", "left_anti").join(rare, "pair")
        parts = parts.unionByName(sums(others))
    total = parts.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(total, "key")


def token_alignment(
    docs: DataFrame, byte_path: str, piece_path: str, frequent: int = FREQUENT, hot: int = HOT
) -> DataFrame:
    """The contract's measures for every row of ``docs``.

    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have zeros and an empty digest, and take no part in the
    counts. Rows that repeat a doc_id, also a null one, stay rows of their own;
    rows that repeat a text count with their number. An empty table gives an
    empty table. A very long text is encoded whole, in one task.
    """
    aligned_path, aligned = _staged(aligned_texts(docs, byte_path, piece_path), "aligned-texts")
    plain_path, plain = _staged(pair_counts(aligned), "pair-counts")
    counts_path, counts = _staged(ranked(plain), "ranked-pairs")
    _, whole = _staged(text_measures(aligned, counts, frequent), "text-measures")
    for path in (aligned_path, plain_path, counts_path):
        remove_staged(docs.sparkSession, path)
    total = whole.agg(F.sum("n")).first()[0] or 0
    fields = F.struct(*_MEASURES, "groups_sha256")
    is_hot = F.col("n") * hot > total
    few = whole.where(is_hot).select(F.col("key").alias("hot_key"), fields.alias("hot"))
    rest = whole.where(~is_hot).select(F.col("key").alias("rest_key"), fields.alias("rest"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    own = F.concat(F.lit("#"), F.xxhash64("doc_id", "key").cast("string"))
    seek = F.when(F.col("key").isNull() | F.col("hot_key").isNotNull(), own).otherwise(F.col("key"))
    met = rows.join(F.broadcast(few), F.col("key") == F.col("hot_key"), "left").withColumn("seek", seek)
    met = met.join(rest, F.col("seek") == F.col("rest_key"), "left").select("doc_id", F.coalesce("hot", "rest").alias("m"))
    return met.select(
        "doc_id",
        *[F.coalesce(F.col("m")[c], F.lit(0)).cast("long").alias(c) for c in _MEASURES],
        F.coalesce(F.col("m.groups_sha256"), F.lit("")).alias("groups_sha256"),
    )
