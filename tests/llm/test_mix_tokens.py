"""Entropy-balanced mixing and the byte-pair codec."""

import hashlib
import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelcheck.llm import backtrack_bpe, entropy_mix
from parcelcheck.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return backtrack_bpe.Codec(file.read())


def test_targets_stop_at_the_cap():
    sizes = [10.0, 1000.0, 50.0, 0.0, 5.0]
    got = entropy_mix.targets(sizes)
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert got[0] == 30 and math.isclose(sum(got), sum(sizes))
    assert entropy_mix.targets([]) == [] and entropy_mix.targets([0.0, 0.0]) == [0.0, 0.0]


def test_mix_meets_targets(spark):
    rows = LLM_QUERIES["op3_entropy_mix"](spark, "/root/testdata/sf0.01").collect()
    again = LLM_QUERIES["op3_entropy_mix"](spark, "/root/testdata/sf0.01").collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)
    assert math.isclose(sum(target.values()), sum(r.size for r in rows))


def test_rates_are_exponential_tilts(spark):
    rows = entropy_mix.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    for group in by_source.values():
        mean = sum(r.size for r in group) / len(group)
        duals = [math.log(r.rate) * (r.size + mean) / (2 * r.size) for r in group if r.size and r.rate < 3]
        assert max(duals) - min(duals) < 1e-6
        assert math.isclose(sum(r.rate * r.size for r in group), group[0].target, rel_tol=1e-6)


def test_mix_of_odd_rows(odd, nothing):
    rows = entropy_mix.entropy_mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.target for r in rows if r.source_size == 1} == {3.0}  # the null source
    mixed = entropy_mix.repeat_rows(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert entropy_mix.entropy_mix(nothing).count() == 0 and entropy_mix.repeat_rows(nothing).count() == 0


def test_equal_rows_share_the_extra_copies(spark):
    """A source of 2,000 equal rows and one of 500, null ids included, come within a document of their targets."""
    text = "w " * 5
    rows = [(7, text, "a")] * 2000 + [(None, text, "b")] * 500 + [(k, "w " * (1 + k % 9), "c") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = entropy_mix.entropy_mix(docs)
    assert mixed.count() == len(rows)
    by_size = {r.source_size: r for r in mixed.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert set(by_size) == {10_000, 2_500, sum(1 + k % 9 for k in range(900))}
    for r in by_size.values():
        assert abs(r.taken - r.target) <= 10 and r.most <= 3
    # the corpus holds as many rows as the copies say, from one pass over the texts
    out = entropy_mix.repeat_rows(docs)
    assert out.columns == docs.columns
    assert out.groupBy("source").count().where("source = 'a'").first()["count"] * 5 == by_size[10_000].taken


def test_numbers_of_equal_rows_have_no_gaps(spark):
    rows = [(1, "s", 3)] * 50 + [(None, None, 3)] * 20 + [(k, "s", 3) for k in range(2, 9)] + [(3, None, 3)]
    dealt = [(*r, k % 4) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(dealt, "doc_id long, source string, size long, __salt int").repartition(3)
    _, told = entropy_mix.numbered(frame)
    got = sorted((str(r.doc_id), str(r.source), r["__nth"]) for r in told.collect())
    want = [("1", "s", k) for k in range(1, 51)] + [("None", "None", k) for k in range(1, 21)] + [(str(k), "s", 0) for k in range(2, 9)] + [("3", "None", 0)]
    assert got == sorted(want)


def test_one_hot_source(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("array_join(array_repeat('w', cast(1 + id % 37 as int)), ' ')").alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
    )
    rows = entropy_mix.mix(docs).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")
    )
    assert all(abs(r.taken - r.target) <= 37 for r in rows.collect())


def random_texts(n):
    rng = random.Random(3)
    parts = ["a", "b", "th", "er", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "<|endoftext|>", "<|end", "'s", "12", "\xa0"]
    parts += ["\x1c", "\x85", "\r\n", "!!", "Ing", "́", "\x00", "²", "　", "﻿", "don't", "\U00010348"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_equals_library(own, library):
    for text in random_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == ids
        assert own.decode(got).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 30_000, "abcdef0123456789" * 2_000, " " * 5_000, "é" * 5_000, "\n \n" * 3_000])
def test_long_runs(own, library, text):
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_piece_table_may_overflow(own, library, monkeypatch):
    monkeypatch.setattr(backtrack_bpe, "KEPT_PIECES", 3)
    for text in ("one two three four five six", "six seven one two eight " + "z" * 100):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_ids(own, library):
    for ids in ([0, 255, 300], [50256, 128], [160, 161, 162, 163]):
        import numpy as np

        assert own.decode(np.array(ids)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_odd_rows(odd, nothing, library):
    got = backtrack_bpe.round_trip(odd, PATH).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), r.text or ""))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert backtrack_bpe.round_trip(nothing, PATH).count() == 0
    encoded = backtrack_bpe.encode(odd, PATH)
    back = backtrack_bpe.decode(encoded, PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
