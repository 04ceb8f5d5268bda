"""Quality classifier, rule ledger and language identification."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcheck.llm import nearest_centroid, pairwise_quality, rule_ledger
from parcelcheck.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_on_held_out_labels(spark):
    scored = LLM_QUERIES["op1_pairwise_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_never_sees_held_out_labels(spark, small):
    ids = small.select("doc_id")
    truth = ids.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    turned = truth.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    first = pairwise_quality.fit(pairwise_quality.labelled_sample(small, truth))
    assert first == pairwise_quality.fit(pairwise_quality.labelled_sample(small, turned))


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, None), (None, 1, 1), (5, None, 0), (10, 1, 0), (8, 0, 0)], LABELS)
    rows = pairwise_quality.pairwise_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score is not None for r in rows)
    kept = pairwise_quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert pairwise_quality.pairwise_quality(nothing, labels).count() == 0
    unlabelled = pairwise_quality.pairwise_quality(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_quality_sample_is_bounded_whatever_repeats(spark):
    """An id of a third of all rows gives one row, and labels beyond the limit none."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text")
    )
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    some = pairwise_quality.labelled_sample(docs, labels, 40).collect()
    assert len(some) <= 40
    every = pairwise_quality.labelled_sample(docs, labels).count()
    learnable = {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).collect()}
    assert every == len(learnable)


def test_fit_reaches_the_least_loss(spark):
    """Newton's weights come to the least pairwise logistic loss, found here by plain descent over all pairs."""
    rng = np.random.default_rng(3)
    width = len(pairwise_quality.FEATURES)
    rows = [(k % 2, [float(x) for x in rng.normal((k % 2) * 0.4, 1.0, width)]) for k in range(60)]
    ridge = 1e-3
    model = pairwise_quality.fit(spark.createDataFrame(rows, "y int, x array<double>"), pairs=10**9, ridge=ridge)
    x = (np.array([r[1] for r in rows]) - np.array(model.mean)) / np.array(model.scale)
    w = np.array(model.weights)
    y = np.array([r[0] for r in rows])

    def loss(w):
        gaps = [(a - b) @ w for a in x[y == 1] for b in x[y == 0]]
        return np.mean(np.log1p(np.exp(-np.array(gaps)))) + ridge / 2 * w @ w

    v = np.zeros(width)
    diff = np.array([a - b for a in x[y == 1] for b in x[y == 0]])
    for _ in range(6000):
        v -= 0.5 * (-(diff / (1 + np.exp(diff @ v))[:, None]).mean(axis=0) + ridge * v)
    # pairs are drawn, so the weights come near the least loss over all pairs
    assert 0 <= loss(w) - loss(v) < 0.1 * (loss(np.zeros(width)) - loss(v))


def test_fit_separates_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 2, [float(x) for x in rng.normal(k % 2, 0.1, len(pairwise_quality.FEATURES))]) for k in range(200)]
    model = pairwise_quality.fit(spark.createDataFrame(rows, "y int, x array<double>"))
    scored = spark.createDataFrame(rows, "y int, x array<double>").select("y", pairwise_quality.score_column(model).alias("p"))
    assert all((r.p >= 0.5) == bool(r.y) for r in scored.collect())


def brute_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger_of_odd_rows(odd, nothing):
    rows = rule_ledger.rule_ledger(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r.doc_id, *brute_measures(r.text)) for r in odd.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert rule_ledger.rule_ledger(nothing).count() == 0


def test_ledger_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = LLM_QUERIES["op2_rule_ledger"](spark, SF)
    res = db.execute(LLM_ORACLES["op2_rule_ledger"])
    names = [d[0] for d in res.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, res.fetchall()))


def test_ablations_count_what_one_rule_rejects(small, nothing):
    book = rule_ledger.ledger(rule_ledger.measure(small))
    rows = book.select("failed", "n_words").collect()
    for r in rule_ledger.ablations(book).collect():
        mask = rule_ledger.mask_of(rule_ledger.POLICIES[r.policy])
        bit = rule_ledger.mask_of((r.rule,))
        alone = [x for x in rows if x.failed & mask == bit]
        assert (r.failing, r.rejected_alone) == (sum(bool(x.failed & bit) for x in rows), len(alone))
        assert r.words_regained == sum(x.n_words for x in alone)
    empty = rule_ledger.ablations(rule_ledger.ledger(rule_ledger.measure(nothing))).collect()
    assert {r.failing for r in empty} == {0}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = LLM_QUERIES["op10_nearest_centroid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_language_of_odd_rows(odd, nothing):
    rows = {(r.doc_id, r.score): r for r in nearest_centroid.nearest_centroid(odd).collect()}
    by_id = {r.doc_id: r for r in rows.values()}
    for key in (4, 5, 6, 8):
        assert (by_id[key].lang_pred, by_id[key].score) == ("und", 0.0)
    assert by_id[7].lang_pred in ("en", "de") and by_id[1].lang_pred == "en"
    assert nearest_centroid.nearest_centroid(odd).count() == odd.count()
    assert nearest_centroid.nearest_centroid(nothing).count() == 0
    assert {r.lang_pred for r in nearest_centroid.predict(odd, None).collect()} == {"und"}


def test_language_sample_is_bounded_whatever_repeats(spark):
    """Null ids and copies of one text, a third of the rows each, don't widen the sample."""
    docs = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    rows = nearest_centroid.sample(docs, 50).collect()
    assert {g: sum(r.lang == g for r in rows) for g in ("en", "de")} == {"en": 50, "de": 50}
    assert len({(r.lang, r.text) for r in rows}) == 100


def test_far_texts_are_rejected(spark):
    rng = np.random.default_rng(0)
    words = {"en": "the and of water house stone", "de": "und der die wasser haus stein"}
    rows = [(k, " ".join(rng.choice(words[g].split(), 40)), g) for k in range(200) for g in ("en", "de")]
    rows = [(i, t, g) for i, (_, t, g) in enumerate(rows)]
    model = nearest_centroid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, "zzxq qqzx xxqz zqxj"), (2, "the house of stone and water")], "doc_id long, text string")
    found = {r.doc_id: r.rejected for r in nearest_centroid.predict(new, model).collect()}
    assert found == {1: True, 2: False}


@pytest.mark.parametrize("text,letters", [("", False), ("12 !?", False), ("é", True), ("日本", True), ("a", True)])
def test_grams_need_letters(text, letters):
    assert bool(nearest_centroid.gram_counts(text).any()) == letters
