"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from parcelcheck.llm import norm_buckets as S
from parcelcheck.llm.queries import LLM_ORACLES, LLM_QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs, items):
    bags = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + (90 * b.total() * n_docs) // n_terms
            score = sum(w[t] * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[: S.TOP], 1):
            out.append((str(item), rank, str(i), -s))
    return sorted(out)


def ours(spark, docs, items):
    found = S.norm_buckets(
        spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3),
        spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int"),
    )
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in found.collect())


def made(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def case(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["ÄB", "äb", "Émile", "x-y", "\U0001f600"]
    docs = [(k, made(rng, rng.randint(0, 200), words)) for k in range(300)]
    docs += [(None, docs[3][1]), (7, docs[7][1]), (500, docs[9][1]), (501, docs[9][1]), (900, None), (901, "!!! ???")]
    items = [(k, made(rng, rng.randint(1, 30), words)) for k in range(20)]
    items += [(20, None), (21, "..."), (None, "w1 W2"), (3, "w5 w6"), (22, docs[9][1]), (23, "nowhere")]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST", 20)
    monkeypatch.setattr(S, "GROWTH", 2)
    monkeypatch.setattr(S, "CELLS", 1000)
    docs, items = case(1)
    assert ours(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TERMS", 150)
    docs, items = case(2)
    assert ours(spark, docs, items) == brute(docs, items)


def test_bounds_leave_out_only_what_cannot_matter():
    """Candidates at a threshold hold every cell that reaches it, and not all cells."""
    rng = np.random.default_rng(4)
    left = 0
    for _ in range(30):
        width = 60
        terms = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)) for _ in range(25)]
        queries = S.Queries(list(range(25)), terms, {str(k): k for k in range(width)}, rng.integers(0, 9000, width))
        queries.prepare()
        rows = [np.sort(rng.choice(width, rng.integers(1, 20), replace=False)) for _ in range(40)]
        ids, starts = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        impacts = rng.integers(1, 900_000, len(ids))
        norm = np.array([math.sqrt(sum(float(queries.weights[i]) * float(v) ** 2 for i, v in zip(ids[a:b], impacts[a:b]))) for a, b in zip(starts, starts[1:])])
        every = np.zeros((40, 25), dtype=np.int64)
        for d in range(40):
            own = dict(zip(ids[starts[d] : starts[d + 1]].tolist(), impacts[starts[d] : starts[d + 1]].tolist()))
            for q, t in enumerate(terms):
                every[d, q] = sum(int(queries.weights[k]) * own.get(int(k), 0) for k in t)
        limit = np.quantile(every, 0.9, axis=0).astype(float)
        alive = S.candidates(queries, limit, norm, starts, ids, impacts)
        assert not ((every >= limit[None, :]) & ~alive).any()
        left += int(alive.sum())
        cell, score = S.exact_scores(queries, alive, starts, ids, impacts)
        assert (every.ravel()[cell] == score).all()
        assert set(np.flatnonzero(alive.ravel() & (every.ravel() > 0))) == set(cell.tolist())
    assert left < 0.6 * 30 * 40 * 25


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = db.execute(LLM_ORACLES["op13_norm_buckets"])
    names = [d[0] for d in res.description]
    got = LLM_QUERIES["op13_norm_buckets"](spark, sf).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, res.fetchall()))


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, rows[0][1]), (2, "green house 5"), (None, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = S.norm_buckets(odd, table).collect()
    assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got) == brute(rows, items)
    assert S.norm_buckets(nothing, table).count() == 0
    assert S.norm_buckets(odd, table.limit(0)).count() == 0
