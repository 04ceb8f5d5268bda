"""Jaccard join, fingerprints, line dedup, components and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelcheck.llm import components, fuzzy_lines, trie_join, weighted_sampling
from parcelcheck.session import staging_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def shingles(text):
    words = [x for x in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if x]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {i: (len(s), groups(sets, links)[i]) for i, s in sets.items()} if len(sets) < 3 else _grouped(sets, links)


def _grouped(sets, links):
    found = groups(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 5), (9, 8), (9, 8)]
    ids = {x for p in links for x in p}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups(ids, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(seed=1):
    """Copies, edits on both sides of the bound, a passage in many documents, a chain, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(8, 200))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(rng.choice([0, 3, 8, 12, 20, 100]))] for _ in range(60)]
    texts += [[w] for w in "abc"] + [["a", "B"], ["a", "b"], ["A", "b", "c", "d"], ["a", "b", "c", "d", "e"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n")]


@pytest.mark.parametrize("frequent", [32, 3])
def test_join_equals_brute_force(spark, monkeypatch, frequent):
    """With a low bound for frequent shingles most documents take the way over rare shingles."""
    monkeypatch.setattr(trie_join, "FREQUENT", frequent)
    rows = planted()
    got = trie_join.trie_join(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows)


def test_join_without_provisional_groups(spark, monkeypatch):
    """Steps 2 and 3 alone find every link."""
    monkeypatch.setattr(trie_join, "star_edges", lambda keys, weights=None: keys.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    rows = planted(2)
    got = trie_join.trie_join(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows)


def test_pairs_of_a_stream_with_a_hot_shingle():
    rows = np.array([(1, k, k) for k in range(100)] + [(2, 5, 5), (2, 6, 6), (3, 1, 9), (3, 2, 9)])
    out = [tuple(x.values()) for b in trie_join._pairs_of(rows) for x in b.to_pylist()]
    assert (5, 6, 1) in out and sum(b == trie_join._NONE for _, b, _ in out) == 100 and len(out) == 101


def test_walk_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(500):
        leader = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 60)))
        members = []
        for _ in range(rng.integers(1, 8)):
            kept = leader[rng.random(len(leader)) > rng.choice([0, 0.05, 0.1, 0.2, 0.5])]
            members.append(np.unique(np.concatenate((kept, rng.integers(-(2**62), 2**62, rng.integers(1, 6))))))
        want = [9 * len(np.intersect1d(leader, m)) >= 4 * (len(leader) + len(m)) for m in members]
        assert trie_join.walk(leader, members) == want


def test_join_of_odd_rows(odd, nothing):
    rows = trie_join.trie_join(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r.component_id for r in rows if r.doc_id != 13}
    assert [found[k] for k in (1, 2, 3, 14)] == [1, 1, 1, 1] and found[4] == 4 and found[None] is None
    kept = trie_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert trie_join.trie_join(nothing).count() == 0 and trie_join.keep_one(nothing).count() == 0


def bag(text):
    return Counter(x for x in re.split("[ \t-\r]+", text or "") if x)


def test_fingerprints_estimate_weighted_jaccard(spark, small):
    rows = sorted(small.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in weighted_sampling.weighted_sampling(small).collect()}
    gaps = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)].text
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = bag(text), bag(other)
            gaps.append(near - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.11


def test_more_samples_come_nearer(spark):
    a, b = "x x x x y y z w w w", "x x y y y y z z q"
    want = sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    frame = spark.createDataFrame([(1, a), (2, b)], DOCS)
    codes = {r.doc_id: r.codes for r in weighted_sampling.fingerprints(frame, "text", ["doc_id"], 4000).collect()}
    assert abs(np.mean([x == y for x, y in zip(codes[1], codes[2], strict=True)]) - want) < 0.03


def test_fingerprints_of_odd_rows(odd, nothing):
    rows = weighted_sampling.weighted_sampling(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[14].fingerprint != by_id[3].fingerprint
    assert by_id[1].near_next == 1.0 and by_id[4].fingerprint == "" and by_id[4].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert weighted_sampling.weighted_sampling(nothing).count() == 0


def test_blocks_of_uneven_ids(spark, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "BLOCK_ROWS", 2)
    ids = list(range(200)) + [10**12 + 7 * k for k in range(150)] + [-5, 2**62]
    frame = spark.createDataFrame([(i, f"w{i} common") for i in ids], DOCS).repartition(6)
    got = {r.doc_id: r.edited_sha256 for r in weighted_sampling.weighted_sampling(frame).collect()}
    ids.sort()
    for k, i in enumerate(ids):
        text, after = f"w{i} common", f"w{ids[(k + 1) % len(ids)]} common"
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def norm_words(line):
    table = {ord(a): (fuzzy_lines._TO[k] if k < len(fuzzy_lines._TO) else None) for k, a in enumerate(fuzzy_lines._FROM)}
    return tuple(w for w in line.translate(table).split(" ") if w)


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def word_hash(word):
    return int(pd.util.hash_array(np.array([word.encode()], dtype=object), categorize=False)[0])


def lanes_of(words):
    """(class, lane, SimHash of the lane), by counting bits."""
    n = len(set(words))
    if n < fuzzy_lines.MIN_WORDS:
        return set()
    own = math.floor(math.log(n) / math.log(fuzzy_lines.CLASS_STEP))
    out = set()
    for c in [own, own + 1] if fuzzy_lines.CLASS_STEP ** (own + 1) * 0.9 <= n else [own]:
        lanes = max(2, math.floor(fuzzy_lines.CLASS_STEP ** (c + 1) / fuzzy_lines.WORDS_A_LANE) + 1)
        dealt = defaultdict(list)
        for h in {word_hash(w) for w in words}:
            dealt[(h % 2**64 >> 48) % lanes].append(h % 2**48)
        for lane, low in dealt.items():
            low = sorted(low)[: fuzzy_lines.LANE_WORDS]
            bits = tuple(2 * sum(x >> i & 1 for x in low) > len(low) for i in range(48) if i % 4 < fuzzy_lines._SHIFTS)
            out.add((c, lane, bits))
    return out


def brute_dedup(rows, every=False):
    """Texts after dedup; links need a lane in common unless ``every`` near pair is to count."""
    at = defaultdict(list)
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for place, line in enumerate((text or "").split("\n")):
            words = norm_words(line)
            if len(words) >= fuzzy_lines.MIN_WORDS or len(" ".join(words)) >= fuzzy_lines.EXACT_CHARS:
                at[words].append((doc_id, place))
    keys = list(at)
    lanes = [lanes_of(k) for k in keys]
    links = near_pairs(keys)
    if not every:
        links = [(i, j) for i, j in links if lanes[i] & lanes[j]]
    home = groups(range(len(keys)), links)
    first = {}
    for i, words in enumerate(keys):
        first[home[i]] = min([first.get(home[i], at[words][0]), *at[words]])
    gone = {p for i, words in enumerate(keys) for p in at[words]} - set(first.values())
    return {
        d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows
    }


def near_pairs(keys):
    """All pairs of texts of which a fifth of the longer one's words or fewer have to be edited."""
    bags = [Counter(k) for k in keys]
    out = []
    order = sorted((i for i in range(len(keys)) if len(keys[i]) >= fuzzy_lines.MIN_WORDS), key=lambda i: len(keys[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            most = len(keys[j]) // 5
            if len(keys[j]) - len(keys[i]) > most:
                break
            if sum((bags[j] - bags[i]).values()) <= most and edits(keys[i], keys[j]) <= most:
                out.append((min(i, j), max(i, j)))
    return out


def fuzzy_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(rng.randint(5, 60))] for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice(["", "! "]) + " ".join(line).capitalize() + rng.choice(["", ".", ","]))
        lines += rng.sample(["short line", "", "   ", word()], 2)
        rows.append((k, "\n".join(lines)))
    return rows + [(60, None), (61, "")]


def test_lines_equal_brute_force(spark):
    rows = fuzzy_rows()
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(frame).collect()}
    want = brute_dedup(rows)
    assert got == want
    assert sum(len(t or "") for t in want.values()) < 0.7 * sum(len(t or "") for _, t in rows)


def test_lanes_are_simhashes_of_their_words():
    """Two lines share a key exactly where class, lane and majority of bits are the same."""
    rng = random.Random(6)
    rows = []
    for n in [1, 4, 5, 6, 7, 9, 12, 15, 24, 25, 60, 61, 140, 2000]:
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for edited in (0, 1, 2, n // 10):
            line = list(base)
            for at in rng.sample(range(n), min(edited, n)):
                line[at] = f"v{rng.randrange(3000)}"
            rows.append((len(rows), line))
    hashes = np.array([word_hash(w) for _, line in rows for w in line], np.uint64)
    found, many = fuzzy_lines.lane_keys(np.array([len(line) for _, line in rows]), hashes)
    keys = dict(enumerate(np.split(found, np.cumsum(many)[:-1])))
    lanes = {i: lanes_of(w) for i, w in rows}
    assert all(len(keys[i]) == len(lanes[i]) for i in keys)
    for i, j in combinations(keys, 2):
        assert len(set(keys[i].tolist()) & set(keys[j].tolist())) == len(lanes[i] & lanes[j])


def test_recall_on_the_lines_of_the_documents(small):
    """At least nine of ten near pairs of the documents' own lines share a lane."""
    lines = {norm_words(x) for r in small.collect() for x in (r.text or "").split("\n")}
    keys = sorted(k for k in lines if len(k) >= fuzzy_lines.MIN_WORDS)
    pairs = near_pairs(keys)
    found = sum(bool(lanes_of(keys[i]) & lanes_of(keys[j])) for i, j in pairs)
    assert len(pairs) > 20 and found >= 0.9 * len(pairs)


def test_short_lines_count_as_equal_ones_only(spark):
    rows = [(1, "Verylongheadingwithoutblanks.py\nyes\na b c d e f"), (2, "verylongheadingwithoutblankspy\nyes\na b c d e g"), (3, "a b c d e f g h i j"), (4, "a b c d e f g h i x")]
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_dedup(rows) and got[2].startswith("yes")


def test_large_blocks_are_cut_and_the_largest_group_never_meets_itself(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "BLOCK_ROWS", 50)
    rng = random.Random(4)
    ids = list({rng.randrange(-(2**62), 2**62) for _ in range(1200)})
    rows = [(1, k, 7 if i < 600 else k) for i, k in enumerate(ids[:601])]  # a large group and an outsider
    rows += [(2, k, k % 3) for k in ids[601:900]] + [(3, k, 5) for k in ids[900:]]
    left, right = fuzzy_lines.sides(spark.createDataFrame(rows, "key long, k long, grp long"))
    met = left.join(right, ["key", "x", "y"])
    cells = met.groupBy("key", "x", "y").count().agg(F.max("count")).first()[0]
    assert met.where("key = 1").count() == 601 and met.where("key = 3").count() == 0 and cells < 10_000
    got = {(min(r.k, r.k2), max(r.k, r.k2)) for r in met.where("grp <> grp2").collect()}
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a, b in combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]}
    assert got == want


def coded_lines(spark, lines):
    """``(k, e, n, b0, b1, b2, b3)`` of lines numbered in order."""
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(lines)], "k long, w array<string>")
    made = rows.select("k", fuzzy_lines.encoded().alias("e"), *fuzzy_lines.word_sets())
    return made.select("k", "e", F.col("n").cast("int").alias("n"), *[F.col("sets")[j].alias(f"b{j}") for j in range(4)])


def test_crowded_block_forms_few_pairs_and_misses_none(spark):
    """Lines with a common word but little else in common don't all meet; similar ones do, and only they leave the join."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    lines = []
    for _ in range(150):
        base = ["the", "of"] + [word() for _ in range(rng.randint(3, 38))]
        lines.append(base)
        changed = list(base)
        for _ in range(len(base) // 5):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], [word()], [word(), changed[at]], ["the"]])
        lines.append(changed)
    lines.append(["the"] * 20 + ["of"] * 5 + ["a", "b", "c"])
    lines.append(["the"] * 21 + ["of"] * 5 + ["d", "e", "f"])
    coded = coded_lines(spark, lines)
    rows = spark.createDataFrame([(1, True, k, k) for k in range(len(lines))], "key long, crowded boolean, k long, grp long")
    left, right = fuzzy_lines.sides(fuzzy_lines.meeting_points(rows, coded))
    met = left.join(right, ["key", "x", "y"])
    assert met.count() < len(lines) ** 2 / 20
    pairs = {(min(r.k, r.k2), max(r.k, r.k2)) for r in met.where(fuzzy_lines.similar("e", "e2") & (F.col("k") != F.col("k2"))).collect()}
    fits = fuzzy_lines.likely(F.col, lambda c: F.col(f"{c}2"))
    kept = {(min(r.k, r.k2), max(r.k, r.k2)) for r in met.where(fits & (F.col("k") != F.col("k2"))).collect()}
    want = {(i, j) for i, j in combinations(range(len(lines)), 2) if edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) // 5}
    assert len(want) > 100 and pairs == want and want <= kept


def test_pair_of_a_crowded_block_leaves_the_join_once(spark):
    """Near copies have many rare words in common, but each pair is compared for one of them only."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(40)]
    lines = []
    for _ in range(30):
        line = list(base)
        for at in rng.sample(range(40), 2):
            line[at] = f"v{rng.randrange(3000)}"
        lines.append(line)
    coded = coded_lines(spark, lines)
    rows = spark.createDataFrame([(1, True, k, k) for k in range(30)], "key long, crowded boolean, k long, grp long")
    pairs = [(r.a, r.b) for r in fuzzy_lines.block_pairs(fuzzy_lines.meeting_points(rows, coded)).collect()]
    want = {(i, j) for i, j in combinations(range(30), 2) if edits(lines[i], lines[j]) <= 8}
    assert want <= set(pairs) and max(Counter(pairs).values()) <= 2  # either of the two may be on the left side


def test_groups_joined_by_further_links_equal_those_of_all_links(spark):
    rng = random.Random(13)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(5, 5), (399, 398)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = components.components(frame(links)).select(F.col("id").alias("k"), F.col("component").alias("grp"))
    own = fuzzy_lines.Staged(spark)
    got = {r.k: r.grp for r in fuzzy_lines.joined_groups(first, frame(more), own).collect()}
    want = {r.id: r.component for r in components.components(frame(links + more)).collect()}
    assert {k: g for k, g in want.items() if g != k} == {k: g for k, g in got.items() if g != k}
    assert fuzzy_lines.joined_groups(first, frame([]), own) is first
    own.clear()


def test_copies_of_a_line_have_keys_once_in_a_task(spark):
    line = "one two three four five six seven eight"
    rows = [(k, f"{line}\n\n  \tGrüße, {line}!\nx y\n{line.upper()}.") for k in range(5)]
    made = fuzzy_lines.eligible_lines(spark.createDataFrame(rows, DOCS).coalesce(1)).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place) for r in made] == [(k, n) for k in range(5) for n in (0, 2, 4)]
    first, second = made[0], made[1]
    assert [len(r.keys) > 0 for r in made] == [True, True] + [False] * 13
    assert {r.k for r in made if r.place != 2} == {first.k} and {r.k for r in made if r.place == 2} == {second.k}
    found = {r.place: r.k for r in spark.createDataFrame([(0, line), (2, f"grüße {line}")], "place int, t string").select("place", F.xxhash64("t").alias("k")).collect()}
    assert (first.k, second.k) == (found[0], found[2])
    assert len(first.keys) == len(lanes_of(norm_words(line)))


def test_crowded_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "CROWD", 0)
    rng = random.Random(3)
    words = ["the", "of", "and"] + [f"w{k}" for k in range(40)]
    rows = []
    for k in range(70):
        line = ["the", "of"] + rng.choices(words, k=rng.randint(3, 9))
        near = list(line)
        near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((k, " ".join(line) + "\n" + " ".join(near)))
    got = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_dedup(rows)


def test_lines_of_odd_rows(odd, nothing):
    left = fuzzy_lines.dedup_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    by_id = {r.doc_id: r.text for r in left.collect()}
    assert by_id[2] == by_id[3] == by_id[14] == "" and by_id[4] is None and by_id[1]
    assert len(by_id[9].split("\n")) == 1
    kept = {r.doc_id for r in fuzzy_lines.without_emptied(odd).collect()}
    assert {1, 4, 5, 6, 9} <= kept and not {2, 3, 14} & kept
    assert fuzzy_lines.fuzzy_lines(nothing).count() == 0 and fuzzy_lines.without_emptied(nothing).count() == 0


def run_stages(spark, docs, sf):
    """What every stage keeps; each runs once."""
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        path = staging_path(spark, "kept")
        step(spark, kept[-1], sf).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(k.columns == docs.columns for k in kept[:-1])
    return kept[1:]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Stages 2, 3 and 5 are redone by hand on what their predecessor kept; 1 and 4 by their operators' tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    one, two, three, four, five = run_stages(spark, docs, sf)
    left = {d: t for d, t in brute_dedup([(r.doc_id, r.text) for r in one.collect()]).items() if t.strip()}
    assert {r.doc_id: r.text for r in two.collect()} == left
    found = jaccard_groups(list(left.items()))
    kept = three.collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, (_, c) in found.items() if d == c)
    mixed = four.collect()
    assert {r.source for r in mixed} <= {r.source for r in kept}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in five.collect()) == want


def test_pipeline_takes_odd_and_empty_tables(spark, odd, nothing):
    sf = "/root/testdata/sf0.001"
    *_, five = run_stages(spark, odd, sf)
    assert five.columns[:2] == ["doc_id", "n_tokens"]
    assert run_stages(spark, nothing, sf)[-1].count() == 0
