"""Personal data: base spans and disclosing terms."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from parcelcheck.llm import disclosure as D

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BLANK = re.compile(r"[\x20\x09-\x0D]")
MARKS = ".,;:!?\"()[]{}<>*#$%&|_/\\'-"


def luhn(digits):
    at = [int(c) for c in reversed(digits)]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(at)) % 10 == 0


def fine(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def value(kind, hit):
    return hit.lower() if kind == "email" else hit if kind == "ip" else re.sub("[^0-9]", "", hit)


def base(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), value(kind, m[0])) for m in p.finditer(text) if fine(kind, m[0])]
    return sorted(out)


def term(piece):
    return piece.strip(MARKS).lower()


def brute(texts):
    """Rank of every disclosing term, by counting over the whole corpus."""
    counts, stems, total = Counter(), Counter(), 0
    contexts, entities = Counter(), Counter()
    for text in texts:
        pieces = BLANK.split(text)
        total += len([p for p in re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))])
        for p in pieces:
            if len(term(p)) >= D.LETTERS:
                counts[term(p)] += 1
                stems[term(p)[: D.STEM]] += 1
        for start, rank, stop, v in base(text):
            head, tail = len(BLANK.findall(text[:start])), len(BLANK.findall(text[:stop]))
            near = pieces[max(head - D.WINDOW, 0) : head] + pieces[tail + 1 : tail + 1 + D.WINDOW]
            near = tuple(t for t in map(term, near) if len(t) >= D.LETTERS and t.isalpha())
            contexts[(rank, v), near] += 1
            entities[rank, v] += 1
    together, seen, stem_near = Counter(), Counter(), Counter()
    for (entity, near), n in contexts.items():
        for t in set(near):
            together[entity, t] += n * near.count(t)
            stem_near[entity, t[: D.STEM]] += n * near.count(t)
            seen[entity, t] += 1
    found = defaultdict(set)
    for (entity, t), n in together.items():
        left = math.log2(counts[t] / min(n, counts[t]))
        g = t[: D.STEM]
        stem_left = math.log2(stems[g] / min(stem_near[entity, g], stems[g]))
        if seen[entity, t] >= D.MIN_CONTEXTS and left <= D.MAX_LEFT and math.log2(total / (2 * D.WINDOW * entities[entity])) > left:
            found[t].add(D.GENERALISED if stem_left >= D.SAFE_LEFT and len(t) > D.STEM else D.REMOVED)
    return {t: min(r) for t, r in found.items()}


def spans(text, terms):
    out = [(a, r, b) for a, r, b, _ in base(text)]
    at = 0
    for p in BLANK.split(text):
        if term(p) in terms:
            a = at + len(p) - len(p.lstrip(MARKS))
            out.append((a, terms[term(p)], a + len(term(p))))
        at += len(p) + 1
    return sorted(out)


def written(found):
    return ",".join(f"{D.KINDS[r]}:{a}:{b}" for a, r, b in found)


def check(df):
    docs = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    terms = brute([t for _, t in docs])
    want = []
    for i, text in docs:
        own = [(a, r, b) for a, r, b, _ in base(text)]
        n = [sum(r == k for _, r, _ in own) for k in range(4)]
        want.append((str(i), *n, hashlib.sha256(written(own).encode()).hexdigest(), written(spans(text, terms))))
    got = [
        (str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans)
        for r in D.disclosure(df).collect()
    ]
    assert sorted(got) == sorted(want)
    return terms


def corpus():
    """Two persons with names that stand by them, a place that shares its stem with many words, plain words."""
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("stone", "water", "light", "house") for b in ("s", "ly", "ward", "like", "ness")]
    rows = []
    for k in range(60):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if k % 3 == 0:
            words[7:7] = ["(Zubrowski)", "ann.z@mail.example.org,", "Waterford;"]
        if k % 5 == 0:
            words[3:3] = ["Kim", "+49 (170) 123-4567", "and", "4539 1488 0343 6467", rng.choice(plain)]
        if k == 17:
            words += ["zubrowski", "waterford's"]
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[1][1] + " copied unique@host.example.com Nevermore") for k in range(30)]
    return rows


def test_terms_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = check(df)
    assert terms["zubrowski"] == D.REMOVED and terms["waterford"] == D.GENERALISED
    assert "nevermore" not in terms  # thirty copies are one neighbourhood
    assert "waters" not in terms


def test_patterns_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x.y%z+w-", "@", "mail.example.com", "..", "1.2.3.4", "255", "256.", "0007", ".", "-", " ", "  ", "\n", "\t", "+"]
    parts += ["4539148803436467", "4111 1111 1111 1111", "49", "(170)", "555-6869", "1", "é", "\U0001f600", "Zoë", "9" * 14, "@c.d@e.f"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(800)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_documents_and_odd_rows(small, odd, nothing):
    check(small)
    check(odd)
    assert D.disclosure(nothing).count() == 0 and D.sanitise(nothing).count() == 0


def test_long_runs_stay_linear(spark):
    """Half a minute or more for a pattern that tries every start of a run."""
    texts = ["1" * 90_000, "a" * 90_000, "a.b" * 30_000, "x@" + "y." * 30_000 + "z", "1-" * 30_000, "+1" + "(" * 50_000, "1.2." * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in D.disclosure(df).collect()}
    assert time.monotonic() - began < 30
    assert [(got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) for k in range(7)] == [(0, 0, 0, 0)] * 3 + [(1, 0, 0, 0)] + [(0, 0, 0, 0)] * 2 + [(0, 1000, 0, 0)]
    assert got[3].spans == "email:0:60003"


def test_sanitise_masks_and_keeps_columns(spark, odd):
    df = spark.createDataFrame([(k, t, k) for k, t in corpus()], "doc_id long, text string, rank int")
    clean = {r.doc_id: r for r in D.sanitise(df).collect()}
    assert len(clean) == df.count() and clean[0]["rank"] == 0
    assert "[email]" in clean[0].text and "Wate*" in clean[0].text and "ubrowski" not in clean[0].text
    # "kim" and "and" stand nowhere else
    assert "waterness  [phone]  [card] " in clean[5].text
    assert clean[1].text == corpus()[1][1]
    out = D.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()
