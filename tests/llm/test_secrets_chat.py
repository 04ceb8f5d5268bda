"""Secret scan and chat formatting."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from parcelcheck.llm import chat_events, secret_scan
from parcelcheck.llm.queries import LLM_ORACLES, LLM_QUERIES

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))


def added_spans(text):
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        s = m[0]
        if re.search(secret_scan.ALLOWED, s):
            continue
        rank, bound = next((k, h) for k, (_, p, h) in enumerate(secret_scan.CLASSES) if re.search(p, s))
        w = secret_scan.WINDOW
        hits = [
            i for i in range(len(s) - w + 1)
            if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= bound - 1e-6
        ]
        if hits and not re.search(secret_scan.HARMLESS, s[hits[0] : hits[-1] + w]):
            out.append((m.start() + hits[0], 3 + rank, m.start() + hits[-1] + w))
    return out


def written(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(df):
    docs = sorted((r.text or "", r.doc_id or -1) for r in df.select("doc_id", "text").collect())
    got = sorted((r.base_sha256, r.spans, r.n_assign, r.n_access, r.n_hex) for r in secret_scan.secret_scan(df).collect())
    want = []
    for text, _ in docs:
        base = base_spans(text)
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        want.append((hashlib.sha256(written(base).encode()).hexdigest(), written(base + added_spans(text)), *n))
    assert got == sorted(want)


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    parts = ["token=", "SECRET : ", 'api_key="', "apikey=", "password", "passwd=", "a", "Zz9", "==", "é", "\U0001f600", "\n", " "]
    parts += ["AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "f" * 31, "9f8a7c6e5d4b3a2f1e0d", "xK9/q+Zr4_T=w8Lm"]
    parts += ["550e8400-e29b-41d4-a716-446655440000", "word-and-2024-more-words", "example", "token=secret=", "token:secret:", "."]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(600)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_scan_of_documents(small):
    check(small)


def test_scan_of_odd_rows(odd, nothing):
    check(odd)
    assert secret_scan.secret_scan(nothing).count() == 0


def test_allow_list(spark):
    harmless = ["550e8400-e29b-41d4-a716-446655440000", "4785380592391139000000", "chapter-12-of-the-long-book", "A0123456789abcXYZ0123456"]
    found = secret_scan.find_secrets(spark.createDataFrame([(k, t) for k, t in enumerate(harmless)], "doc_id long, text string"))
    assert all(not r.added for r in found.collect())
    key = "q7Rt2LwX9bVn4KsY8dHf3JmZ"
    row = secret_scan.find_secrets(spark.createDataFrame([(1, f"see {key} here")], "doc_id long, text string")).first()
    assert [(x.start, x.stop, x.kind) for x in row.added] == [(4, 4 + len(key), "entropy_alnum")]


def test_keys_of_letters_and_keys_behind_harmless_names(spark):
    key = "qRtLwXbVnKsYdHfJmZcGpTgB"
    mixed = "q7Rt2LwX9bVn4KsY8dHf3JmZ"
    texts = [f"see {key} here", f"example_cred={mixed}", "plain words only, nothing else", "Donaudampfschifffahrtsgesellschaft", "Some-Hyphenated-Words-In-A-Row", "changeme" * 4 + "Q1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][x.start : x.stop] for x in r.added] for r in secret_scan.find_secrets(df).collect()}
    assert found[0] == [key] and found[1] == [mixed]
    assert not found[2] and not found[3] and not found[4] and not found[5]
    check(df)


ROWS = "conv_id long, turn long, role string, text string"


def test_chat_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    res = db.execute(LLM_ORACLES["op6_chat_events"])
    names = [d[0] for d in res.description]
    got = LLM_QUERIES["op6_chat_events"](spark, sf).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, res.fetchall()))


def test_chat_reads_back_odd_rows(spark):
    texts = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "<</s>", "[[INST]", "", None, "</s", "é\U0001f600", "\n"]
    rng = random.Random(4)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", None, "<s>", "[INST"]), "".join(x or "" for x in rng.sample(texts, 3)) if t else None)
        for c in (1, 2, None) for t in range(30)
    ]
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, None, "assistant", "early")]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS + ", seq long, kind string, start long")
    got = {r.conv_id: r for r in chat_events.chat_events(table).collect()}
    want = {}
    for c, t, role, text in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns, key=lambda x: x)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].n_turns) == (len(learned), len(turns))
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_log_of_a_table_folds_back_to_it(spark):
    """All four ways occur; drafts, void events and parts leave no trace."""
    rows = [(c, t, "user" if t % 2 else "assistant", "x" * (c % 5) + f"text {c} {t} é\U0001f600") for c in range(12) for t in range(9)] + [(3, 9, None, None), (3, 10, "user", "")]
    table = spark.createDataFrame(rows, ROWS)
    log = chat_events.logged_events(table)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 10
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_events.fold(log).collect())
    want = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_events.message_events(table).collect())
    assert got == want
    # the same events in any order of rows
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_events.fold(log.orderBy(F.desc("seq"))).collect()) == want


def test_no_conversations_leave_the_control_texts(spark):
    assert chat_events.chat_events(spark.createDataFrame([], ROWS)).count() == 1


def replay(events):
    turns = {}
    for seq, _, turn, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if kind == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
        if kind == "delta" and turn in turns:
            turns[turn] = (role or turns[turn][0], turns[turn][1] + (text or ""))
        else:
            old = turns.get(turn, ("", ""))[0] if kind == "edit" else ""
            turns[turn] = (role or (old if kind == "edit" else ""), text or "")
    return turns


def test_fold_replays_the_log(spark):
    rng = random.Random(9)
    logs, rows = {}, []
    for conv in range(25):
        events, seq, open_turns = [], 0, 0
        for _ in range(40):
            seq += 1
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            turn = open_turns if kind == "message" or not open_turns else rng.randrange(open_turns)
            if kind != "message" and turn >= open_turns:
                kind = "message"
            if kind == "message":
                open_turns = turn + 1
            if kind == "regenerate":
                open_turns = turn + 1
            role = None if kind == "delta" else rng.choice(["user", "assistant"])
            events.append((seq, 0, turn, kind, role, f"{kind[0]}{seq} "))
        logs[conv] = events
        rows += [(conv, turn, seq, kind, role, text) for seq, _, turn, kind, role, text in events]
    table = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {}
    for r in chat_events.fold(table.repartition(5)).collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.text
    assert got == {c: {t: text for t, (_, text) in replay(e).items()} for c, e in logs.items()}
    assert chat_events.format_log(table.limit(0)).count() == 0


def test_loss_mask_places_are_absolute(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "a[INST]b"), (1, 2, "user", "x"), (1, 3, "assistant", "yes")]
    row = chat_events.format_log(chat_events.message_events(spark.createDataFrame(rows, ROWS))).first()
    parts = [row.formatted[s + m.start : s + m.start + m.length] for s, m in zip(row.starts, row.loss, strict=True) if m]
    assert parts == ["a[\\INST]b", "yes"]
