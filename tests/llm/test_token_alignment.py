"""Alignment of two tokenizers against a direct count of overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from parcelcheck.llm import token_alignment as T

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(values):
    out, at = [], 0
    for v in values:
        out.append((at, at + len(v)))
        at += len(v)
    return out


def brute(both, docs):
    """The contract by comparing every token of A with every token of B."""
    a_tok, b_tok = both
    byte = letters()
    made, counts = [], Counter()
    for i, text in docs:
        ids_a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b_tok.encode(text or "") if text else []
        va = [bytes(byte[c] for c in a_tok.id_to_token(x)) for x in ids_a]
        vb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b_tok.id_to_piece(x)]]
        if not text or b"".join(va) != (" " + text).encode() or b"".join(vb) != (" " + text).encode():
            made.append((i, [], [], [], []))
            continue
        sa, sb = spans(va), spans(vb)
        links, low = [], 0
        for (p, q), x in zip(sa, ids_a):
            while sb[low][1] <= p:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < q:
                links.append((x, ids_b[j]))
                j += 1
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for cut in cuts:
            inside = [",".join(str(x) for (p, q), x in zip(s, ids) if start <= p and q <= cut) for s, ids in ((sa, ids_a), (sb, ids_b))]
            groups.append("|".join(inside))
            start = cut
        made.append((i, ids_a, ids_b, groups, links))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        (
            str(i), len(a), len(b), len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(g).encode()).hexdigest() if a else "",
        )
        for i, a, b, g, links in made
    )


def ours(df, **kinds):
    names = [*T._MEASURES, "groups_sha256"]
    return sorted((str(r.doc_id), *[r[c] for c in names]) for r in T.token_alignment(df, A, B, **kinds).collect())


def test_documents_equal_brute_force(both, small):
    docs = [(r.doc_id, r.text) for r in small.limit(80).collect()]
    df = small.sparkSession.createDataFrame(docs, "doc_id long, text string")
    want = brute(both, docs)
    assert ours(df) == want
    # few pairs and texts are broadcast, the others take the joins
    assert ours(df, frequent=300, hot=4) == want
    assert ours(df, frequent=0, hot=1) == want


def test_odd_texts_equal_brute_force(both, spark):
    rng = random.Random(1)
    texts = [None, "", " ", "  ", "a", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|> x", "\n\n\t ", "​", "Grüße \U0001f600 中文", "<0x41>", "x" * 3000, " ", "é", "ﬁ", "\x00a"]
    parts = [t for t in texts if t]
    texts += ["".join(rng.choice(parts[:14]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    docs = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(5, "a")] * 40 + [(None, "a")] * 3
    df = spark.createDataFrame([(i, t, k, "k") for k, (i, t) in enumerate(docs)], "doc_id long, text string, n long, key string").repartition(4)
    want = brute(both, docs)
    assert ours(df) == want
    assert ours(df, frequent=10, hot=3) == want


def test_odd_rows_and_empty_table(odd, nothing, both):
    assert T.token_alignment(nothing, A, B).count() == 0
    got = ours(odd)
    assert len(got) == odd.count()
    # tokens of the very long texts are counted by their tokenizer alone
    lengths = sorted(len(both[1].encode(r.text)) for r in odd.select("text").collect() if r.text)
    assert sorted(r[2] for r in got if r[2]) == lengths
