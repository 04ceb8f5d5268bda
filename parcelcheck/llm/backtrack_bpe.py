"""Byte-level BPE by backtracking over longest matches.

A vocabulary is read from the tokenizer file named by the caller. For every
pre-token an Aho-Corasick automaton yields all tokens that start at each byte.
The encoder takes the longest one and checks the pair with the token before it
against a compatibility table: a pair is compatible if merging its bytes gives
exactly these two tokens. If no shorter token fits, it steps back one token and
never enters the failed byte again, so each byte is decided a bounded number of
times. The result equals that of the merge rules. Decoding copies byte ranges
by an offset table.

Texts are cut where a cut can't change the result (before a single blank), and
the ids of a piece are kept in a bounded table per task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcheck.llm.common import text_of

#: White space as Unicode defines it; Python's ``\\s`` also takes U+001C to U+001F (fixed value).
BLANK = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-token pattern of byte-level BPE (fixed value).
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
#: Pieces whose ids a task remembers.
KEPT_PIECES = 600_000
#: Longer pieces are not remembered.
KEPT_LENGTH = 64

_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        byte = byte_letters()
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        values: list[bytes] = [b""] * top
        for text, i in vocab.items():
            if text not in self.special:
                values[i] = bytes(byte[c] for c in text)
        self.token = {v: i for i, v in enumerate(values) if v}
        # a merge's rank orders tokens; single bytes come before all merges
        self.rank = [-1] * top
        self.parts: list[tuple[int, int] | None] = [None] * top
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            i, a, b = vocab[left + right], vocab[left], vocab[right]
            self.merged[(a, b)] = i
            if self.parts[i] is None:
                self.parts[i], self.rank[i] = (a, b), rank
        for text, i in self.special.items():
            values[i] = text.encode()
        lengths = np.array([len(v) for v in values], dtype=np.int64)
        self.lengths, self.sizes = lengths, lengths.tolist()
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.pool = np.frombuffer(b"".join(values), dtype=np.uint8)
        self.matches = ahocorasick.Automaton()
        for value, i in self.token.items():
            self.matches.add_word(value.decode("latin-1"), i)
        self.matches.make_automaton()
        self.pretoken = regex.compile(PRETOKEN)
        self.cut_special = re.compile("|".join(map(re.escape, self.special)))
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, int] = {}
        self.flat: list[int] = []
        self.starts: list[int] = [0]

    def compatible(self, left: int, right: int) -> bool:
        """Does merging the bytes of both give exactly ``left`` and ``right``?

        The only way to lose the border is a merge across it. Going back in
        time from both finished tokens, the last merge inside either token is
        undone; a pair across the border that would have merged before that
        moment breaks the border.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, until, fits = left, right, None, True
        while True:
            across = self.merged.get((a, b))
            # at equal ranks the leftmost pair merges first
            if across is not None and (until is None or self.rank[across] < until):
                fits = False
                break
            if self.rank[a] < 0 and self.rank[b] < 0:
                break
            if self.rank[a] > self.rank[b]:
                until, a = self.rank[a], self.parts[a][1]
            else:
                until, b = self.rank[b] + 1, self.parts[b][0]
        if len(self.fits) < 500_000:
            self.fits[(left, right)] = fits
        return fits

    def encode_pretoken(self, value: bytes) -> list[int]:
        whole = self.token.get(value)
        if whole is not None and self._reachable(whole):
            return [whole]
        size = len(value)
        at: list[list[int]] = [[] for _ in range(size)]
        for end, i in self.matches.iter(value.decode("latin-1")):
            at[end + 1 - self.sizes[i]].append(i)
        # matches end further and further right, so each list grows by length
        choice = [len(found) - 1 for found in at]
        dead = bytearray(size + 1)
        out: list[int] = []
        pos = 0
        while pos < size:
            found, k = at[pos], choice[pos]
            last = out[-1] if out else None
            while k >= 0:
                end = pos + self.sizes[found[k]]
                if not dead[end] and self._reachable(found[k]) and (last is None or self.compatible(last, found[k])):
                    break
                k -= 1
            if k >= 0:
                choice[pos] = k
                out.append(found[k])
                pos += self.sizes[found[k]]
            else:
                dead[pos] = 1
                back = out.pop()
                pos -= self.sizes[back]
        return out

    def _reachable(self, i: int) -> bool:
        """A token that merging its own bytes gives; others are never produced."""
        parts = self.parts[i]
        if parts is None:
            return self.sizes[i] == 1
        return self._whole(i, parts)

    def _whole(self, i: int, parts: tuple[int, int]) -> bool:
        known = self.fits.get((i, -1))
        if known is None:
            a, b = parts
            known = self._reachable(a) and self._reachable(b) and self._border_until(a, b, self.rank[i])
            self.fits[(i, -1)] = known
        return known

    def _border_until(self, left: int, right: int, rank: int) -> bool:
        """Is the border between both free of merges before ``rank``?"""
        a, b, until = left, right, rank
        while True:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < until:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until, a = self.rank[a], self.parts[a][1]
            else:
                until, b = self.rank[b] + 1, self.parts[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for pre in self.pretoken.findall(piece):
            ids += self.encode_pretoken(pre.encode("utf-8", "surrogatepass"))
        return ids

    def _number(self, piece: str) -> int:
        """The place of a blank and a piece in the task's table."""
        ids = self.encode_piece(" " + piece)
        self.flat += ids
        self.starts.append(len(self.flat))
        k = len(self.starts) - 2
        self.seen[piece] = k
        return k

    def _plain(self, text: str) -> np.ndarray:
        single = text[0] != " " and text[-1] != " " and not _DOUBLE.search(text)
        first, *rest = text.split(" ") if single else _CUT.split(text)
        if len(self.seen) > KEPT_PIECES:
            self.seen, self.flat, self.starts = {}, [], [0]
        places = list(map(self.seen.get, rest))  # keys leave out the blank before the piece
        long: dict[int, list[int]] = {}
        if None in places:
            for n, k in enumerate(places):
                if k is not None:
                    continue
                piece = rest[n]
                if len(piece) > KEPT_LENGTH:
                    long[n] = self.encode_piece(" " + piece)
                    places[n] = -1
                else:
                    k = self.seen.get(piece)
                    places[n] = self._number(piece) if k is None else k
        head = np.array(self.encode_piece(first), dtype=np.int64)
        return np.concatenate((head, self._gather(np.array(places, dtype=np.int64), long)))

    def _gather(self, places: np.ndarray, long: dict[int, list[int]]) -> np.ndarray:
        starts, flat = self._arrays()
        if not long:
            return ranges(flat, starts[places], starts[places + 1] - starts[places])
        out, at = [], 0
        for n, ids in long.items():
            own = places[at:n]
            out += [ranges(flat, starts[own], starts[own + 1] - starts[own]), np.array(ids, dtype=np.int64)]
            at = n + 1
        own = places[at:]
        return np.concatenate([*out, ranges(flat, starts[own], starts[own + 1] - starts[own])])

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The table as arrays; only what is new since the last call is converted."""
        done = getattr(self, "_done", None)
        if done is None or done[2] is not self.starts:
            done = [np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), self.starts, 0, 0]
            self._done = done
        for slot, source in ((0, self.starts), (1, self.flat)):
            have, want = done[3 + slot], len(source)
            if want > len(done[slot]):
                done[slot] = np.concatenate((done[slot], np.zeros(max(want, len(done[slot])), np.int64)))
            if want > have:
                done[slot][have:want] = source[have:]
                done[3 + slot] = want
        return done[0], done[1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens become their ids."""
        if not text:
            return np.zeros(0, np.int64)
        if not any(name in text for name in self.special):
            return self._plain(text)
        out, at = [], 0
        for hit in self.cut_special.finditer(text):
            if hit.start() > at:
                out.append(self._plain(text[at : hit.start()]))
            out.append(np.array([self.special[hit.group()]], np.int64))
            at = hit.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return ranges(self.pool, self.offsets[ids], self.lengths[ids]).tobytes()


def ranges(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``pool[start:start + length]`` of all pairs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - ends + lengths, lengths)
    return pool[shift + np.arange(total)]


_CODECS: dict[str, Codec] = {}


def share_file(spark: SparkSession, path: str) -> str:
    """Send the tokenizer file to the executors; the name they know it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def codec(name: str) -> Codec:
    """One codec for each file and Python worker."""
    if name not in _CODECS:
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            _CODECS[name] = Codec(file.read())
    return _CODECS[name]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row; null and empty texts have no ids."""
    name = share_file(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(name)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [own.encode(t) for t in batch["body"]]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInPandas(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; broken UTF-8 becomes U+FFFD."""
    name = share_file(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(name)
        for batch in batches:
            ids = [np.asarray(x, dtype=np.int64) if x is not None else np.zeros(0, np.int64) for x in batch["ids"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text": [own.decode(x).decode("utf-8", "replace") for x in ids]}
            )

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Count and digests of the ids and of the text decoded from them, for every row.

    Encodes and decodes in one pass, so that ids never leave the task. Rows
    that repeat a doc_id stay rows of their own.
    """
    name = share_file(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(name)
        for batch in batches:
            counts, marks, texts = [], [], []
            for text in batch["body"]:
                ids = own.encode(text)
                counts.append(len(ids))
                marks.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                back = own.decode(ids).decode("utf-8", "replace")
                texts.append(hashlib.sha256(back.encode()).hexdigest())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": marks, "decoded_sha256": texts}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("body"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
