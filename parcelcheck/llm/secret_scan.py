"""Secret scans: fixed patterns and sliding-window entropy.

Patterns give the base spans. Beyond them, candidate strings (long runs of key
characters with a digit) are walked by a window per character class. The
window's Shannon entropy comes from counts that change by one character in and
one out; integer arithmetic keeps the sums exact. Windows over the class's
bound make a span unless an allow-list knows the string as harmless. Built-in
functions only, one pass over the texts, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.llm.common import sha256, text_of

# The base patterns, and how long a hit must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run is taken whole or not at all, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_alnum", "entropy_base64")

#: A candidate is a whole run of key characters, this long or longer, with a digit or a capital after a small letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Class, the strings that belong to it (the first that fits counts), bits of entropy.
CLASSES = (
    ("entropy_hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("entropy_letters", r"^[A-Za-z]+$", 3.9),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("entropy_base64", r".", 3.8),
)
#: Harmless strings: numbers, dates, ids in UUID form, words and numbers joined by marks.
ALLOWED = (
    r"^[0-9/_+=-]+$"
    r"|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/_+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_+=-]*$"
)
#: What makes the high-entropy part of a string harmless: counted-up keys, placeholders.
HARMLESS = r"0123456789|abcdefghijkl|(?i:example|placeholder|changeme)"

_SCALE = 1_000_000
#: c * log2(c) of the counts a window can hold, as integers.
_TERMS = ", ".join(f"{round(c * math.log2(c) * _SCALE) if c else 0}L" for c in range(WINDOW + 1))
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,body:string>>"
PATTERNS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE))


def quote(pattern: str) -> str:
    """A SQL string literal of the pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and ``body`` with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hit_columns(name: str, pattern: str) -> list[Column]:
    """All hits of a pattern, what lies between them, and the values of group 2
    where the pattern has one; null for a text without a hit."""
    value = f"regexp_extract_all(t, {quote(pattern)}, 2)" if name == "assign" else f"regexp_extract_all(t, {quote(pattern)}, 0)"
    parts = {
        f"{name}_hit": f"regexp_extract_all(t, {quote(pattern)}, 0)",
        f"{name}_gap": f"split(t, {quote(pattern)}, -1)",
        f"{name}_value": value,
    }
    return [F.expr(f"if(t rlike {quote(pattern)}, {sql}, null)").alias(k) for k, sql in parts.items()]


def span_column(name: str, least: int = 0) -> Column:
    """Spans of the hits whose value has ``least`` characters or more.

    Lengths of hits and gaps add up to the places, so a text is only cut, never
    searched again.
    """
    rank = KINDS.index(name) if name in KINDS else len(KINDS)
    span = (
        f"named_struct('start', a.at + length(x.{name}_gap), 'rank', {rank},"
        f" 'stop', a.at + length(x.{name}_gap) + length(x.{name}_hit), 'kind', '{name}', 'body', x.{name}_hit)"
    )
    walk = (
        f"aggregate(arrays_zip({name}_gap, {name}_hit, {name}_value),"
        f" named_struct('at', 0, 'out', cast(array() as {_SPANS})), (a, x) -> named_struct("
        f"'at', a.at + length(x.{name}_gap) + coalesce(length(x.{name}_hit), 0),"
        f" 'out', if(length(x.{name}_value) >= {least}, concat(a.out, array({span})), a.out)), a -> a.out)"
    )
    return F.expr(f"coalesce({walk}, cast(array() as {_SPANS}))").alias(name)


def entropy_spans(candidates: str) -> Column:
    """Of an array of candidate spans, those parts whose windows are over the bound.

    A span's part goes from the first such window's start to the last one's
    end; a part that holds a harmless piece is left out. The state holds a count for each distinct character of the string,
    the sum of c * log2(c) over the counts, and the part so far; a step takes
    one character in and, past the first window, one out.
    """
    kind = " ".join(f"when x.body rlike {quote(p)} then '{k}'" for k, p, _ in CLASSES)
    rank = " ".join(f"when x.body rlike {quote(p)} then {KINDS.index(k)}" for k, p, _ in CLASSES)
    most = " ".join(
        f"when x.body rlike {quote(p)} then {round((math.log2(WINDOW) - h) * WINDOW * _SCALE)}L" for _, p, h in CLASSES
    )
    moved = (
        "if(g.e = g.o, named_struct('n', a.n, 's', a.s), named_struct("
        "'n', transform(a.n, (v, k) -> v + if(k = g.e, 1, 0) - if(k = g.o, 1, 0)),"
        " 's', a.s + c.terms[a.n[g.e] + 1] - c.terms[a.n[g.e]]"
        " + if(g.o < 0, 0L, c.terms[a.n[g.o] - 1] - c.terms[a.n[g.o]])))"
    )
    marked = (
        f"named_struct('n', b.n, 's', b.s, 'first', if(i >= {WINDOW - 1} and b.s <= c.most and a.first < 0,"
        f" i - {WINDOW - 1}, a.first), 'last', if(i >= {WINDOW - 1} and b.s <= c.most, i + 1, a.last))"
    )
    change = f"named_struct('e', c.codes[i], 'o', if(i >= {WINDOW}, c.codes[i - {WINDOW}], -1))"
    walk = (
        "aggregate(sequence(0, size(c.codes) - 1), named_struct('n', array_repeat(0, c.letters), 's', 0L,"
        " 'first', -1, 'last', -1), (a, i) -> " + let("g", change, let("b", moved, marked)) + ")"
    )
    coded = (
        "named_struct('codes', transform(q, y -> cast(array_position(d, y) as int) - 1),"
        f" 'letters', size(d), 'most', case {most} end, 'terms', array({_TERMS}))"
    )
    part = "substring(x.body, r.first + 1, r.last - r.first)"
    span = (
        f"named_struct('start', x.start + r.first, 'rank', case {rank} end, 'stop', x.start + r.last,"
        f" 'kind', if(r.first < 0 or {part} rlike {quote(HARMLESS)}, null, case {kind} end), 'body', x.body)"
    )
    one = let("q", "split(x.body, '')", let("d", "array_distinct(q)", let("c", coded, let("r", walk, span))))
    wanted = f"filter({candidates}, x -> not x.body rlike {quote(ALLOWED)})"
    return F.expr(f"filter(transform({wanted}, x -> {one}), x -> x.kind is not null)")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, base, added)``: arrays of (start, rank, stop, kind, body) for every row.

    Places are code points, the end is exclusive. Hits of one kind are leftmost
    and don't overlap; spans of different kinds may. ``body`` is the base hit
    or the candidate. Null and empty texts have no spans. Rows that repeat a
    text or an id are scanned one by one; a very long text or string is scanned
    whole, in time that grows with its length.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    cut = body.select("doc_id", *[c for name, pattern in PATTERNS for c in hit_columns(name, pattern)])
    found = cut.select(
        "doc_id", span_column("assign", ASSIGN_LEAST), *[span_column(name) for name, _ in PATTERNS[1:]]
    )
    return found.select(
        "doc_id",
        F.sort_array(F.concat("assign", "access", "hex")).alias("base"),
        entropy_spans("candidate").alias("added"),
    )


def written(spans: Column) -> Column:
    """kind:start:end of all spans, by start, then kind as listed."""
    ordered = F.sort_array(spans)
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))),
        ",",
    )


def secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's digest for every row."""
    found = find_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        sha256(written(F.col("base"))).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
