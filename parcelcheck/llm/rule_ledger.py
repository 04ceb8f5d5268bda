"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document. The ledger keeps the
measurements and one bit for each failed rule; policies are versioned sets of
rules, so a change of policy or an ablation only reads the bits. Built-in
functions only, no shuffle for the ledger, one small grouped sum for ablations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.llm.common import count_of, text_of, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)

#: A version of the policy never changes once published; add a new one.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = {rule.name: 1 << k for k, rule in enumerate(rules)}
    return sum(known[name] for name in set(names))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measurements for each row of ``docs``; other columns are left out.

    Null and empty texts measure zero everywhere; rows that repeat a doc_id
    stay rows of their own. A word of a repeated three-word window counts
    once however many windows cover it. Windows are compared by a 64-bit hash
    within one document.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("body"))
    split = base.select("doc_id", "body", words_of(F.col("body")).alias("w"))
    windows = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_of(F.col("body"), SYMBOLS).cast("long").alias("n_symbols"),
        count_of(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        F.expr(r"filter(split(body, '\n'), x -> length(translate(x, ' \t\n\u000B\f\r', '')) > 0)").alias("lines"),
        F.expr(
            "sort_array(if(size(w) < 3, cast(array() as array<struct<h:bigint,i:int>>),"
            " transform(sequence(0, size(w) - 3),"
            " i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i))))"
        ).alias("s"),
    )
    repeated = windows.withColumn(
        "starts",
        F.expr(
            "sort_array(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h)"
            " or (k + 1 < size(s) and s[k + 1].h = x.h)), x -> x.i))"
        ),
    )
    return repeated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(starts, named_struct('n', 0L, 'at', -3),"
            " (a, x) -> named_struct('n', a.n + least(3, x - a.at), 'at', x), a -> a.n)"
        ).alias("n_repeat_words"),
    )


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``failed``: bit k is set if rule k fails (or can't be told)."""
    bits = [F.when(F.coalesce(F.expr(r.fails), F.lit(True)), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)]
    total = bits[0].cast("long")
    for bit in bits[1:]:
        total = total.bitwiseOR(bit.cast("long"))
    return measured.withColumn("failed", total)


def passes(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule of the policy has its bit set in ``failed``."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(names, rules))) == 0


def ablations(
    book: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """For each policy and rule: documents that fail it, and those it alone rejects.

    The ledger is first reduced to a count for each distinct set of bits, so
    at most 2^rules rows leave the map side whatever the corpus holds. An
    empty ledger gives zero counts.
    """
    policies = POLICIES if policies is None else policies
    names = {rule.name: 1 << k for k, rule in enumerate(rules)}
    cases = [(v, n, mask_of(chosen, rules), names[n]) for v, chosen in policies.items() for n in chosen]
    counts = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    sums = []
    for k, (_, _, mask, bit) in enumerate(cases):
        hit = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        alone = F.col("failed").bitwiseAND(F.lit(mask)) == bit
        sums.append(
            F.struct(
                F.lit(cases[k][0]).alias("policy"),
                F.lit(cases[k][1]).alias("rule"),
                F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failing"),
                F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("rejected_alone"),
                F.coalesce(F.sum(F.when(alone, F.col("words"))), F.lit(0)).alias("words_regained"),
            )
        )
    return counts.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def rule_ledger(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The contract's digest: base measurements, ``base_failed``, ``kept`` and the bits."""
    book = ledger(measure(docs))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(POLICIES["base"])).alias("base_failed"),
        passes(POLICIES[policy]).alias("kept"),
        "n_lines",
        "n_capitals",
        "failed",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY 1
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_capitals > 40 * word_chars THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       failed = 0 AS kept, n_lines, n_capitals, failed
FROM f
"""
