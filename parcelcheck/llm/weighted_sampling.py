"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with their counts as weights. For each of K samples
every word draws, from hashes of the word and the sample alone, r and c of
Gamma(2, 1) and b of U(0, 1). With t = floor(ln w / r + b) and y = exp(r (t - b))
the word with the least a = c / (y exp(r)) is the sample, and (word, t) its
code. Two texts have equal codes with the probability of their generalised
Jaccard similarity: the sum of smaller weights over the sum of larger ones.

Words and counts are made inside the row from sorted hashes. The samples are a
grouped minimum that needs no shuffle beyond the one that brings neighbours
together. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.llm.common import sha256, text_of, words_of
from parcelcheck.session import staging_path

#: Samples of a fingerprint.
SAMPLES = 24
#: Samples drawn by one row of the grouped minimum.
AT_ONCE = 4
#: Texts of one block of neighbours, about.
BLOCK_ROWS = 500
LEAVES = 64

_CODE_BITS = 24


def with_terms(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row for each distinct word of ``column`` (and one with a null word
    for a text without words): its hash ``h`` and the logarithm of its count."""
    hashed = rows.select(*keep, F.sort_array(F.transform(words_of(text_of(column)), lambda w: F.xxhash64(w))).alias("__s"))
    starts = hashed.select(
        *keep,
        "__s",
        F.expr(
            "filter(transform(__s, (h, i) -> if(i = 0 or __s[i - 1] <> h, i, null)), i -> i is not null)"
        ).alias("__at"),
    )
    # a word's count is the way to the next word's start
    runs = F.expr(
        "transform(__at, (i, k) -> named_struct('h', __s[i],"
        " 'w', if(k + 1 < size(__at), __at[k + 1], size(__s)) - i))"
    )
    term = starts.select(*keep, F.explode_outer(runs).alias("__t"))
    return term.select(*keep, F.col("__t.h").alias("h"), F.ln(F.col("__t.w")).alias("lw"))


def draw(k: Column) -> Column:
    """The sample k of a word as one number: ln a in the leading bits, the code in the rest.

    Uniform numbers are bits of two hashes; half a step is added, so none is 0.
    """
    one, two = F.xxhash64("h", k), F.xxhash64(k, "h")

    def uniform(bits: Column, shift: int, width: int) -> Column:
        return (F.shiftright(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)

    r = -F.ln(uniform(one, 0, 21) * uniform(one, 21, 21))
    c = -F.ln(uniform(two, 0, 32) * uniform(two, 32, 31))
    b = uniform(one, 42, 22)
    t = F.floor(F.col("lw") / r + b)
    ln_a = F.ln(c) - r * (t - b) - r
    code = F.xxhash64("h", k, t).bitwiseAND(F.lit((1 << _CODE_BITS) - 1))
    # |ln a| stays far below 2^11; steps of 2^-28 decide
    return F.shiftleft(F.floor(ln_a * float(1 << 28)).cast("long"), _CODE_BITS).bitwiseOR(code)


def fingerprints(rows: DataFrame, column: str, keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keep`` (a key of the rows) and ``codes``, an array of ``samples`` codes.

    Equal bags of words have equal codes; a text without words has null codes
    only.
    """
    groups = samples // AT_ONCE
    drawn = with_terms(rows, column, keep).withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    values = drawn.select(
        *keep, "__g", *[draw(F.col("__g") * AT_ONCE + j).alias(f"__v{j}") for j in range(AT_ONCE)]
    )
    least = values.groupBy(*keep, "__g").agg(*[F.min(f"__v{j}").alias(f"__m{j}") for j in range(AT_ONCE)])
    codes = F.array(*[F.col(f"__m{j}").bitwiseAND(F.lit((1 << _CODE_BITS) - 1)).cast("int") for j in range(AT_ONCE)])
    ordered = F.sort_array(F.collect_list(F.struct(F.col("__g").alias("g"), codes.alias("c"))))
    return least.groupBy(*keep).agg(F.flatten(F.transform(ordered, lambda x: x["c"])).alias("codes"))


def written(codes: Column) -> Column:
    """Codes as hex digits; empty for a text without words."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), _CODE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes, from 0 to 1; two texts without words are alike."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x
    )
    return same / F.size(a).cast("double")


def neighbour_blocks(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``__block``, which grows with the id and holds about BLOCK_ROWS rows.

    The ids' quantiles cut them into leaves, a leaf is cut evenly. Only the
    quantiles (LEAVES numbers) and the count reach the driver. Null ids come
    first. Uneven ids give uneven blocks, never a wrong order.
    """
    bounds, n = docs.agg(
        F.percentile_approx(doc_id, [k / LEAVES for k in range(LEAVES + 1)], 10_000), F.count(F.lit(1))
    ).first()
    if bounds is None:
        return docs.withColumn("__block", F.lit(0).cast("long"))
    cuts = sorted(set(bounds))
    parts = max(1, round(n / LEAVES / BLOCK_ROWS))
    key = F.col(doc_id)
    block = F.lit(0)
    for k, low in enumerate(cuts):
        high = cuts[k + 1] if k + 1 < len(cuts) else low
        inside = F.floor((key - low) * float(parts) / max(high - low, 1))
        # below the first quantile there may be ids that it missed; above the last as well
        place = F.lit(1 + k * parts) + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))
        block = F.when(key >= low, place).otherwise(block)
    return docs.withColumn("__block", F.coalesce(block.cast("long"), F.lit(-1).cast("long")))


def beside_next(docs: DataFrame) -> DataFrame:
    """``(__block, __n, doc_id, body, __inner)`` for every row; ``__inner`` is the
    next text, null for the last row of a block.

    The next document is the one after it by doc_id, ties by text; after the
    last the first. ``__block, __n`` is a key of the rows in that order. The
    last row of a block takes the first of the next block that has rows: one
    row for each block, hundreds of times fewer than documents.
    """
    rows = neighbour_blocks(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("body"))
    )
    order = Window.partitionBy("__block").orderBy("doc_id", "body")
    placed = rows.select(
        "__block",
        F.row_number().over(order).alias("__n"),
        "doc_id",
        "body",
        F.lead("body").over(order).alias("__inner"),
    )
    return placed


def first_of_next(rows: DataFrame, value: str) -> DataFrame:
    """For every block, ``value`` of the first row of the next block with rows, cyclic."""
    firsts = rows.where(F.col("__n") == 1).select("__block", F.col(value).alias("__value"))
    blocks = rows.where(F.col("__n") == 1).select("__block")
    # one id for each block of about BLOCK_ROWS rows: no texts, and hundreds of times fewer than rows
    after = blocks.select(
        F.col("__block").alias("__own"),
        F.coalesce(
            F.lead("__block").over(Window.orderBy("__block")),
            F.first("__block").over(Window.orderBy("__block")),
        ).alias("__after"),
    )
    return after.join(firsts, F.col("__after") == F.col("__block")).select(
        F.col("__own").alias("__block"), "__value"
    )


def edited(body: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) characters replaced by the first as many of the next."""
    n = F.length(body)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(body, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def weighted_sampling(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The contract's digest for every row; a single document is its own next."""
    placed = beside_next(docs)
    last = first_of_next(placed, "body")
    texts = placed.join(last, "__block").select(
        "__block", "__n", "doc_id", "body", F.coalesce("__inner", "__value").alias("following")
    )
    texts = texts.select(
        "__block", "__n", "doc_id", "body", edited(F.col("body"), F.col("following")).alias("changed")
    )
    key = ["__block", "__n", "__kind"]
    both = texts.select(
        "__block",
        "__n",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("body").alias("t")),
                F.struct(F.lit(1).alias("kind"), F.col("changed").alias("t")),
            )
        ).alias("__v"),
    ).select("__block", "__n", F.col("__v.kind").alias("__kind"), F.col("__v.t").alias("t"))
    codes = fingerprints(both, "t", key, samples)
    pairs = codes.groupBy("__block", "__n").agg(
        F.max(F.when(F.col("__kind") == 0, F.col("codes"))).alias("own"),
        F.max(F.when(F.col("__kind") == 1, F.col("codes"))).alias("other"),
    )
    facts = texts.select(
        "__block",
        "__n",
        "doc_id",
        F.length("body").cast("long").alias("n_chars"),
        sha256(F.col("changed")).alias("edited_sha256"),
    )
    whole = facts.join(pairs, ["__block", "__n"])
    # codes are short; written once, because neighbours read them again
    path = staging_path(docs.sparkSession, "fingerprints")
    whole.write.parquet(path)
    whole = docs.sparkSession.read.schema(whole.schema).parquet(path)
    order = Window.partitionBy("__block").orderBy("__n")
    beside = whole.withColumn("__inner", F.lead("own").over(order)).join(first_of_next(whole, "own"), "__block")
    return beside.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("__inner", "__value")).alias("near_next"),
    )
