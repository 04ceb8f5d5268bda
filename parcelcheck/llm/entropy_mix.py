"""Mixing sources to target token shares by entropy balancing.

Every source has a target number of tokens. Document rates r minimise the
entropy distance sum m (r log r - r + 1) to "everything once" under the
constraint sum size * r = target and r <= cap, with the measure
m = (size + mean size of the source) / 2. The solution is an exponential tilt, r =
min(cap, exp(lambda * size / m)), with one dual variable for each source, found
by Newton steps. Rates are rounded into whole copies so that the sum meets the
target to about one document.

Newton's sums only need the rows (source, size, count), which are aggregated
once before anything is iterated. What depends on the number of sources (the
targets and dual variables) is kept on the driver; it is the mixing
configuration, and ``MAX_SOURCES`` bounds it by an error, not by dropping any.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcheck.llm.common import hash_share, text_of, words_of
from parcelcheck.session import remove_staged, staging_path

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
MAX_SOURCES = 100_000
#: Newton stops when every source is this close to its target.
TOLERANCE = 1e-9
#: Bits of a rounding priority that one pass over the documents decides.
DIGIT_BITS, DIGITS = 12, 3
SIZE_CLASSES = 3
#: Parts in which rows that agree in source, doc_id and size are numbered.
SALTS = 256


@dataclass
class Share:
    """Configuration and state of one source."""

    place: int
    size: float
    n: int
    target: float = 0.0
    dual: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; null and empty texts have none."""
    return F.size(words_of(text_of(text))).cast("long")


def targets(own: list[float], cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Shares of the total by the repeating weights; what exceeds ``cap`` times a
    source's size goes to the others by their weights, until none is above."""
    weight = [weights[k % len(weights)] for k in range(len(own))]
    total, out, full = sum(own), [0.0] * len(own), [False] * len(own)
    while True:
        free = sum(w for w, f in zip(weight, full, strict=True) if not f)
        rest = total - sum(cap * s for s, f in zip(own, full, strict=True) if f)
        above = []
        for k, s in enumerate(own):
            if full[k]:
                out[k] = cap * s
            else:
                out[k] = max(rest, 0.0) * weight[k] / free
                if out[k] > cap * s:
                    above.append(k)
        if not above:
            return out
        for k in above:
            full[k] = True


def describe(counts: DataFrame) -> dict[str | None, Share]:
    """The sources by code point, null last, with their sizes and targets."""
    rows = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")
    ).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; merge them before mixing")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    found = {r.source: Share(k, float(r["size"]), r.n) for k, r in enumerate(rows)}
    for share, target in zip(found.values(), targets([s.size for s in found.values()]), strict=True):
        share.target = target
        share.done = share.size == 0 or target >= CAP * share.size
        share.dual = math.inf if share.size and share.done else 0.0
    return found


def table_of(spark, shares: dict[str | None, Share]) -> DataFrame:
    rows = [
        (name, s.place, s.size / s.n if s.n else 0.0, min(max(s.dual, -1e300), 1e300), s.target, int(s.size))
        for name, s in shares.items()
    ]
    return F.broadcast(
        spark.createDataFrame(
            rows, "__source string, place int, mean double, dual double, target double, source_size long"
        )
    )


def rate(cap: float = CAP) -> Column:
    """min(cap, exp(dual * size / m)); a document without words has rate 1."""
    tilt = F.col("dual") * (2 * F.col("size") / (F.col("size") + F.col("mean")))
    bounded = F.exp(F.greatest(F.least(tilt, F.lit(math.log(cap) + 1)), F.lit(-700.0)))
    return F.when(F.col("size") == 0, 1.0).otherwise(F.least(bounded, F.lit(cap)))


def balance(counts: DataFrame, shares: dict[str | None, Share], rounds: int = 200) -> None:
    """Newton steps on the dual of every source, all sources in one job a step.

    The dual's slope is monotone, so signs keep a bracket; a step that leaves
    it is replaced by a bisection (or a doubling while one end is open).
    """
    spark = counts.sparkSession
    for _ in range(rounds):
        open_now = {k: s for k, s in shares.items() if not s.done}
        if not open_now:
            return
        m = (F.col("size") + F.col("mean")) / 2
        r, live = rate(), F.col("size") > 0
        sums = (
            counts.join(table_of(spark, open_now), F.col("source").eqNullSafe(F.col("__source")))
            .where(live)
            .groupBy("place")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("sum"),
                F.sum(F.when(r < CAP, F.col("n") * F.col("size") * F.col("size") / m * r).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        by_place = {row.place: row for row in sums}
        for s in open_now.values():
            row = by_place[s.place]
            gap = row["sum"] - s.target
            if abs(gap) <= TOLERANCE * max(s.target, 1.0):
                s.done, s.dual = True, float(f"{s.dual:.9g}")  # sums differ in the last bits between runs
                continue
            if gap > 0:
                s.high = s.dual
            else:
                s.low = s.dual
            step = s.dual - gap / row["slope"] if row["slope"] > 0 else math.nan
            if not s.low < step < s.high:
                if math.isinf(s.high):
                    step = 2 * max(s.low, 0.0) + 1
                elif math.isinf(s.low):
                    step = 2 * min(s.high, 0.0) - 1
                else:
                    step = (s.low + s.high) / 2
                    s.done = step in (s.low, s.high)  # no number lies between
            s.dual = step
    if any(not s.done for s in shares.values()):
        raise RuntimeError(f"the dual of a source did not settle within {rounds} rounds")


def rounded(docs: DataFrame, shares: dict[str | None, Share]) -> DataFrame:
    """Add ``copies``: the whole part of the rate, and one more for documents
    whose priority, a hash minus the fractional part, lies below a bound.

    Each source has a bound for each of three size classes. Classes are
    settled from long to short documents, and what one leaves over is carried
    to the next, so that the source's tokens meet the target to about a short
    document. Bounds are found digit by digit from sums of (source, digit);
    no list of documents is sorted or collected. Equal priorities go together.
    """
    spark = docs.sparkSession
    place = table_of(spark, shares)
    rated = docs.join(place, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__r", rate())
    base = F.floor(F.col("__r"))
    priority = hash_share(F.lit("copies"), F.col("doc_id"), F.col("size"), F.col("__nth")) - (F.col("__r") - base)
    scale = 2 ** (DIGIT_BITS * DIGITS)
    rated = (
        rated.withColumn("__key", F.floor((priority + 1) / 2 * scale).cast("long"))
        .withColumn("__base", base.cast("long"))
        .withColumn(
            "__class",
            F.when(F.col("size") >= F.col("mean"), 0).when(F.col("size") * 8 >= F.col("mean"), 1).otherwise(2),
        )
    )
    path = staging_path(spark, "priorities")
    rated.select("place", "size", "__class", "__base", "__key", "__r").write.parquet(path)
    keys = spark.read.parquet(path)
    wanted: dict[tuple[int, int], float] = {}
    carry = {s.place: s.target for s in shares.values()}
    sums = keys.groupBy("place", "__class").agg(
        F.sum(F.col("__r") * F.col("size")).alias("ideal"), F.sum(F.col("__base") * F.col("size")).alias("whole")
    )
    for r in sums.collect():  # three rows for each source
        wanted[(r.place, r["__class"])] = round(r["ideal"] - r["whole"], 3)
        carry[r.place] -= r["ideal"]
    carry = {p: round(v, 3) for p, v in carry.items()}
    bounds: list[tuple[int, int, int]] = []
    for size_class in range(SIZE_CLASSES):
        missing = {p: carry[p] + wanted.get((p, size_class), 0.0) for p in carry}
        own = keys.where((F.col("__class") == size_class) & (F.col("__base") < CAP) & (F.col("size") > 0))
        found, carry = descend(own, missing)
        bounds += [(p, size_class, bound) for p, bound in found.items()]
    remove_staged(spark, path)
    # three rows for each source, at most 3 * MAX_SOURCES
    known = F.broadcast(spark.createDataFrame(bounds, "__place int, __of int, __bound long"))
    placed = rated.join(known, (F.col("place") == F.col("__place")) & (F.col("__class") == F.col("__of")))
    extra = (F.col("__base") < CAP) & (F.col("size") > 0) & (F.col("__key") < F.col("__bound"))
    return placed.withColumn("copies", F.col("__base") + extra.cast("long"))


def descend(keys: DataFrame, missing: dict[int, float]) -> tuple[dict[int, int], dict[int, float]]:
    """For each source the first key left out, and the tokens that stay missing.

    Keys are taken in ascending order while their tokens fit. Every pass reads
    one more digit of the keys that share the bound's leading digits.
    """
    spark = keys.sparkSession
    missing = dict(missing)
    prefix = dict.fromkeys(missing, 0)
    bound: dict[int, int] = {}
    for level in range(DIGITS):
        if not prefix:
            break
        shift = DIGIT_BITS * (DIGITS - 1 - level)
        last = level == DIGITS - 1
        now = F.broadcast(spark.createDataFrame(list(prefix.items()), "place int, prefix long"))
        digit = F.shiftright("__key", shift)
        rows = (
            keys.join(now, "place")
            .where(F.shiftright(digit, DIGIT_BITS) == F.col("prefix"))
            .groupBy("place", digit.alias("digit"))
            .agg(F.sum("size").alias("total"))
            .collect()  # at most 2^DIGIT_BITS rows for each source
        )
        found: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            found.setdefault(r.place, []).append((r.digit, r.total))
        for p in list(prefix):
            stop = None
            for d, total in sorted(found.get(p, [])):
                # on the last digit a group is taken if that comes nearer to the target
                if missing[p] < (total / 2 if last else total):
                    stop = d
                    break
                missing[p] -= total
            if stop is None:  # all of them fit
                bound[p] = (prefix.pop(p) + 1) << (shift + DIGIT_BITS)
            elif last:
                bound[p] = stop
            else:
                prefix[p] = stop
    return bound, missing


def numbered(rows: DataFrame) -> tuple[str, DataFrame]:
    """Add ``__nth``: 0, or the number of a row among those that agree in source, doc_id and size.

    Such rows are counted by a salt first, so that a group of any size is
    numbered in parts; the parts before are added. Rows that don't repeat
    aren't moved. Also returns the path of the counts.
    """
    spark = rows.sparkSession
    text = lambda c: F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-"))
    keyed = rows.withColumn("__g", F.xxhash64(F.concat_ws(":", text("source"), text("doc_id"), text("size"))))
    parts = keyed.groupBy("__g", "__salt").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("__g")  # SALTS rows at most
    before = F.sum("n").over(group.orderBy("__salt")) - F.col("n")
    repeated = parts.withColumn("total", F.sum("n").over(group)).withColumn("before", before).where("total > 1")
    path = staging_path(spark, "repeated")
    repeated.select("__g", "__salt", "before").write.parquet(path)
    many = spark.read.schema("__g long, __salt int, before long").parquet(path)
    place = F.row_number().over(Window.partitionBy("__g", "__salt").orderBy("size"))
    several = keyed.join(many, ["__g", "__salt"]).withColumn("__nth", (F.col("before") + place).cast("long")).drop("before")
    single = keyed.join(many.select("__g").distinct(), "__g", "left_anti").withColumn("__nth", F.lit(0).cast("long"))
    return path, single.unionByName(several).drop("__g", "__salt")


def mix(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies for every row, and the ``carried`` columns.

    A document without words has one copy and takes nothing. A null source is
    a source of its own. Rows that repeat doc_id and size each count; as many
    of them as the target asks for get a copy more. An empty table gives no
    rows. A very long text counts with all of its words.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    sized = docs.select("doc_id", "source", *carried, sizes(docs).alias("size"), salt.alias("__salt"))
    path = staging_path(spark, "sizes")
    sized.write.parquet(path)
    own = spark.read.schema(sized.schema).parquet(path)
    grouped = own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts_path = staging_path(spark, "size-counts")
    grouped.write.parquet(counts_path)
    counts = spark.read.schema(grouped.schema).parquet(counts_path)
    shares = describe(counts)
    balance(counts, shares)
    remove_staged(spark, counts_path)
    _, told_apart = numbered(own)
    return rounded(told_apart, shares).select(
        "doc_id", "source", "size", "source_size", "target", F.col("__r").alias("rate"), "copies", *carried
    )


def entropy_mix(docs: DataFrame) -> DataFrame:
    """The contract's digest: what the mix takes of every document."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.

    Rows go along with their copies, so texts are written once and not shuffled.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    chosen = mix(packed, "__row")
    return chosen.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
