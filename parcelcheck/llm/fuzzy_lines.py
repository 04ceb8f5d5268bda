"""Line dedup across documents: equal and nearly equal lines are kept once.

A line is normalised to its words in lower case without punctuation, digits as
0. Its distinct words are dealt by hash to lanes, about one for eleven words,
and each lane has a SimHash of its own: bit i is set if more than half of the
hashes of its LANE_WORDS least words have it. These are the pigeonhole blocks:
an edit touches two lanes at most, so of two lines with fewer than half as many
edits as lanes, one lane at least is the same in both, and most lines with more
edits keep one as well (README has the measured share). Lanes are counted for
classes of distinct words; a line near the upper end of its class has the lanes of the
next class, too.

In every block each text meets the block's first one; linked texts form
provisional groups, and where a block holds several groups, texts of different
groups meet in pairs. In a crowded block, the others first meet one more text
of the largest group; of those that are left, only those meet that have one of
their rarest words in common, so many that no similar pair is missed. Lengths
and word sets are compared where a pair is formed; a pair leaves that join once
for a block, without its words, and its words are compared once for all blocks.
Candidates are verified by the edit similarity of their
words: at most a fifth of the longer one's may have to be edited. Of a
connected group's lines only the first, by doc_id and place, stays.

Lanes come from one Arrow pass, whose arrays hold the words of a bounded number
of characters; README has the figures of the form in built-in functions. All
else is built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions.rings import settle
from parcelcheck.llm.common import sha256, text_of
from parcelcheck.llm.components import components
from parcelcheck.llm.secret_scan import let
from parcelcheck.session import remove_staged, staging_path

#: Lines of fewer distinct words have no near lines; as equal ones they count from so many characters on.
MIN_WORDS, EXACT_CHARS = 5, 20
#: A class reaches from a number of distinct words to half as much more; words of a lane, about; words that its SimHash takes at most.
CLASS_STEP, WORDS_A_LANE, LANE_WORDS = 1.5, 11, 15
#: Characters whose words a task holds in arrays at once, about; texts that it remembers at least.
CHUNK_CHARS, SEEN_TEXTS = 1_000_000, 200_000
#: Rows of one side that meet in a cell of a large block.
BLOCK_ROWS = 1000
#: A block with more rows than this outside its largest group is crowded.
CROWD = 16
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\t\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO = "abcdefghijklmnopqrstuvwxyz000000000    "
_WORD_BUCKETS = 1 << 16
_SETS = [f"b{j}" for j in range(4)]
#: Hash bits of a word that stand below its lane, a counter of four bits for every fourth of them, and shifts that are counted.
_HASH = (1 << 48) - 1
_EACH = sum(1 << j for j in range(0, 48, 4))
_SHIFTS = 3


def line_words(line: Column) -> Column:
    """The normalised words of a line: A to Z in lower case, digits as 0, no ASCII punctuation."""
    return F.array_remove(F.split(F.translate(line, _FROM, _TO), " "), "")


_TABLE = bytes.maketrans(_FROM[: len(_TO)].encode(), _TO.encode())
_DROPPED = _FROM[len(_TO) :].encode()


def text_key(words: Column) -> Column:
    """The 64-bit hash that stands for a normalised line."""
    return F.xxhash64(F.array_join(words, " "))


def lane_keys(lengths: np.ndarray, hashes: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all lines, one after the other, and how many each line has.

    ``lengths`` are the words of each line, ``hashes`` those of all words or, with ``codes``, of the words
    that these number. A key hashes class, lane and the lane's SimHash. Counters of four bits hold
    up to LANE_WORDS words; with 7 less half of the words added, the highest
    bit of each tells the majority.
    """
    hashes, equal = np.unique(hashes, return_inverse=True)
    codes = equal if codes is None else equal[codes]
    # words are sorted as numbers that hold their line or lane in the high bits
    bits = np.int64(max(len(hashes) - 1, 1)).item().bit_length()
    mask = (1 << bits) - 1
    both = _distinct((np.repeat(np.arange(len(lengths)), lengths) << bits) | codes)
    lengths, codes = np.bincount(both >> bits, minlength=len(lengths)), both & mask
    own = np.floor(np.log(np.maximum(lengths, 1)) / math.log(CLASS_STEP)).astype(np.int64)
    times = np.where(lengths >= MIN_WORDS, 1 + (CLASS_STEP ** (own + 1) * 0.9 <= lengths), 0)
    # a row for each line and class it has lanes of
    owner = np.repeat(np.arange(len(lengths)), times)
    second = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    grade = own[owner] + second
    lanes = np.maximum(np.floor(CLASS_STEP ** (grade + 1) / WORDS_A_LANE).astype(np.int64) + 1, 2)
    sizes = lengths[owner]
    at = np.arange(int(sizes.sum())) + np.repeat((np.cumsum(lengths) - lengths)[owner] - (np.cumsum(sizes) - sizes), sizes)
    code, row = codes[at], np.repeat(np.arange(len(owner)), sizes)
    base = np.cumsum(lanes) - lanes
    lane = (hashes >> np.uint64(48)).astype(np.int64)[code] % lanes[row]
    lows, rank = np.unique((hashes & np.uint64(_HASH)).astype(np.int64), return_inverse=True)
    both = _distinct(((base[row] + lane) << bits) | rank[code])
    group, low = both >> bits, lows[both & mask]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((starts, [len(group)])))
    held = np.arange(len(group)) - np.repeat(starts, counts) < LANE_WORDS
    low, counts = low[held], np.minimum(counts, LANE_WORDS)
    named = group[starts]
    of = np.searchsorted(base, named, side="right") - 1
    key = _mixed((grade[of] << 32) + named - base[of])
    begins = np.cumsum(counts) - counts
    for j in range(_SHIFTS):
        sums = np.add.reduceat((low >> j) & _EACH, begins) if len(begins) else np.zeros(0, np.int64)
        key = _mixed(key ^ ((sums + (7 - counts // 2) * _EACH) & (8 * _EACH)))
    return key, np.bincount(owner[of], minlength=len(lengths))


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers in order, each once."""
    numbers = np.sort(numbers)
    fresh = np.ones(len(numbers), bool)
    fresh[1:] = numbers[1:] != numbers[:-1]
    return numbers[fresh]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        y = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (y ^ (y >> np.uint64(31))).view(np.int64)


def eligible_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, k, keys)`` of the lines that count: the hash of their words and their lanes' keys.

    A task makes the keys of a text once among SEEN_TEXTS texts; its copies have none.
    """

    def of_texts(ids: np.ndarray, texts: list, seen: set) -> pa.RecordBatch:
        body = ("\n".join(texts) + "\n").encode().translate(_TABLE, _DROPPED)
        breaks = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
        raw = np.frombuffer(body.replace(b"\n", b" "), np.uint8)
        inside = raw != 32
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        turns = np.concatenate(([0], turns)) if inside[0] else turns
        starts, ends = turns[::2], turns[1::2]
        lengths = np.diff(np.searchsorted(starts, breaks), prepend=0)
        # the words of all lines with one blank behind each
        inside[ends] = True
        joined = raw[inside].tobytes()
        words_to = np.cumsum(lengths)
        bytes_to = np.concatenate(([0], np.cumsum(ends - starts + 1)))
        begin, end = bytes_to[words_to - lengths], bytes_to[words_to] - 1
        counted = lengths >= MIN_WORDS
        for n in np.flatnonzero(~counted & (end - begin >= EXACT_CHARS)).tolist():
            counted[n] = len(joined[begin[n] : end[n]].decode()) >= EXACT_CHARS
        view = memoryview(joined)
        keys, fresh = [], []
        for a, b in zip(begin[counted].tolist(), end[counted].tolist()):
            k = xxhash.xxh64_intdigest(view[a:b], seed=42)
            keys.append(k)
            fresh.append(k not in seen)
            seen.add(k)
        fresh = np.array(fresh, bool)
        hashed = np.zeros(len(lengths), bool)
        hashed[np.flatnonzero(counted)[fresh]] = True
        offsets = pa.py_buffer(bytes_to.astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(joined)]).dictionary_encode()
        distinct = np.empty(len(words.dictionary), dtype=object)
        distinct[:] = [w[:-1] for w in words.dictionary.to_numpy(zero_copy_only=False)]
        codes = words.indices.to_numpy(zero_copy_only=False)[np.repeat(hashed, lengths)].astype(np.int64)
        lanes, few = lane_keys(lengths[hashed], pd.util.hash_array(distinct, categorize=False), codes)
        many = np.zeros(len(fresh), np.int64)
        many[fresh] = few
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(lanes, pa.int64()))
        in_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
        place = np.arange(len(lengths)) - np.repeat(np.cumsum(in_text) - in_text, in_text)
        doc = np.repeat(np.arange(len(texts)), in_text)[counted]
        k = pa.array(np.array(keys, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(doc)), pa.array(place[counted], pa.int32()), k, lists], names=["doc_id", "place", "k", "keys"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // CHUNK_CHARS
            for cut in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if len(seen) > SEEN_TEXTS:
                    seen.clear()
                if len(cut):
                    yield of_texts(batch.column(0).slice(cut[0], len(cut)), [texts[n] for n in cut], seen)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body")).where(F.length("body") > 0)
    return rows.mapInArrow(run, "doc_id long, place int, k long, keys array<long>")


def encoded(words: str = "w") -> Column:
    """A string with one character for each word, drawn from 917,504 by hash, so
    that a character edit distance is one of words."""
    return F.expr(
        f"decode(unhex(array_join(transform({words}, x ->"
        " lpad(hex(131072 + pmod(xxhash64(x), 917504)), 8, '0')), '')), 'UTF-32')"
    )


def similar(a: str, b: str) -> Column:
    """At most a fifth of the longer one's words have to be edited.

    Lengths decide first, as they cost nothing."""
    longest = f"greatest(length({a}), length({b}))"
    return F.expr(
        f"5 * least(length({a}), length({b})) >= 4 * {longest} and levenshtein({a}, {b}, cast({longest} div 5 as int)) >= 0"
    )


class Staged:
    """Tables of one run in the shared folder; each can be removed once nothing reads it."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def write(self, rows: DataFrame, label: str) -> DataFrame:
        path = staging_path(self.spark, label)
        rows.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove_staged(self.spark, path)
        self.paths = []


def _bits_of(hashes: DataFrame, own: Staged) -> tuple[DataFrame, int]:
    """One row ``bits``, an array of numbers with a bit for each hash ``h``, and how many bits it has:
    eight for a hash at least, so that few others meet one."""
    hashes = own.write(hashes, "line-bits")
    size = 1 << max(16, (8 * hashes.count()).bit_length())
    spot = F.pmod("h", F.lit(size))
    part = F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("part")
    parts = hashes.select(spot.alias("spot")).groupBy(F.expr("spot div 64").alias("id")).agg(part)
    filled = hashes.sparkSession.range(size // 64).join(parts, "id", "left").select("id", F.coalesce("part", F.lit(0).cast("long")).alias("part"))
    row = filled.agg(F.array_sort(F.collect_list(F.struct("id", "part"))).alias("all"))
    return own.write(row.select(F.col("all.part").alias("bits")), "line-bits"), size


def _bit_test(size: int, *columns: str) -> Column:
    spot = F.pmod(F.xxhash64(*columns), F.lit(size))
    part = F.get("bits", F.call_function("shiftright", spot, F.lit(6)).cast("int"))
    return F.call_function("shiftright", part, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def word_sets(words: str = "w") -> list[Column]:
    """A bit of 256 for every word, by hash, in four numbers."""
    bit = "shiftleft(1L, cast(shiftright(h, 2) & 63 as int))"
    sets = F.expr(
        let(
            "d",
            f"transform({words}, x -> xxhash64(x))",
            "array(" + ", ".join(f"aggregate(d, 0L, (a, h) -> if((h & 3) = {j}, a | {bit}, a))" for j in range(4)) + ")",
        )
    )
    return [sets.alias("sets"), F.size(words).alias("n")]


def coded_texts(texts: DataFrame, firsts: DataFrame, docs: DataFrame, own: Staged) -> DataFrame:
    """``(k, e, n, b0, b1, b2, b3)`` of the wanted texts ``k``, written to the shared folder.

    Words are read again from the one document line that stands for a text.
    A broadcast array of bits keeps most other lines out of the shuffle.
    """
    wanted = own.write(texts.join(firsts, "k").select("k", "doc_id", "place"), "line-places")
    hashes = wanted.select(F.xxhash64("doc_id").alias("h")).distinct().union(wanted.select(F.xxhash64("doc_id", "place")))
    bits, size = _bits_of(hashes, own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # the documents' test comes before any text is cut
    parts = rows.join(F.broadcast(bits), _bit_test(size, "doc_id"), "left_semi").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")
    )
    lines = parts.join(F.broadcast(bits), _bit_test(size, "doc_id", "place"), "left_semi").join(wanted, ["doc_id", "place"])
    words = settle(lines, w=line_words(F.col("line")))
    # where rows repeat a doc_id, the line must be the one that was hashed
    made = words.where(text_key(F.col("w")) == F.col("k")).select("doc_id", "place", "k", encoded().alias("e"), *word_sets())
    # a text has one place, so this asks for no other order than the join
    once = made.groupBy("doc_id", "place", "k").agg(F.first("e").alias("e"), F.first("n").alias("n"), F.first("sets").alias("sets"))
    return own.write(once.select("k", "e", "n", *[F.col("sets")[j].alias(f"b{j}") for j in range(4)]), "line-words")


def likely(one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Lengths and word sets allow the two texts to be similar.

    An edit changes the length by one and exchanges two words at most."""
    longer = F.greatest(one("n"), other("n"))
    differ = sum((F.bit_count(one(c).bitwiseXOR(other(c))) for c in _SETS), F.lit(0))
    return (5 * F.least(one("n"), other("n")) >= 4 * longer) & (differ <= 2 * F.floor(longer / 5))


def likely_edges(edges: DataFrame, coded: DataFrame) -> DataFrame:
    """Those candidates ``(a, b)`` whose lengths and word sets allow it."""
    side = lambda name: coded.select(F.col("k").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *_SETS)])
    met = edges.join(side("a"), "a").join(side("b"), "b")
    return met.where(likely(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")


def linked(edges: DataFrame, coded: DataFrame, own: Staged) -> DataFrame:
    """Those candidates ``(a, b)`` whose words are similar enough, written to the shared folder."""
    left = coded.select(F.col("k").alias("a"), F.col("e").alias("ea"))
    right = coded.select(F.col("k").alias("b"), F.col("e").alias("eb"))
    return own.write(edges.join(left, "a").join(right, "b").where(similar("ea", "eb")).select("a", "b"), "line-links")


def joined_groups(groups: DataFrame, links: DataFrame, own: Staged) -> DataFrame:
    """``(k, grp)`` of groups joined by further links ``(a, b)``, written to the shared folder.

    Only links between groups take part in the rounds, as links of the groups' names."""
    home = lambda c: groups.select(F.col("k").alias(c), F.col("grp").alias(f"g{c}"))
    named = links.join(home("a"), "a", "left").join(home("b"), "b", "left")
    between = own.write(named.select("a", "b", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb"), "line-links")
    if between.isEmpty():
        return groups
    upper = components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
    alone = between.where("a = ga").select("a", "ga").union(between.where("b = gb").select("b", "gb")).distinct()
    every = groups.union(alone.join(groups, F.col("a") == F.col("k"), "left_anti")).join(upper, F.col("grp") == F.col("id"), "left")
    return own.write(every.select("k", F.coalesce("component", "grp").alias("grp")), "line-groups")


def mixed_blocks(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``(key, crowded, k, grp, big, one)`` of the blocks ``(key, k)`` with several of the
    groups ``(k, grp)``: ``big`` is a block's largest group, ``one`` any of its texts."""
    labelled = shared.join(groups, "k", "left").select("key", "k", F.coalesce("grp", "k").alias("grp"))
    some = F.min_by("k", F.xxhash64("k", "grp")).alias("one")
    sizes = labelled.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"), some)
    spread = sizes.groupBy("key").agg(
        F.max(F.struct("n", "grp", "one")).alias("big"), F.sum("n").alias("of"), F.count(F.lit(1)).alias("groups")
    )
    spread = spread.where("groups > 1").select(
        "key", (F.col("of") - F.col("big.n") > CROWD).alias("crowded"), F.col("big.grp").alias("big"), "big.one"
    )
    return labelled.join(spread, "key").select("key", "crowded", "k", "grp", "big", "one")


def rare_words(coded: DataFrame) -> DataFrame:
    """``(k, rare)``: of every text of n words, the n div 5 + 1 distinct words of the fewest texts.

    Of a text of n words, n div 5 at most are missing from a similar text. So the first word that both have, in any
    order of all words, is among these of either. Texts are counted for buckets of words; words of one bucket go by number.
    """
    words = coded.select("k", "n", F.array_distinct(F.split("e", "")).alias("c"))
    bucket = F.pmod(F.ascii("w"), F.lit(_WORD_BUCKETS)).alias("bucket")
    counts = [0] * _WORD_BUCKETS
    for row in words.select(F.explode("c").alias("w")).groupBy(bucket).count().collect():  # at most _WORD_BUCKETS rows
        counts[row["bucket"]] = row["count"]
    often = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<long>")
    ranks = F.transform("c", lambda x: often[F.pmod(F.ascii(x), F.lit(_WORD_BUCKETS))] * (1 << 20) + F.ascii(x))
    return words.select("k", F.slice(F.sort_array(ranks), F.lit(1), F.expr("cast(n div 5 as int) + 1")).alias("rare"))


def meeting_points(rows: DataFrame, coded: DataFrame, own: Staged | None = None) -> DataFrame:
    """``(key, k, grp, w, rare, e, n, b0, b1, b2, b3)`` of the blocks with several groups; a crowded block
    has a key for each rare word ``w``. No similar pair of a block is without a key in common."""
    none = [F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("rare")]
    few = rows.where("not crowded").select("key", "k", "grp", *none)
    crowd = rows.where("crowded")
    ids = crowd.select("k").distinct()
    mine = coded.join(own.write(ids, "line-crowd") if own else ids, "k", "left_semi").select("k", "n", "e")
    rare = rare_words(own.write(mine, "line-crowd") if own else mine)
    split = crowd.join(rare, "k").select("key", "k", "grp", F.explode("rare").alias("w"), "rare")
    met = few.union(split.select(F.xxhash64("key", "w").alias("key"), "k", "grp", "w", "rare"))
    return met.join(coded, "k").select("key", "k", "grp", "w", "rare", "e", "n", *_SETS)


def sides(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides ``(key, x, y, ...)`` of the pairs between different groups of a block.

    The left side leaves out the block's largest group, so that its rows don't meet each other; blocks of one
    group have no rows. A large block is cut on both sides, and every two pieces are a join key (key, x, y) of their own.
    All columns go along, those of the right side with a 2 behind their names.
    """
    sizes = labelled.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.groupBy("key").agg(
        F.max(F.struct("n", "grp")).alias("big"), F.sum("n").alias("of"), F.count(F.lit(1)).alias("groups")
    )
    spread = spread.where("groups > 1").select(
        "key",
        F.col("big.grp").alias("big"),
        F.ceil((F.col("of") - F.col("big.n")) / BLOCK_ROWS).alias("nx"),
        F.ceil(F.col("of") / BLOCK_ROWS).alias("ny"),
    )
    mixed = labelled.join(spread, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    facts = [c for c in labelled.columns if c != "key"]
    left = mixed.where("grp <> big").select("key", F.pmod("k", "nx").alias("x"), every("ny").alias("y"), *facts)
    second = [F.col(c).alias(f"{c}2") for c in facts]
    return left, mixed.select("key", every("nx").alias("x"), F.pmod("k", "ny").alias("y"), *second)


def block_pairs(points: DataFrame) -> DataFrame:
    """The likely pairs ``(a, b)`` of different groups among the rows of ``meeting_points``.

    A pair that has several rare words of a block in common leaves the join by the first of them only."""
    left, right = sides(points)
    met = left.join(right, ["key", "x", "y"]).where((F.col("grp") != F.col("grp2")) & likely(F.col, lambda c: F.col(f"{c}2")))
    once = met.where("w is null or w = array_min(array_intersect(rare, rare2))")
    return once.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))


def line_groups(docs: DataFrame, keep: Staged) -> tuple[DataFrame, DataFrame]:
    """All eligible lines ``(doc_id, place, k)``, and ``(k, grp)`` of the texts with a similar other text."""
    own = Staged(docs.sparkSession)
    lines = keep.write(eligible_lines(docs), "lines")
    # copies of a text combine on the map side
    firsts = own.write(lines.groupBy("k").agg(F.min(F.struct("doc_id", "place")).alias("at")).select("k", "at.*"), "line-firsts")
    # one shuffle serves the blocks' first texts and all others; only texts that meet another one go on
    keyed = lines.select(F.explode("keys").alias("key"), "k").where("key is not null and k is not null").repartition("key")
    heads = keyed.groupBy("key").agg(F.min("k").alias("fk"), F.max("k").alias("__last")).where("fk <> __last").select("key", "fk")
    star = own.write(keyed.join(heads.hint("shuffle_hash"), "key").where("k <> fk").distinct(), "line-blocks")
    shared = star.select("key", "k").union(star.select("key", "fk")).distinct()
    coded = coded_texts(shared.select("k").distinct(), firsts, docs, own)
    edges = star.select(F.col("fk").alias("a"), F.col("k").alias("b"))
    links = linked(likely_edges(edges.distinct(), coded), coded, own)
    groups = own.write(components(links).select(F.col("id").alias("k"), F.col("component").alias("grp")), "line-groups")
    rows = own.write(mixed_blocks(shared, groups), "line-mixed")
    # the largest group of a crowded block takes in what is similar to one more of its texts
    edges = own.write(rows.where("crowded and grp <> big").select(F.col("one").alias("a"), F.col("k").alias("b")).distinct(), "line-pairs")
    if not edges.isEmpty():
        pairs = own.write(likely_edges(edges, coded), "line-pairs")
        groups = joined_groups(groups, linked(pairs, coded, own), own)
        rows = own.write(mixed_blocks(rows.select("key", "k"), groups), "line-mixed")
    points = own.write(meeting_points(rows, coded, own).drop("e"), "line-points")
    pairs = own.write(block_pairs(points).distinct(), "line-pairs")
    groups = keep.write(joined_groups(groups, linked(pairs, coded, own), own), "line-groups")
    own.clear()
    return lines.select("doc_id", "place", "k"), groups


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, places)``: the lines, counted from 0, that repeat an earlier one."""
    keep = Staged(docs.sparkSession)
    lines, groups = line_groups(docs, keep)
    # the first line of a text, then of its group; both minima combine on the map side
    texts = lines.groupBy("k").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.count(F.lit(1)).alias("n"))
    named = texts.join(groups, "k", "left").withColumn("grp", F.coalesce("grp", "k"))
    kept = named.groupBy("grp").agg(F.min("at").alias("keep"), F.sum("n").alias("of"))
    # only texts with a line to remove go on
    hit = named.join(kept.where("of > 1"), "grp").select("k", "keep")
    out = lines.join(hit, "k").where(F.struct("doc_id", "place") != F.col("keep"))
    gone = Staged(docs.sparkSession).write(
        out.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("places")), "lines-removed"
    )
    keep.clear()
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the lines that repeat an earlier one.

    "Earlier" goes by doc_id, then by place in the text. Null texts stay null;
    empty texts stay as they are, and so do lines of fewer than MIN_WORDS words
    and EXACT_CHARS characters. A very long line is compared whole. Rows
    of one doc_id count as one document: a place is removed in all of them.
    Rows without an id stay whole.
    """
    columns = docs.columns
    gone = removed_lines(docs).select(F.col("doc_id").alias("__gone_id"), F.col("places").alias("__gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    joined = packed.join(gone, F.col("__row.doc_id") == F.col("__gone_id"), "left")
    rest = F.expr(
        r"array_join(filter(split(__row.text, '\n'), (x, i) -> not array_contains(__gone, i)), '\n')"
    )
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(rest)
    return joined.select(*[text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in columns])


def without_emptied(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` without the documents that lost all of their words by it:
    everything in them stands in other documents."""
    columns = docs.columns
    marked = docs.withColumn("__had", F.length(F.trim(F.translate(text_of("text"), "\n\t\r\x0b\x0c", "     "))) > 0)
    left = dedup_lines(marked)
    has = F.length(F.trim(F.translate(text_of("text"), "\n\t\r\x0b\x0c", "     "))) > 0
    return left.where(~F.col("__had") | has).select(*[F.col(f"`{c}`") for c in columns])


def fuzzy_lines(docs: DataFrame) -> DataFrame:
    """For every row: lines before and after, and a digest of the remaining text."""
    columns = docs.select("doc_id", "text", F.size(F.split(text_of("text"), "\n")).cast("long").alias("n_lines"))
    left = dedup_lines(columns)
    return left.select(
        "doc_id",
        "n_lines",
        F.size(F.split(text_of("text"), "\n")).cast("long").alias("n_left"),
        F.length(text_of("text")).cast("long").alias("chars_left"),
        sha256(text_of("text")).alias("text_sha256"),
    )
