"""Personal data: fixed patterns, and terms that reveal what they hide.

The patterns give the base spans (e-mail, IP address, card, phone); each
distinct value is a protected entity. A word that stands near an entity and
hardly anywhere else still discloses it when the value is masked. How strongly
is estimated from the whole corpus: with N words, n(c) occurrences of entity c,
n(t) of term t and n(c, t) of t within WINDOW words of c,

    IC(c)     = log2(N / (2 * WINDOW * n(c)))        information of the entity
    PMI(c; t) = IC(c) - log2(n(t) / n(c, t))         what the term gives away

A term discloses c if PMI is positive and leaves at most MAX_LEFT bits of IC,
seen in MIN_CONTEXTS different neighbourhoods or more, so that copies of one
text are no evidence. Its stem (STEM letters) is tried as a generalisation: if
the stem leaves SAFE_LEFT bits or more for every such entity, the term is
generalised to it, else removed. Such terms are spans wherever they stand.

Built-in functions only. Texts are not shuffled: entities go on with their
neighbourhoods, words as 64-bit hashes that are counted on the map side first,
and spans with a 64-bit hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcheck.functions.rings import settle
from parcelcheck.llm.common import sha256, text_of
from parcelcheck.llm.secret_scan import let, quote
from parcelcheck.session import remove_staged, staging_path

# The base patterns. Possessive repeats and look-behinds change no
# match, they keep long runs linear: a later start in a run fails as the first does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term_removed", "term_generalised")
REMOVED, GENERALISED = KINDS.index("term_removed"), KINDS.index("term_generalised")

#: Words on either side of an entity that count as near.
WINDOW = 5
#: Different neighbourhoods of an entity in which a term must stand.
MIN_CONTEXTS = 3
#: Bits of the entity's information that a disclosing term leaves at most, and a safe stem at least.
MAX_LEFT, SAFE_LEFT = 1.0, 3.0
#: Letters of a stem, and of a term at least.
STEM, LETTERS = 4, 3

#: Words are cut at each blank, so a place is a sum of lengths.
_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = r"' \t\n\u000B\f\r'"
_MARKS = r"""'.,;:!?"()[]{}<>*#$%&|_/\\\'-'"""
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,value:string,head:int,tail:int>>"
_ADDED = "array<struct<start:int,rank:int,stop:int,kind:string>>"
_NEAR = "array<struct<entity:bigint,terms:array<string>>>"
#: Bits that keep most words of the corpus out of the last join.
_BITS = 1 << 20

#: What a hit must pass, and the value it stands for; ``hit`` is the whole hit.
_ACCEPTS = {
    "email": "true",
    "ip": r"forall(split(hit, '\\.'), p -> length(ltrim('0', p)) < 3 or (length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255'))",
    "card": "(length(translate(hit, ' -', '')) between 14 and 19 and luhn_check(translate(hit, ' -', '')))",
    "phone": "(length(translate(hit, '+ ().-', '')) between 10 and 15)",
}
_VALUES = {
    "email": "lower(hit)",
    "ip": "hit",
    "card": "translate(hit, ' -', '')",
    "phone": "translate(hit, '+ ().-', '')",
}


def _blanks_in(text: str) -> str:
    return f"(length({text}) - length(translate({text}, {_BLANKS}, '')))"


def _term(piece: str) -> str:
    """SQL of a word in lower case without the ASCII punctuation around it."""
    return f"lower(trim(BOTH {_MARKS} FROM {piece}))"


def _cut(kind: str) -> Column:
    """All hits of a pattern in ``t``, each with what stands before it; null for a text without a hit."""
    p = quote(PATTERNS[kind])
    zipped = f"arrays_zip(split(t, {p}, -1), regexp_extract_all(t, {p}, 0))"
    return F.expr(f"cast(if(t rlike {p}, {zipped}, null) as array<struct<gap:string,hit:string>>)").alias(f"cut_{kind}")


def _spans_of(kind: str) -> Column:
    """Spans of one kind, leftmost first, without the hits that fail its test.

    Lengths of hits and of what lies between them add up to the places; blanks
    in them add up to the number of the word (``head``, ``tail``) that a hit
    starts and ends in.
    """
    span = (
        f"named_struct('start', a.at + length(x.gap), 'rank', {KINDS.index(kind)},"
        f" 'stop', a.at + length(x.gap) + length(x.hit), 'kind', '{kind}', 'value', {_VALUES[kind].replace('hit', 'x.hit')},"
        f" 'head', a.word + {_blanks_in('x.gap')}, 'tail', a.word + {_blanks_in('x.gap')} + {_blanks_in('x.hit')})"
    )
    passes = _ACCEPTS[kind].replace("hit", "x.hit")
    return F.expr(
        f"coalesce(aggregate(cut_{kind}, named_struct('at', 0, 'word', 0, 'out', cast(array() as {_SPANS})),"
        " (a, x) -> named_struct('at', a.at + length(x.gap) + coalesce(length(x.hit), 0),"
        f" 'word', a.word + {_blanks_in('x.gap')} + coalesce({_blanks_in('x.hit')}, 0),"
        f" 'out', if(x.hit is not null and {passes}, concat(a.out, array({span})), a.out)), a -> a.out),"
        f" cast(array() as {_SPANS}))"
    )


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_words, base, near)`` for every row.

    ``base`` holds the spans by start, then kind; ``near`` the entity of every
    span, as a hash of kind and value, and the terms around it. Words of the
    span itself are not near it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    cut = rows.select("doc_id", "t", *[_cut(kind) for kind in PATTERNS])
    found = settle(
        cut.select("doc_id", "t", *[_spans_of(kind).alias(kind) for kind in PATTERNS]),
        base=F.sort_array(F.concat(*PATTERNS)),
    )
    around = (
        f"concat(slice(q, greatest(x.head - {WINDOW}, 0) + 1, least({WINDOW}, x.head)), slice(q, x.tail + 2, {WINDOW}))"
    )
    terms = f"filter(transform({around}, p -> {_term('p')}), p -> p rlike '^\\\\p{{L}}{{{LETTERS},}}$')"
    near = let(
        "q",
        f"split(t, {quote(_BLANK)})",
        f"transform(base, x -> named_struct('entity', xxhash64(x.kind, x.value), 'terms', {terms}))",
    )
    return found.select(
        "doc_id",
        F.xxhash64("t").alias("text_key"),
        F.expr(f"size(split(trim(BOTH {_BLANKS} FROM t), {quote(_BLANK + '+')}))").cast("long").alias("n_words"),
        "base",
        F.expr(f"if(size(base) = 0, cast(array() as {_NEAR}), {near})").cast(_NEAR).alias("near"),
    )


def _staged(rows: DataFrame, label: str) -> tuple[str, DataFrame]:
    path = staging_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return path, rows.sparkSession.read.schema(rows.schema).parquet(path)


def _hashed(term: Column) -> list[Column]:
    """A term and its stem as hashes."""
    return [F.xxhash64(term).alias("h"), F.xxhash64(F.substring(term, 1, STEM)).alias("g")]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(h, g, n)``: how often the corpus holds each word; g is its stem's hash."""
    words = docs.select(F.explode(F.split(text_of(text), _BLANK)).alias("p")).select(F.expr(_term("p")).alias("w"))
    hashed = words.where(F.length("w") >= LETTERS).select(*_hashed(F.col("w")))
    # dealt by the word: some stems have a large share of the words
    return hashed.groupBy("h").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))


def disclosures(facts: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``(entity, term, h, ic, pmi, left_bits, stem_left, rank)``: every term that discloses an entity.

    ``facts`` comes from ``base_spans``. A term near two occurrences of its
    entity at once counts twice, but never more often than it occurs.
    """
    contexts = facts.select(F.explode("near").alias("x")).groupBy("x.entity", "x.terms").agg(F.count(F.lit(1)).alias("n"))
    entities = contexts.groupBy("entity").agg(F.sum("n").alias("n_c"))
    single = contexts.select("entity", "n", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    times = F.expr("n * size(filter(terms, y -> y = term))")
    pairs = single.groupBy("entity", "term").agg(F.sum(times).alias("n_ct"), F.count(F.lit(1)).alias("contexts"))
    pairs = pairs.select("*", *_hashed(F.col("term")))
    stems = pairs.groupBy("entity", "g").agg(F.sum("n_ct").alias("n_cg"))
    strong = pairs.where(F.col("contexts") >= MIN_CONTEXTS)
    _, counted = _staged(word_counts(docs, text).join(strong.select("g").distinct(), "g", "left_semi"), "near-words")
    total = facts.agg(F.sum("n_words")).first()[0] or 0
    of_stem = counted.groupBy("g").agg(F.sum("n").alias("n_g"))
    joined = (
        strong.join(counted.select("h", F.col("n").alias("n_t")), "h")
        .join(of_stem, "g")
        .join(stems, ["entity", "g"])
        .join(entities, "entity")
    )
    left = F.log2(F.col("n_t") / F.least("n_ct", "n_t"))
    stem_left = F.log2(F.col("n_g") / F.least("n_cg", "n_g"))
    known = F.log2(F.lit(float(total)) / (2 * WINDOW * F.col("n_c")))
    safe = (F.col("stem_left") >= SAFE_LEFT) & (F.length("term") > STEM)
    measured = joined.select("entity", "term", "h", known.alias("ic"), left.alias("left_bits"), stem_left.alias("stem_left"))
    return measured.where((F.col("left_bits") <= MAX_LEFT) & (F.col("ic") > F.col("left_bits"))).select(
        "*", (F.col("ic") - F.col("left_bits")).alias("pmi"), F.when(safe, GENERALISED).otherwise(REMOVED).alias("rank")
    )


def _bit_of(bits: bytes, h: str) -> str:
    """SQL that looks a hash up in a bit array of fixed size."""
    spot = f"pmod({h}, {_BITS})"
    byte = f"cast(conv(hex(substring(unhex('{bits.hex()}'), cast(shiftright({spot}, 3) as int) + 1, 1)), 16, 10) as int)"
    return f"(shiftright({byte}, cast({spot} & 7 as int)) & 1) = 1"


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``(text_key, added)``: the spans of ``(h, rank)`` in every distinct text that has any."""
    spots = terms.select(F.pmod("h", F.lit(_BITS)).cast("int").alias("s")).distinct()
    bits = bytearray(_BITS // 8)
    for row in spots.collect():  # at most _BITS numbers
        bits[row.s >> 3] |= 1 << (row.s & 7)
    rows = docs.select(text_of(text).alias("t"))
    pieces = settle(rows, q=F.split("t", _BLANK))
    likely = (
        f"filter(transform(q, (p, i) -> named_struct('i', i, 'p', p, 'h', xxhash64({_term('p')}))),"
        f" y -> {_bit_of(bytes(bits), 'y.h')})"
    )
    found = settle(pieces, y=F.expr(likely)).where(F.size("y") > 0)
    start = "a.at + length(array_join(slice(q, a.next + 1, x.i - a.next), ' ')) + if(x.i > a.next, 1, 0)"
    lead = f"length(x.p) - length(trim(LEADING {_MARKS} FROM x.p))"
    span = f"named_struct('start', s + {lead}, 'stop', s + {lead} + length({_term('x.p')}), 'h', x.h)"
    step = let("s", start, f"named_struct('at', s, 'next', x.i, 'out', concat(a.out, array({span})))")
    walk = (
        "aggregate(y, named_struct('at', 0, 'next', 0, 'out', cast(array() as array<struct<start:int,stop:int,h:bigint>>)),"
        f" (a, x) -> {step}, a -> a.out)"
    )
    spread = found.select(F.xxhash64("t").alias("text_key"), F.explode(F.expr(walk)).alias("z"))
    single = spread.groupBy("text_key", "z.start", "z.stop", "z.h").agg(F.count(F.lit(1)).alias("copies"))
    kind = F.when(F.col("rank") == REMOVED, KINDS[REMOVED]).otherwise(KINDS[GENERALISED])
    named = single.join(terms, "h").select("text_key", F.struct("start", "rank", "stop", kind.alias("kind")).alias("z"))
    # the spans of one text
    return named.groupBy("text_key").agg(F.sort_array(F.collect_list("z")).alias("added"))


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, base, added)``: arrays of spans for every row.

    Places are code points, the end is exclusive. Base hits of one kind are
    leftmost and don't overlap; spans of different kinds may. Null and empty
    texts have no spans, and neither have null ids any say: rows that repeat
    an id or a text each count as an occurrence, and equal texts get equal
    spans. An empty table gives an empty table. A very long text is one row in
    one task, as long as its words.
    """
    path, facts = _staged(base_spans(docs, doc_id, text), "personal-facts")
    terms_path, terms = _staged(
        disclosures(facts, docs, text).groupBy("h").agg(F.min("rank").alias("rank")), "disclosing-terms"
    )
    none = F.expr(f"cast(array() as {_ADDED})")
    slim = facts.select("doc_id", "text_key", "base")
    if terms.isEmpty():
        return slim.withColumn("added", none)
    spans = term_spans(docs, terms, text)
    return slim.join(spans, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("added", none).alias("added"))


def _both() -> Column:
    plain = F.transform("base", lambda x: F.struct(x["start"], x["rank"], x["stop"], x["kind"]))
    return F.sort_array(F.concat(plain.cast(_ADDED), F.col("added").cast(_ADDED)))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, in their order."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` base spans become their kind in
    brackets, removed terms go and generalised ones become stem and asterisk.

    Of overlapping spans the one that starts first (then the kind as listed)
    names the mask, and what the others cover beyond it goes too. Null texts
    stay null.
    """
    found = find_personal(docs, docs.columns[0], text).select("text_key", _both().alias("__spans"))
    keyed = found.where(F.size("__spans") > 0).dropDuplicates(["text_key"]).withColumnRenamed("text_key", "__key")
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.xxhash64(text_of(text)).alias("__of"))
    body = f"__row.`{text}`"
    mask = (
        f"case when x.rank = {REMOVED} then '' when x.rank = {GENERALISED}"
        f" then concat(substring({body}, x.start + 1, {STEM}), '*') else concat('[', x.kind, ']') end"
    )
    walk = (
        "aggregate(__spans, named_struct('at', 0, 'out', ''), (a, x) -> if(x.start >= a.at, named_struct('at', x.stop,"
        f" 'out', concat(a.out, substring({body}, a.at + 1, x.start - a.at), {mask})),"
        " named_struct('at', greatest(a.at, x.stop), 'out', a.out)),"
        f" a -> concat(a.out, substring({body}, a.at + 1)))"
    )
    joined = packed.join(keyed, F.col("__of") == F.col("__key"), "left")
    clean = F.expr(f"if(__spans is null or {body} is null, {body}, {walk})")
    return joined.select(*[clean.alias(c) if c == text else F.col("__row")[c].alias(c) for c in columns])


def disclosure(docs: DataFrame) -> DataFrame:
    """The contract's digest for every row."""
    found = find_personal(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in PATTERNS],
        sha256(written(F.col("base"))).alias("base_sha256"),
        written(_both()).alias("spans"),
    )
