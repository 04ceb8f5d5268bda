"""Chat formatting from an event log.

A log row is an event of one turn: ``message`` starts the turn's text,
``delta`` appends to it, ``edit`` replaces it, ``regenerate`` starts it anew
and voids everything that was logged before for this turn and all later ones.
Events are partitioned by conversation, ordered by sequence number and folded
into final messages, which a template renders. Built-in functions only; the
windows and the grouping share one shuffle by conversation.

The template writes ``<s>role[INST]text</s>`` for a turn. Inside roles and
texts a backslash goes into every control string, and one more where some are
there already, so unescaping gives the same text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelcheck.llm.common import sha256

OPEN, TEXT, CLOSE = "<s>", "[INST]", "</s>"
RESETS = ("message", "edit", "regenerate")
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1$2\\$3")


def unescape(text: str) -> str:
    """SQL for the text behind an escaped SQL expression."""
    return rf"regexp_replace({text}, r'([<\[])\\(\\*)(/?(?:s>|INST\]))', '$1$2$3')"


def message_events(rows: DataFrame) -> DataFrame:
    """Every row of a plain table of turns as a ``message`` event.

    Rows are numbered by turn, ties by role and text, so that rows of equal
    turn, even repeated ones, stay turns of their own. Null texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.row_number().over(order).cast("long").alias("turn"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def logged_events(rows: DataFrame) -> DataFrame:
    """A plain table of turns as the log that a chat server could have written.

    By a hash of each turn it is sent whole, streamed in three parts, edited
    after a wrong draft, or regenerated after a draft and the beginning of a
    next turn, which both become void. Folding the log gives the turns back.
    """
    turns = message_events(rows).withColumn("way", F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4)))
    third = "length(text) div 3"

    def log(*steps: tuple[str, str, str, str]) -> str:
        """SQL of an array of (turn, kind, role, text), numbered in order."""
        made = [
            f"named_struct('turn', {turn}, 'seq', turn * 8 + {k}, 'kind', '{kind}', 'role', {role}, 'text', {text})"
            for k, (turn, kind, role, text) in enumerate(steps)
        ]
        return f"array({', '.join(made)})"

    start = f"substring(text, 1, cast({third} as int))"
    rest = f"substring(text, cast({third} as int) + 1)"
    ways = [
        log(("turn", "message", "role", "text")),
        log(
            ("turn", "message", "role", start),
            ("turn", "delta", "''", f"substring(text, cast({third} as int) + 1, cast({third} as int))"),
            ("turn", "delta", "''", f"substring(text, 2 * cast({third} as int) + 1)"),
        ),
        log(("turn", "message", "'draft'", "reverse(text)"), ("turn", "delta", "''", "' and more'"), ("turn", "edit", "role", "text")),
        log(
            ("turn", "message", "role", "concat('draft of ', text)"),
            ("turn + 1", "message", "'draft'", "'too early'"),
            ("turn", "regenerate", "role", start),
            ("turn", "delta", "''", rest),
        ),
    ]
    chosen = "case way " + " ".join(f"when {k} then {w}" for k, w in enumerate(ways)) + " end"
    return turns.select("conv_id", F.explode(F.expr(chosen)).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Final ``(conv_id, turn, role, text)`` of a log.

    Events of one turn with equal seq apply in the order of kind and text. A
    turn without a starting event consists of its deltas. The role is the
    last one that an event of the surviving text names, else empty. An empty
    log has no messages.
    """
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    restart = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(upto)
    alive = events.withColumn("__cut", restart).where(F.col("__cut").isNull() | (F.col("seq") >= F.col("__cut")))
    turn = Window.partitionBy("conv_id", "turn")
    start = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(turn)
    current = alive.withColumn("__start", start).where(F.col("__start").isNull() | (F.col("seq") >= F.col("__start")))
    # the starting event precedes deltas of equal seq
    rank = F.when(F.col("kind") == "delta", 1).otherwise(0)
    piece = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.when(F.col("role") != "", F.struct("seq", rank.alias("rank"), "role"))
    return current.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max(named)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row for each turn: its ``piece`` of the formatted text, where that
    starts in the conversation, and the place of the loss inside the piece."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    learned = F.col("role").isin(*LEARNED)
    return (
        messages.select("conv_id", "turn", learned.alias("learned"), head.alias("head"), body.alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
        .select(
            "conv_id",
            "turn",
            "piece",
            F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("start"),
            F.when(
                F.col("learned"),
                F.struct(F.length("head").alias("start"), F.length("body").alias("length")),
            ).alias("loss"),
        )
    )


def assemble(turns: DataFrame) -> DataFrame:
    """The formatted text of every conversation and its loss mask.

    ``loss`` has an entry for each turn: null, or start and length in code
    points within the turn's piece, and ``start`` of the piece in the text.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "piece", "start", "loss")))
    return turns.groupBy("conv_id").agg(ordered.alias("all")).select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("all", lambda x: x["start"]).alias("starts"),
        F.transform("all", lambda x: x["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, learned, formatted)``, parsed from the formatted text.

    ``turns`` are (role, text) in order; ``learned`` is all text under the
    loss mask. Every piece is cut once, so the work is linear in the text.
    """
    pieces = formatted.select(
        "conv_id",
        "formatted",
        "loss",
        # what follows the last closing mark is empty
        F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1).alias("pieces"),
    )
    role = rf"substring_index(substring(p, {len(OPEN) + 1}), '{TEXT}', 1)"
    text = rf"substring(p, locate('{TEXT}', p) + {len(TEXT)})"
    return pieces.select(
        "conv_id",
        "formatted",
        F.expr(
            f"transform(pieces, p -> named_struct('role', {unescape(role)}, 'text', {unescape(text)}))"
        ).alias("turns"),
        F.expr(
            "array_join(zip_with(pieces, loss, (p, m) -> if(m is null, '', "
            + unescape("substring(p, m.start + 1, m.length)")
            + ")), '')"
        ).alias("learned"),
    )


def format_log(events: DataFrame) -> DataFrame:
    return assemble(render(fold(events)))


def control_texts(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts made of control strings."""
    said = f"{CLOSE}{TEXT} ok [/INST]"
    return spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )


def chat_events(conversations: DataFrame) -> DataFrame:
    """The contract's digest, read back from the formatted conversations.

    Turns are logged as events, folded, rendered and parsed. Null roles and
    texts are empty, rows that repeat a turn stay turns, a null conv_id is a
    conversation; an empty table leaves the control texts. A conversation,
    however long, is one row in one task.
    """
    columns = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*columns).unionByName(control_texts(conversations.sparkSession))
    back = read_back(format_log(logged_events(rows)))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        sha256(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *,
    regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS etext
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>' || erole || '[INST]' || etext || '</s>')) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
