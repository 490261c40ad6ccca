"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one text::

    <|im_start|>role
    text<|im_end|>

per turn.  A deterministic parser reads it back: a text ends at the first
control string, a control string that is no mark of the template is an error,
and ``<`` + backslashes + ``|`` loses one backslash.  The rendered text is
parsed and compared with its source; where they differ, every turn of that
conversation is rendered again with its control strings escaped (one backslash
more between ``<`` and ``|``; in roles also line ends and backslashes) and
parsed again, until both are identical.  One escape always suffices; that the
last parse agrees is returned as ``exact``.

``loss_spans`` are (start, length) in code points of the formatted text, one
per assistant turn: the text only, without marks.

At volume: one shuffle by conversation.  A conversation is one training record,
so its turns meet in one row by definition; nothing else is gathered.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text), null turns first; repeated rows are repeated turns; all rows with a null
conversation id are one conversation; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A control string, escaped or not: what an escaped text must not hold bare.
CONTROL = r"<(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape_role(role: Column) -> Column:
    # Backslash pairs are set apart before \n is read.
    plain = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(plain, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped: bool) -> Column:
    """Turns (role, text) as one text."""
    role = (lambda t: escape_role(t["role"])) if escaped else (lambda t: t["role"])
    text = (lambda t: escape(t["text"])) if escaped else (lambda t: t["text"])
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), role(t), F.lit("\n"), text(t), F.lit(END + "\n"))), "")


def _pieces(formatted: Column) -> Column:
    """What stands between the start marks; the part before the first mark is dropped."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _role(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _text(piece: Column) -> Column:
    """The text of a turn, still escaped."""
    body = F.substr(piece, F.length(_role(piece)) + 2)
    return F.substr(body, F.lit(1), F.length(body) - len(END) - 1)


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back; null if the text does not follow the grammar."""
    pieces = _pieces(formatted)
    sound = F.forall(pieces, lambda p: F.endswith(p, F.lit(END + "\n")) & F.contains(p, F.lit("\n"))
                     & ~F.contains(_role(p), F.lit("<|")) & ~F.contains(_text(p), F.lit("<|")))
    begins = (formatted == "") | F.startswith(formatted, F.lit(START))
    return F.when(begins & sound, F.transform(pieces, lambda p: F.struct(
        unescape_role(_role(p)).alias("role"), unescape(_text(p)).alias("text"))))


def loss_spans(formatted: Column) -> Column:
    """(start, length) of every assistant text in the formatted text."""
    sized = F.transform(_pieces(formatted), lambda p: F.struct(
        (unescape_role(_role(p)) == "assistant").alias("own"), F.length(_role(p)).alias("role"),
        F.length(_text(p)).alias("text")))
    mark, rest = len(START), len(END) + 2
    walked = F.aggregate(
        sized, F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + mark + s["role"] + s["text"] + rest).alias("at"),
            F.when(s["own"], F.array_append(acc["spans"], F.struct(
                (acc["at"] + mark + s["role"] + 1).alias("start"), s["text"].alias("length"))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return walked


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: id, source turns, ``formatted``, ``loss_spans``, ``escaped``, ``exact``."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = chats.groupBy(F.col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    whole = whole.withColumn("turns", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = whole.withColumn("_plain", render(F.col("turns"), escaped=False))
    tried = plain.withColumn("escaped", ~parse(F.col("_plain")).eqNullSafe(F.col("turns")))
    done = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), escaped=True))
                            .otherwise(F.col("_plain")))
    return done.select(conv_col, "turns", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"), "escaped",
                       parse(F.col("formatted")).eqNullSafe(F.col("turns")).alias("exact"))
