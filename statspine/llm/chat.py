"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = "<s>" NL turn* "</s>"
    turn         = "[INST] " role NL text NL "[/INST]" NL

Control strings are ``<s> </s> [INST] [/INST]``; one that a backslash precedes is text. A turn is rendered as it is and
read again by a parser of this grammar; where the turn that comes back differs from the source, or nothing does, a backslash
is put before every control string in its text, with the backslashes that stand before it, and reading takes it away
again. The whole conversation is then read back the same way, and escaped throughout should any turn still differ.
The loss mask marks the texts of assistant turns.

Defined results: null texts and roles are empty; turns are ordered by turn number (null first), then role, then text, so
repeated rows are repeated turns; rows with a null conv_id form one conversation; an empty table gives an empty table;
other columns are not read. A conversation is one value, so its turns meet in one row whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspine.functions.columns import let

CONTROL = r"(</?s>|\[/?INST\])"
OPEN, TURN, CLOSE_TURN, CLOSE = "<s>\n", "[INST] ", "\n[/INST]\n", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


#: a role is one line without control strings; characters that would break that are written as their code
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for char, code in ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape_role(role), F.lit("\n"), text, F.lit(CLOSE_TURN))


#: the control strings of a conversation, one after the other
GRAMMAR = r"^<s>(?:\[INST\]\[/INST\])*</s>$"


def segments(formatted: Column) -> Column:
    """What stands between the control strings; turns are at 2, 4, ... up to the last but two."""
    return F.split(formatted, r"(?<!\\)" + CONTROL, -1)


def controls(formatted: Column) -> Column:
    return F.array_join(F.regexp_extract_all(formatted, F.lit(r"(?<!\\)" + CONTROL), F.lit(1)), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null if it is none of the grammar's.

    The control strings have to come in the grammar's order, with nothing but the line ends that it asks for between turns,
    before the first and after the last one; a turn is a space, a line with the role, and lines with the text.
    """

    def turn(segment):
        line = F.substring_index(segment, "\n", 1)
        text = F.substr(segment, F.length(line) + 2, F.length(segment) - F.length(line) - 2)
        return F.struct(unescape_role(F.substr(line, F.lit(2))).alias("role"), unescape(text).alias("text"))

    def read(parts):
        last = F.size(parts) - 1
        inner = F.filter(parts, lambda _, i: (i % 2 == 0) & (i >= 2) & (i < last))
        between = F.forall(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p == "\n").otherwise((p.startswith(" ") & p.endswith("\n")) | (i == 0) | (i == last))), lambda ok: ok)
        outside = (F.element_at(parts, 1) == "") & (F.element_at(parts, -1) == "")
        return F.when(between & outside, F.transform(inner, turn))

    return F.when(controls(formatted).rlike(GRAMMAR), let(segments(formatted), read))


def whole(turns: Column) -> Column:
    return F.concat(F.lit(OPEN), turns, F.lit(CLOSE))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask (turn, start, skip, length), n_escaped.

    ``start`` counts code points of the formatted text, ``skip`` those of the turn's segment.
    """
    said = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    back = parse(whole(render(F.col("role"), F.col("text"))))
    same = F.coalesce(back == F.array(F.struct("role", "text")), F.lit(False))
    said = said.withColumn("wire", F.when(same, F.col("text")).otherwise(escape(F.col("text"))))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "wire")))
    talk = said.groupBy("conv_id").agg(turns.alias("turns"))

    def joined(wire):
        return whole(F.array_join(F.transform("turns", lambda t: render(t.role, wire(t))), ""))

    source = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    first = talk.withColumn("formatted", joined(lambda t: t.wire)).withColumn("exact", F.coalesce(parse(F.col("formatted")) == source, F.lit(False)))
    again = first.withColumn(
        "turns",
        F.when(F.col("exact"), F.col("turns")).otherwise(
            F.transform("turns", lambda t: F.struct(t.turn.alias("turn"), t.role.alias("role"), t.text.alias("text"), escape(t.text).alias("wire")))
        ),
    ).withColumn("formatted", F.when(F.col("exact"), F.col("formatted")).otherwise(joined(lambda t: t.wire)))

    # starts of turns: lengths added up by position, one row for each turn, beside the text itself
    each = again.select("conv_id", F.posexplode("turns").alias("at", "t"))
    head = F.length(F.concat(F.lit(" "), escape_role(F.col("t.role")), F.lit("\n")))
    size = F.length(render(F.col("t.role"), F.col("t.wire")))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select(
        "conv_id", "at", F.col("t.role").alias("role"), (F.col("t.wire") != F.col("t.text")).cast("long").alias("escaped"),
        head.alias("skip"), F.length("t.wire").alias("length"),
        (len(OPEN) + F.coalesce(F.sum(size).over(before), F.lit(0)) + len(TURN) - 1 + head).alias("start"),
    )
    span = F.struct(F.col("at").alias("turn"), "start", "skip", "length")
    masks = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("mask"), F.sum("escaped").alias("n_escaped")
    )
    texts = again.select(F.col("conv_id").alias("c"), "formatted")
    return masks.join(texts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "formatted", "mask", "n_escaped")


def loss_texts(formatted_: Column, mask: Column) -> Column:
    """Texts under the mask, without escapes, in order."""

    def read(parts):
        return F.transform(mask, lambda m: unescape(F.substr(F.get(parts, 2 + 2 * m.turn), m.skip + 1, m.length)))

    return let(segments(formatted_), read)
