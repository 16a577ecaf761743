"""Chat formatting by a grammar round trip.

``format_chats`` renders every conversation as one string of turns

    ### ROLE: TEXT</turn>

(a line end after each), reads it back with ``parse``, a deterministic parser of that grammar, and compares the recovered turns
with the source. Where they differ, the conversation is rendered again with more escapes: first the control strings, then the escape
sign as well. The last step is always reversible, as then no control string and no escape sign of a text survives
unescaped; a conversation that still differed would end the job. Texts without conflict stay as they are. Everything is a DataFrame expression.

A template's escapes: ``\\s`` for the escape sign itself, ``\\h`` for ``### ``, ``\\e`` for ``</turn>``, and in roles ``\\c`` for the
separator. The parser refuses any other use of the escape sign and any bare control string inside a turn.

The loss mask is one (before, under, after) triple of code-point lengths for each turn: the text of an assistant's turn is under the
mask, all else is not; end to end, the triples cover the formatted string.

Defined cases: a null role or text is empty; turns go by number, a null one first, equal ones by role and text; repeated rows are repeated turns; rows
with a null id are one conversation; an empty table gives no row; columns other than the four named are not read, so clashing names
do no harm. A conversation is one record, as its string is one value: its turns meet in one task, and it may not pass 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEPARATOR, END = "### ", ": ", "</turn>"
SIGN = "\\"
ESCAPES = {HEAD: "\\h", END: "\\e"}
ROLE_ESCAPES = ESCAPES | {SEPARATOR: "\\c"}
LOSS_ROLE = "assistant"


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, turns array<struct<role, text>> in order."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn"), text("role"), text("text"))))
    return conversations.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def _escaped(text: Column, level: int, table: dict[str, str]) -> Column:
    """Level 0: as it is; 1: control strings; 2: the escape sign as well, which has to come first."""
    if level == 2:
        text = F.replace(text, F.lit(SIGN), F.lit("\\s"))
    for plain, code in table.items() if level else ():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in ROLE_ESCAPES.items():
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("\\s"), F.lit(SIGN))


def _render(turns: Column, level: int) -> Column:
    """Of each turn its string and the three lengths of its mask."""
    def turn(t):
        head = F.concat(F.lit(HEAD), _escaped(t.role, level, ROLE_ESCAPES), F.lit(SEPARATOR))
        body = _escaped(t.text, level, ESCAPES)
        tail = F.lit(f"{END}\n")
        learned = t.role == LOSS_ROLE
        rest = F.char_length(body)
        return F.struct(
            F.concat(head, body, tail).alias("piece"),
            (F.char_length(head) + F.when(learned, 0).otherwise(rest + len(END) + 1)).alias("before"),
            F.when(learned, rest).otherwise(0).alias("under"),
            F.when(learned, len(END) + 1).otherwise(0).alias("after"))

    return F.transform(turns, turn)


def pieces_of(formatted: Column) -> Column:
    """The turns' strings, each without its end mark."""
    found = F.split(formatted, f"{END}\n", -1)
    return F.slice(found, 1, F.size(found) - 1)


def parse(formatted: Column) -> Column:
    """Turns of a formatted string, array<struct<role, text>>; a turn outside the grammar is null."""
    def legal(raw, table):
        bad = raw.rlike(r"\\(?![shec])")
        for plain in table:
            bad = bad | raw.contains(plain)
        return ~bad

    def turn(piece):
        rest = F.substr(piece, F.lit(len(HEAD) + 1))
        at = F.locate(SEPARATOR, rest)
        role, text = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(SEPARATOR))
        good = piece.startswith(HEAD) & (at > 0) & legal(role, ROLE_ESCAPES) & legal(text, ESCAPES)
        return F.when(good, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))

    return F.transform(pieces_of(formatted), turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, escape_level (0 to 2), loss_mask array<struct<before, under, after>>."""
    out = turns_of(conversations)
    done = F.lit(False)
    for level in range(3):
        before = F.col("rendered") if level else F.lit(None)
        out = out.select("conv_id", "turns", F.when(done, before).otherwise(_render(F.col("turns"), level)).alias("rendered"),
                         (F.when(done, F.col("escape_level")) if level else F.when(F.lit(False), 0)).otherwise(level).alias("escape_level"))
        out = out.withColumn("formatted", F.array_join(F.transform("rendered", lambda r: r.piece), ""))
        out = out.withColumn("same", F.col("turns").eqNullSafe(parse(F.col("formatted"))))
        done = F.col("same")
    kept = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    mask = F.transform("rendered", lambda r: F.struct(r.before.alias("before"), r.under.alias("under"), r.after.alias("after")))
    return out.select("conv_id", kept.alias("formatted"), "escape_level", mask.alias("loss_mask"))


def loss_text(formatted: Column, mask: Column) -> Column:
    """What stands under the mask, read from the formatted string and unescaped; nothing between the turns."""
    under = F.zip_with(pieces_of(formatted), mask, lambda p, m: unescaped(F.substr(p, m.before + 1, m.under)))
    return F.array_join(under, "")
