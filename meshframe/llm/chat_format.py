r"""Chat formatting in DataFrame code only.

The turns of a conversation are collected as structs and sorted; each run of turns of one role is cut out of the array
and merged into one block, and the blocks are concatenated:

    ### user: text <+> text </turn>

`#`, `<`, `:` and `\` in texts and roles become `\h`, `\l`, `\c` and `\s`, so control strings never occur inside a text
and every text can be read back. A block is made as segments with a mark, and the formatted text is these segments joined:
the marks are its loss mask, on the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, JOIN, CLOSE = "### ", ": ", " <+> ", " </turn>\n"
ASSISTANT = "assistant"


def escaped(x: Column) -> Column:
    for a, b in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescaped(x: Column) -> Column:
    for a, b in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\s")):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def format_chats(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted, segments): one row a conversation; segments is an array of (text, in_loss), which joined
    give `formatted`.

    Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one order and all stay.
    Null texts and roles are empty; an empty text is still a turn. A null conv_id is a conversation of its own. A
    conversation is one output row and must fit a task. Other columns are ignored.
    """
    own = rows.select(
        F.col(id_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get(F.col("turns"), i)
    last = F.size("turns") - 1
    heads = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    runs = turns.withColumn("heads", heads)
    block = lambda h, j: F.slice(
        "turns", h + 1, F.coalesce(F.get(F.col("heads"), j + 1), F.size("turns")) - h
    )
    runs = runs.withColumn("blocks", F.transform("heads", block))

    def piece(text: Column, marked: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(marked).alias("in_loss"))

    def parts(b: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(b[0]["role"]), F.lit(SAYS))
        inner = F.transform(
            b,
            lambda t, i: F.array(
                piece(F.when(i == 0, head).otherwise(F.lit(JOIN)), False),
                F.struct(escaped(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("in_loss")),
            ),
        )
        return F.concat(F.flatten(inner), F.array(piece(F.lit(CLOSE), False)))

    cut = runs.select("conv_id", F.flatten(F.transform("blocks", parts)).alias("segments"))
    return cut.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text: array of (role, text)."""
    blocks = F.split(formatted, F.lit("</turn>\n"))
    inner = F.transform(
        F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substr(b, F.lit(len(OPEN) + 1), F.length(b) - len(OPEN) - 1)
    )

    def turns(b: Column) -> Column:
        role = F.substring_index(b, SAYS, 1)
        texts = F.split(F.substr(b, F.length(role) + len(SAYS) + 1, F.length(b)), r" <\+> ", -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(inner, turns))


def chat_report(rows: DataFrame) -> DataFrame:
    """Digests of what can be read back from the formatted conversations."""
    done = format_chats(rows)
    loss = F.transform(F.filter("segments", lambda s: s["in_loss"]), lambda s: unescaped(s["text"]))
    read = done.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("n")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )


_E = r"replace(replace(replace(replace(coalesce({0}, ''), '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c')"
OP3_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS head FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_E.format("text")}) + CASE WHEN head THEN {len(OPEN + SAYS + CLOSE)} + length({_E.format("role")}) ELSE {len(JOIN)} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
