"""Conversations as one training text each, proven by reading them back.

Grammar of the output, turn after turn with nothing between::

    turn      = "<s>" body "</s>"
    body      = "[INST] " text " [/INST]"            user
              | "[ROLE] " role " [/ROLE] " text      any role but user and assistant
              | text                                 assistant

A text is written as it is if reading it back gives the source. Otherwise it is escaped: each backslash is
doubled and each control string gets one backslash behind its first character, so no control string
survives inside a text and the parser stays a split followed by one left-to-right unescape. What
then still differed would stop the run.

Defined results: a null text or role is empty; turns go by number, ties by role and text, a null number
first; repeated rows are repeated turns; a null conv_id is a conversation of its own. No rows give no
rows. Other columns are ignored. The whole of one conversation meets in one task, since its text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE] "
CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
USER, ASSISTANT = "user", "assistant"


def escape(text: Column) -> Column:
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        safe = F.replace(safe, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return safe


def unescape(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")
    ).otherwise(text)


def write_turn(role: Column, text: Column) -> Column:
    """One turn from a role and a text that are both safe already."""
    body = (
        F.when(role == USER, F.concat(F.lit(USER_OPEN), text, F.lit(USER_CLOSE)))
        .when(role == ASSISTANT, text)
        .otherwise(F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE), text))
    )
    return F.concat(F.lit(START), body, F.lit(END))


def bodies(formatted: Column) -> Column:
    """The turns of a formatted text without their end marks: the parser's first step."""
    pieces = F.split(formatted, F.lit(END))
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_turn(piece: Column) -> Column:
    """struct(role, text) of a turn without its end mark; nulls where it breaks the grammar."""
    body = F.when(F.startswith(piece, F.lit(START)), F.substr(piece, F.lit(len(START) + 1)))
    is_user = F.startswith(body, F.lit(USER_OPEN)) & F.endswith(body, F.lit(USER_CLOSE))
    is_other = F.startswith(body, F.lit(ROLE_OPEN))
    between = F.length(body) - (len(USER_OPEN) + len(USER_CLOSE))
    close = F.locate(ROLE_CLOSE, body, len(ROLE_OPEN) + 1)
    user_text = F.when(between >= 0, F.substr(body, F.lit(len(USER_OPEN) + 1), between))
    role_text = F.substr(body, F.lit(len(ROLE_OPEN) + 1), close - (len(ROLE_OPEN) + 1))
    role = F.when(is_user, F.lit(USER)).when(is_other, unescape(role_text))
    text = F.when(is_user, user_text).when(is_other, F.substr(body, close + len(ROLE_CLOSE)))
    return F.struct(
        F.coalesce(role, F.when(body.isNotNull(), F.lit(ASSISTANT))).alias("role"),
        unescape(F.coalesce(text, body)).alias("text"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct(role, text)> parsed from a formatted conversation."""
    return F.transform(bodies(formatted), read_turn)


def _comes_back(written: Column, role: Column, text: Column) -> Column:
    pieces = bodies(written)
    turn = read_turn(F.get(pieces, F.lit(0)))
    same = turn["role"].eqNullSafe(role) & turn["text"].eqNullSafe(text)
    return (F.size(pieces) == 1) & same


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, written): each row rendered, escaped only where needed."""
    clean = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    tried = clean.withColumn("_raw", write_turn(role, text)).withColumn(
        "_safe", write_turn(escape(role), escape(text))
    )
    stop = F.raise_error(F.lit("a turn does not survive formatting")).cast("string")
    return tried.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(_comes_back(F.col("_raw"), role, text), F.col("_raw"))
        .when(_comes_back(F.col("_safe"), role, text), F.col("_safe"))
        .otherwise(stop)
        .alias("written"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation.

    ``mask`` lists (turn, start, length) of the assistant texts, as written, in code points of
    ``formatted``. Rows are rendered, verified and placed before they are gathered, so
    that one conversation with very many turns costs a task only their joining.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = F.length("written").cast("long")
    placed = (
        format_turns(rows)
        .withColumn("length", length)
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("end", F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    piece = F.struct("place", "role", "written", "length", "end")
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    spoken = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    mask = F.transform(
        spoken,
        lambda t: F.struct(
            (t["place"] - 1).alias("turn"),
            (t["end"] - t["length"] + len(START)).alias("start"),
            (t["length"] - (len(START) + len(END))).alias("length"),
        ),
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        mask.alias("mask"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the parser and the mask read out of ``formatted``."""
    turns = formatted.withColumn("pieces", bodies(F.col("formatted"))).withColumn(
        "turns", F.transform("pieces", read_turn)
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    # A span lies within its turn, behind the start mark: looked up there, in linear time.
    under_mask = F.transform(
        "mask",
        lambda m: unescape(
            F.substr(
                F.get(F.col("pieces"), m["turn"]), F.lit(len(START) + 1), m["length"].cast("int")
            )
        ),
    )
    digests = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.array_join(under_mask, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return digests.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
