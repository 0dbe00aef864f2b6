"""Chat formatting by prefix-target expansion (operator 3), with DataFrame functions only.

A conversation is formatted once. Every assistant turn becomes an example of
its own by ``expand``: its text is the prefix of the formatted conversation up
to that turn's end, and only its reply is trainable. Turns behind the last
reply are in a last row that trains nothing. Until they are written out,
examples are kept as places, so what is shuffled grows with the turns only.

Turns are ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no control string is left inside; in
roles ``%``, ``<`` and newlines are percent codes. Both are undone by
``read_back``. A null role or text is empty; turns that share a number are
ordered by role and text, and rows that repeat are turns that repeat; a null
conv_id is a conversation of its own. An empty table gives no rows; other columns
are not read. One conversation has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and examples (turn number from 0, its start, and the bounds of its loss, in code points)."""
    said = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape_text(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.select("conv_id", (F.row_number().over(order) - 1).alias("at"), (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("start"), "role", "head", "body")
    begin = F.col("start") + F.length("head")
    example = F.when(F.col("role") == target, F.struct(F.col("at").alias("turn"), F.col("start"), begin.alias("loss_start"), (begin + F.length("body")).alias("loss_end")))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(example)).alias("examples")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "examples")


def expand(formatted: DataFrame) -> DataFrame:
    """Every example as a row: conv_id, example (from 0), text (context and reply), loss_start, loss_end, last.

    ``last`` marks the longest text of a conversation; where turns follow its last reply,
    or it has none, that is a row of the whole conversation whose loss bounds are null.
    """
    whole = F.struct(F.lit(None).cast("bigint").alias("loss_start"), F.length("formatted").cast("bigint").alias("loss_end"))
    bounds = F.transform("examples", lambda e: F.struct(e["loss_start"].cast("bigint").alias("loss_start"), e["loss_end"].cast("bigint").alias("loss_end")))
    covered = F.coalesce(F.get(bounds, F.size(bounds) - 1)["loss_end"] + len(END) == F.length("formatted"), F.lit(False))
    rows = formatted.select("conv_id", "formatted", F.when(covered, bounds).otherwise(F.concat(bounds, F.array(whole))).alias("rows"))
    each = rows.select("conv_id", "formatted", (F.size("rows") - 1).alias("top"), F.posexplode("rows").alias("example", "e"))
    end = F.when(F.col("e.loss_start").isNull(), F.col("e.loss_end")).otherwise(F.col("e.loss_end") + len(END))
    text = F.substring("formatted", F.lit(1), end.cast("int"))
    return each.select("conv_id", "example", text.alias("text"), F.col("e.loss_start").alias("loss_start"), F.when(F.col("e.loss_start").isNotNull(), F.col("e.loss_end")).alias("loss_end"), (F.col("example") == F.col("top")).alias("last"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the texts of ``expand`` alone: conv_id, formatted (the longest text), turns (role, text) and replies (the unescaped text under each loss mask)."""
    under = F.col("text").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    told = examples.select("conv_id", F.struct("example", F.when(F.col("loss_start").isNotNull(), unescape_text(under)).alias("reply")).alias("reply"), F.when(F.col("last"), F.col("text")).alias("whole"))
    one = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("reply")).alias("replies"), F.collect_list("whole").alias("whole"))
    one = one.select("conv_id", F.get("whole", F.lit(0)).alias("formatted"), F.filter(F.transform("replies", lambda r: r["reply"]), lambda r: r.isNotNull()).alias("replies"))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        inner = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape_text(inner).alias("text"))

    return one.select("conv_id", "formatted", F.transform(F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30), turn).alias("turns"), "replies")
