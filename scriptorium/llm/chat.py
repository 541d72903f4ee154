"""Conversations as training text, from typed content parts; DataFrame functions only.

A message is a list of parts.  A text part is written as it is, with control strings escaped; an image,
audio or document part becomes a placeholder numbered in the order of the conversation, its reference goes
to the list of attachments and its tokens to the count.

Template: ``<|turn ROLE|>`` text ``<|end|>`` and a line end.  Inside texts a backslash is written ``\\s`` and a
bar ``\\p``, letter by letter: no bar is left, so no control string can arise, not even over the borders of
parts.  Reading back takes them out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, ref: string, tokens: bigint>"
KINDS = ("image", "audio", "document")
OPEN, CLOSE, END = "<|turn ", "|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def _visit(parts: Column, earlier: Column) -> Column:
    """The text of a message; attachments are numbered behind the ``earlier`` ones of the conversation."""
    files = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i)["kind"].isin(*KINDS))

    def one(p: Column, i: Column) -> Column:
        number = earlier + F.array_position(files, i)
        mark = F.concat(F.lit("<|"), p["kind"], F.lit(" "), number.cast("string"), F.lit("|>"))
        return F.when(p["kind"].isin(*KINDS), mark).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, one), "")).otherwise("")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """``(conv_id, formatted, loss, turn_sizes, attachments, part_tokens)`` of turns with a column of ``PART`` lists.

    ``turn_sizes`` are the characters of every turn in ``formatted``.  ``loss`` has one range ``(skip, length)``
    per turn, ``skip`` counted from the beginning of the turn; its length is 0 where the turn is not trained on.  ``attachments`` are ``(number, kind, ref, tokens)`` in order; ``part_tokens``
    their tokens, which come on top of those of the text.

    - One shuffle by conversation; the turns are put together in its rows.  A conversation is one row, so its
      text must fit one; the number of conversations with equal turns does not matter.
    - Attachments are numbered by the counts of the turns before, for every turn anew, and by their place among the
      files of their message: quadratic in the turns of a conversation with files and in the files of a message.
    - Repeated turns stay; an empty table gives an empty one; texts of any length are taken whole.
    - Null texts and empty lists are empty messages; null roles the empty role; unknown kinds are read as text.
      Turns of equal number are ordered by role and content, null turns come first; null conversations are one
      conversation of their own; other columns are not read.
    """
    p = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), p.alias("parts"))
    df = turns.select(F.col(conv).alias("conv_id"), one.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    files = F.transform("turns", lambda m: F.filter(m["parts"], lambda x: x["kind"].isin(*KINDS)))
    df = df.withColumn("files", files)
    has_files = F.exists("files", lambda x: F.size(x) > 0)
    before = F.when(has_files, F.transform("files", lambda x, i: F.aggregate(F.slice("files", 1, i), F.lit(0), lambda a, y: a + F.size(y))))
    df = df.withColumn("before", before)
    head = lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(CLOSE))
    df = df.withColumn("pieces", F.transform("turns", lambda m, i: F.struct(head(m).alias("head"), _visit(m["parts"], F.coalesce(F.get("before", i), F.lit(0))).alias("text"), m["role"].isin(*loss_roles).alias("loss"))))
    size = lambda x: F.length(x["head"]) + F.length(x["text"]) + F.lit(len(END))
    df = df.withColumn("sizes", F.transform("pieces", size))
    loss = F.transform("pieces", lambda x: F.struct(F.length(x["head"]).cast("bigint").alias("skip"), F.when(x["loss"], F.length(x["text"])).otherwise(0).cast("bigint").alias("length")))
    formatted = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    all_files = F.flatten("files")
    listed = F.transform(all_files, lambda x, i: F.struct((i + 1).alias("number"), x["kind"].alias("kind"), x["ref"].alias("ref"), F.coalesce(x["tokens"], F.lit(0)).alias("tokens")))
    return df.select(
        "conv_id", formatted.alias("formatted"), loss.alias("loss"), F.col("sizes").alias("turn_sizes"), listed.alias("attachments"),
        F.aggregate(all_files, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))).alias("part_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, loss_texts)`` parsed from the formatted text and its loss ranges alone.

    Placeholders come back as they stand in the text.  Repeated rows are read each; an empty table gives an empty one.
    """
    pieces = F.split("formatted", r"<\|end\|>\n")
    df = formatted.withColumn("_p", F.slice(pieces, 1, F.size(pieces) - 1))
    cut_at = lambda x: F.instr(x, CLOSE)
    role = lambda x: unescape(F.substring(x, F.lit(len(OPEN) + 1), cut_at(x) - 1 - len(OPEN)))
    text = lambda x: unescape(F.substring(x, cut_at(x) + len(CLOSE), F.length(x)))
    masked = lambda x, i: unescape(F.substring(x, F.get("loss", i)["skip"].cast("int") + 1, F.get("loss", i)["length"].cast("int")))
    return df.select(
        "conv_id", "formatted",
        F.transform("_p", lambda x: F.struct(role(x).alias("role"), text(x).alias("text"))).alias("turns"),
        F.filter(F.transform("_p", masked), lambda x: x != "").alias("loss_texts"),
    )
