r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its
reply alone trainable. A turn reads ``<turn ROLE>``, a line break, the text, ``</turn>`` and a
line break. Inside roles and texts a backslash is written ``\b``, ``</turn>`` as ``\c``,
``<turn `` as ``\o``, and ``>`` in a role as ``\g``; so no text can end or open a turn, and
reading back is exact.

Defined results: a null text or role counts as empty. Turns are ordered by ``turn`` (null
first), then role and text, so ties have one order and repeated rows are repeated turns. Rows
without ``conv_id`` form one conversation. What follows the last reply, or a conversation
without one, gives one more example with nothing trainable. An empty table gives no example.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
ESCAPES = [("\\", "\\b"), ("</turn>", "\\c"), ("<turn ", "\\o")]


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    # Every backslash opens a code, so codes can be undone one after another; \b comes last.
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def chat_examples(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per example: ``conv_id``, ``n_turns`` in it, ``formatted``, ``loss_start`` and
    ``loss_length`` (code points; null where nothing is trainable), ``last`` (it ends its
    conversation)."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    rows = rows.select(
        "conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id",
        "role",
        F.length("head").alias("head_length"),
        F.length("body").alias("body_length"),
        F.length("segment").alias("segment_length"),
        F.row_number().over(order).cast("long").alias("n_turns"),
        F.lead("role").over(order).isNull().alias("last"),
        F.collect_list("segment").over(so_far).alias("segments"),
    )
    trained = F.col("role") == trained_role
    start = F.length("formatted") - F.col("segment_length") + F.col("head_length")
    return (
        rows.filter(trained | F.col("last"))
        .withColumn("formatted", F.array_join("segments", ""))
        .select(
            "conv_id",
            "n_turns",
            "formatted",
            F.when(trained, start.cast("long")).alias("loss_start"),
            F.when(trained, F.col("body_length").cast("long")).alias("loss_length"),
            "last",
        )
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return unescape(F.coalesce(F.substring(formatted, (start + 1).cast("int"), length.cast("int")), F.lit("")))


def read_turns(formatted: Column) -> Column:
    """Array of ``role``, ``text`` read back from an example."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    split_at = lambda p: F.instr(p, ">")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring(p, F.lit(7), split_at(p) - 7), F.lit("\\g"), F.lit(">"))).alias("role"),
            unescape(F.substring(p, split_at(p) + 2, F.length(p))).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256`` and ``formatted_chars`` (over all its examples)."""
    turns = F.when(F.col("last"), read_turns(F.col("formatted")))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "n_turns",
        F.when(F.col("last"), F.size(turns).cast("long")).alias("found"),
        F.when(F.col("last"), F.sha2(told, 256)).alias("told"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("found").alias("n_turns"),
            F.max("told").alias("turns_sha256"),
            F.array_sort(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
