"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged where neighbours have one
role, and joined into one string:

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n ...

Inside texts and roles every backslash is doubled and every ``<|`` becomes ``<\\|``, so no text can
hold a control string, and `read_back` restores what was put in. Merged turns stay apart by
``<|im_sep|>``.

Defined cases: a null text or role is empty; rows of one conversation with equal turn numbers
stand in the order of role and text; a null turn comes first; a null conversation id is an id like
any other; a repeated row is a turn of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _merged(turns: Column) -> Column:
    """array<struct<role, texts array<string>>>: neighbours with one role become one message."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    return F.aggregate(
        turns,
        none,
        lambda done, t: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["role"] == t["role"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(t["role"].alias("role"), F.concat(F.element_at(done, -1)["texts"], F.array(t["text"])).alias("texts"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))),
    )


def _pieces(messages: Column, trained: str) -> Column:
    """array<struct<s string, loss boolean>> whose strings in order are the formatted conversation."""

    def of(m: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(m["role"], F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        texts = F.transform(m["texts"], lambda t: F.array(F.struct(t.alias("s"), (m["role"] == F.lit(trained)).alias("loss")), F.struct(F.lit(SEP).alias("s"), F.lit(False).alias("loss"))))
        flat = F.flatten(texts)
        return F.concat(F.array(F.struct(head.alias("s"), F.lit(False).alias("loss"))), F.slice(flat, 1, F.size(flat) - 1), F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))))

    return F.flatten(F.transform(messages, of))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, n_messages and `loss`, the [start, end)
    code points of the formatted string on which a model trains (the texts of `trained_role`)."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = grouped.select("conv_id", _merged(F.col("turns")).alias("m")).select("conv_id", F.size("m").cast("long").alias("n_messages"), _pieces(F.col("m"), trained_role).alias("p"))
    at = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["s"])).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.char_length(x["s"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return pieces.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), "n_messages", at.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted string holds, unescaped and unmerged."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda m: m != "")

    def turns(m: Column) -> Column:
        inner = F.substr(m, F.lit(len(START) + 1))
        at = F.instr(inner, "\n")
        role = unescape(F.replace(F.substr(inner, F.lit(1), at - 1), F.lit(NEWLINE), F.lit("\n")))
        return F.transform(F.split(F.substr(inner, at + 1), r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """array<string>: what stands under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
