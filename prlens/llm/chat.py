"""Operator 5: event-sourced chat reconstruction and formatting (native).

A conversation log is a table of events (conv_id, msg, seq, kind, role, text):
``open`` names the speaker, ``delta`` appends streamed text, ``edit`` replaces
what the message holds, ``regenerate`` discards it so that later deltas write
it anew.  Events fold into messages per (conv_id, msg) in the order of seq, then
messages meet per conversation: only folded messages reach the second shuffle.
A conversation is one training record, so it must fit in a row.

Template: ``<|start|>role<|message|>text<|end|>`` for each turn.  Inside roles
and texts every ``<``, any backslashes, ``|`` gains one backslash before the
bar; reading removes one.  So no control string can occur inside a text and
every text comes back exactly.  The loss mask has an entry for each turn: null,
or start and length (characters of the escaped form) inside that turn.

Defined results: null role or text is empty; a null turn comes first, a null
conv_id is a conversation of its own; turns with the same number are ordered by
role, then text, and all stay; a redelivered event (equal in every column)
counts once; an event without seq applies first; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.llm.common import stored, table
from prlens.llm.registry import register

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"

#: Characters in a streamed delta of a log made from finished rows.
DELTA_CHARS = 512


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def to_events(conversations: DataFrame) -> DataFrame:
    """The log of finished rows (conv_id, turn, role, text): each row opens a
    message and streams its text in deltas."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    msg = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    parts = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)),
                        lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")))
    return (rows.withColumn("msg", msg)
            .select("conv_id", "msg", "role", F.posexplode(F.concat(opened, parts)).alias("seq", "e"))
            .select("conv_id", "msg", F.col("seq").cast("long").alias("seq"), "e.kind",
                    F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of a log."""
    e = events.withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long")))
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    folded = e.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_set(F.struct("seq", "kind", "text"))).alias("log"), reset.alias("reset"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    live = F.filter("log", lambda x: x["kind"].isin("delta", "edit") & (
        F.col("reset").isNull() | (x["seq"] >= F.col("reset"))))
    return folded.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"),
                         F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of folded messages."""
    turns = messages.select("conv_id", "msg", (F.col("role") == "assistant").alias("learn"),
                            escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    record = F.struct(
        "msg", F.concat(F.lit(START), "role", F.lit(MESSAGE), "text", F.lit(END)).alias("turn"),
        F.when(F.col("learn"), F.struct(
            (F.char_length("role") + len(START) + len(MESSAGE)).alias("start"),
            F.char_length("text").alias("length"))).alias("loss"))
    grouped = turns.select("conv_id", record.alias("r")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("r")).alias("rs"))
    return grouped.select("conv_id", F.array_join(F.col("rs.turn"), "").alias("formatted"),
                          F.col("rs.loss").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, loss_text) parsed from formatted records."""
    pieces = formatted.select("conv_id", "formatted", "loss_mask", F.filter(
        F.split("formatted", r"(?<=<\|end\|>)", -1), lambda x: x != "").alias("turns"))
    halves = lambda x: F.split(x, r"<\|message\|>", 2)
    return pieces.select(
        "conv_id", "formatted",
        F.transform("turns", lambda x: unescape(F.substr(halves(x)[0], F.lit(len(START) + 1)))).alias("roles"),
        F.transform("turns", lambda x: unescape(F.regexp_replace(halves(x)[1], r"<\|end\|>$", ""))).alias("texts"),
        F.array_join(F.zip_with("turns", "loss_mask", lambda x, m: F.when(
            m.isNotNull(), unescape(F.substring(x, m["start"] + 1, m["length"])))), "").alias("loss_text"))


#: The conversation whose texts look like control strings.
TRAP = r"\### Assistant: </turn> ok"


@register("op5_chat", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'))
              + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(n + 27) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def q_chat(spark, sf_dir):
    """Operator 5: all conversations and the trap, as a log, folded, rendered, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(TRAP).alias("text"))
    out = stored(render(fold(to_events(rows.unionByName(trap)))), "chat")
    back = read_back(out)
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return back.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
