r"""Chat formatting by prefix-target expansion (operator 7), in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are its prompt, and only its text is
trainable. A conversation that ends otherwise also gives one remainder without a trainable part, so that the output
holds every turn. Turns are written `<turn:ROLE`, newline, TEXT, `</turn>`, newline. In texts a backslash is doubled
and a control string gets a backslash after its `<`, so that no control string is left in them; in roles a newline is
written `\l` too. Unescaping is the exact inverse.

Defined cases: null roles and texts are empty; each row of a null conv_id is a conversation of its own; turns of equal number are ordered
by role and text, repeated rows stay; role `assistant` is matched exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<turn:", "</turn>"
OPEN_ESCAPED, CLOSE_ESCAPED = "<\\turn:", "<\\/turn>"


def _put(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _put(_put(_put(c, "\\", "\\\\"), OPEN, OPEN_ESCAPED), CLOSE, CLOSE_ESCAPED)


def unescape(c: Column) -> Column:
    # Pairs from the left: a backslash stands for the character after it.
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return _put(escape(c), "\n", "\\l")


def unescape_role(c: Column) -> Column:
    # Doubled backslashes are taken out first; what is left of a backslash before l is a newline.
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda x: unescape(_put(x, "\\l", "\n"))), "\\")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE + "\n"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of formatted turns."""
    pieces = F.filter(F.split(formatted, CLOSE + "\n", -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def chat_examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, single, example, target_turn, text, loss_start, loss_len, whole): single numbers the rows of null conv_id, the loss span in code points, none for a remainder; `whole` marks the last example, which holds the whole conversation."""
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("single"),
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id", "single").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id", "single",
        F.transform("ts", lambda t: format_turn(t["role"], t["text"])).alias("pieces"),
        F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.char_length(escape(t["text"])).alias("n"))).alias("marks"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("marks")), lambda i: F.element_at("marks", i)["reply"] | (i == F.size("marks")))
    each = convs.select("conv_id", "single", "pieces", "marks", F.posexplode(ends).alias("example", "i"))
    mark = F.element_at("marks", F.col("i"))
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("i")), "")
    return each.select(
        "conv_id", "single",
        "example",
        F.when(mark["reply"], F.col("i") - 1).alias("target_turn"),
        text.alias("text"),
        F.when(mark["reply"], mark["n"]).otherwise(0).alias("loss_len"),
        (F.col("i") == F.size("pieces")).alias("whole"),
    ).select(
        "conv_id", "single", "example", "target_turn", "text",
        F.when(F.col("target_turn").isNotNull(), F.char_length("text") - len(CLOSE) - 1 - F.col("loss_len")).alias("loss_start"),
        "loss_len", "whole",
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Digests read back from the examples: turns from the one that holds the whole conversation, the loss text from each example's span."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    # Roles and turn numbers of the conversation that tests the escapes.
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select(F.lit(-7).alias("conv_id"), "t.turn", "t.role", said.alias("text"))
    found = chat_examples(turns.unionByName(own))
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_len")))
    each = found.select("conv_id", "single", "example", F.char_length("text").alias("chars"), F.when(F.col("loss_len") > 0, loss).otherwise("").alias("loss"), F.when(F.col("whole"), F.col("text")).alias("formatted"))
    convs = each.groupBy("conv_id", "single").agg(F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.max("formatted").alias("formatted"), F.sum("chars").alias("formatted_chars"))
    convs = convs.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
p AS (
  SELECT *, 15 + length(replace(role, '\', '\\')) + length(replace(replace(replace(text, '\', '\\'), '<turn:', '<\turn:'), '</turn>', '<\/turn>')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS ends FROM t),
q AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR ends)::BIGINT AS formatted_chars
FROM q GROUP BY conv_id
"""
