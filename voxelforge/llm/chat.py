"""Chat formatting in Spark expressions only.

The turn structs of a conversation are collected and sorted, neighbours of the same role are merged into
one block, and pieces are concatenated.  A block is ``<|turn|>role<|text|>text<|end|>``; texts of merged
turns are separated by ``<|next|>``, so the turns can be read back.  In roles and texts ``&`` becomes
``&amp;`` and ``<`` becomes ``&lt;``, so no control string can occur in them, and unescaping restores
every text.  The loss mask covers exactly the assistant's texts.

Edge cases: a null text or role is empty; a null turn sorts first; rows that repeat a turn are kept, in
order of role and text; extra columns are ignored; an empty table gives an empty result; a conversation
with no assistant has an empty mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> in code points of ``formatted``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id"), F.struct(F.col("turn").alias("turn"), escape(role).alias("role"), escape(text).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def head(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("ts"), i - 1)["role"] == x["role"])
        start = F.when(i > 0, F.lit(END)).otherwise(F.lit(""))
        return F.when(same, F.lit(NEXT)).otherwise(F.concat(start, F.lit(TURN), x["role"], F.lit(TEXT)))

    pieces = chats.select("conv_id", F.transform("ts", lambda x, i: F.struct(head(x, i).alias("head"), x["role"].alias("role"), x["text"].alias("text"))).alias("ps"))
    sized = pieces.select("conv_id", "ps", F.transform("ps", lambda p: F.length(p["head"]) + F.length(p["text"])).alias("n"))
    ends = F.aggregate("n", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    placed = sized.select("conv_id", "ps", ends.alias("at"))
    spans = F.transform("ps", lambda p, i: F.struct((F.get(F.col("at"), i) + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"), p["role"].alias("role")))
    kept = F.transform(F.filter(spans, lambda s: s["role"] == escape(F.lit(trained_role))), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    body = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    return placed.select("conv_id", body.alias("formatted"), kept.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns, read back from a formatted conversation."""

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, TEXT, 1))
        body = F.substring(block, F.length(F.substring_index(block, TEXT, 1)) + len(TEXT) + 1, F.length(block))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.replace(formatted, F.lit(END), F.lit("")), r"<\|turn\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{odd}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    chats = format_chats(own.unionByName(more))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0,'user'),(1,'assistant')) v(t, r)),
e AS (SELECT *, replace(replace(role,'&','&amp;'),'<','&lt;') AS er, replace(replace(text,'&','&amp;'),'<','&lt;') AS et,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role='assistant' THEN length(text) END),0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN text END, '' ORDER BY turn, role, text),'')) AS loss_sha256,
  sum(length(et) + CASE WHEN before = role THEN 8 ELSE 8 + 8 + 7 + length(er) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
