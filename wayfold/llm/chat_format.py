"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, units). A visitor, one expression per kind, flattens the parts
into one string: text parts are escaped, image, audio and document parts become ordered placeholders, and each
attachment is recorded with its reference, its ordinal in the conversation and the tokens that its placeholder expands
to. The template marks turns; control strings inside texts are escaped reversibly, so that the formatted string can be
read back.

Defined results: a null text or role is empty; a null part or a part of unknown kind gives nothing; turns are ordered
by turn, then role, then content, so that repeated rows and ties have one order; rows with a null conversation id form
one conversation; an empty table gives an empty result; other columns of the input are ignored. A conversation is one
row of the result, so its turns meet in one row: together they have to stay under the 2 GB that a row may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks of the template. No mark holds the first character of another but at its own start, so escaping one never makes another.
TURN, HEAD_END, TURN_END = "<|turn|>", "\n", "<|end|>\n"
#: Openings that must not stand in a text; each is broken by a backslash after its first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: What stands for a line feed in a role, which a line feed closes; no escaped text holds it, for its backslash is a lone one.
ROLE_BREAK = "<\\n>"
#: Tokens for one unit of an attachment: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 85, "audio": 25, "document": 600}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """Double the backslashes, then break control strings: the only lone backslashes are then the inserted ones."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark in CONTROL:
        out = F.replace(out, F.lit(f"{mark[0]}\\{mark[1:]}"), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(HEAD_END), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit(HEAD_END)))


def text_parts(text: str) -> Column:
    """The content of a turn that has one plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(f"array<{PART}>")


def visit(part: Column) -> Column:
    """The flat form of one part; attachments give a placeholder that names kind and expanded tokens."""
    out = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind in UNIT_TOKENS:
        out = out.when(part["kind"] == kind, F.concat(F.lit(f"<|{kind}:"), tokens_of(part).cast("string"), F.lit("|>")))
    return F.coalesce(out, F.lit(""))


def tokens_of(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, unit in UNIT_TOKENS.items():
        out = F.when(part["kind"] == kind, F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)) * F.lit(unit)).otherwise(out)
    return out


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*UNIT_TOKENS), F.lit(False))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask (per turn: length of head, body and tail, and whether the body
    is under the loss), attachments (turn, ordinal, kind, ref, tokens in order of appearance), expanded_tokens.

    Each turn is flattened before the shuffle; the only aggregation gathers the turns of a conversation.
    """
    one = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.array_join(F.transform(F.col(parts), visit), "").alias("body"),
        F.transform(F.filter(F.col(parts), is_attachment), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens_of(p).alias("tokens"))).alias("attached"),
    )
    whole = one.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "body", "attached")).alias("t"))
    # Ties go by the plain content, which an escape may order differently.
    plain = F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), unescape(t["body"]).alias("plain"), t["body"].alias("body"), t["attached"].alias("attached")))
    whole = whole.select("conv_id", F.array_sort(plain).alias("t"))
    head = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit(HEAD_END))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(head(t), F.coalesce(t["body"], F.lit("")), F.lit(TURN_END))), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(F.char_length(head(t)).alias("head"), F.char_length(F.coalesce(t["body"], F.lit(""))).alias("body"), F.lit(len(TURN_END)).alias("tail"), (t["role"] == trained).alias("loss"))).alias("mask"),
        F.flatten(F.transform("t", lambda t, i: F.transform(F.coalesce(t["attached"], F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")), lambda a, k: F.struct(i.alias("turn_no"), k.alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns as the formatted string alone tells them, and the text under the loss mask.

    Adds turns (role, text), loss_text. The string is cut at the turn marks, so the work grows with its length.
    """
    cut = F.expr(f"slice(split(formatted, '\\\\Q{TURN}\\\\E', -1), 2, 2147483647)")
    chunk = formatted.withColumn("chunks", cut)
    ended = len(TURN_END)
    parsed = F.transform(
        "chunks",
        lambda c: F.struct(
            unescape_role(F.substring_index(c, HEAD_END, 1)).alias("role"),
            unescape(F.substr(c, F.char_length(F.substring_index(c, HEAD_END, 1)) + F.lit(2), F.char_length(c) - F.char_length(F.substring_index(c, HEAD_END, 1)) - F.lit(1 + ended))).alias("text"),
        ),
    )
    masked = F.zip_with("chunks", "mask", lambda c, m: F.when(m["loss"], unescape(F.substr(c, m["head"] - F.lit(len(TURN)) + F.lit(1), m["body"]))).otherwise(F.lit("")))
    return chunk.withColumn("turns", parsed).withColumn("loss_text", F.array_join(masked, "")).drop("chunks")


#: A conversation whose texts hold marks of common templates.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back; digests per conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_chat(rows.unionByName(probe).withColumn("parts", text_parts("text"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(TURN) + len(HEAD_END) + len(TURN_END)} + length({_sql_escape('role')}) + {len(ROLE_BREAK) - 1} * (length(role) - length(replace(role, chr(10), ''))) + length({_sql_escape('text')})) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

QUERIES = {"op5_chat_format": op5_chat_format}
ORACLE = {"op5_chat_format": SQL}
