"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns the parts of a message, in order, into text: a text part becomes its escaped text; image, audio and
document parts become placeholders, and each adds an attachment record (turn, type, reference, tokens it expands to).

The template is <|turn|>role<|says|>content<|end|> for every turn. Backslashes in roles and texts are doubled and a
backslash is put behind the first character of every control string, so that none can occur and `unescaped` restores the
original. The loss mask holds the code point ranges of the assistant contents.

Turns are formatted in segments of `SEGMENT` turn numbers, which are joined in order, so a very long conversation is put
together from few rows.

Defined cases: null roles and texts are empty; rows of equal turn follow each other by role and text; null turns come first;
a null conversation id is a conversation of its own; an unknown part type is an attachment that expands to no token; a
conversation of one row is formatted like any other; without rows there is no output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import picked, query, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Control strings of this and of other common templates; `<|` stands for all that start with it.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SEGMENT = 64
#: Tokens an attachment expands to: per tile of an image (squares of this side), per second of audio, per page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 448, 256, 25, 1_024

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_part(c: Column) -> Column:
    """Parts of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(PARTS)


def expanded(part: Column) -> Column:
    """Tokens a part that is no text expands to."""
    tiles = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    return F.coalesce(
        F.when(part["type"] == "image", tiles * TILE_TOKENS).when(part["type"] == "audio", F.ceil(part["seconds"] * SECOND_TOKENS))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS), F.lit(0)).cast("long")


def visited(part: Column) -> Column:
    """The text a part leaves in the message."""
    known = part["type"].isin("image", "audio", "document")
    name = F.when(known, part["type"]).otherwise("attachment")
    return F.when(part["type"] == "text", escaped(part["text"])).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))


def formatted(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, mask (ranges start, stop), attachments and their expanded tokens."""
    body = F.array_join(F.transform(F.coalesce(col(parts), F.array().cast(PARTS)), visited), "")
    files = F.transform(
        F.filter(F.coalesce(col(parts), F.array().cast(PARTS)), lambda p: ~p["type"].eqNullSafe("text")),
        lambda p: F.struct(col(turn).cast("long").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    rows = messages.select(
        col(conv).alias("conv_id"), F.floor(col(turn) / SEGMENT).alias("segment"), col(turn).cast("long").alias("turn"),
        escaped(col(role)).alias("role"), body.alias("body"), files.alias("files"))
    one = F.struct("turn", "role", "body", "files")
    # Equal turns are ordered by what was said, not by its escaped form; the plain form is made again after the shuffle.
    told = F.transform(F.collect_list(one), lambda t: F.struct(t["turn"], unescaped(t["role"]).alias("own_role"), unescaped(t["body"]).alias("said"), t["role"], t["body"], t["files"]))
    grouped = rows.groupBy("conv_id", "segment").agg(F.sort_array(told).alias("turns"))
    head = F.length(F.lit(TURN)) + F.length(F.lit(SAYS))
    wrapped = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(SAYS), t["body"], F.lit(END)))
    sized = grouped.select("conv_id", "segment", "turns", F.array_join(wrapped, "").alias("text"))
    # Within a segment the number of turns is small; offsets of turns are sums over the turns before.
    lengths = F.transform("turns", lambda t: F.length(t["role"]) + F.length(t["body"]) + head + F.length(F.lit(END)))
    sized = sized.withColumn("lengths", lengths)
    before = F.transform("turns", lambda t, i: F.aggregate(F.slice(F.col("lengths"), F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    sized = sized.withColumn("before", before)
    window = Window.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum(F.length("text").cast("long")).over(window), F.lit(0)))
    spans = F.filter(
        F.transform("turns", lambda t, i: F.struct(
            t["role"].alias("role"), (F.col("offset") + F.get(F.col("before"), i) + head + F.length(t["role"])).alias("start"), F.length(t["body"]).cast("long").alias("size"))),
        lambda s: s["role"] == learned)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("stop")))
    ready = placed.select("conv_id", "segment", "text", spans.alias("spans"), F.flatten(F.transform("turns", lambda t: t["files"])).alias("files"))
    whole = ready.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "text", "spans", "files"))).alias("s"))
    return whole.select(
        "conv_id", F.array_join(F.col("s.text"), "").alias("formatted"), F.flatten(F.col("s.spans")).alias("mask"), F.flatten(F.col("s.files")).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def turns_of(c: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(c, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, SAYS, 1), F.lit(len(TURN) + 1), F.length(p))).alias("role"), unescaped(F.substring_index(p, SAYS, -1)).alias("text")))


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), "")


_ESC = "replace(coalesce({0}, ''), chr(92), chr(92) || chr(92))"
for _s in CONTROL:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}' || chr(92) || '{_s[1:]}')"

SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, length({_ESC.format("role")}) + length({_ESC.format("text")}) + {len(TURN + SAYS + END)} AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


@query("op10_chat_format", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = picked(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    both = rows.union(extra)
    out = formatted(both.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = out.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
