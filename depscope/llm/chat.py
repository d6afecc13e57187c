"""Chat formatting: typed content parts become one marked string per conversation, with a loss mask.

A visitor walks the parts of each turn in order. Text parts go in escaped; image, audio and
document parts become a placeholder that states how many tokens the attachment expands to, and
their references are recorded beside the string. All of it is DataFrame functions.

The template of one turn is TURN role TEXT body END. Roles and bodies are escaped so that no
control string can occur inside them: the escape character is doubled, and an escape pair goes
behind the first character of every control string. Reading replaces both in one pass, so the
escape can always be undone. A mark that stands unescaped was therefore written by the template: reading back tells a
placeholder from a text that spells one, and gives typed parts. The loss mask has a span per trained text part, so placeholders are never trained on.

Defined results: null text is empty; null roles are empty; null types are text; unknown types
give a placeholder of one token; turns that share a number are ordered by role, then body; a null
turn comes first; rows of a null conversation form one conversation. A conversation is one output
value, so it must fit in a row; only its finished turns are gathered, by partial aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The marks of this template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ATTACH, CLOSE = "<|attach|>", "<|/attach|>"
MARKS = (TURN, TEXT, END, ATTACH, CLOSE)
# Control strings of other templates, which must not be spoken by a text either.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CONTROLS = MARKS + FOREIGN

# Tokens that attachments expand to: image patches of 28 x 28, audio frames per second, a document's pages.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def _starts(controls: tuple[str, ...]) -> str:
    """Pattern of a control string's first character, standing before the rest of it."""
    return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(controls))


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    r"""`\` becomes `\\`, and `\.` goes behind the first character of each control string."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_starts(controls)})", r"$1\\.")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def expanded_tokens(part: Column) -> Column:
    """How many tokens an attachment takes: patches, frames or pages; at least one."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    frames = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    pages = F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS
    kind = part["type"]
    count = F.when(kind == "image", patches).when(kind == "audio", frames).when(kind == "document", pages).otherwise(1)
    return F.greatest(count.cast("int"), F.lit(1))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visit(part: Column) -> Column:
    """One part as it stands in a body: escaped text, or a placeholder."""
    held = F.concat(
        F.lit(ATTACH), escape(part["type"]), F.lit("|"), expanded_tokens(part).cast("string"), F.lit(CLOSE)
    )
    return F.when(_is_text(part), escape(part["text"])).otherwise(held)


def format_turns(turns: DataFrame, conv: str, turn: str, role: str, parts: str) -> DataFrame:
    """(conv, turn, role, body, spans, attachments): every turn by itself, where it lies; `spans` are its text parts in the body."""
    listed = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    attachments = F.filter(
        F.transform(listed, lambda p, i: F.struct(
            i.alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: F.coalesce(a["kind"], F.lit("text")) != "text",
    )
    none = F.array().cast("array<struct<start:int,length:int>>")
    walk = F.aggregate(
        F.transform(listed, lambda p: F.struct(F.length(_visit(p)).alias("length"), _is_text(p).alias("text"))),
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda seen, p: F.struct(
            (seen["at"] + p["length"]).alias("at"),
            F.when(p["text"] & (p["length"] > 0), F.concat(seen["spans"], F.array(F.struct(seen["at"].alias("start"), p["length"].alias("length")))))
            .otherwise(seen["spans"]).alias("spans")))
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.array_join(F.transform(listed, _visit), "").alias("body"), walk["spans"].alias("spans"), attachments.alias("attachments"),
    )


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                         trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss, attachments.

    `loss` lists (turn, start, length) in code points, a row per trained text part that is not empty: the turn's number from 0, where
    the text begins behind that turn's mark, and its length. Attachments carry their turn and part.
    """
    done = format_turns(turns, conv, turn, role, parts)
    kept = F.struct("turn", "role", "body", "spans", "attachments")
    gathered = done.groupBy("conv").agg(F.array_sort(F.collect_list(kept)).alias("turns"))
    marked = F.transform(
        "turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), t["body"], F.lit(END))
    )
    spans = F.flatten(F.transform("turns", lambda t, i: F.transform(
        F.filter(t["spans"], lambda _: t["role"].isin(*trained)), lambda s: F.struct(
            i.alias("turn"), (F.length(escape(t["role"])) + len(TEXT) + s["start"]).alias("start"), s["length"].alias("length")))))
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(
        t["attachments"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select(
        "conv", F.size("turns").cast("long").alias("n_turns"), F.array_join(marked, "").alias("formatted"),
        spans.alias("loss"), attached.alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, re.escape(TURN)), F.lit(2), F.greatest(F.size(F.split(formatted, re.escape(TURN))) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
    ))


def read_parts(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, parts), with parts (type, text, tokens) in order.

    Text parts that stood side by side come back as one, and empty ones not at all.
    """
    turns = F.slice(F.split(formatted, re.escape(TURN)), 2, 1 << 30)
    null = lambda kind: F.lit(None).cast(kind)
    words = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), null("int").alias("tokens"))
    held = lambda x: F.struct(
        unescape(F.regexp_extract(x, r"(?s)^(.*)\|(\d+)$", 1)).alias("type"), null("string").alias("text"), F.regexp_extract(x, r"(?s)^(.*)\|(\d+)$", 2).cast("int").alias("tokens"))

    def parts(body):
        # Each piece behind an opening mark is an attachment, a closing mark, and text.
        pieces = F.split(body, re.escape(ATTACH))
        first = F.array(words(F.get(pieces, F.lit(0))))
        rest = F.transform(F.slice(pieces, 2, 1 << 30), lambda x: F.array(
            held(F.substring_index(x, CLOSE, 1)), words(F.substring_index(x, CLOSE, -1))))
        return F.filter(F.concat(first, F.flatten(rest)), lambda p: ~(F.coalesce(p["text"], F.lit("x")) == ""))

    return F.transform(turns, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        parts(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("parts")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    pieces = F.split(formatted, re.escape(TURN))
    return F.array_join(F.transform(
        loss, lambda s: unescape(F.substring(F.get(pieces, s["turn"] + 1), s["start"] + 1, s["length"]))), "")


def text_part(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"),
        null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the output."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_conversations(rows.unionByName(extra).withColumn("parts", text_part(F.col("text"))))
    back = done.withColumn("read", read_back(F.col("formatted"))).withColumn("masked", under_loss(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )


def _sql_escaped(text: str) -> str:
    done = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        done = f"replace({done}, '{c}', '{c[0]}\\.{c[1:]}')"
    return done


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments
FROM turns GROUP BY conv_id
"""
