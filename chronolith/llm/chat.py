"""Chat formatting of typed content parts, in DataFrame expressions alone.

A turn's content is an array of parts; a visitor flattens each in order: text is escaped, an image, audio or document part becomes a
placeholder that numbers its attachment, and the attachment's reference and expanded token count are recorded. Turns are
marked by control strings that no escaped text can hold, so the formatted string can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import let, running, table

#: The template. Escaped text has no "<" and no "[", so none of these, nor [INST], can be said by a text.
TURN, END, ASSISTANT = "<|turn|>", "<|end|>\n", "assistant"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens that a part takes when expanded, by type: a fixed number, and a number for each unit of its size.
EXPANDED = {"image": (2, 1.0), "audio": (2, 0.025), "document": (2, 0.25)}
#: Turns of a conversation that are first put together in one row; hot conversations are so spread over tasks.
CHUNK = 16
PART = "struct<type:string,text:string,ref:string,size:double>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _expanded(part: Column) -> Column:
    out = F.lit(0)
    for kind, (fixed, rate) in EXPANDED.items():
        out = F.when(part.type == kind, F.lit(fixed) + F.ceil(F.coalesce(part["size"], F.lit(0.0)) * rate)).otherwise(out)
    return out.cast("long")


def _visit(part: Column) -> Column:
    """A part as text: its own, escaped, or a placeholder with its type and reference. A part of an unknown type is escaped text."""
    mark = F.concat(F.lit("<|"), part.type, F.lit(":"), escape(F.coalesce(part.ref, F.lit(""))), F.lit("|>"))
    return F.when(part.type.isin(*EXPANDED), mark).otherwise(escape(F.coalesce(part.text, F.lit(""))))


def _starts(texts: Column) -> Column:
    """Where each text of an array begins, were they put together."""
    before = lambda ends: F.transform(ends, lambda x, i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0))
    return let(running(F.transform(texts, F.length), lambda a, b: a + b), before)


def flatten(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys with content (the flattened parts), attachments (array of ordinal, type, ref, start in content, tokens) of turns (keys, parts).

    Null parts and an empty array flatten to an empty content; a null part is skipped; parts of the same reference are attachments of their own.
    """
    parts = turns.select(*keys, F.filter(F.coalesce(F.col("parts"), F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull()).alias("parts"))
    seen = parts.withColumn("said", F.transform("parts", _visit))
    all_parts = F.zip_with("parts", _starts(F.col("said")), lambda p, at: F.struct(p.type.alias("type"), p.ref.alias("ref"), at.alias("start"), _expanded(p).alias("tokens")))
    attached = F.filter(all_parts, lambda a: F.coalesce(a.type.isin(*EXPANDED), F.lit(False)))
    numbered = F.transform(attached, lambda a, i: F.struct((i + 1).alias("ordinal"), a.type.alias("type"), a.ref.alias("ref"), a.start.alias("start"), a.tokens.alias("tokens")))
    return seen.select(*keys, F.array_join("said", "").alias("content"), numbered.alias("attachments"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, loss (array of start, length in code points of the formatted string: what assistants
    say), attachments (with their turn's place), expanded_tokens, from turns (conv_id, turn, role, parts).

    Turns follow by turn, then role and content where turns tie; a null turn comes first. A null role is empty. Rows that
    repeat are turns of their own. Conversations with a null id form one. Long conversations are put together in
    two steps, runs of turns first. An empty table gives no rows.
    """
    flat = flatten(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "parts"), ["conv_id", "turn", "role"])
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    one = flat.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), F.struct("turn", "role", "content", head.alias("head"), "attachments").alias("t"))
    ordered = one.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    piece = lambda t: F.concat(t["head"], t.content, F.lit(END))
    said = ordered.withColumn("said", F.transform("ts", piece)).withColumn("at", F.zip_with("ts", _starts(F.col("said")), lambda t, at: at + F.length(t["head"])))
    spans = F.transform(F.filter(F.arrays_zip("ts", "at"), lambda z: z.ts.role == ASSISTANT), lambda z: F.struct(z["at"].alias("start"), F.length(z.ts.content).alias("length")))
    attached = F.flatten(F.transform(F.arrays_zip("ts", "at"), lambda z: F.transform(z.ts.attachments, lambda a: F.struct(a.type.alias("type"), a.ref.alias("ref"), (z["at"] + a.start).alias("start"), a.tokens.alias("tokens")))))
    chunks = said.select("conv_id", F.struct(F.coalesce("chunk", F.lit(-(1 << 62))).alias("chunk"), F.array_join("said", "").alias("text"), F.size("ts").alias("n"), spans.alias("loss"), attached.alias("attachments")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    moved = whole.withColumn("ahead", _starts(F.transform("cs", lambda c: c.text)))
    shift = lambda name, fields: F.flatten(F.transform(F.arrays_zip("cs", "ahead"), lambda z: F.transform(z.cs[name], lambda x: F.struct((z.ahead + x.start).alias("start"), *[x[f].alias(f) for f in fields]))))
    return moved.select(
        "conv_id",
        F.array_join(F.transform("cs", lambda c: c.text), "").alias("formatted"),
        F.aggregate("cs", F.lit(0).cast("long"), lambda n, c: n + c.n).alias("n_turns"),
        shift("loss", ["length"]).alias("loss"),
        shift("attachments", ["type", "ref", "tokens"]).alias("attachments"),
        F.aggregate("cs", F.lit(0).cast("long"), lambda n, c: n + F.aggregate(c.attachments, F.lit(0).cast("long"), lambda m, a: m + a.tokens)).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string as an array of (role, content): content is unescaped text when it has no placeholders."""
    pieces = F.split(F.substring(formatted, len(TURN) + 1, 2147483647), r"<\|turn\|>", -1)
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n")))
    body = lambda p: F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("content")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s["length"]))), "")


def with_part(rows: DataFrame) -> DataFrame:
    """Turns whose text is their one part."""
    return rows.select("conv_id", "turn", "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size"))).alias("parts"))


def query(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(own)
    chats = format_chats(with_part(rows))
    told = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.content, F.lit("\n"))), "")
    loss = under_loss(F.col("formatted"), F.col("loss"))
    return chats.select("conv_id", F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 17 AS n FROM rows),
done AS (
  SELECT conv_id, count(*) AS n_turns, sum(n)::BIGINT AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM done
"""
