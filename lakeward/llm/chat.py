"""Chat formatting with typed content parts, in built-in functions only.

A turn's content is an array of parts. A visitor over the part type turns text into escaped text and
every image, audio or document part into a numbered placeholder, and records what it stands for.
Turns are marked; control strings inside texts are escaped, so formatting can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: an image patch of so many pixels each way, a second, a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 256
_ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&s"))


def escape(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A single text part."""
    null = F.lit(None)
    fields = {"type": F.lit("text"), "text": text, "ref": null, "width": null, "height": null, "seconds": null, "pages": null}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(PART_TYPE)


def expanded_tokens(part: Column) -> Column:
    """How many tokens a part that is no text stands for; nothing known counts as one."""
    patches = lambda side: F.ceil(F.coalesce(side, F.lit(PATCH)) / PATCH)
    return (
        F.when(part["type"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))) * PER_PAGE)
        .otherwise(F.lit(1))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(part: Column, ordinal: Column) -> Column:
    """What stands in the output for a part; `ordinal` numbers the attachments of a conversation."""
    marker = F.concat(F.lit("<|"), escape(part["type"]), F.lit("_"), ordinal.cast("string"), F.lit("|>"))
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(marker)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: n_turns, formatted, loss_spans (start, length: code points), attachments.

    `rows` has conv_id, turn, role and parts (an array of PART_TYPE). Turns are ordered by turn, ties by
    role and content; repeated rows are turns of their own. A null role or text is empty, null parts
    are no content, a null conv_id is one conversation; other columns are not read. An empty table
    gives no rows. A conversation becomes one row, so its turns meet in one task; no other rows do.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>"))
    seen = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    seen = seen.withColumn("_key", F.to_json("parts")).withColumn("_files", F.filter("parts", lambda p: ~is_text(p)))
    seen = seen.withColumn("_first", F.coalesce(F.sum(F.size("_files")).over(before), F.lit(0)))
    # The ordinal of an attachment: those before the turn, and those before it in the turn.
    number = lambda i: F.col("_first") + F.size(F.filter(F.slice(F.col("parts"), 1, i), lambda p: ~is_text(p)))
    body = F.array_join(F.transform("parts", lambda p, i: visit(p, number(i))), "")
    seen = seen.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("_body", body)
    seen = seen.withColumn("_segment", F.concat("_head", "_body", F.lit(END)))
    seen = seen.withColumn("_start", F.coalesce(F.sum(F.length("_segment").cast("long")).over(before), F.lit(0)))
    files = F.transform(
        "_files",
        lambda p, i: F.struct((F.col("_first") + i).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    span = F.struct((F.col("_start") + F.length("_head") + 1).alias("start"), F.length("_body").cast("long").alias("length"))
    seen = seen.select("conv_id", F.row_number().over(order).alias("at"), "_segment", F.when(F.col("role") == loss_role, span).alias("span"), files.alias("files"))
    turns = F.sort_array(F.collect_list(F.struct("at", "_segment", "span", "files")))
    grouped = seen.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["_segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["files"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text); placeholders stay as they are."""
    pieces = F.split(formatted, "<\\|turn\\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    rows = rows.unionByName(extra).select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))
    done = format_conversations(rows).withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED_SQL = "replace(replace(replace({0}, '&', '&a'), '<', '&l'), '[', '&s')"
ORACLE_OP7 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END)} + length({_ESCAPED_SQL.format('role')}) + length({_ESCAPED_SQL.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
