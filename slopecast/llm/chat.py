"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of typed parts. Every part is visited by its type: text is escaped and kept;
an image, audio clip or document becomes a numbered placeholder, and its reference and the
number of tokens it will expand to are recorded beside the text. All marks start with ``<|``.
Inside texts a backslash becomes two and ``<|`` becomes ``<\\|``, so no text can hold a mark,
and one pass that drops each escaping backslash restores it. A ``|`` that begins a later part of
a turn becomes ``\\|``, too: after a part that ends in ``<`` it would make a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28  # pixels a side of one image token
AUDIO_RATE = 25  # tokens per second of sound
PAGE_TOKENS = 768  # tokens per document page


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def expanded_tokens(p: Column) -> Column:
    """Tokens a part's placeholder stands for; 0 for text and for kinds that are not known."""
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
    return (
        F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def text_parts(text: Column) -> Column:
    """A plain text as a one-part turn."""
    empty = "named_struct('kind', 'text', 'text', '', 'ref', string(null), 'width', int(null), 'height', int(null), 'seconds', double(null), 'pages', int(null))"
    return F.array(F.expr(empty).withField("text", F.coalesce(text, F.lit(""))))


def format_chat(
    turns: DataFrame, parts: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``formatted``, its loss ``spans``, ``attachments`` and ``expanded_tokens``.

    ``spans`` are (start, length) in code points of the escaped bodies of ``trained_role``.
    ``attachments`` lists (turn position, number, kind, ref, tokens) in order of appearance.
    Without ``parts`` each row of ``text`` is a turn of one text part.

    A null text or null list of parts is an empty turn, a null role is empty; rows with equal
    turn numbers (repeated rows included) are ordered by role, then body; conversations with a
    null id are one conversation; an empty table gives no rows; other columns are not read.
    One shuffle by conversation: running totals give each turn its place before the turns meet.
    A conversation becomes one string, so its own size is the bound of a group.
    """
    content = F.coalesce(turns[parts], F.array().cast(f"array<{PART}>")) if parts else text_parts(turns[text])
    visited = F.transform(
        content,
        lambda p, i: F.struct(
            F.when(F.coalesce(p["kind"], F.lit("text")) == "text", F.concat(F.when((i > 0) & p["text"].startswith("|"), F.lit("\\")).otherwise(F.lit("")), escape(F.coalesce(p["text"], F.lit(""))))).alias("escaped"),
            p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"),
        ),
    )
    base = turns.select(
        turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), visited.alias("parts")
    ).withColumns(
        {
            "files": F.filter("parts", lambda p: p["escaped"].isNull()),
            "sort_body": F.array_join(F.transform("parts", lambda p: F.coalesce(p["escaped"], p["ref"], F.lit(""))), ""),
        }
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "sort_body")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    numbered = base.withColumns(
        {"pos": F.row_number().over(order), "files_before": F.coalesce(F.sum(F.size("files")).over(upto), F.lit(0)).cast("int")}
    )
    mark = lambda kind, no: F.concat(F.lit("<|"), escape(kind), F.lit(":"), no.cast("string"), F.lit("|>"))
    file_no = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: p["escaped"].isNull())) + F.col("files_before")
    body = F.when(
        F.size("files") == 0, F.array_join(F.transform("parts", lambda p: p["escaped"]), "")
    ).otherwise(F.array_join(F.transform("parts", lambda p, i: F.coalesce(p["escaped"], mark(p["kind"], file_no(i)))), ""))
    written = numbered.withColumn("body", body).withColumns(
        {
            "head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)),
            "attached": F.transform(
                "files",
                lambda p, i: F.struct(
                    F.col("pos").alias("turn_pos"), (F.col("files_before") + i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                    p["tokens"].alias("tokens"),
                ),
            ),
        }
    )
    size = F.char_length("head") + F.char_length("body") + len(END)
    placed = written.withColumn("at", F.coalesce(F.sum(size).over(upto), F.lit(0)).cast("long"))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")))
    row = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("chunk"), span.alias("span"), "attached")
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    out = rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["chunk"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("spans"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns parsed from ``formatted`` again: ``turns`` array<struct<role, text>>, and ``loss_text`` under the spans."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    parsed = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(x, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text"),
        ),
    )
    under = F.transform("spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumns({"turns": parsed, "loss_text": unescape(F.array_join(under, ""))})


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], conv.schema)
    read = read_back(format_chat(conv.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT
    AS formatted_chars
FROM t GROUP BY conv_id
"""
