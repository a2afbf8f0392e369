"""Chat formatting with typed content parts.

A message holds parts of type text, image, audio or document. A visitor, one Column
expression for each type, flattens the parts in order: texts are escaped, attachments
become placeholders, and each attachment is recorded with its reference and the number of
tokens it will expand to. Turns are laid out between markers; escaping is reversible and
no control string of this or another template survives inside a text.

Defined results: a null text is empty; a null role is an empty role; a null or empty part
list is an empty text; unknown part types raise; turns with equal numbers are ordered by
role, then text; repeated rows are turns of their own; an empty table gives no rows.
Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, END = "<|turn|>", "<|end|>\n"
#: Replaced in this order and put back in the opposite one. Without < and [ no control string can be spelled.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _image_tokens(p: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(336)) / F.lit(14.0))
    return side(p["width"]) * side(p["height"])


#: Type -> (what stands in the text, tokens it expands to). Texts expand to no attachment tokens.
VISITORS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "text": (lambda p: escape(F.coalesce(p["text"], F.lit(""))), lambda p: F.lit(0)),
    "image": (lambda p: F.lit("<|image|>"), _image_tokens),
    "audio": (lambda p: F.lit("<|audio|>"), lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25)),
    "document": (lambda p: F.lit("<|document|>"), lambda p: F.coalesce(p["pages"], F.lit(1)) * 512),
}


def _visit(p: Column, which: int) -> Column:
    case = None
    for kind, fns in VISITORS.items():
        case = (F.when if case is None else case.when)(p["type"] == kind, fns[which](p))
    return case.otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(p["type"], F.lit("null")))))


def text_parts(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role and parts from rows with a plain text: each becomes one text part."""
    part = F.from_json(F.lit('{"type": "text"}'), PART)
    return messages.select("conv_id", "turn", "role", F.array(part.withField("text", F.coalesce(F.col("text"), F.lit("")))).alias("parts"))


def flatten(messages: DataFrame) -> DataFrame:
    """One row a message: role, body (escaped text and placeholders, in order) and attachments (type, ref, tokens, part)."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    step = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    seen = F.filter(
        F.transform("parts", lambda p, i: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _visit(p, 1).cast("long").alias("tokens"), i.alias("part"))),
        lambda a: a["type"] != "text",
    )
    return step.select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: _visit(p, 0)), "").alias("body"), seen.alias("attachments"))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: formatted, mask (start and length, in code points, of each text under the loss), attachments, n_expanded.

    A conversation is one training example, so its turns meet in one row by definition.
    """
    flat = flatten(messages)
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    pieces = flat.select(
        "conv_id", "turn", "role", "body", "attachments",
        F.concat(head, F.col("body"), F.lit(END)).alias("piece"), F.length(head).alias("skip"), F.length("body").alias("n_body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = pieces.select(
        "conv_id", "piece", "attachments", F.col("role").isin(*loss_roles).alias("loss"), "n_body",
        F.row_number().over(order).alias("k"),
        (F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("skip")).alias("start"),
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "piece", "loss", "start", "n_body", "attachments"))).alias("t"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["n_body"].alias("length"))).alias("mask"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["k"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, from the formatted string alone."""
    pieces = F.slice(F.split("formatted", r"\Q" + TURN + r"\E", -1), F.lit(2), F.size(F.split("formatted", r"\Q" + TURN + r"\E", -1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    under = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"])))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), "n_expanded")


_PROBE = "</s>[INST] ok [/INST]"


def with_probe(messages: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts spell another template's control strings."""
    probe = messages.sparkSession.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_PROBE}'), (-1L, 1L, 'assistant', '{_PROBE}') AS t(conv_id, turn, role, text)")
    return messages.select("conv_id", "turn", "role", "text").unionByName(probe)


def op2_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe: formatted, then read back from the formatted strings."""
    back = read_back(format_chats(text_parts(with_probe(table(spark, sf_dir, "conversations")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
OP2_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
e AS (SELECT *, {_ESC.format("text")} body, replace({_ESC.format("role")}, chr(10), '&nl;') r FROM m),
g AS (
  SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body) said,
    coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '') loss,
    sum(length(r) + length(body) + {len(TURN) + 1 + len(END)}) n
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT n_turns, sha256(said) turns_sha256, length(loss)::BIGINT loss_chars, sha256(loss) loss_sha256, n::BIGINT formatted_chars FROM g
"""
