"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted.  Adjacent turns of
one role are merged under one heading; every turn still ends with its own
marker, so the single turns can be read back:

    ### user: first</turn>second</turn>### assistant: answer</turn>

Inside texts a backslash, ``###`` and ``</turn>`` are escaped with a backslash,
in roles also the colon.  No control string is left in an escaped text, so the
output is cut at the markers and unescaped to get exactly what went in.
``loss_spans`` lists the assistant texts (code points, end exclusive) of the
formatted string; markers are outside.

Nulls: a null text or role is empty, a null ``turn`` sorts first, a null
``conv_id`` is a conversation of its own.  Equal turn numbers are ordered by
role, then text.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import let, running_sums, table

HEAD, HEAD_END, END = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit(END), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; other columns of ``turns`` are not read.

    Null texts and roles are empty, null turns come first, repeated rows are turns
    of their own, null ids are one conversation, empty tables give no rows.  A
    conversation is one row, whatever its length; the work grows with its turns.
    """
    struct = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(struct)).alias("turns"))

    def piece(t: Column, before: Column) -> Column:
        # There is no role before the first turn, which then opens a block.
        opens = ~before.eqNullSafe(t["role"])
        head = F.when(opens, F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(HEAD_END))).otherwise("")
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))

    def pieces_of(turns: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(turns["role"], 1, F.size(turns) - 1))
        return F.zip_with(turns, before, piece)

    pieces = sorted_turns.select("conv_id", let(F.col("turns"), pieces_of).alias("pieces"))
    starts = running_sums(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)))

    def span(p: Column, at: Column) -> Column:
        start = at + F.length(p["head"])
        return F.when(p["loss"], F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))

    # The last of the sums has no piece and so no span.
    spans = F.filter(F.zip_with("pieces", starts, span), lambda s: s.isNotNull())
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return pieces.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, col: str = "formatted") -> DataFrame:
    """Adds ``turns``, an array of (role, text), parsed from the formatted string alone."""
    cut = F.split(F.col(col), END)
    parts = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    heading = r"(?s)^### ((?:[^\\:]|\\.)*): "
    opened = F.transform(parts, lambda p: F.when(p.startswith(HEAD), unescape(F.regexp_extract(p, heading, 1))))
    # The heading that holds for a part is the last one up to it: the n-th of those there are.
    headings = F.filter(opened, lambda role: role.isNotNull())
    n = running_sums(F.transform(opened, lambda role: role.isNotNull().cast("int")))
    places = F.slice(n, 2, F.size(parts))
    roles = let(F.struct(headings.alias("all"), places.alias("n")), lambda s: F.transform(s["n"], lambda k: F.get(s["all"], k - 1)))
    texts = F.transform(parts, lambda p: unescape(F.when(p.startswith(HEAD), F.regexp_replace(p, heading, "")).otherwise(p)))
    return formatted.withColumn("turns", F.arrays_zip(roles.alias("role"), texts.alias("text")))


# Spans that are cut out of one stretch of the string: finding a place in it takes its length.
SPANS = 64


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, taken from the formatted string by its spans, which are in order."""

    def cut(text: Column, start: Column, end: Column) -> Column:
        return F.substring(text, start + 1, end - start)

    def stretch(own: Column, whole: Column) -> Column:
        first = F.get(own, F.lit(0))["start"]
        text = cut(whole, first, F.element_at(own, -1)["end"])
        return let(text, lambda t: F.array_join(F.transform(own, lambda s: unescape(cut(t, s["start"] - first, s["end"] - first))), ""))

    def whole_text(both: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(both["spans"]) - 1) / SPANS).cast("int"))
        numbers = F.filter(numbers, lambda b: (b >= 0) & (b * SPANS < F.size(both["spans"])))
        parts = F.transform(numbers, lambda b: let(F.slice(both["spans"], b * SPANS + 1, SPANS), lambda own: stretch(own, both["text"])))
        return F.array_join(parts, "")

    return let(F.struct(formatted.alias("text"), spans.alias("spans")), whole_text)


# Fixed values of the contract: a conversation made of control strings.
PLANTED_ID = -7
PLANTED_TEXT = r"\### Assistant: </turn> ok"


def with_planted(turns: DataFrame) -> DataFrame:
    planted = turns.sparkSession.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(planted)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    out = read_back(format_conversations(with_planted(table(spark, sf_dir, "conversations"))))
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e as (
  select *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>')) as body,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:')) as head,
    coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) <> role, true) as opens
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(body + 7 + case when opens then head + 6 else 0 end)::bigint as formatted_chars
from e group by conv_id
"""
