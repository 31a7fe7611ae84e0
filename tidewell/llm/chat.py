"""Chat formatting with Spark expressions only.

Template: each block of adjacent turns of one role is `### role:` and a newline, the turns' texts joined by
`<turn/>`, then `</turn>` and a newline. Inside texts and roles the control strings and the
escape character are replaced by backslash codes, so that the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, NEXT, END = "### ", ":\n", "<turn/>", "</turn>\n"
#: Control string -> code. The backslash comes first when escaping and last when unescaping.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("<turn/>", "\\n"))
ROLE_CODES = (*CODES, ("\n", "\\l"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted (string), loss_spans (array of start and length in code points of formatted, start from 0).

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, null turns last, ties by
    role and text. A null text or role is empty. The loss mask covers each text of loss_role
    as it stands (escaped) in formatted, not its marks. A null conv_id is a conversation of its own. Repeated
    turns stand as often as they are given, texts of any length whole. No rows, no conversations.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    merged = sorted_.select("conv_id", "turns", heads.alias("heads")).select(
        "conv_id",
        F.transform(
            "heads",
            lambda h, k: F.struct(
                at(h).alias("role"),
                F.transform(F.slice("turns", h + 1, F.coalesce(F.get("heads", k + 1), F.size("turns")) - h), lambda t: escape(t["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )
    head = lambda b: F.concat(F.lit(HEAD), escape(b["role"], ROLE_CODES), F.lit(HEAD_END))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(j == 0, F.length(head(b))).otherwise(F.lit(len(NEXT))).alias("before"),
                    F.length(t).alias("own"),
                    F.when(j == F.size(b["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("after"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))
    begin = F.struct(F.lit(0).alias("at"), F.filter(F.array(span), lambda _: F.lit(False)).alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + p["before"] + p["own"] + p["after"]).alias("at"),
        F.when(p["loss"], F.array_append(a["spans"], F.struct((a["at"] + p["before"]).alias("start"), p["own"].alias("length")))).otherwise(a["spans"]).alias("spans"),
    )
    return merged.select("conv_id", formatted.alias("formatted"), F.aggregate(pieces, begin, step, lambda a: a["spans"]).alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    head_end = lambda b: F.locate(HEAD_END, b)
    role = lambda b: unescape(F.substr(b, F.lit(len(HEAD) + 1), head_end(b) - len(HEAD) - 1), ROLE_CODES)
    texts = lambda b: F.split(F.substr(b, head_end(b) + len(HEAD_END)), NEXT, -1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
