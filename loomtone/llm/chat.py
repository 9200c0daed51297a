r"""Chat formatting with a grammar that every rendered text is parsed by again.

The library has no conversations of its own, so this operator is general: one row per turn, ``(conv_id, turn, role, text)``.

    conversation := turn*          turn := tag body "</s>"
    tag := "[INST] " (user) | "[/INST] " (assistant) | "[SYS] " (system) | "[ROLE:" name "] " (any other role, name percent-encoded)
    body := any text without a control string

Control strings are ``<s> </s> [INST] [/INST] [SYS] [/SYS]`` and ``[ROLE:``. An escape is one backslash after the opening bracket; text that
already has backslashes there gets one more, so that taking one away restores it. The parser cuts at ``</s>``, reads the tag, refuses a body that holds a
control string, and takes one backslash away from each escape. A turn is rendered as it stands; what the parser then reads is compared with the source, and a
turn that differs is rendered with its conflicting strings escaped, until it is identical. At the end whole conversations are parsed
once more and must equal their source.

All of it is DataFrame functions. A conversation is one training record and so one row: it has to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "</s>"
_TAGS = {"user": "[INST] ", "assistant": "[/INST] ", "system": "[SYS] "}
_NAMES = r"s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE:"
_CONTROL = rf"[<\[](?:{_NAMES})"
#: An opening bracket, backslashes and the rest of a control string.
_OPEN = rf"([<\[])(\\*)({_NAMES})"
_ESCAPED = rf"([<\[])\\(\\*)({_NAMES})"


def escape(text: Column) -> Column:
    """One more backslash in every control string, escaped or not."""
    return F.regexp_replace(text, _OPEN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """One backslash fewer in every escaped control string."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def tag(role: Column) -> Column:
    """The tag of a role; a null role is the empty name."""
    known = F.when(F.lit(False), "")
    for name, text in _TAGS.items():
        known = known.when(role == name, text)
    return known.otherwise(F.concat(F.lit("[ROLE:"), F.url_encode(F.coalesce(role, F.lit(""))), F.lit("] ")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text, body>>; ``text`` is null where the grammar does not hold."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def read(piece):
        role = F.url_decode(F.regexp_extract(piece, r"^\[ROLE:([^\]]*)\] ", 1))
        mark = F.regexp_extract(piece, r"^\[ROLE:[^\]]*\] ", 0)
        for name, text in _TAGS.items():
            role = F.when(F.startswith(piece, F.lit(text)), name).otherwise(role)
            mark = F.when(F.startswith(piece, F.lit(text)), text).otherwise(mark)
        body = F.substring(piece, F.length(mark) + 1, F.length(piece))
        sound = (mark != "") & ~F.rlike(body, F.lit(_CONTROL))
        return F.struct(role.alias("role"), F.when(sound, unescape(body)).alias("text"), body.alias("body"))

    return F.transform(pieces, read)


def format_conversations(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                         text_column: str = "text") -> DataFrame:
    """``(id, formatted, turns, loss_spans)``, one row per conversation.

    Turns go by ``turn`` (nulls first), ties by role and text; repeated rows are turns of their own. A null text is empty, a null role the empty role.
    ``turns`` is what the parser reads back from ``formatted``: array<struct<role, text, body>>. ``loss_spans`` are the ranges
    ``[start, stop)`` of ``formatted``, in characters, that a loss is taken on: the bodies of assistant turns. Rows with a null id make one conversation. An empty
    table gives no rows; further columns are not looked at. Fails if a rendered conversation does not parse to its source.
    """
    rows = conversations.select(
        F.col(id_column), F.col(turn_column).alias("_n"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    for _ in range(2):  # a body as it stands, then escaped where the parser does not give the source back
        body = F.col("_body") if "_body" in rows.columns else F.col("_text")
        alone = F.transform(parse(F.concat(tag(F.col("_role")), body, F.lit(CLOSE))), lambda t: F.struct(t["role"], t["text"]))
        source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
        same = F.coalesce(alone == source, F.lit(False))
        rows = rows.withColumn("_body", F.when(same, body).otherwise(escape(F.col("_text"))))
    rows = rows.withColumn("_tag", tag(F.col("_role")))
    order = Window.partitionBy(id_column).orderBy("_n", "_role", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("_tag") + F.length("_body") + len(CLOSE)
    rows = rows.withColumn("_stop", F.sum(size).over(order) - len(CLOSE))
    whole = rows.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("_stop", "_tag", "_body", "_role", "_text"))).alias("_turns"))
    formatted = F.array_join(F.transform("_turns", lambda t: F.concat(t["_tag"], t["_body"], F.lit(CLOSE))), "")
    spans = F.transform(
        F.filter("_turns", lambda t: t["_role"] == "assistant"),
        lambda t: F.struct((t["_stop"] - F.length(t["_body"])).alias("start"), t["_stop"].alias("stop")))
    out = whole.select(
        F.col(id_column), formatted.alias("formatted"), spans.alias("loss_spans"),
        F.transform("_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text"))).alias("_source"))
    out = out.withColumn("turns", parse(F.col("formatted")))
    identical = F.coalesce(F.transform("turns", lambda t: F.struct(t["role"], t["text"])) == F.col("_source"), F.lit(False))
    return out.select(
        id_column, F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse to its source"))).alias("formatted"),
        "turns", "loss_spans")


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
