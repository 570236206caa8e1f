"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation is its rows by turn (ties: role, then text). Each turn is written between marks:

    user        [INST] text [/INST]
    assistant   <s> text </s>
    any other   <<SYS>>role=text<</SYS>>        role URL-encoded

Rendered text is parsed back by cutting it after each closing mark; a control string between a turn's marks is no turn
of the grammar. Where the parser doesn't recover a turn from its own
rendering, that turn's text is escaped, one backslash more inside each control string, which the parser takes off again;
where a conversation as a whole still differs, all its texts are escaped. The result carries the verdict.

Null texts and null roles count as empty. Null conversation ids are one conversation. Repeated rows are turns like any
others, in any order where they are equal. Very long texts are formatted whole. A conversation is one text by contract, so it
lies in one row. An empty table gives no rows. Columns but the named ones are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The control strings of the template, opened and closed per role.
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s> ", " </s>")
OTHER = ("<<SYS>>", "<</SYS>>")
#: First character, backslashes so far, rest, of every control string.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)"
BARE = r"[<\[](?:/?s>|/?INST\]|<SYS>>|</SYS>>)"
CLOSED = r"(?<=\[/INST\]|</s>|<</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    """A turn between its marks; text is escaped already or not."""
    return (
        F.when(role == "user", F.concat(F.lit(USER[0]), text, F.lit(USER[1])))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), text, F.lit(ASSISTANT[1])))
        .otherwise(F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("="), text, F.lit(OTHER[1])))
    )


def _inner(segment: Column, marks: tuple[str, str]) -> Column:
    return F.substring(segment, F.lit(len(marks[0]) + 1), F.length(segment) - len(marks[0]) - len(marks[1]))


def parse_segment(segment: Column) -> Column:
    """(role, text) of one cut segment; null where it fits no rule or has a bare control string inside its marks."""
    is_ = lambda marks: segment.startswith(marks[0]) & segment.endswith(marks[1]) & (F.length(segment) >= len(marks[0]) + len(marks[1]))
    body = _inner(segment, OTHER)
    cut = F.locate("=", body)
    role = (
        F.when(is_(USER), F.lit("user")).when(is_(ASSISTANT), F.lit("assistant")).when(is_(OTHER) & (cut > 0), F.try_url_decode(F.substring(body, F.lit(1), cut - 1)))
    )
    raw = (
        F.when(is_(USER), _inner(segment, USER))
        .when(is_(ASSISTANT), _inner(segment, ASSISTANT))
        .when(is_(OTHER) & (cut > 0), F.substring(body, cut + 1, F.length(body)))
    )
    return F.when(~raw.rlike(BARE), F.struct(role.alias("role"), unescape(raw).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    segments = F.filter(F.split(formatted, CLOSED), lambda s: s != "")
    return F.transform(segments, parse_segment)


def formatted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted, turns (parsed from it), spans (start and length of the assistant texts in it,
    in characters and in bytes: the loss mask), identical (the parsed turns are the source's), n_escaped."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    plain = render_turn(F.col("role"), F.col("text"))
    conflict = ~(parse(plain).eqNullSafe(F.array(F.struct("role", "text"))))
    first = rows.withColumn("body", F.when(conflict, escape(F.col("text"))).otherwise(F.col("text"))).withColumn("safe", escape(F.col("text")))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    measures = {"chars": F.length, "bytes": F.octet_length}
    for name, size in measures.items():  # running lengths of what comes before a turn, escaped where in conflict or throughout
        for how in ("body", "safe"):
            first = first.withColumn(f"{name}_{how}", F.coalesce(F.sum(size(render_turn(F.col("role"), F.col(how)))).over(before), F.lit(0)))
    at = lambda how: F.struct(*[F.col(f"{name}_{how}").alias(name) for name in measures])
    kept = F.struct("turn", "role", "text", at("body").alias("at_body"), "body", at("safe").alias("at_safe"), "safe")
    held = first.groupBy("conv").agg(F.array_sort(F.collect_list(kept)).alias("source"))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    joined = lambda how: F.array_join(F.transform("source", lambda t: render_turn(t["role"], t[how])), "")
    once = held.withColumn("wanted", wanted).withColumn("once", joined("body"))
    once = once.withColumn("well", parse(F.col("once")).eqNullSafe(F.col("wanted")))
    done = once.withColumn("formatted", F.when(F.col("well"), F.col("once")).otherwise(joined("safe"))).withColumn("turns", parse(F.col("formatted")))
    mark = len(ASSISTANT[0])
    span = lambda t, how: F.struct(
        (t[f"at_{how}"]["chars"] + mark).alias("start"),
        F.length(t[how]).alias("length"),
        (t[f"at_{how}"]["bytes"] + mark).alias("start_byte"),
        F.octet_length(t[how]).alias("bytes"),
    )
    spans = F.transform(F.filter("source", lambda t: t["role"] == "assistant"), lambda t: F.when(F.col("well"), span(t, "body")).otherwise(span(t, "safe")))
    return done.select(
        F.col("conv").alias(conv),
        "formatted",
        "turns",
        spans.alias("spans"),
        F.col("turns").eqNullSafe(F.col("wanted")).alias("identical"),
        F.size(F.filter("source", lambda t: t["body"] != t["text"])).alias("n_escaped"),
    )


def masked(chats: DataFrame, into: str = "masked") -> DataFrame:
    """chats with the texts under the loss mask: cut out of the formatted bytes by the spans, then unescaped."""
    raw = chats.withColumn("lanewise_raw", F.col("formatted").cast("binary"))
    cut = lambda s: unescape(F.decode(F.substring("lanewise_raw", (s["start_byte"] + 1).cast("int"), s["bytes"]), "UTF-8"))
    return raw.withColumn(into, F.transform("spans", cut)).drop("lanewise_raw")


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what the parser reads back from the formatted text, and of what the loss mask cuts out of it."""
    turns, loss = F.col("turns"), F.array_join("lanewise_loss", "")
    all_ = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return masked(chats, "lanewise_loss").select(
        conv,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(all_.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
