"""Chat formatting from an event log (operator 7), in DataFrame functions only.

Events are dealt by conversation, once; all later steps reuse that partitioning.
In each message, in order of ``seq``: ``open`` gives the role and a first text, ``delta``
appends text, ``edit`` replaces all text so far, ``regenerate`` drops it and also every
later message of the conversation that was opened before it (the answers to what was
taken back), and ``delete`` drops the message until something is written to it again.
Messages stand in the order of their first event.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  In texts and roles
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, in roles also a line feed ``&nl;``, so that
no text can hold a mark and everything is read back exactly.  ``spans`` gives for every
turn where it starts, where its text starts and how long that is (in code points of
``formatted``), and whether the text is under the loss mask.

Defined results: null texts and roles are empty; a conversation with a null id is one of
its own; ties of ``seq`` are ordered by kind, role and text; a conversation of which no
message is left has no row; an empty log gives no rows; other columns don't matter.  A
conversation is one row in the end, so its text must be shorter than Spark's 2 GB of a value;
all rows with a null id together are such a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of finished rows: each one opens a message of its own, in the order of turns (null first), roles and texts."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return (
        rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
        .repartition("conv")
        .select("conv", F.row_number().over(order).cast("long").alias("seq"), "role", "text")
        .select("conv", F.col("seq").alias("msg"), "seq", F.lit("open").alias("kind"), "role", "text")
    )


def streamed(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log that ends in the same messages as events_of_rows(): each one is opened with a draft, goes on with a delta, is
    regenerated in two deltas of a wrong end, is edited to its first half, and ends with a delta of the rest."""
    said = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(said) / 2).cast("int")
    first, rest = F.substr(said, F.lit(1), half), F.substr(said, half + 1)
    steps = [("open", "role", F.lit("draft ")), ("delta", None, rest), ("regenerate", None, None), ("delta", None, first), ("delta", None, F.lit(" wrong")), ("edit", None, first), ("delta", None, rest)]
    given = lambda c: F.lit(None).cast("string") if c is None else c if isinstance(c, Column) else F.col(c)
    log = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), given(r).alias("role"), given(t).alias("text")) for k, (kind, r, t) in enumerate(steps)])
    events = events_of_rows(rows, conv, turn, role, text).select("conv", "msg", "seq", F.explode(log).alias("e"))
    return events.select("conv", "msg", (F.col("seq") * len(steps) + F.col("e.step")).alias("seq"), "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv, pos, role, text), pos from 1 without gaps, of rows (conv, msg, seq, kind, role, text)."""
    message = Window.partitionBy("conv", "msg")
    reset = F.col("kind").isin("edit", "regenerate", "delete")
    rows = (
        events.repartition("conv")
        .withColumn("first", F.min("seq").over(message))
        .withColumn("reset", F.max(F.when(reset, F.col("seq"))).over(message))
    )
    # taken back: a message that began earlier was regenerated after this one's beginning
    earlier = Window.partitionBy("conv").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("redone", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    back = F.coalesce(F.col("redone") > F.col("first"), F.lit(False))
    live = rows.where(~back & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset")) | (F.col("kind") == "open")))
    writes = F.when(F.col("kind").isin("delete", "regenerate"), F.lit("")).when(F.col("reset").isNotNull() & (F.col("seq") < F.col("reset")), F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), writes.alias("text"))))
    messages = live.groupBy("conv", "msg").agg(F.min("first").alias("first"), F.max_by(F.when(F.col("kind") == "open", F.coalesce("role", F.lit(""))), F.struct(F.col("kind") == "open", "seq")).alias("role"), parts.alias("parts"))
    gone = F.element_at("parts", -1)["kind"] == "delete"
    messages = messages.where(~gone).select("conv", "first", "msg", F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text"))
    return messages.select("conv", F.row_number().over(Window.partitionBy("conv").orderBy("first", "msg")).alias("pos"), "role", "text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv, formatted, spans) of messages (conv, pos, role, text)."""
    before = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    name = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;"))
    rows = messages.select("conv", "pos", F.col("role").isin(*loss_roles).alias("loss"), F.concat(F.lit(START), name, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    turn = F.struct("pos", F.struct("start", (F.col("start") + F.length("head")).alias("text_start"), F.length("body").alias("text_length"), "loss").alias("span"), "piece")
    turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv", F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of the output again: rows (conv, formatted, spans, turns), turns holding role, text and the text under the mask (null outside)."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column, i: Column) -> Column:
        span = F.get(F.col("spans"), i)
        body = F.substr(p, F.instr(p, F.lit("\n")) + 1)
        role = F.substr(F.substring_index(p, "\n", 1), F.lit(len(START) + 1))
        under = F.substr(p, (span["text_start"] - span["start"] + 1).cast("int"), span["text_length"].cast("int"))
        return F.struct(
            unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"),
            unescape(body).alias("text"),
            F.when(span["loss"], unescape(under)).alias("under"),
        )

    return formatted.withColumn("pieces", pieces).withColumn("turns", F.transform("pieces", turn)).drop("pieces")


def summary(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what was read back."""
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    under = F.concat_ws("", F.transform("turns", lambda t: t["under"]))
    return turns.select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
