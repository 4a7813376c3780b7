"""Context operators over messages: rows (conv, pos, role, content), pos from 0 without gaps in each conversation.

Each operator returns the messages that an agent would see, as (conv, ord, pos, role, content): ord is the place
in the new context, pos the message's own place (null for a summary).  Summaries are injected as a function of
columns; the default joins the first characters of the messages that went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Fixed value: what stands for a masked message.
MASK = "<MASKED>"
# Fixed value: what keeps a message from being masked.
ERRORS = r"(?i)Traceback \(most recent call last\)|Error:|error:|FAILED|FAIL|AssertionError|Exception:|raise \w+Error|pytest.*ERRORS?|assert .+ =="


def whole() -> WindowSpec:
    """A conversation."""
    return Window.partitionBy("conv")


def in_order() -> WindowSpec:
    """A conversation up to a message."""
    return Window.partitionBy("conv").orderBy("pos")


def tokens(c: Column) -> Column:
    """Tokens as characters div 4."""
    return F.floor(F.length(c) / 4).cast("long")


def placed(df: DataFrame) -> DataFrame:
    """Adds n (messages) and back (place from the end, from 1)."""
    return df.withColumns({"n": F.count("*").over(whole()), "back": F.count("*").over(whole()) - F.col("pos")})


def extract(n: int = 200, cap: int = 2000) -> Callable[[Column], Column]:
    """A summary of an array of struct(pos, role, content): the roles and first characters of each, up to a cap."""
    return lambda gone: F.substring(F.concat_ws("\n", F.transform(gone, lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["content"], 1, n)))), 1, cap)


def pass_through(df: DataFrame) -> DataFrame:
    """All messages, with the running number of tokens."""
    return df.select("conv", F.col("pos").alias("ord"), "pos", "role", "content", F.sum(tokens(F.col("content"))).over(in_order()).alias("tokens_so_far"))


def masked(df: DataFrame, keep_first: int, window: int) -> DataFrame:
    """Masks user and tool messages that are neither among the first nor the last ones and report no error."""
    hide = F.col("role").isin("user", "tool") & (F.col("pos") >= keep_first) & (F.col("back") > window) & ~F.regexp_like("content", F.lit(ERRORS))
    rows = placed(df).withColumn("was_masked", hide)
    return rows.select("conv", F.col("pos").alias("ord"), "pos", "role", F.when(F.col("was_masked"), MASK).otherwise(F.col("content")).alias("content"), "was_masked")


def classed(df: DataFrame, keep_first: int, keep_recent: int) -> DataFrame:
    """Adds part: 0 pinned (the first ones, and the first user message after them), 1 middle, 2 tail (the last ones that aren't pinned)."""
    first_user = F.min(F.when((F.col("role") == "user") & (F.col("pos") >= keep_first), F.col("pos"))).over(whole())
    rows = df.withColumn("pinned", (F.col("pos") < keep_first) | F.coalesce(F.col("pos") == first_user, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("conv", "pinned").orderBy(F.col("pos").desc()))
    return rows.withColumn("part", F.when(F.col("pinned"), 0).when(rank <= keep_recent, 2).otherwise(1)).drop("pinned")


def with_summary(df: DataFrame, summarise: Callable[[Column], Column]) -> DataFrame:
    """Replaces the messages of part 1 of each conversation by one summary between parts 0 and 2."""
    gone = df.where("part = 1").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("gone"))
    summary = gone.select("conv", F.lit(1).alias("part"), F.lit(None).cast(df.schema["pos"].dataType).alias("pos"), F.lit("user").alias("role"), summarise(F.col("gone")).alias("content"))
    rows = df.where("part <> 1").select("conv", "part", "pos", "role", "content").unionByName(summary)
    place = F.row_number().over(Window.partitionBy("conv").orderBy("part", "pos")) - 1
    return rows.select("conv", place.cast("long").alias("ord"), "pos", "role", "content")


def adaptive_budget(df: DataFrame, max_tokens: int, keep_first: int = 1, keep_recent: int = 2, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Above a budget of tokens: pinned messages, a summary of the middle, the tail; below it everything."""
    total = F.sum(tokens(F.col("content"))).over(whole())
    rows = classed(df, keep_first, keep_recent).withColumn("part", F.when(total > max_tokens, F.col("part")).otherwise(0))
    return with_summary(rows, summarise or extract())


def condensed(df: DataFrame, max_size: int, keep_first: int = 1, share: float = 0.5, max_tokens: int | None = None, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """With more than max_size messages (or tokens): head, summary, and a tail of int(max_size * share) - keep_first - 1, one at least."""
    tail = max(1, int(max_size * share) - keep_first - 1)
    rows = placed(df)
    over = F.col("n") > max_size
    if max_tokens is not None:
        over = over | (F.sum(tokens(F.col("content"))).over(whole()) > max_tokens)
    rows = rows.withColumn("part", F.when(~over | (F.col("pos") < keep_first), 0).when(F.col("back") <= tail, 2).otherwise(1))
    return with_summary(rows, summarise or extract())


def sliding_window(df: DataFrame, window: int, keep_first: int = 1, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Head, a summary of what has left the window, and the last messages."""
    rows = placed(df)
    rows = rows.withColumn("part", F.when(F.col("pos") < keep_first, 0).when(F.col("back") <= window, 2).otherwise(1))
    return with_summary(rows, summarise or extract(200, 1000))


def naive_summary(df: DataFrame, max_tokens: int, keep_first: int, keep_recent: int, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Above the budget: head, summary, last messages; where the whole is shorter than the tail, the head comes twice."""
    rows = placed(df).withColumn("over", F.sum(tokens(F.col("content"))).over(whole()) > max_tokens)
    head, tail = F.col("pos") < keep_first, F.col("back") <= keep_recent
    kept = rows.where("NOT over").withColumn("part", F.lit(0))
    kept = kept.unionByName(rows.where(F.col("over") & head).withColumn("part", F.lit(0))).unionByName(rows.where(F.col("over") & tail).withColumn("part", F.lit(2)))
    kept = kept.unionByName(rows.where(F.col("over") & ~head & ~tail).withColumn("part", F.lit(1)))
    return with_summary(kept, summarise or extract())


def view(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Drops messages in the union of the half-open ranges (conv, start, end, summary, offset, seq) and puts the last range's summary at its offset."""
    dropped = df.alias("m").join(ranges.alias("r"), (F.col("m.conv") == F.col("r.conv")) & (F.col("m.pos") >= F.col("r.start")) & (F.col("m.pos") < F.col("r.end")), "left_anti")
    kept = dropped.select("conv", "pos", "role", "content", (F.row_number().over(in_order()) - 1).alias("place"))
    last = ranges.groupBy("conv").agg(F.max_by(F.struct("summary", "offset"), "seq").alias("s"))
    summary = last.select("conv", F.lit(None).cast(df.schema["pos"].dataType).alias("pos"), F.lit("user").alias("role"), F.col("s.summary").alias("content"), F.col("s.offset").alias("place"))
    rows = kept.withColumn("late", F.lit(1)).unionByName(summary.withColumn("late", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("place", "late", "pos")) - 1
    return rows.select("conv", place.cast("long").alias("ord"), "pos", "role", "content")


def stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each conversation: messages and tokens before and after, and original over filtered."""
    a = before.groupBy("conv").agg(F.count("*").alias("original_msgs"), F.sum(tokens(F.col("content"))).alias("original_tokens"))
    b = after.groupBy("conv").agg(F.count("*").alias("filtered_msgs"), F.sum(tokens(F.col("content"))).alias("filtered_tokens"), F.bool_or(F.col("pos").isNull()).alias("was_compacted"))
    return a.join(b, "conv", "left").withColumn("compression_ratio", F.col("original_tokens") / F.greatest("filtered_tokens", F.lit(1)))


def truncated(c: Column, most: int, mark: str = "\n[...]\n") -> Column:
    """First half, a mark and the last half of longer texts."""
    half = most // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, half), F.lit(mark), F.right(c, F.lit(half))))


def last_chars(df: DataFrame, most: int) -> DataFrame:
    """The last characters of each conversation's joined messages."""
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]))
    return df.groupBy("conv").agg(text.alias("t")).select("conv", F.right("t", F.lit(most)).alias("content"))


def neighbours(df: DataFrame, event: Column, reach: int) -> DataFrame:
    """For each message that is an event: the places of up to so many messages before and after it."""
    w = Window.partitionBy("conv").orderBy("pos")
    rows = df.withColumns({"event": event, "before": F.collect_list("pos").over(w.rowsBetween(-reach, -1)), "after": F.collect_list("pos").over(w.rowsBetween(1, reach))})
    return rows.where("event").drop("event")


def rising(df: DataFrame, flag: Column) -> DataFrame:
    """Messages where the flag turns true."""
    return df.withColumn("now", flag).withColumn("was", F.lag("now", 1, False).over(in_order())).where("now AND NOT was").drop("now", "was")


def repair_tool_calls(df: DataFrame) -> DataFrame:
    """Rows (conv, pos, role, content, calls array<string>, call_id): drops tool messages whose nearest earlier message that
    is no tool message isn't an assistant's with that call, then calls without an answer; an assistant left with neither says (continued)."""
    before = F.last(F.when(F.col("role") != "tool", F.struct("role", "calls")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    held = (F.col("b.role") == "assistant") & F.array_contains(F.col("b.calls"), F.col("call_id"))
    rows = df.withColumn("b", before).where((F.col("role") != "tool") | F.coalesce(held, F.lit(False)))
    # the messages of a turn: an assistant's and the tool messages after it
    turn = F.count_if(F.col("role") != "tool").over(in_order())
    rows = rows.withColumn("turn", turn).withColumn("answered", F.collect_set(F.when(F.col("role") == "tool", F.col("call_id"))).over(Window.partitionBy("conv", "turn")))
    calls = F.filter("calls", lambda c: F.array_contains("answered", c))
    rows = rows.withColumn("left", F.when(F.col("role") == "assistant", calls).otherwise(F.col("calls")))
    empty = (F.col("role") == "assistant") & (F.coalesce(F.size("calls"), F.lit(0)) > 0) & (F.size("left") == 0) & (F.coalesce(F.trim("content"), F.lit("")) == "")
    return rows.select("conv", "pos", "role", F.when(empty, "(continued)").otherwise(F.col("content")).alias("content"), F.col("left").alias("calls"), "call_id")


def recent(df: DataFrame, capacity: int, last: int) -> DataFrame:
    """A ring buffer of the last ``capacity`` messages, and which of them are the last ones."""
    return placed(df).where(F.col("back") <= capacity).select("conv", "pos", "role", "content", (F.col("back") <= last).alias("retrieved"))


def growth(df: DataFrame) -> DataFrame:
    """Current, largest, mean tokens, and tokens gained per message from the first to the last."""
    rows = df.withColumn("t", tokens(F.col("content")))
    span = F.max("pos") - F.min("pos")
    return rows.groupBy("conv").agg(
        F.max_by("t", "pos").alias("current"), F.max("t").alias("largest"), F.avg("t").alias("mean"),
        F.coalesce((F.max_by("t", "pos") - F.min_by("t", "pos")) / F.nullif(span, F.lit(0)), F.lit(0.0)).alias("rate"),
    )


def whole_calls(df: DataFrame) -> DataFrame:
    """Rows with part (0 pinned, 1 middle, 2 tail), calls and call_id: answers in the middle follow their call to the head or the tail,
    and a call in the middle with an answer in the tail goes there with all its answers."""
    none = F.array().cast("array<string>")
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    calls = F.coalesce("calls", none)
    # lists of calls are made once a conversation, not once a row
    lists = df.groupBy("conv").agg(
        gathered(F.when(F.col("part") == 0, calls)).alias("__pinned"), gathered(F.when(F.col("part") == 2, calls)).alias("__tail"), F.collect_set(F.when(F.col("part") == 2, F.col("call_id"))).alias("__answers")
    )
    rows = df.join(lists, "conv")
    middle = F.col("part") == 1
    answers = lambda c: F.coalesce(F.array_contains(c, F.col("call_id")), F.lit(False))
    to_head = middle & answers(F.col("__pinned"))
    to_tail = middle & ~to_head & (answers(F.col("__tail")) | F.arrays_overlap(calls, "__answers"))
    rows = rows.withColumn("__part", F.when(to_head, 0).when(to_tail, 2).otherwise(F.col("part")))
    moved = rows.groupBy("conv").agg(gathered(F.when(middle & (F.col("__part") == 2), calls)).alias("__moved"))
    rows = rows.join(moved, "conv")
    part = F.when((F.col("__part") == 1) & answers(F.col("__moved")), 2).otherwise(F.col("__part"))
    return rows.withColumn("part", part).drop("__pinned", "__tail", "__answers", "__part", "__moved")
