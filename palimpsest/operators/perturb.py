"""Perturbations of messages and of configurations; draws are by md5 of keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.context import placed
from palimpsest.operators.sets import draw

# Fixed value: what summaries hold.
SUMMARY = r"USER_CONTEXT|TASK_TRACKING|CURRENT_STATE|Summary of|summary of|condensed"
# What a summary holds into which noise is put, and the noise.
NOISY = r"USER_CONTEXT|TASK_TRACKING|CURRENT_STATE|Summary of|condensed"
NOISE = [
    "\n\nNote: Also investigated /testbed/src/utils/deprecated_helper.py which may be related.",
    "\n\nPreviously found potential issue in validate_input() around line 342.",
    "\n\nAlso checked /testbed/tests/test_regression.py — tests were passing before this change.",
    "\n\nThe config parser in /testbed/src/config/loader.py may need updating as well.",
    "\n\nCOMPLETED: Fixed the type annotation in base_handler.py (unrelated to current task).",
]


def random_drop(df: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Drops max(1, int(share * n)) of the messages between the first and the last two; three messages or less stay."""
    rows = placed(df).withColumn("inner", (F.col("pos") >= 1) & (F.col("back") > 2) & (F.col("n") > 3))
    key = F.concat_ws("/", "conv", "pos")
    rank = F.row_number().over(Window.partitionBy("conv", "inner").orderBy(draw(key, seed), "pos"))
    return rows.withColumn("rank", rank).where(~F.col("inner") | (F.col("rank") > F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select("conv", "pos", "role", "content")


def first_and_last(df: DataFrame, n: int) -> DataFrame:
    """The first and the last n messages."""
    return placed(df).where((F.col("pos") == 0) | (F.col("back") <= n)).select("conv", "pos", "role", "content")


def redacted_summaries(df: DataFrame) -> DataFrame:
    """Paths, errors and calls replaced in messages that look like summaries."""
    c = F.col("content")
    return df.withColumn("content", F.when(F.regexp_like(c, F.lit(SUMMARY)), X.redacted(c)).otherwise(c))


def noisy_summary(df: DataFrame, seed: int = 42) -> DataFrame:
    """Two snippets, picked by md5, at the end of the first message of a conversation that looks like a summary."""
    like = F.regexp_like("content", F.lit(NOISY))
    first = F.min(F.when(like, F.col("pos"))).over(Window.partitionBy("conv"))
    order = lambda c: F.md5(F.concat(c, F.col("conv").cast("string"), F.lit(f":{seed}")))
    picked = F.slice(F.array_sort(F.array(*[F.struct(order(F.lit(n)).alias("o"), F.lit(n).alias("n")) for n in NOISE])), 1, 2)
    noise = F.concat_ws("", F.transform(picked, lambda x: x["n"]))
    return df.withColumn("first", first).withColumn("content", F.when(F.col("pos") == F.col("first"), F.concat("content", noise)).otherwise(F.col("content"))).drop("first")


def scaled_config(size: Column, tokens: Column, share: Column, factor: float) -> Column:
    """Limits times a factor, with floors of 10 messages, 500 tokens and a share of .3."""
    return F.struct(
        F.greatest(F.lit(10), F.floor(size * factor)).cast("long").alias("max_size"), F.greatest(F.lit(500), F.floor(tokens * factor)).cast("long").alias("max_tokens"),
        F.greatest(F.lit(0.3), share * factor).alias("share"),
    )


def inserted(df: DataFrame, extra: DataFrame, seed: int = 42) -> DataFrame:
    """Puts rows (conv, role, content) at seeded places between a conversation's first and last message, and places all anew."""
    n = df.groupBy("conv").agg(F.count("*").alias("n"))
    unit = F.conv(F.substring(draw(F.concat_ws("/", "conv", "content"), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    more = extra.join(n, "conv").select("conv", "role", "content", (F.floor(unit * F.greatest(F.lit(1), F.col("n") - 1)) + 0.5).alias("at"))
    rows = df.select("conv", "role", "content", F.col("pos").cast("double").alias("at")).unionByName(more)
    place = F.row_number().over(Window.partitionBy("conv").orderBy("at", "content")) - 1
    return rows.select("conv", place.cast("long").alias("pos"), "role", "content")


def spread(items: DataFrame, group: str, order: str, turns: int) -> DataFrame:
    """Items of a group over turns in a round."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return items.withColumn("turn", F.pmod(rank, F.lit(turns)))


def rendered(df: DataFrame, most: int = 24_000) -> DataFrame:
    """A conversation as one prompt: blocks of role and content, cut, and whether it was cut."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"]))
    return df.groupBy("conv").agg(F.concat_ws("\n\n", blocks).alias("p")).select("conv", F.substring("p", 1, most).alias("prompt"), (F.length("p") > most).alias("truncated"))


def counterfactuals(events: DataFrame, names: list[str]) -> DataFrame:
    """Each event with each of a stated list of perturbations."""
    return events.withColumn("perturbation", F.explode(F.array(*[F.lit(n) for n in names])))


def fact_spans(facts: DataFrame) -> DataFrame:
    """Rows (inst, hop, available, refs array<int>): the latest hop that refers to a fact's, and how long it must be kept."""
    needed = facts.select("inst", F.col("hop").alias("by"), F.explode("refs").alias("hop")).groupBy("inst", "hop").agg(F.max("by").alias("needed"))
    return facts.join(needed, ["inst", "hop"], "left").select("inst", "hop", "available", "needed", F.greatest(F.lit(0), F.coalesce("needed", "available") - F.col("available")).alias("retention"))


def hop_references(questions: DataFrame) -> DataFrame:
    """Rows (inst, hop, question): edges (inst, hop, ref) where a question holds # and an earlier hop's number (so #1 also in #10)."""
    refs = F.filter(F.sequence(F.lit(1), F.greatest(F.col("hop") - 1, F.lit(1))), lambda k: (k < F.col("hop")) & F.contains("question", F.concat(F.lit("#"), k.cast("string"))))
    return questions.select("inst", "hop", F.explode(refs).alias("ref"))


def token_replay(df: DataFrame) -> DataFrame:
    """Tokens of each prefix of a conversation: largest and total, and the total over what a single reading takes."""
    t = F.floor(F.length("content") / 4)
    rows = df.withColumn("prefix", F.sum(t).over(Window.partitionBy("conv").orderBy("pos")))
    return rows.groupBy("conv").agg(F.max("prefix").alias("peak"), F.sum("prefix").alias("naive"), F.count("*").alias("steps")).withColumn("ratio", F.try_divide("naive", "peak"))


def summary_rows(df: DataFrame, group: str, flag: Column, value: Column) -> DataFrame:
    """n, rate, total and largest of a group, its share of all, and the difference to the overall rate."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_true"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    whole = g.agg(F.sum("n").alias("all_n"), F.sum("n_true").alias("all_true"))
    return g.crossJoin(F.broadcast(whole)).select(group, "n", "n_true", "total", "largest", (F.col("n") / F.col("all_n")).alias("share"), (F.col("n_true") / F.col("n") - F.col("all_true") / F.col("all_n")).alias("delta"))
