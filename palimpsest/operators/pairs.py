"""Joins of runs, steps and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_labels(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Inner join of two runs (key, resolved, tokens, est_tokens): labels default to false, tokens of 0 are missing and estimated."""
    side = lambda df, s: df.select(key, F.coalesce("resolved", F.lit(False)).alias(f"{s}_resolved"), F.coalesce(F.nullif("tokens", F.lit(0)), "est_tokens").alias(f"{s}_tokens"))
    rows = side(base, "base").join(side(other, "memory"), key)
    return rows.withColumn("outcome", outcome(F.col("base_resolved"), F.col("memory_resolved")))


def outcome(base: Column, memory: Column) -> Column:
    return F.when(base & memory, "both_pass").when(base, "memory_hurt").when(memory, "memory_helped").otherwise("both_fail")


def reward_pairs(base: DataFrame, other: DataFrame, key: str, keep_zero: bool = True, most: int = 2000) -> DataFrame:
    """Steps (key, step, action, reward) of both runs joined; rows without reward or with a blank action go, label is whether the
    other run's reward is not below (keep_zero) or above the base's (by 1e-9 at least); actions are cut."""
    b = base.select(key, "step", F.col("action").alias("base_action"), F.col("reward").alias("base_reward"))
    rows = b.join(other.select(key, "step", "reward"), [key, "step"]).where("reward IS NOT NULL AND base_reward IS NOT NULL AND trim(base_action) <> ''")
    rows = rows.withColumn("delta", F.col("reward") - F.col("base_reward"))
    rows = rows if keep_zero else rows.where("abs(delta) >= 1e-9")
    return rows.select(key, "step", F.substring("base_action", 1, most).alias("action"), "delta", (F.col("delta") >= 0).alias("safe"))


def positional(left: DataFrame, right: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The k-th rows of both sides, as far as the shorter side goes."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    side = lambda df, s: df.select(*key, k.alias("k"), F.col(value).alias(s))
    return side(left, "left_value").join(side(right, "right_value"), [*key, "k"])


def occurrences(old: DataFrame, new: DataFrame, by: list[str], order: str, ident: str, key: list[str]) -> DataFrame:
    """Ids of the n-th occurrence of the same attributes on both sides; those without a partner are left out."""
    n = F.row_number().over(Window.partitionBy(*key, *by).orderBy(order))
    side = lambda df, s: df.select(*key, *by, n.alias("nth"), F.col(ident).alias(s))
    return side(old, "old_id").join(side(new, "new_id"), [*key, *by, "nth"]).select(*key, *by, "old_id", "new_id")


def tail_aligned(left: DataFrame, right: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """The last n positions of both sides, paired from the end."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    side = lambda df, s: df.withColumn("back", back).where(F.col("back") <= n).select(key, "back", F.col(value).alias(s))
    return side(left, "left_value").join(side(right, "right_value"), [key, "back"])


def as_of(queries: DataFrame, facts: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """For each query the value of the latest fact at or before it, and the number of such facts.

    Both sides are one stream by key and time, and the last value seen is carried on: one shuffle, no join."""
    rows = queries.select(*queries.columns, F.lit(None).cast(facts.schema[value].dataType).alias("__v"), F.lit(1).alias("__q"), F.lit(None).cast(facts.schema[tie].dataType).alias("__t"))
    more = facts.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in queries.columns], F.col(value).alias("__v"), F.lit(0).alias("__q"), F.col(tie).alias("__t"))
    w = Window.partitionBy(key).orderBy(at, "__q", "__t").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(more).withColumns({"latest": F.last("__v", True).over(w), "n_before": F.count_if(F.col("__q") == 0).over(w)})
    return both.where("__q = 1").select(*queries.columns, "latest", "n_before")


def windows_of_facts(facts: DataFrame, turns: DataFrame, key: str, window: int) -> DataFrame:
    """Range join: for each turn the facts of earlier turns within the window and those already gone.

    A turn meets each turn of its own conversation only through counts and ordered windows, never all pairs."""
    n = facts.groupBy(key, "turn").agg(F.count("*").alias("facts"))
    rows = turns.select(key, "turn").distinct().join(n, [key, "turn"], "left").fillna(0, ["facts"])
    w = Window.partitionBy(key).orderBy("turn")
    return rows.withColumns({"visible": F.sum("facts").over(w.rangeBetween(-(window - 1), 0)), "evicted": F.coalesce(F.sum("facts").over(w.rangeBetween(Window.unboundedPreceding, -window)), F.lit(0))})


def merged_intervals(df: DataFrame, key: str, gap: int) -> DataFrame:
    """Unions of the intervals (key, start, end) that are at most ``gap`` apart."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def snippets(facts: DataFrame, files: DataFrame, key: str, fact: str, before: int = 5, lines: int = 40, gap: int = 3, per_file: int = 2, most: int = 3) -> DataFrame:
    """Rows (key, fact, path, start, end, snippet): parts of the files (key, path, content) of a fact's instance around lines that hold a
    code name of the fact (key, fact, content), from ``before`` lines ahead on, ``lines`` in all; parts at most ``gap`` apart are one.  The
    first two of a file and the first three of a fact stay, in order of path and line.  Lines count from 0, their numbers in the text from 1."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b[A-Za-z_][A-Za-z0-9_.]{4,}\b"), 0))
    code = F.filter(names, lambda w: F.contains(w, F.lit("_")) | F.contains(w, F.lit(".")) | (F.regexp_like(w, F.lit("^[A-Z]")) & F.regexp_like(w, F.lit("[a-z]"))))
    asked = facts.select(key, fact, code.alias("__names")).where(F.size("__names") > 0)
    split = files.select(key, "path", F.split("content", "\n").alias("__lines"))
    there = F.filter(F.transform("__lines", lambda x, i: F.when(F.exists("__names", lambda n: F.contains(x, n)), i)), lambda i: i.isNotNull())
    pairs = asked.join(split, key).withColumn("__at", there).where(F.size("__at") > 0)
    rows = pairs.select(key, fact, "path", F.explode("__at").alias("i"), F.size("__lines").alias("n"))
    whole = F.struct(key, fact, "path")
    parts = merged_intervals(rows.select(whole.alias("__k"), F.greatest(F.lit(0), F.col("i") - before).alias("start"), F.least("n", F.col("i") + lines - before).alias("end")), "__k", gap)
    in_file = F.row_number().over(Window.partitionBy("__k").orderBy("start"))
    parts = parts.withColumn("__r", in_file).where(F.col("__r") <= per_file).select("__k.*", "start", "end")
    in_all = F.row_number().over(Window.partitionBy(key, fact).orderBy("path", "start"))
    parts = parts.withColumn("__r", in_all).where(F.col("__r") <= most).drop("__r")
    numbered = F.transform(F.slice("__lines", F.col("start") + 1, F.col("end") - F.col("start")), lambda x, i: F.concat(F.lpad((F.col("start") + i + 1).cast("string"), 4, " "), F.lit(" | "), x))
    return parts.join(split, [key, "path"]).select(key, fact, "path", "start", "end", F.concat_ws("\n", numbered).alias("snippet"))
