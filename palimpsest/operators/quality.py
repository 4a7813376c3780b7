"""Gates and checks over instances, as columns and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_hop_gate(answerable: Column, hops: Column, supporting: Column, answer: Column, question: Column) -> Column:
    return answerable & (hops >= 2) & (supporting >= 2) & (F.length(answer) >= 2) & (F.length(question) >= 30)


def patch_gate(changed: Column, tests: Column, hunks: Column, problem: Column, least: int = 8, most: int = 500) -> Column:
    """Size of a patch, number of tests and hunks, length of the problem; most = 0 sets no bound."""
    ok = (changed >= least) & (tests >= 2) & (hunks >= 2) & (F.length(problem) >= 200)
    return ok & (changed <= most) if most else ok


def accepted(with_memory: Column, without: Column, docker: Column) -> Column:
    """Docker scores: above 0 with memory and 0 without; else at least .4 and more than .3 above."""
    return F.when(docker, (with_memory > 0) & (without == 0)).otherwise((with_memory >= 0.4) & (with_memory > without + 0.30))


def verdict(with_memory: Column, distractors: Column, without: Column) -> Column:
    """The ladder over three injected scores."""
    confusable, leaky = distractors >= 0.4, without >= 0.3
    return F.when(with_memory < 0.5, "broken").when(confusable & leaky, "confusable_and_leaky").when(confusable, "confusable").when(leaky, "leaky").otherwise("valid")


def prescreen(parametric: Column, partial: Column) -> Column:
    """The reason for which an instance is rejected, null if it isn't; the second score counts only where the first one passes."""
    said = lambda name, c: F.concat(F.lit(f"{name}="), F.format_string("%.2f", c))
    return F.when(parametric >= 0.5, said("parametric", parametric)).when(partial >= 0.6, said("partial", partial))


def difficulty(discoverable: Column, linked: Column) -> Column:
    """easy without a fact that can't be discovered; else hard from three linked facts on."""
    hidden = F.exists(discoverable, lambda d: ~F.coalesce(d, F.lit(True)))
    return F.when(~hidden, "easy").when(linked >= 3, "hard").otherwise("medium")


def fact_gate(facts: Column) -> Column:
    """Two critical facts at least that can't be discovered (null: can be); facts are structs of discoverable and relevance."""
    return F.size(F.filter(facts, lambda f: ~F.coalesce(f["discoverable"], F.lit(True)) & (F.coalesce(f["relevance"], F.lit("")) == "critical"))) >= 2


def hunk_coverage(hunks: Column, n: Column) -> tuple[Column, Column]:
    """Two rules: share of distinct hunks (1 where there are none; may exceed 1), and share of those in range (0 where there are none)."""
    distinct = F.array_distinct(F.flatten(hunks))
    inside = F.filter(distinct, lambda h: (h >= 0) & (h < n))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(distinct) / n), F.when(n == 0, F.lit(0.0)).otherwise(F.size(inside) / n)


# What gives a change away in a question.
LEAKY = [
    r"\b(added|removed|deleted|inserted|changed)\b",
    r"\bline\s+\d+\b",
    r"\b(the patch|the diff|the change)\b",
    r"[+\-]{3}\s",
    r"@@\s",
]


def leaky(question: Column) -> Column:
    return F.regexp_like(F.lower(question), F.lit("|".join(LEAKY)))


def long_checks(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row a check: (key, check, passed); a check that is null has failed."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return df.select(key, F.explode(rows).alias("c")).select(key, "c.check", "c.passed")


def check_report(checks: DataFrame, key: str) -> DataFrame:
    """Pass rate of each check, and the share of rows that pass all (as check "all")."""
    whole = checks.groupBy(key).agg(F.bool_and("passed").alias("passed")).withColumn("check", F.lit("all"))
    return checks.unionByName(whole.select(key, "check", "passed")).groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), (F.count_if("passed") / F.count("*")).alias("rate"))


def measures(df: DataFrame, names: list[str]) -> DataFrame:
    """Minimum, median (interpolated), mean and maximum of some columns, one row each."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select("m.*")
    return rows.groupBy("measure").agg(F.min("x").alias("least"), F.percentile("x", 0.5).alias("median"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("most"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows pass each step and all before it, and the share of the step before."""
    passed, so_far = [], F.lit(True)
    for i, (name, c) in enumerate(steps.items()):
        so_far = so_far & F.coalesce(c, F.lit(False))
        passed.append((i, name, so_far))
    one = df.agg(F.count("*").alias("loaded"), *[F.count_if(c).alias(f"s{i}") for i, _, c in passed])
    rows = [F.struct(F.lit(0).alias("step"), F.lit("loaded").alias("name"), F.col("loaded").alias("n"), F.col("loaded").alias("before"))]
    rows += [F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(f"s{i}").alias("n"), F.col(f"s{i - 1}" if i else "loaded").alias("before")) for i, name, _ in passed]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.step", "r.name", "r.n", F.coalesce(F.try_divide("r.n", "r.before"), F.lit(0.0)).alias("rate"))


def difficulty_in_context(given: Column, tokens: Column, above: int = 100_000) -> Column:
    """medium becomes hard in a long context."""
    return F.when((given == "medium") & (tokens > above), "hard").otherwise(given)


def siblings(results: Column, supporting: Column) -> Column:
    """The results whose place isn't among the supporting ones."""
    return F.filter(results, lambda r, i: ~F.array_contains(supporting, i))


def latest_checkpoint(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The name with the highest number at its end, of each group."""
    number = F.regexp_extract(name, r"(\d+)$", 1).try_cast("long")
    return df.where(number.isNotNull()).groupBy(*(by or [])).agg(F.max_by(name, number).alias(name))
