"""Operators over instances: adapters of question sets, comparisons with a baseline, distractors, budgets and substitutions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.cluster import cut, ship
from palimpsest.functions import text as X


def supported(titles: Column, sentences: Column, facts: Column) -> Column:
    """Paragraphs (title, text, supporting) of parallel arrays of titles and sentences; supporting if the title is among the facts'."""
    return F.transform(F.arrays_zip(titles.alias("t"), sentences.alias("s")), lambda p: F.struct(p["t"].alias("title"), F.concat_ws(" ", p["s"]).alias("text"), F.array_contains(facts, p["t"]).alias("supporting")))


def multi_hop(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows (id, titles, sentences, facts) with paragraphs split into supporting ones and distractors; those with too few supporting ones go."""
    rows = df.withColumn("p", supported(F.col("titles"), F.col("sentences"), F.col("facts")))
    rows = rows.withColumns({"supporting": F.filter("p", lambda p: p["supporting"]), "distractors": F.filter("p", lambda p: ~p["supporting"])})
    return rows.where(F.size("supporting") >= least).drop("p")


def decomposed(df: DataFrame) -> DataFrame:
    """Rows (id, paragraphs array<struct<idx, title, text>>, steps array<struct<question, answer, idx>>): each hop with its paragraph, by
    idx, else the first one whose title is in the question."""
    steps = df.select("id", "paragraphs", F.posexplode("steps").alias("hop", "s"))
    own = F.get(F.filter("paragraphs", lambda p: p["idx"] == F.col("s.idx")), F.lit(0))
    named = F.get(F.filter("paragraphs", lambda p: F.contains(F.lower("s.question"), F.lower(p["title"]))), F.lit(0))
    return steps.select("id", "hop", "s.question", "s.answer", F.coalesce(own, named).alias("p")).select("id", "hop", "question", "answer", F.col("p.title").alias("title"))


def structural(df: DataFrame, window: int = 0) -> DataFrame:
    """Instances without any model call, of rows (id, answer, hops array<struct<question, answer, title, text>>, distractors array<struct<title, text>>).

    A turn for each hop with its paragraph (if title and text are there) and every n-th distractor; facts F1, F2, ... of the hops, each needed at the
    next one; ``required``: facts whose turn is out of the window (0: each turn sees itself only) where they are needed.  Instances without any go."""
    n, none = F.size("hops"), F.array().cast("array<struct<title: string, text: string>>")
    missing = F.coalesce("distractors", none)
    named = F.transform(missing, lambda d, j: F.struct(F.coalesce(d["title"], F.concat(F.lit("Distractor "), j.cast("string"))).alias("title"), F.coalesce(d["text"], F.lit("")).alias("text"), F.lit(False).alias("supporting"), j.alias("j")))

    def turn(h: Column, i: Column) -> Column:
        own = F.struct(h["title"].alias("title"), h["text"].alias("text"), F.lit(True).alias("supporting"))
        there = (F.coalesce(h["title"], F.lit("")) != "") & (F.coalesce(h["text"], F.lit("")) != "")
        others = F.transform(F.filter(named, lambda d: d["j"] % n == i), lambda d: d.dropFields("j"))
        return F.struct(i.alias("turn"), h["question"].alias("query"), h["answer"].alias("answer"), F.concat(F.filter(F.array(own), lambda _: there), others).alias("documents"))

    def fact(h: Column, i: Column) -> Column:
        last = i == n - 1
        needed = F.when(last, i).otherwise(F.least(i + 1, n - 1))
        answer = F.coalesce(h["answer"], F.lit(""))
        return F.struct(
            F.concat(F.lit("F"), (i + 1).cast("string")).alias("fact_id"), F.concat(F.coalesce(h["title"], F.lit("")), F.lit(": "), answer).alias("content"), F.when(last, "terminal_fact").otherwise("bridge_fact").alias("fact_type"),
            F.lit(False).alias("is_discoverable"), i.alias("first_available_at_hop"), needed.alias("needed_at_hop"), (needed - i).alias("retention_span"), F.when(last, "").otherwise(answer).alias("intermediate_answer"),
        )

    rows = df.withColumns({"turns": F.transform("hops", turn), "facts": F.transform("hops", fact)})
    start = lambda t: F.greatest(F.lit(0), t - max(window - 1, 0))
    gone = F.filter("facts", lambda f: f["first_available_at_hop"] < start(f["needed_at_hop"]))
    files = F.transform("turns", lambda t: F.concat_ws("\n\n", F.transform(t["documents"], lambda d: F.concat(F.lit("--- "), d["title"], F.lit(" ---\n"), d["text"]))))
    total = F.aggregate(F.flatten(F.transform("turns", lambda t: t["documents"])), F.lit(0), lambda a, d: a + F.size(X.space_words(d["text"])))
    rows = rows.withColumns({"required": F.transform(gone, lambda f: f["fact_id"]), "files": files, "tokens": total})
    return rows.where(F.size("required") > 0)


def rubric(answer: Column, facts: Column, contradictions: Column) -> Column:
    """What an answer is judged by, of facts as ``structural`` gives them and claims (contradicted_claim, wrong_claim)."""
    claims = F.transform(contradictions, lambda c: F.coalesce(F.nullif(c["contradicted_claim"], F.lit("")), F.nullif(c["wrong_claim"], F.lit(""))))
    span = lambda f: f["retention_span"] > 0
    return F.struct(
        answer.alias("expected_answer"),
        F.transform(F.filter(facts, lambda f: ~f["is_discoverable"]), lambda f: f["content"]).alias("retention_facts"),
        F.filter(claims, lambda c: c.isNotNull()).alias("noise_contradictions"),
        F.transform(F.filter(facts, lambda f: f["intermediate_answer"] != ""), lambda f: F.struct(f["needed_at_hop"].alias("hop"), f["intermediate_answer"].alias("answer"))).alias("per_hop_answers"),
        F.transform(F.filter(facts, lambda f: (f["fact_type"] == "bridge_fact") & span(f)), lambda f: F.struct(f["fact_id"], f["first_available_at_hop"].alias("from_hop"), f["needed_at_hop"].alias("to_hop"))).alias("bridge_dependencies"),
        F.transform(F.filter(facts, span), lambda f: F.struct(f["fact_id"], f["retention_span"])).alias("temporal_facts"),
    )


def compared(runs: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """A run left joined with the baseline: capability_win, regression, both or neither, and the ratio of tokens."""
    b = base.select(key, F.col("resolved").alias("base_resolved"), F.col("tokens").alias("base_tokens"))
    now, then = F.coalesce("resolved", F.lit(False)), F.coalesce("base_resolved", F.lit(False))
    outcome = F.when(now & then, "both").when(now, "capability_win").when(then, "regression").otherwise("neither")
    return runs.join(b, key, "left").select(key, outcome.alias("outcome"), F.try_divide("tokens", "base_tokens").alias("token_ratio"))


def similar_instances(df: DataFrame, key: str, text: str, k: int, most: int) -> DataFrame:
    """For each instance the k others that share the most words (one at least), ties by key; counts are those of all words.

    Pairs that share a word of at most ``most`` instances are compared first.  Other pairs share commoner words only: where the k-th
    best so far shares t words, one that shares t of an instance's c common words has one of its c - t + 1 rarest, so only those are
    joined, and none where c < t.  ``most`` moves work between the two steps and doesn't change the result."""
    rows = df.select(key, F.array_distinct(X.terms(F.col(text))).alias("w"))
    words = rows.select(key, F.explode("w").alias("word"))
    known = words.join(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word")
    near, common = known.where(F.col("n") <= most), known.where(F.col("n") > most)
    other = lambda x: x.select("word", F.col(key).alias("b"))
    sets = rows.select(F.col(key).alias("a"), F.col("w").alias("wa"))

    def scored(asked: DataFrame, of: DataFrame) -> DataFrame:
        pairs = asked.select("word", F.col(key).alias("a")).join(other(of), "word").where("a <> b").select("a", "b").distinct()
        both = pairs.join(sets, "a").join(rows.select(F.col(key).alias("b"), F.col("w").alias("wb")), "b")
        return both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"))

    def best(x: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("shared").desc(), "b"))
        return x.withColumn("rank", rank).where(F.col("rank") <= k)

    first = cut(best(scored(near, near)))
    bound = first.where(F.col("rank") == k).select(F.col("a").alias(key), F.col("shared").alias("t"))
    # 1 for the commonest word of an instance: the places from t on are its rarest c - t + 1
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "word"))
    asked = common.withColumn("place", place).join(bound, key, "left").where(F.col("place") >= F.coalesce("t", F.lit(1)))
    found = best(first.drop("rank").union(scored(asked, common)).distinct())
    return found.select(F.col("a").alias(key), F.col("b").alias("other"), "shared", "rank")


def binned(df: DataFrame, group: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Sequential bins: a bin is closed when the next item would pass the budget; the last of ``most`` bins takes all the rest."""
    from palimpsest.operators.sets import in_order

    def step(state: list, n: int) -> int:
        full = state[1] > 0 and state[1] + n > budget and state[0] < most - 1
        state[:] = [state[0] + 1, n] if full else [state[0], state[1] + n]
        return state[0]

    return in_order(df, group, order, size, lambda: [0, 0], step, "bin").select(group, F.col(order).cast("long").alias(order), "bin")


def padded_sample(pool: DataFrame, wanted: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows (key, n) ask for n items of the pool (kind, item), in a seeded order for each key and without repeats; where the pool is shorter it starts anew."""
    from palimpsest.operators.sets import draw

    rank = F.row_number().over(Window.partitionBy(key).orderBy(draw(F.concat_ws("/", key, "item"), seed), "item"))
    rows = wanted.join(pool, "kind").withColumn("r", rank).withColumn("size", F.count("*").over(Window.partitionBy(key)))
    times = F.ceil(F.col("n") / F.col("size")).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0))))).withColumn("place", F.col("k") * F.col("size") + F.col("r"))
    return rows.where("place <= n").select(key, F.concat(F.lit("DP"), F.col("place")).alias("name"), "item")


def substituted(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Whole words replaced by a dictionary whatever their case, longest first, in one scan (what is put in isn't looked at again)."""
    if not names:
        return df
    ship(df.sparkSession)
    low = {k.lower(): v for k, v in names.items()}
    pattern = r"(?i)\b(" + "|".join(map(re.escape, sorted(low, key=lambda k: (-len(k), k)))) + r")\b"

    def run(texts: pd.Series) -> pd.Series:
        return texts.str.replace(re.compile(pattern), lambda m: low[m[0].lower()], regex=True)

    return df.withColumn(column, F.pandas_udf(run, "string")(column))


def recent_screens(df: DataFrame, window: int) -> DataFrame:
    """Rows (conv, pos, screen): screenshots stay with the last messages only."""
    back = F.count("*").over(Window.partitionBy("conv")) - F.col("pos")
    return df.withColumn("screen", F.when(back <= window, F.col("screen")))


def placed_facts(df: DataFrame) -> DataFrame:
    """Rows (inst, facts array<string>, files array<struct<name, content>>): files that hold the first 40 characters of a fact (of ten at
    least), the largest share of facts in one file, and whether two files at least hold some."""
    heads = F.filter(F.transform("facts", lambda f: F.substring(F.trim(f), 1, 40)), lambda f: F.length(f) >= 10)
    rows = df.withColumn("heads", heads)
    counts = F.transform("files", lambda f: F.size(F.filter("heads", lambda h: F.contains(f["content"], h))))
    rows = rows.withColumn("counts", F.filter(counts, lambda n: n > 0))
    total = F.aggregate("counts", F.lit(0), lambda a, n: a + n)
    return rows.select("inst", F.size("counts").alias("n_files"), F.coalesce(F.try_divide(F.array_max("counts"), total), F.lit(0.0)).alias("concentration"), (F.size("counts") >= 2).alias("passed"))


def scores(df: DataFrame, group: str) -> DataFrame:
    """Rows (group, recalled, critical, external, score): recall over all facts, over critical and over external ones, share of answers from .5 on."""
    share = lambda c: F.coalesce(F.try_divide(F.count_if(F.col("recalled") & c), F.count_if(c)), F.lit(0.0))
    return df.groupBy(group).agg(share(F.lit(True)).alias("recall"), share(F.col("critical")).alias("critical_recall"), share(F.col("external")).alias("external_recall"), F.avg((F.col("score") >= 0.5).cast("double")).alias("qa_accuracy"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table for each row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def callers(files: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """Rows (inst, path, content) and (inst, name): the first lines that call each name and don't define it."""
    lines = files.select("inst", "path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    calls = lines.select("inst", "path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\("), 1))).alias("name"))
    hits = calls.join(names, ["inst", "name"]).where(~F.regexp_like("text", F.lit(r"^\s*(?:def|class)\s")))
    rank = F.row_number().over(Window.partitionBy("inst", "name").orderBy("path", "line"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("inst", "name", "path", "line", F.trim("text").alias("text"))
