"""Set operations, splits, samples, budgets and clusters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cluster import ship
from palimpsest.operators.ranking import running


def first_wins(sources: list[DataFrame], key: Column, order: str) -> DataFrame:
    """The union of sources of falling priority; of rows with an equal key the first one stays."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = Window.partitionBy("__k").orderBy("source_rank", order)
    return rows.withColumn("__k", key).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__k")


def cascade(sources: list[DataFrame], by: str, key: Column, order: str, n: int, extra: int = 2) -> DataFrame:
    """Up to n rows for each query ``by``: sources are asked one after the other, each for what is still missing and ``extra`` more, the
    first of these by order; rows with an empty key or one that is there already go.  Adds source_rank and place (from 1)."""
    found = None
    for rank, source in enumerate(sources):
        rows = source.withColumn("__k", key).withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(order)))
        if found is None:
            rows = rows.withColumn("__had", F.lit(0))
        else:
            rows = rows.join(found.groupBy(by).agg(F.count("*").alias("__had")), by, "left").fillna(0, ["__had"])
        rows = rows.where((F.col("__had") < n) & (F.col("__i") <= n - F.col("__had") + extra) & (F.col("__k") != ""))
        if found is not None:
            rows = rows.join(found.select(by, "__k"), [by, "__k"], "left_anti")
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__k").orderBy("__i"))).where("__r = 1")
        rows = rows.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy("__i")) + F.col("__had")).cast("int")).where(F.col("place") <= n)
        rows = rows.select(*source.columns, "__k", F.lit(rank).alias("source_rank"), "place")
        found = rows if found is None else found.unionByName(rows)
    return found.drop("__k")


def unseen(rows: DataFrame, done: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Rows whose key isn't done, with or without a prefix."""
    bare = F.regexp_replace(F.col(key).cast("string"), f"^{prefix}", "")
    return rows.withColumn("__k", bare).join(done.select(bare.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def splits(df: DataFrame, group: str, share: float = 0.1) -> DataFrame:
    """Whole groups in order of (size, name) go to eval while the rows so far are below int(total * share); the rest is train."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.floor(F.sum("n") * share).alias("wanted"))
    rows = running(counts, [F.col("n"), F.col(group)], {"so_far": F.col("n")}).crossJoin(F.broadcast(total))
    return rows.select(group, "n", F.when(F.col("so_far") - F.col("n") < F.col("wanted"), "eval").otherwise("train").alias("split"))


def manifest(split: DataFrame, group: str) -> DataFrame:
    """SHA-256 over all sorted lines "group tab split", their number, and the number of groups that are in more than one split.

    Lines are sorted by range and read by one task, which holds the digest's state only and never all lines."""
    lines = split.groupBy(group).agg(F.min("split").alias("split"), F.count_distinct("split").alias("splits"))
    lines = lines.select(F.concat(F.col(group), F.lit("\t"), F.col("split"), F.lit("\n")).alias("line"), (F.col("splits") > 1).alias("mixed"))

    def digest(batches):
        import hashlib

        import pyarrow as pa

        found, n, mixed = hashlib.sha256(), 0, 0
        for batch in batches:
            found.update("".join(batch.column(0).to_pylist()).encode())
            n, mixed = n + batch.num_rows, mixed + sum(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"sha256": [found.hexdigest()], "n_groups": [n], "n_mixed": [mixed]})

    return lines.orderBy("line").coalesce(1).mapInArrow(digest, "sha256 string, n_groups long, n_mixed long")


def draw(key: Column, seed: int) -> Column:
    """A seeded order: md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_per(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each group, the first by a seeded order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("place", rank).where(F.col("place") <= n)


def interleaved(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of all groups in turn, n in all."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("place", place).orderBy("place", group).limit(n)


def until_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows in order while those before them are below the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < budget)


def in_order(df: DataFrame, group: str, order: str, size: str, start: Callable[[], list], step: Callable[[list, int], int], out: str) -> DataFrame:
    """Rows (group, order, size, out) with what a fold gives for each row of a group, in order (ties by size); a null size counts as 0.

    Rows are dealt by group, sorted on the disk if need be, and read once; a group's state is all that is held."""
    rows = df.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias(size))
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        none = object()
        last, state = none, start()
        for batch in batches:
            found = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != last:
                    last, state = g, start()
                found.append(step(state, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, out])

    return rows.repartition(group).sortWithinPartitions(group, order, size).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())]))


def packed(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy packing in order: what fits is taken, what doesn't is skipped; returns (group, taken, used)."""

    def step(state: list, n: int) -> int:
        fits = state[0] + n <= budget
        state[0] += n if fits else 0
        return int(fits)

    rows = in_order(df.where(F.col(size).isNotNull()), group, order, size, lambda: [0], step, "__taken")
    fits = F.col("__taken") == 1
    found = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.when(fits, F.col(order).cast("long")))).alias("taken"), F.sum(F.when(fits, F.col(size)).otherwise(0)).alias("used"))
    return found


def word_set(c: Column) -> Column:
    """Distinct lower-cased words of more than three characters without punctuation around them."""
    words = F.transform(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)))


def greedy_dedup(df: DataFrame, group: str, key: str, score: str, words: str, above: float = 0.7, cap: int = 5) -> DataFrame:
    """In order of falling score: a row stays if it shares at most ``above`` of the smaller word set with each kept one, ``cap`` a group; empty sets go."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(words).alias("w"))))
    start = F.array().cast(f"array<struct<k: {df.schema[key].dataType.simpleString()}, w: array<string>>>")
    near = lambda a, x: F.exists(a, lambda y: F.size(F.array_intersect(x["w"], y["w"])) > above * F.least(F.size(x["w"]), F.size(y["w"])))
    step = lambda a, x: F.when((F.size(x["w"]) == 0) | (F.size(a) >= cap) | near(a, x), a).otherwise(F.concat(a, F.array(F.struct(x["k"].alias("k"), x["w"].alias("w")))))
    kept = df.groupBy(group).agg(F.aggregate(rows, start, step).alias("kept"))
    return kept.select(group, F.explode(F.transform("kept", lambda x: x["k"])).alias(key))
