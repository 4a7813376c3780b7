"""Registries of context strategies and instance transforms, and plans with injected scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.cluster import ship
from palimpsest.operators import context as C

Strategy = Callable[..., DataFrame]

_STRATEGIES: dict[str, Strategy] = {}


def register(name: str) -> Callable[[Strategy], Strategy]:
    """Registers a function from messages to the messages that an agent sees; names don't depend on case."""

    def put(f: Strategy) -> Strategy:
        _STRATEGIES[name.lower()] = f
        return f

    return put


def strategy(name: str) -> Strategy:
    if name.lower() not in _STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known are {strategies()}")
    return _STRATEGIES[name.lower()]


def strategies() -> list[str]:
    return sorted(_STRATEGIES)


for _name, _f in (("passthrough", C.pass_through), ("observation_masking", C.masked), ("adaptive_token_budget", C.adaptive_budget), ("llm_summarizing", C.condensed), ("sliding_window_summary", C.sliding_window), ("naive_summarization", C.naive_summary)):
    register(_name)(_f)


def pipeline(df: DataFrame, stages: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Strategies one after another, each on the messages that the one before left, placed anew."""
    for stage in stages:
        df = stage(df).select("conv", F.col("ord").alias("pos"), "role", "content")
    return df.withColumn("ord", F.col("pos"))


def with_scores(df: DataFrame, score: Callable, column: str, out: str) -> DataFrame:
    """Adds the scores that a Python function gives for batches (a pandas Series) of a column, by a pandas UDF."""
    ship(df.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return score(texts)

    return df.withColumn(out, F.pandas_udf(run, "double")(column))


#: Presets of transforms, from easy to hard.
PRESETS = {"easy": (), "medium": ("scale_distractors",), "hard": ("scale_distractors", "place_contradictions")}


def scale_distractors(docs: DataFrame, factor: float = 1.5) -> DataFrame:
    """Rows (inst, pos, kind): the first int(n * (factor - 1)) distractors of an instance come a second time, at the end."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("inst").orderBy("pos"))
    n = F.count("*").over(Window.partitionBy("inst"))
    more = docs.where("kind = 'distractor'").withColumns({"r": rank, "n": n}).where(F.col("r") <= F.floor(F.col("n") * (factor - 1)))
    last = docs.groupBy("inst").agg(F.max("pos").alias("last"))
    return docs.unionByName(more.join(last, "inst").select(*[(F.col("last") + F.col("r")).cast(docs.schema["pos"].dataType).alias("pos") if c == "pos" else F.col(c) for c in docs.columns]))


def place_contradictions(docs: DataFrame) -> DataFrame:
    """Rows (inst, pos, kind, turn, entity): distractors of the entity of a fact go one turn later, up to the last one."""
    from pyspark.sql import Window

    last = F.max("turn").over(Window.partitionBy("inst"))
    about = F.max((F.col("kind") == "fact").cast("int")).over(Window.partitionBy("inst", "entity")) == 1
    moved = F.when((F.col("kind") == "distractor") & about, F.least(F.col("turn") + 1, last)).otherwise(F.col("turn"))
    return docs.withColumn("turn", moved)


def harden(docs: DataFrame, preset: str) -> DataFrame:
    """The transforms of a preset, in order."""
    for name in PRESETS[preset]:
        docs = docs.transform({"scale_distractors": scale_distractors, "place_contradictions": place_contradictions}[name])
    return docs
