"""Writers: JSON lines, rows routed by a manifest, append-only checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, extra: DataFrame | None = None, key: str | None = None) -> None:
    """JSON lines; further fields come from another table, by key and never by position."""
    if extra is not None:
        rows = rows.join(extra, key, "left")
    rows.write.json(path)


def read_examples(spark, path: str, schema: str) -> DataFrame:
    """The rows again, with label 1 and weight 1.0 where they are missing."""
    return spark.read.schema(schema).json(path).withColumns({"label": F.coalesce("label", F.lit(1)), "weight": F.coalesce("weight", F.lit(1.0))})


def route(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Adds the split of the manifest; unknown where it has none."""
    return rows.join(manifest.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def write_routed(rows: DataFrame, manifest: DataFrame, key: str, path: str) -> None:
    """One folder for each split."""
    route(rows, manifest, key).write.partitionBy("split").json(path)


def append_new(rows: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Appends the first row of each key that isn't done."""
    rows.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key]).write.mode("append").json(path)


def concise(rows: DataFrame, episode: str, order: str, line: str) -> DataFrame:
    """Episodes as arrays of role and content, of lines "role: content"; others go."""
    pattern = r"(?s)^(.*?): (.*)$"
    rows = rows.where(F.regexp_like(line, F.lit(pattern))).select(episode, F.struct(order, F.regexp_extract(line, pattern, 1).alias("role"), F.regexp_extract(line, pattern, 2).alias("content")).alias("m"))
    return rows.groupBy(episode).agg(F.array_sort(F.collect_list("m")).alias("m")).select(episode, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
