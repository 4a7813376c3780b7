"""Readers: JSON lines with bad rows counted, documents of several files merged, reports of several shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def parsed(lines: DataFrame, schema: str, required: list[str], action: str | None = None, line: str = "value") -> DataFrame:
    """JSON lines as rows with a status: ok, bad_json, bad_schema (a required field is missing) or empty_action."""
    kind = T.StructType([*schema_of(schema).fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.withColumn("__r", F.from_json(line, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("__r").isNull() | F.col("__r._corrupt").isNotNull()
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | F.col(f"__r.{name}").isNull()
    empty = F.lit(False) if action is None else F.trim(F.col(f"__r.{action}")) == ""
    status = F.when(broken, "bad_json").when(lacks, "bad_schema").when(empty, "empty_action").otherwise("ok")
    return rows.withColumn("status", status).select(*lines.columns, "status", *[F.col(f"__r.{f.name}").alias(f.name) for f in schema_of(schema).fields])


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, required: list[str], action: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of JSON-lines files with status, file and the folder that it lies in; strict: a row that isn't ok fails the query."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    rows = parsed(text, schema, required, action).withColumn("folder", F.element_at(F.split("file", "/"), -2))
    if not strict:
        return rows
    return rows.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat(F.col("status"), F.lit(" in "), F.col("file"))).cast("string")))


def prompts(rows: DataFrame) -> DataFrame:
    """Evaluation rows: prompt, else input; rows with neither go; label as int, and a row without one fails the query."""
    label = F.when(F.col("label").isNull(), F.raise_error(F.lit("a row has no label")).cast("int")).otherwise(F.col("label").cast("int"))
    prompt = F.coalesce(F.nullif("prompt", F.lit("")), F.nullif("input", F.lit("")))
    return rows.withColumn("prompt", prompt).where("prompt IS NOT NULL").withColumn("label", label).drop("input")


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of documents by key; of each field the first one that isn't null, in the order of the parts."""
    fields = list(dict.fromkeys(c for p in parts for c in p.columns if c != key))
    rows = parts[0]
    tagged = [p.select(key, *[F.col(c).alias(f"__{i}_{c}") for c in p.columns if c != key]) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.join(p, key, "full")
    return rows.select(key, *[F.coalesce(*[F.col(f"__{i}_{c}") for i, p in enumerate(parts) if c in p.columns]).alias(c) for c in fields])


def resolved(reports: DataFrame) -> DataFrame:
    """Rows (id, resolved) of reports with arrays resolved_ids, unresolved_ids and error_ids: true wins, errors count only for ids in neither."""
    each = lambda c, rank, value: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda i: F.struct(i.alias("id"), F.lit(rank).alias("rank"), F.lit(value).alias("resolved")))
    rows = reports.select(F.explode(F.concat(each("resolved_ids", 0, True), each("unresolved_ids", 1, False), each("error_ids", 2, False))).alias("r")).select("r.*")
    return rows.groupBy("id").agg(F.min_by("resolved", "rank").alias("resolved"))


def resolved_set(reports: DataFrame) -> DataFrame:
    """Rows (report, id, resolved) of all that each report's run completed.

    Of three shapes the first one that a report has counts: resolved_ids (with completed_ids and unresolved_ids), instance_results
    (a reward of 1.0 or more), results (resolved); a report without any fails the query."""
    none = F.array().cast("array<string>")
    flag = lambda c, value: F.transform(F.coalesce(c, none), lambda i: F.struct(i.alias("id"), F.lit(value).alias("resolved")))
    lists = F.concat(flag(F.col("resolved_ids"), True), flag(F.col("completed_ids"), False), flag(F.col("unresolved_ids"), False))
    rewards = F.transform("instance_results", lambda r: F.struct(r["instance_id"].alias("id"), (F.coalesce(r["reward"], F.lit(0.0)) >= 1.0).alias("resolved")))
    flags = F.transform("results", lambda r: F.struct(r["instance_id"].alias("id"), F.coalesce(r["resolved"], F.lit(False)).alias("resolved")))
    unknown = F.raise_error(F.concat(F.lit("report of unknown shape: "), F.col("report").cast("string")))
    found = F.when(F.col("resolved_ids").isNotNull(), lists).when(F.col("instance_results").isNotNull(), rewards).when(F.col("results").isNotNull(), flags).otherwise(unknown)
    return reports.select("report", F.explode(found).alias("r")).groupBy("report", "r.id").agg(F.max("r.resolved").alias("resolved"))


def latest_resolved(reports: DataFrame) -> DataFrame:
    """Rows (id, resolved) of reports in order of ``place``: what is written later holds, in a report first resolved_ids, then
    unresolved_ids; error_ids make an id false only if nothing else is said of it.  A report without resolved_ids has results with a reward (above 0)."""
    none = F.array().cast("array<string>")
    each = lambda c, step, value: F.transform(F.coalesce(c, none), lambda i: F.struct(i.alias("id"), F.lit(step).alias("step"), F.lit(value).alias("resolved")))
    lists = F.concat(each(F.col("resolved_ids"), 1, True), each(F.col("unresolved_ids"), 2, False), each(F.col("error_ids"), 0, False))
    legacy = F.transform("results", lambda r: F.struct(r["instance_id"].alias("id"), F.lit(1).alias("step"), (F.coalesce(r["reward"], F.lit(0.0)) > 0).alias("resolved")))
    rows = reports.select("place", F.explode(F.when(F.col("resolved_ids").isNotNull(), lists).otherwise(legacy)).alias("r")).select("place", "r.*").where("id <> ''")
    # errors come before all places
    return rows.groupBy("id").agg(F.max_by("resolved", F.struct(F.col("step") > 0, "place", "step")).alias("resolved"))


# What a report's file name has, and what it doesn't have.
REPORT = "reeval"
NO_REPORT = r"_training|_replay|_forked|\.traj|summary|preds"


def newest_report(rows: DataFrame) -> DataFrame:
    """Rows (id, resolved) of the file that changed last, of rows (name, changed, id, resolved) of many files; only files named as reports count."""
    rows = rows.where(F.contains("name", F.lit(REPORT)) & ~F.regexp_like("name", F.lit(NO_REPORT)))
    last = rows.agg(F.max_by("name", F.struct("changed", "name")).alias("last"))
    return rows.join(F.broadcast(last), F.col("name") == F.col("last")).select("id", "resolved")


def graded(rows: DataFrame) -> DataFrame:
    """Rows (id, resolved) of a run's own rewards: 0.5 or more."""
    return rows.select("id", (F.coalesce("reward", F.lit(0.0)) >= 0.5).alias("resolved"))


def first_source(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any, with its place as ``authority``."""
    tagged = [s.withColumn("authority", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.join(F.broadcast(rows.agg(F.min("authority").alias("authority"))), "authority").select(*sources[0].columns, "authority")


def by_authority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Of sources in order of authority, the first one's value for each key."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(key, value, F.lit(i).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min_by(value, "rank").alias(value), F.min("rank").alias("authority"))


def from_inverted(index: Column) -> Column:
    """The text of a map from words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.concat_ws(" ", F.transform(F.array_sort(places), lambda x: x["w"]))


def articles(xml: DataFrame, column: str) -> DataFrame:
    """Rows (ident, title, abstract, year) of XML article lists: entities are undone, an element's text goes to its first child,
    labelled parts of an abstract are "label: text", joined by spaces.  An article that isn't XML fails the query."""
    one = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<PubmedArticle\b[^>]*>.*?</PubmedArticle>"), 0)).alias("__article")
    rows = xml.select(*[c for c in xml.columns if c != column], one)
    first = lambda c, path: F.xpath_string(c, F.lit(f"({path})[1]/node()[1][self::text()]"))
    parts = F.regexp_extract_all("__article", F.lit(r"(?s)<AbstractText\b(?:[^>]*/>|.*?</AbstractText>)"), 0)

    def part(p: Column) -> Column:
        label = F.xpath_string(p, F.lit("/AbstractText/@Label"))
        return F.concat(F.when(label == "", label).otherwise(F.concat(label, F.lit(": "))), first(p, "/AbstractText"))

    year = F.nullif(first(F.col("__article"), "//PubDate/Year"), F.lit("")).cast("int")
    return rows.select(
        *[c for c in xml.columns if c != column], first(F.col("__article"), "//PMID").alias("ident"), first(F.col("__article"), "//ArticleTitle").alias("title"), F.concat_ws(" ", F.transform(parts, part)).alias("abstract"), year.alias("year")
    )


def source_plan(spec: str, known: dict[str, DataFrame]) -> list[DataFrame]:
    """The sources of a spec like a+b+c, in that order."""
    names = [s.strip() for s in spec.split("+") if s.strip()]
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown sources {unknown}; known are {sorted(known)}")
    return [known[n] for n in names]
