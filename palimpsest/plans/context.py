"""Context queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import context as C
from palimpsest.plans.registry import query, table

BASE = """WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, coalesce(text, '') AS content FROM conversations),
p AS (SELECT *, count(*) OVER (PARTITION BY conv) AS n, count(*) OVER (PARTITION BY conv) - pos AS back, length(content) // 4 AS tok FROM m)
"""
#: Of rows k (conv, part, pos, role, content): the summary of part 1 between the others.
SUMMED = """, s AS (SELECT conv, 1 AS part, NULL::BIGINT AS pos, 'user' AS role, substr(string_agg(role || ': ' || substr(content, 1, 200), chr(10) ORDER BY pos), 1, {cap}) AS content FROM k WHERE part = 1 GROUP BY conv),
 u AS (SELECT conv, part, pos, role, content FROM k WHERE part <> 1 UNION ALL SELECT * FROM s),
 o AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY part, pos) - 1 AS ord, pos, role, content FROM u)
"""
CLASSED = """, q AS (SELECT *, pos < {first} OR coalesce(pos = min(CASE WHEN role = 'user' AND pos >= {first} THEN pos END) OVER (PARTITION BY conv), false) AS pinned FROM p),
 c AS (SELECT *, CASE WHEN pinned THEN 0 WHEN row_number() OVER (PARTITION BY conv, pinned ORDER BY pos DESC) <= {recent} THEN 2 ELSE 1 END AS cls FROM q)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn")) - 1
    return rows.select("conv", place.cast("long").alias("pos"), "role", "content")


@query(BASE + "SELECT conv, pos AS ord, pos, role, content, sum(tok) OVER (PARTITION BY conv ORDER BY pos)::BIGINT AS tokens_so_far FROM p")
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pass_through(messages(spark, sf_dir))


@query(BASE + f", k AS (SELECT *, role IN ('user', 'tool') AND pos >= 1 AND back > 2 AND NOT regexp_matches(content, '{C.ERRORS}') AS was_masked FROM p) SELECT conv, pos AS ord, pos, role, CASE WHEN was_masked THEN '<MASKED>' ELSE content END AS content, was_masked FROM k")
def observation_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.masked(messages(spark, sf_dir), 1, 2)


@query(BASE + CLASSED.format(first=1, recent=2) + ", k AS (SELECT *, CASE WHEN sum(tok) OVER (PARTITION BY conv) > 300 THEN cls ELSE 0 END AS part FROM c)" + SUMMED.format(cap=2000) + "SELECT * FROM o")
def adaptive_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.adaptive_budget(messages(spark, sf_dir), 300)


WINDOWED = BASE + ", k AS (SELECT *, CASE WHEN pos < 1 THEN 0 WHEN back <= 2 THEN 2 ELSE 1 END AS part FROM p)" + SUMMED.format(cap=1000)


@query(WINDOWED + "SELECT * FROM o")
def sliding_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sliding_window(messages(spark, sf_dir), 2)


@query(WINDOWED + ", a AS (SELECT conv, count(*) AS original_msgs, sum(tok)::BIGINT AS original_tokens FROM p GROUP BY conv), b AS (SELECT conv, count(*) AS filtered_msgs, sum(length(content) // 4)::BIGINT AS filtered_tokens, bool_or(pos IS NULL) AS was_compacted FROM o GROUP BY conv) SELECT *, original_tokens / greatest(filtered_tokens, 1) AS compression_ratio FROM a LEFT JOIN b USING (conv)")
def window_compaction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each conversation before and after a sliding window with summary."""
    rows = messages(spark, sf_dir)
    return C.stats(rows, C.sliding_window(rows, 2))


@query(BASE + ", k AS (SELECT *, CASE WHEN n <= 4 OR pos < 1 THEN 0 WHEN back <= 1 THEN 2 ELSE 1 END AS part FROM p)" + SUMMED.format(cap=2000) + "SELECT * FROM o")
def condensed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than four messages: head, summary, tail of max(1, int(4 * .5) - 1 - 1)."""
    return C.condensed(messages(spark, sf_dir), 4)


@query(BASE + ", z AS (SELECT *, sum(tok) OVER (PARTITION BY conv) > 200 AS over FROM p), k AS (SELECT *, 0 AS part FROM z WHERE NOT over UNION ALL SELECT *, 0 FROM z WHERE over AND pos < 1 UNION ALL SELECT *, 2 FROM z WHERE over AND back <= 3 UNION ALL SELECT *, 1 FROM z WHERE over AND pos >= 1 AND back > 3)" + SUMMED.format(cap=2000) + "SELECT * FROM o")
def naive_summarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.naive_summary(messages(spark, sf_dir), 200, 1, 3)


@query(BASE + ", r AS (SELECT DISTINCT conv, a AS start, b AS end_, 'gone ' || a AS summary, a AS off, a AS seq FROM p, (VALUES (1, 2), (2, 4)) v(a, b) WHERE n > 3), k AS (SELECT conv, pos, role, content, row_number() OVER (PARTITION BY conv ORDER BY pos) - 1 AS place, 1 AS late FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv = p.conv AND pos >= start AND pos < end_)), l AS (SELECT conv, NULL::BIGINT AS pos, 'user' AS role, max_by(summary, seq) AS content, max_by(off, seq) AS place, 0 AS late FROM r GROUP BY conv), u AS (SELECT * FROM k UNION ALL SELECT * FROM l) SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY place, late, pos) - 1 AS ord, pos, role, content FROM u")
def condensation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges [1, 2) and [2, 4) dropped, the last one's summary at its offset."""
    rows = messages(spark, sf_dir)
    long = rows.groupBy("conv").agg(F.count("*").alias("n")).where("n > 3")
    r = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((1, 2), (2, 4))])).alias("r")
    ranges = long.select("conv", r).select("conv", "r.*", F.concat(F.lit("gone "), F.col("r.start")).alias("summary"), F.col("r.start").alias("offset"), F.col("r.start").alias("seq"))
    return C.view(rows, ranges)


@query(BASE + "SELECT conv, pos, role, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 40) || chr(10) || '[...]' || chr(10) || right(content, 40) END AS content FROM p")
def truncated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("content", C.truncated(F.col("content"), 80))


@query(BASE + "SELECT conv, right(string_agg(content, chr(10) ORDER BY pos), 500) AS content FROM p GROUP BY conv")
def truncated_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_chars(messages(spark, sf_dir), 500)


@query(BASE + "SELECT conv, pos, role, content, list_sort(coalesce(list(pos) OVER (PARTITION BY conv ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])) AS before, list_sort(coalesce(list(pos) OVER (PARTITION BY conv ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])) AS after FROM p QUALIFY role = 'assistant' AND length(content) > 400")
def compaction_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return C.neighbours(rows, (F.col("role") == "assistant") & (F.length("content") > 400), 3)


@query("WITH e AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type FROM events), f AS (SELECT *, event_type = 'error' AS now, lag(event_type = 'error', 1, false) OVER (PARTITION BY conv ORDER BY pos) AS was FROM e) SELECT conv, pos, event_type FROM f WHERE now AND NOT was")
def trigger_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising edges of the error flag in each user's events."""
    return C.rising(steps(spark, sf_dir).select("conv", "pos", "event_type"), F.col("event_type") == "error")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "conv")
    place = F.row_number().over(Window.partitionBy("conv").orderBy("ts", "event_id")) - 1
    return rows.select("conv", place.cast("long").alias("pos"), "event_id", "ts", "event_type", "value", "props")


@query(BASE + "SELECT conv, pos, role, content, back <= 2 AS retrieved FROM p WHERE back <= 3")
def simple_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(messages(spark, sf_dir), 3, 2)


@query(BASE + "SELECT conv, max_by(tok, pos) AS current, max(tok) AS largest, avg(tok) AS mean, coalesce((max_by(tok, pos) - min_by(tok, pos)) / nullif(max(pos) - min(pos), 0), 0)::DOUBLE AS rate FROM p GROUP BY conv")
def token_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.growth(messages(spark, sf_dir))


TOOLS = """WITH r(conv, pos, role, content, calls, call_id) AS (VALUES (1::BIGINT, 0::BIGINT, 'system', 's', NULL::VARCHAR[], NULL::VARCHAR), (1, 1, 'tool', 'orphan', NULL, 'a'), (1, 2, 'assistant', '', ['a', 'b'], NULL),
 (1, 3, 'tool', 'ra', NULL, 'a'), (1, 4, 'tool', 'rz', NULL, 'z'), (1, 5, 'assistant', '', ['c'], NULL), (1, 6, 'user', 'u', NULL, NULL))
"""


@query(TOOLS + "SELECT conv, pos, role, CASE WHEN pos = 5 THEN '(continued)' ELSE content END AS content, CASE pos WHEN 2 THEN ['a'] WHEN 5 THEN []::VARCHAR[] ELSE calls END AS calls, call_id FROM r WHERE pos NOT IN (1, 4)")
def tool_call_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture, as the tables have no tool messages; its result is stated."""
    rows = [(1, 0, "system", "s", None, None), (1, 1, "tool", "orphan", None, "a"), (1, 2, "assistant", "", ["a", "b"], None), (1, 3, "tool", "ra", None, "a"), (1, 4, "tool", "rz", None, "z"), (1, 5, "assistant", "", ["c"], None), (1, 6, "user", "u", None, None)]
    return C.repair_tool_calls(spark.createDataFrame(rows, "conv long, pos long, role string, content string, calls array<string>, call_id string"))


@query("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 0), (1, 1, 0), (1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 5, 2), (1, 6, 1), (1, 7, 2)) t(conv, pos, part)")
def whole_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated messages in head, middle and tail: answers stay with their calls."""
    rows = [(1, 0, 0, ["a"], None), (1, 1, 1, None, "a"), (1, 2, 1, ["b", "c"], None), (1, 3, 1, None, "c"), (1, 4, 2, None, "b"), (1, 5, 2, ["d"], None), (1, 6, 1, ["e"], None), (1, 7, 1, None, "d")]
    df = spark.createDataFrame(rows, "conv long, pos long, part int, calls array<string>, call_id string")
    return C.whole_calls(df).select("conv", "pos", "part")
