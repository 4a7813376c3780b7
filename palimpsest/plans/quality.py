"""Gate, check and funnel queries; scores are deterministic functions of rows, as an injected scorer's would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import quality as Q
from palimpsest.plans.registry import query, table

SCORES = "(o_orderkey % 11) / 10.0::DOUBLE AS a, (o_orderkey % 7) / 10.0::DOUBLE AS b, (o_orderkey % 5) / 10.0::DOUBLE AS c"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (k % 11 / 10.0).alias("a"), (k % 7 / 10.0).alias("b"), (k % 5 / 10.0).alias("c"))


@query(f"WITH s AS (SELECT o_orderkey, o_orderstatus, {SCORES} FROM orders) SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN a > 0 AND b = 0 ELSE a >= 0.4 AND a > b + 0.30::DOUBLE END AS accepted, CASE WHEN a < 0.5 THEN 'broken' WHEN b >= 0.4 AND c >= 0.3 THEN 'confusable_and_leaky' WHEN b >= 0.4 THEN 'confusable' WHEN c >= 0.3 THEN 'leaky' ELSE 'valid' END AS verdict, CASE WHEN a >= 0.5 THEN 'parametric=' || printf('%.2f', a) WHEN b >= 0.6 THEN 'partial=' || printf('%.2f', b) END AS reason FROM s")
def verification_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return scores(spark, sf_dir).select("o_orderkey", Q.accepted(a, b, F.col("o_orderstatus") == "O").alias("accepted"), Q.verdict(a, b, c).alias("verdict"), Q.prescreen(a, b).alias("reason"))


@query("SELECT l_orderkey, count(*) AS hops, count(*) >= 2 AND count(*) FILTER (l_returnflag <> 'N') >= 2 AND bool_or(l_linestatus = 'F') AND length(max(l_returnflag || l_linestatus)) >= 2 AND length(string_agg(l_returnflag || l_linestatus || '-----------')) >= 30 AS kept FROM lineitem GROUP BY 1")
def multi_hop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("l_returnflag", "l_linestatus")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("hops"), F.count_if(F.col("l_returnflag") != "N").alias("supporting"), F.bool_or(F.col("l_linestatus") == "F").alias("answerable"),
        F.max(both).alias("answer"), (F.count("*") * 14 - 1).alias("length"),
    )
    return g.select("l_orderkey", "hops", Q.multi_hop_gate(F.col("answerable"), F.col("hops"), F.col("supporting"), F.col("answer"), F.repeat(F.lit("x"), F.col("length").cast("int"))).alias("kept"))


FACTS = """WITH f AS (SELECT l_orderkey, list({'d': CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag = 'N' END, 'r': CASE WHEN l_linestatus = 'F' THEN 'critical' ELSE 'minor' END}) AS facts, list([l_linenumber - 1, l_linenumber]) AS hunks, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
"""


@query(FACTS + "SELECT l_orderkey, len(list_filter(facts, lambda f: NOT coalesce(f.d, true) AND f.r = 'critical')) >= 2 AS gate, CASE WHEN len(list_filter(facts, lambda f: NOT coalesce(f.d, true))) = 0 THEN 'easy' WHEN len(facts) >= 3 THEN 'hard' ELSE 'medium' END AS difficulty, (len(list_distinct(flatten(hunks))) / n)::DOUBLE AS coverage, (len(list_filter(list_distinct(flatten(hunks)), lambda h: h >= 0 AND h < n)) / n)::DOUBLE AS coverage_in_range FROM f")
def fact_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.struct(F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_returnflag") == "N").alias("discoverable"), F.when(F.col("l_linestatus") == "F", "critical").otherwise("minor").alias("relevance"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(f).alias("facts"), F.collect_list(F.array(F.col("l_linenumber") - 1, F.col("l_linenumber"))).alias("hunks"), F.max("l_linenumber").alias("n"))
    both = Q.hunk_coverage(F.col("hunks"), F.col("n"))
    return g.select("l_orderkey", Q.fact_gate(F.col("facts")).alias("gate"), Q.difficulty(F.transform("facts", lambda x: x["discoverable"]), F.size("facts")).alias("difficulty"), both[0].alias("coverage"), both[1].alias("coverage_in_range"))


CHECKS = f"""WITH s AS (SELECT o_orderkey, {SCORES} FROM orders), c AS (SELECT o_orderkey, 'answer' AS "check", a >= 0.4 AS passed FROM s UNION ALL SELECT o_orderkey, 'gap', a - b >= 0.30::DOUBLE FROM s UNION ALL SELECT o_orderkey, 'leak', c < 0.3 FROM s)
"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.long_checks(scores(spark, sf_dir), "o_orderkey", {"answer": F.col("a") >= 0.4, "gap": F.col("a") - F.col("b") >= 0.30, "leak": F.col("c") < 0.3})


@query(CHECKS + ', u AS (SELECT "check", passed FROM c UNION ALL SELECT \'all\', bool_and(passed) FROM c GROUP BY o_orderkey) SELECT "check", count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed) / count(*) AS rate FROM u GROUP BY 1')
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_report(checked(spark, sf_dir), "o_orderkey")


@query("WITH l AS (SELECT 'l_quantity' AS measure, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem) SELECT measure, min(x) AS least, quantile_cont(x, 0.5) AS median, round(avg(x), 6) AS mean, max(x) AS most FROM l GROUP BY 1")
def report_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.measures(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@query(f"WITH s AS (SELECT {SCORES} FROM orders), n AS (SELECT count(*) AS n0, count(*) FILTER (a >= 0.4) AS n1, count(*) FILTER (a >= 0.4 AND b < 0.3) AS n2, count(*) FILTER (a >= 0.4 AND b < 0.3 AND c < 0.3) AS n3 FROM s) SELECT 0 AS step, 'loaded' AS name, n0 AS n, 1.0::DOUBLE AS rate FROM n UNION ALL SELECT 1, 'answered', n1, n1 / n0 FROM n UNION ALL SELECT 2, 'not_confused', n2, coalesce(n2 / nullif(n1, 0), 0) FROM n UNION ALL SELECT 3, 'not_leaked', n3, coalesce(n3 / nullif(n2, 0), 0) FROM n")
def triage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.funnel(scores(spark, sf_dir), {"answered": F.col("a") >= 0.4, "not_confused": F.col("b") < 0.3, "not_leaked": F.col("c") < 0.3})


@query("SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN turn % 3 = 1 THEN ' Which check was Added in the diff?' WHEN turn % 3 = 2 THEN ' See @@ 1' ELSE '' END), '" + "|".join(Q.LEAKY) + "') AS leaky FROM conversations")
def leaky_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, two of three with an end that gives the answer away."""
    end = F.when(F.col("turn") % 3 == 1, " Which check was Added in the diff?").when(F.col("turn") % 3 == 2, " See @@ 1").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.leaky(F.concat("text", end)).alias("leaky"))


@query("WITH c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS said, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'assistant'), '')) AS asked FROM conversations GROUP BY 1), i AS (SELECT conv_id, asked, list_distinct(regexp_extract_all(said, '[A-Za-z_][A-Za-z0-9_.]{11,}')) AS idents FROM c) SELECT conv_id, len(idents) AS n, len(list_filter(idents, lambda x: contains(asked, lower(x)))) AS n_leaked FROM i")
def keyword_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long identifiers of a conversation's answers that stand in its questions."""
    from palimpsest.functions.text import identifiers

    said = lambda c: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda x: x["text"]))
    answer = F.col("role") == "assistant"
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(answer).alias("said"), F.lower(said(~answer)).alias("asked"))
    c = c.select("conv_id", "asked", identifiers(F.col("said"), 12).alias("i"))
    return c.select("conv_id", F.size("i").cast("long").alias("n"), F.size(F.filter("i", lambda x: F.contains(F.col("asked"), F.lower(x)))).cast("long").alias("n_leaked"))


@query("SELECT doc_id, n_chars % 600 >= 8 AND n_chars % 600 <= 500 AND doc_id % 4 >= 2 AND doc_id % 5 >= 2 AND length(coalesce(text, '')) >= 200 AS passes FROM documents")
def patch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes made of numbers of documents, the text as the problem."""
    docs = table(spark, sf_dir, "documents")
    passes = Q.patch_gate(F.col("n_chars") % 600, F.col("doc_id") % 4, F.col("doc_id") % 5, F.coalesce("text", F.lit("")))
    return docs.select("doc_id", passes.alias("passes"))


@query("SELECT lang, 'checkpoint-' || max(doc_id) AS name FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the checkpoint with the highest number; names without a number don't count."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    names = docs.select("lang", F.explode(F.array(F.concat(F.lit("checkpoint-"), "doc_id"), F.lit("final"))).alias("name"))
    return Q.latest_checkpoint(names, "name", ["lang"])


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (place % 3 <> 1) AS siblings FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) GROUP BY conv_id")
def hop_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose place isn't among the supporting ones (1, 4, 7, ...)."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    supporting = F.filter(F.sequence(F.lit(0), F.size("turns")), lambda i: i % 3 == 1)
    left = F.transform(Q.siblings(F.col("turns"), supporting), lambda t: t.cast("string"))
    return rows.select("conv_id", F.when(F.size(left) > 0, F.concat_ws(",", left)).alias("siblings"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'haiku' WHEN doc_id % 4 = 1 THEN 'gptoss' WHEN doc_id % 4 = 2 THEN 'sonnet' ELSE lower(split_part(coalesce(source, 'none'), '_', 1)) END AS family FROM documents")
def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of runs, made of ids and sources."""
    name = F.when(F.col("doc_id") % 4 == 0, "Haiku45_run").when(F.col("doc_id") % 4 == 1, "gpt-oss_x_y").when(F.col("doc_id") % 4 == 2, "sonnet4").otherwise(F.concat(F.upper(F.coalesce("source", F.lit("none"))), F.lit("_run")))
    return table(spark, sf_dir, "documents").select("doc_id", X.source_model(name).alias("family"))
