"""Queries of perturbations, prompts, spans and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import perturb as P
from palimpsest.plans.context import BASE, messages
from palimpsest.plans.registry import query, table

DRAWN = "md5(conv || '/' || pos || ':42')"


@query(BASE + f", z AS (SELECT *, pos >= 1 AND back > 2 AND n > 3 AS inner_ FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY conv, inner_ ORDER BY {DRAWN}, pos) AS rank FROM z) SELECT conv, pos, role, content FROM r WHERE NOT inner_ OR rank > greatest(1, floor(n * 0.2::DOUBLE))")
def random_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.random_drop(messages(spark, sf_dir))


@query(BASE + "SELECT conv, pos, role, content FROM p WHERE pos = 0 OR back <= 2")
def context_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_and_last(messages(spark, sf_dir), 2)


@query(BASE + ", b AS (SELECT conv, string_agg('[' || upper(role) || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY pos) AS p FROM p GROUP BY conv) SELECT conv, substr(p, 1, 24000) AS prompt, length(p) > 24000 AS truncated FROM b")
def memory_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rendered(messages(spark, sf_dir))


@query(BASE + ", x AS (SELECT conv, pos, sum(tok) OVER (PARTITION BY conv ORDER BY pos) AS prefix FROM p) SELECT conv, max(prefix)::BIGINT AS peak, sum(prefix)::BIGINT AS naive, count(*) AS steps, (sum(prefix) / nullif(max(prefix), 0))::DOUBLE AS ratio FROM x GROUP BY conv")
def replay_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_replay(messages(spark, sf_dir))


@query("WITH f AS (SELECT l_orderkey AS inst, l_linenumber AS hop, l_linenumber // 2 AS available, CASE WHEN l_linenumber > 1 THEN [l_linenumber - 1, l_linenumber // 2] ELSE [] END AS refs FROM lineitem), u AS (SELECT inst, hop AS by_, unnest(refs) AS hop FROM f), n AS (SELECT inst, hop, max(by_) AS needed FROM u GROUP BY ALL) SELECT inst, hop, available, needed, greatest(0, coalesce(needed, available) - available) AS retention FROM f LEFT JOIN n USING (inst, hop)")
def retention_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a fact must be kept; here a line refers to the one before it and the one at half its number."""
    n = F.col("l_linenumber")
    half = F.floor(n / 2).cast("int")
    refs = F.when(n > 1, F.array(n - 1, half)).otherwise(F.array().cast("array<int>"))
    return P.fact_spans(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inst"), n.alias("hop"), half.alias("available"), refs.alias("refs")))


@query("SELECT * FROM (VALUES (1, 2, 1), (1, 10, 1), (1, 11, 1), (1, 11, 10)) t(inst, hop, ref)")
def hop_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of stated questions; #10 also counts as #1."""
    rows = [(1, 1, "who #1"), (1, 2, "where was #1"), (1, 10, "when #1"), (1, 11, "why #10")]
    return P.hop_references(spark.createDataFrame(rows, "inst int, hop int, question string"))


@query(BASE + ", e AS (SELECT conv, 'user' AS role, 'herring ' || conv AS content FROM p WHERE pos = 0), x AS (SELECT e.conv, e.role, e.content, floor(('0x' || substr(md5(e.conv || '/' || e.content || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * greatest(1, n - 1)) + 0.5 AS at_ FROM e JOIN p ON p.conv = e.conv AND p.pos = 0), u AS (SELECT conv, role, content, pos::DOUBLE AS at_ FROM p UNION ALL SELECT * FROM x) SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY at_, content) - 1 AS pos, role, content FROM u")
def red_herrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message put at a seeded place inside each conversation."""
    m = messages(spark, sf_dir)
    extra = m.where("pos = 0").select("conv", F.lit("user").alias("role"), F.concat(F.lit("herring "), F.col("conv")).alias("content"))
    return P.inserted(m, extra)


@query("WITH r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS turn FROM documents) SELECT source, turn::INT AS turn, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1, 2")
def scaled_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source dealt over four turns in a round."""
    rows = P.spread(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4)
    return rows.groupBy("source", "turn").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("WITH g AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_true, max(c_acctbal) AS largest, sum(c_nationkey)::BIGINT AS total FROM customer GROUP BY 1) SELECT c_mktsegment, n, n_true, total, largest, (n / sum(n) OVER ())::DOUBLE AS share, round(n_true / n - sum(n_true) OVER () / sum(n) OVER (), 9) AS delta FROM g")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and shares by group, and the distance to the overall rate."""
    out = P.summary_rows(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal") > 0, F.col("c_nationkey"))
    largest = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("largest"))
    return out.drop("largest").join(largest, "c_mktsegment").withColumn("delta", F.round("delta", 9))


@query("SELECT e.event_id, p AS perturbation FROM events e, (VALUES ('drop'), ('redact'), ('noise')) v(p) WHERE event_type = 'error'")
def counterfactual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counterfactuals(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id"), ["drop", "redact", "noise"])


@query("SELECT o_orderkey, greatest(10, floor((o_orderkey % 60) * 0.5))::BIGINT AS max_size, greatest(500, floor((o_custkey % 4000) * 0.5))::BIGINT AS max_tokens, greatest(0.3::DOUBLE, (o_orderkey % 10) / 10.0::DOUBLE * 0.5) AS share FROM orders")
def compressed_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits scaled down, with floors."""
    c = P.scaled_config(F.col("o_orderkey") % 60, F.col("o_custkey") % 4000, F.col("o_orderkey") % 10 / 10.0, 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")


SUMMARISED = BASE + ", c AS (SELECT conv, pos, role, CASE WHEN pos % 3 = 1 THEN 'Summary of ' || content || ' in /opt/src/a.py' ELSE content END AS content FROM p)"


def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which each third one looks like a summary."""
    return messages(spark, sf_dir).withColumn("content", F.when(F.col("pos") % 3 == 1, F.concat(F.lit("Summary of "), "content", F.lit(" in /opt/src/a.py"))).otherwise(F.col("content")))


@query(SUMMARISED + ", n AS (SELECT conv, noise FROM (SELECT DISTINCT conv FROM c), LATERAL (SELECT string_agg(s, '' ORDER BY md5(s || conv || ':42')) AS noise FROM (SELECT s FROM (VALUES " + ", ".join("('" + s.replace("\n", "' || chr(10) || '") + "')" for s in P.NOISE) + f") v(s) ORDER BY md5(s || conv || ':42') LIMIT 2)) l), f AS (SELECT conv, min(pos) AS pos FROM c WHERE regexp_matches(content, '{P.NOISY}') GROUP BY conv) SELECT c.conv, c.pos, role, CASE WHEN f.pos IS NULL THEN content ELSE content || noise END AS content FROM c JOIN n USING (conv) LEFT JOIN f ON f.conv = c.conv AND f.pos = c.pos")
def summary_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.noisy_summary(summarised(spark, sf_dir))


@query(SUMMARISED + f" SELECT conv, pos, role, CASE WHEN regexp_matches(content, '{P.SUMMARY}') THEN regexp_replace(regexp_replace(regexp_replace(content, '{X.PATHS}', '<REDACTED_PATH>', 'g'), '{X.ERRORS}', '<REDACTED_ERROR>', 'g'), '{X.FUNCTIONS}', '<REDACTED_FUNC>', 'g') ELSE content END AS content FROM c")
def summary_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.redacted_summaries(summarised(spark, sf_dir))
